"""Quality rules whose cutoffs keep the risk of a wrong rejection limited."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.text import SPACE
from emberwatch.session import stored

SYMBOLS = "#*$%&|<>"
_GAP = r"[\x20\x09-\x0D]+"

SHARES = (0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0)
#: A rule rejects a document if its value is above the rule's cutoff, one of these.
CUTOFFS: Mapping[str, Sequence[float]] = {
    "symbols": SHARES,  # symbols to characters in words
    "same_lines": SHARES[:-1],  # lines equal to an earlier one, of lines with a word
    "repeats": SHARES[:-1],  # words in repeated three-word windows, of all words
    "word_length": (6, 7, 8, 9, 10, 12, 15, 20, 30),  # characters in words to words
}


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def text_statistics(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the `keep` columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words of each text, a null being an empty one.

    `n_lines` counts lines with a word. All is computed within the row; each array is made in a
    projection of its own and used more than once in the next, which keeps Spark from computing
    it again for every element.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        "doc_id",
        *keep,
        F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.split(F.btrim(text, F.lit(SPACE)), _GAP).alias("words"),
    )
    told = [c for c in split.columns if c not in ("lines", "words")]
    words = F.col("words")
    # Three words are one window; its hash stands for it and its place comes along.
    windows = F.slice(
        F.transform(
            words,
            lambda word, i: F.struct(
                F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")
            ),
        ),
        1,
        F.greatest(F.size(words) - 2, F.lit(0)),
    )
    counted = split.select(
        *told,
        F.when(F.col("word_chars") > 0, F.size(words)).otherwise(0).cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("sorted"),
    )
    told = [c for c in counted.columns if c != "sorted"]
    ordered = F.col("sorted")
    twice = F.filter(
        ordered,
        lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]),
    )
    found = counted.select(*told, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("starts"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate(
        "starts",
        start,
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    return found.select(*told, covered.alias("n_repeat_words"))


def _rules() -> dict[str, Column]:
    def share(of: str, whole: str) -> Column:
        return F.coalesce(F.col(of) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))

    return {
        "symbols": share("n_symbols", "word_chars"),
        "same_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
    }


def most_errors(n: Column, rate: float, level: float) -> Column:
    """The largest k with P(Binomial(n, rate) <= k) <= level, -1 if there is none.

    With k errors or fewer among n the exact (Clopper-Pearson) upper bound of the error rate at
    that level is `rate` at most. Terms are summed as logarithms, so none vanishes.
    """
    step = math.log(rate / (1 - rate))
    term = n * F.lit(math.log1p(-rate))
    start = F.struct(
        term.alias("term"),
        term.alias("sum"),
        F.when(term <= math.log(level), F.lit(0)).otherwise(-1).cast("long").alias("k"),
    )

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + step
        both = F.greatest(acc["sum"], term) + F.log1p(F.exp(-F.abs(acc["sum"] - term)))
        k = F.when(both <= math.log(level), j).otherwise(acc["k"])
        return F.struct(term.alias("term"), both.alias("sum"), k.alias("k"))

    upto = F.least(n, F.greatest(F.ceil(n * rate), F.lit(1)))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), upto), start, add, lambda acc: acc["k"])


def choose_cutoffs(
    holdout: DataFrame, cutoffs: Mapping[str, Sequence[float]], risk: float, doubt: float
) -> DataFrame:
    """Per stratum and rule the least cutoff that may be used: (stratum, <rule> ...), or null.

    `holdout` has `stratum` and a column for each rule, a row for each good document. With
    probability 1 - `doubt`, over all strata at once, no stratum loses more than `risk` of its
    good documents by all rules together. Each rule has an equal share of the risk and each
    (stratum, rule) an equal share of the doubt; its cutoffs are tested in a fixed sequence from
    the loosest on, each at that whole share, up to the first one that fails. Counts only grow
    along that sequence, so the last cutoff that passes is the least one that does.
    """
    counts = stored(
        holdout.groupBy("stratum").agg(
            F.count("*").alias("n"),
            *[
                F.count_if(F.col(rule) > cut).alias(f"{rule}_{i}")
                for rule, cuts in cutoffs.items()
                for i, cut in enumerate(cuts)
            ],
        )
    )
    sequences = max(counts.count(), 1) * len(cutoffs)
    allowed = most_errors(F.col("n"), risk / len(cutoffs), doubt / sequences)
    counts = counts.withColumn("allowed", allowed)
    return counts.select(
        "stratum",
        *[
            F.coalesce(
                *[
                    F.when(F.col(f"{rule}_{i}") <= F.col("allowed"), F.lit(float(cut)))
                    for i, cut in enumerate(cuts)
                ]
            ).alias(rule)
            for rule, cuts in cutoffs.items()
        ],
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    least_words: int = 50,
    most_repeats: float = 0.5,
    risk: float = 0.05,
    doubt: float = 0.05,
) -> DataFrame:
    """Per row of `docs`: doc_id, the counts of its text, base_failed, kept.

    A text fails the base with fewer than `least_words` words or more than `most_repeats` of its
    words in repeated windows. Each rule then rejects above a cutoff chosen for the document's
    stratum from `labels` (doc_id, quality): good documents (quality 1) that pass the base are
    the holdout. A stratum with too few labels for a guarantee has no cutoffs and rejects
    nothing; null is a stratum of its own. A null or empty text has no words. Labels without a
    document or a quality count for nothing. Repeated rows each give a row; an empty table gives
    none.
    """
    counted = stored(text_statistics(docs.withColumn("_stratum", F.col(stratum)), ["_stratum"]))
    failed = (F.col("n_words") < least_words) | (
        F.col("n_repeat_words") > most_repeats * F.col("n_words")
    )
    valued = counted.select("*", failed.alias("base_failed"), *[
        value.alias(f"_{rule}") for rule, value in _rules().items()
    ])
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
    holdout = valued.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_good"))
    chosen = stored(
        choose_cutoffs(
            holdout.select(
                F.col("_stratum").alias("stratum"),
                *[F.col(f"_{rule}").alias(rule) for rule in CUTOFFS],
            ),
            CUTOFFS, risk, doubt,
        )
    )
    judged = valued.join(chosen, valued["_stratum"].eqNullSafe(chosen["stratum"]), "left")
    above = [F.coalesce(F.col(f"_{rule}") > F.col(rule), F.lit(False)) for rule in CUTOFFS]
    rejected = F.lit(False)
    for one in above:
        rejected = rejected | one
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"),
    )


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs.select("doc_id", "text", "lang"), labels)


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP1_BASE_SQL = f"""
    WITH d AS (
        SELECT doc_id, lang, coalesce(text, '') AS text, {_W} AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)),
                           lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
        FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS p
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
    ), twice AS (
        SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, p) > 1
    ), repeated AS (
        SELECT doc_id, count(DISTINCT i + k) AS n
        FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM twice) GROUP BY doc_id
    ), base AS (
        SELECT doc_id, lang, len(w) AS n_words,
               coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
               len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
               coalesce(n, 0) AS n_repeat_words
        FROM d LEFT JOIN repeated USING (doc_id)
    ), judged AS (
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbols,
               CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS same_lines,
               CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats,
               CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length
        FROM base
    )"""


def _op1_sql(risk: float = 0.05, doubt: float = 0.05) -> str:
    """The cutoffs in SQL: binomial sums from log-gamma terms."""
    rate = risk / len(CUTOFFS)
    grid = ", ".join(f"('{r}', {float(c)})" for r, cuts in CUTOFFS.items() for c in cuts)
    values = " ".join(f"WHEN '{rule}' THEN {rule}" for rule in CUTOFFS)
    reject = " OR ".join(
        f"coalesce({rule} > (SELECT cut FROM chosen c WHERE c.rule = '{rule}' AND c.lang = j.lang),"
        " FALSE)"
        for rule in CUTOFFS
    )
    return OP1_BASE_SQL + f""", good AS (
        SELECT * FROM judged WHERE NOT base_failed
        AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    ), grid(rule, cut) AS (VALUES {grid}
    ), counts AS (
        SELECT lang, rule, cut, count(*) AS n,
               count(*) FILTER (WHERE CASE rule {values} END > cut) AS k
        FROM good, grid GROUP BY ALL
    ), tested AS (
        SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
                                  + j * ln({rate}) + (n - j) * ln(1 - {rate})))
                   FROM (SELECT unnest(range(0, k + 1)) AS j)) AS p
        FROM counts
    ), chosen AS (
        SELECT lang, rule, min(cut) AS cut FROM tested
        WHERE p <= {doubt} / (SELECT count(DISTINCT (lang, rule)) FROM counts) GROUP BY ALL
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT ({reject}) AS kept
    FROM judged j"""


OP1_SQL = _op1_sql()
