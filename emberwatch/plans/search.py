"""Search the index of logs, and count what was found."""

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.text import terms_of
from emberwatch.streaming.index import ID, read_loads
from emberwatch.streaming.live import NO_DATE, LiveList, Load

#: Hits that are told to the scan one by one; where more segments hold a word, they are joined.
TOLD = 2_000

#: The usual constants of the ranking.
K1, B = 1.2, 0.75


def _loads(
    spark: SparkSession, path: str, since: dt.datetime | None, until: dt.datetime | None
) -> list[Load]:
    """The live loads that may hold logs in [since, until); logs without a time lie in no range."""
    first = None if since is None else str(_in_utc(since).date())
    last = None if until is None else str(_in_utc(until).date())
    return [
        load
        for load in LiveList(spark, path).loads()
        if (since is None and until is None)
        or (load.date != NO_DATE and (first is None or load.date >= first) and (last is None or load.date <= last))
    ]


def read_index(
    spark: SparkSession,
    path: str,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
) -> DataFrame:
    """The live loads of the index, of the dates in [since, until] only if given.

    What is read is settled here: a merge that ends later neither hides nor repeats a row.
    """
    loads = _loads(spark, path, since, until) or LiveList(spark, path).loads()
    if not loads:
        raise ValueError(f"nothing is indexed at {path!r}")
    return read_loads(spark, path, loads)


def _field(index: DataFrame, name: str) -> Column:
    if name in index.columns:
        return F.col(name).cast("string")
    return F.try_variant_get("doc", f"$.{name}", "string")


def _in_utc(when: dt.datetime) -> dt.datetime:
    return (when if when.tzinfo else when.replace(tzinfo=dt.UTC)).astimezone(dt.UTC)


def search_logs(
    index: DataFrame,
    term: str | None = None,
    fields: Mapping[str, str] | None = None,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
) -> DataFrame:
    """Logs that contain `term`, have all the given field values and lie in [since, until).

    The time range also picks the date partitions; times without a zone are UTC. A record
    indexed more than once is given once; only what was found is shuffled for that.
    """
    found = index
    date, time = F.col("log_date"), F.col("log_time")
    if since is not None:
        start = _in_utc(since)
        found = found.filter((date >= F.lit(start.date())) & (time >= F.lit(start)))
    if until is not None:
        end = _in_utc(until)
        found = found.filter((date <= F.lit(end.date())) & (time < F.lit(end)))
    for name, value in (fields or {}).items():
        own = name in index.columns
        found = found.filter(F.col(name) == value if own else _field(index, name) == str(value))
    if term is not None:
        found = found.filter(F.col("text").contains(term))
    return found.dropDuplicates(ID)


def _matches(terms: Column, all_of: Sequence[str], any_of: Sequence[str], none_of: Sequence[str]) -> Column:
    """Whether the words of a row meet a search; a word may end in `*`."""

    def has(word: str) -> Column:
        if word.endswith("*"):
            return F.exists(terms, lambda term: term.startswith(word[:-1]))
        return F.array_contains(terms, word)

    wanted = [has(word) for word in all_of]
    if any_of:
        wanted.append(reduce(or_, [has(word) for word in any_of]))
    wanted += [~has(word) for word in none_of]
    return reduce(and_, wanted, F.lit(True))


def _words(words: Sequence[str]) -> list[str]:
    """Words as the index has them; one that is not a single word, with or without `*`, is an error."""
    told = [word.lower() for word in words]
    for word in told:
        if not word.removesuffix("*").isalnum():
            raise ValueError(f"{word!r} is not one word")
    return told


def _entry(word: str) -> Column:
    return F.col("term").startswith(word[:-1]) if word.endswith("*") else F.col("term") == word


def _terms_table(spark: SparkSession, path: str, loads: Sequence[Load]) -> DataFrame:
    return read_loads(spark, f"{path}/_terms", loads)


def _hits(
    terms: DataFrame, all_of: Sequence[str], any_of: Sequence[str]
) -> DataFrame:
    """(log_date, load, segment) of the stretches of rows that may hold what is looked for.

    Only the entries of the asked words are read. Words that a log must not have tell nothing
    about the others of its stretch.
    """
    asked = [*[(word,) for word in all_of], *([tuple(any_of)] if any_of else [])]
    entries = terms.filter(reduce(or_, [_entry(word) for group in asked for word in group]))
    of = F.array_compact(F.array(*[
        F.when(reduce(or_, [_entry(word) for word in group]), F.lit(i)) for i, group in enumerate(asked)
    ]))
    parts = entries.select("log_date", "load", "segments", F.explode(of).alias("part"))
    each = parts.select("log_date", "load", "part", F.explode("segments").alias("segment"))
    held = each.groupBy("log_date", "load", "segment").agg(F.count_distinct("part").alias("parts"))
    return held.filter(F.col("parts") == len(asked)).select("log_date", "load", "segment")


def _rows_of(spark: SparkSession, path: str, loads: Sequence[Load], hits: DataFrame) -> DataFrame:
    """The rows of the hit segments.

    A few hits are told to the scan, which then reads only their pages. Where a word is in so many
    segments that there is little to leave out, they are joined.
    """
    told = hits.limit(TOLD + 1).collect()
    rows = read_loads(spark, path, loads)
    if not told:
        return rows.filter(F.lit(False))
    if len(told) > TOLD:
        same = (rows["load"] == hits["load"]) & (rows["segment"] == hits["segment"])
        return rows.join(hits, same & rows["log_date"].eqNullSafe(hits["log_date"]), "left_semi")
    by_folder: dict[tuple, list[int]] = {}
    for hit in told:
        by_folder.setdefault((hit.log_date, hit.load), []).append(hit.segment)
    found = None
    # loads with the same segments are read together, so that the scans stay few
    alike: dict[tuple[int, ...], list[Load]] = {}
    for (date, name), segments in by_folder.items():
        load = Load(str(date) if date else NO_DATE, name)
        alike.setdefault(tuple(sorted(segments)), []).append(load)
    if len(alike) > 50:
        segments = sorted({hit.segment for hit in told})
        alike = {tuple(segments): [load for own in alike.values() for load in own]}
    for segments, own in alike.items():
        part = read_loads(spark, path, own).filter(_in_stretches(segments))
        found = part if found is None else found.unionByName(part)
    return found


def _in_stretches(segments: Sequence[int]) -> Column:
    """A test on `segment` that Parquet can use: one stretch for each run of numbers."""
    stretches: list[list[int]] = []
    for segment in segments:
        if stretches and segment == stretches[-1][1] + 1:
            stretches[-1][1] = segment
        else:
            stretches.append([segment, segment])
    return reduce(or_, [
        F.col("segment") == a if a == b else F.col("segment").between(a, b) for a, b in stretches
    ])


def search_terms(
    spark: SparkSession,
    path: str,
    all_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    phrase: str | None = None,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
) -> DataFrame:
    """Logs by their words: all of some, any of some, none of some, and a phrase.

    Words are runs of letters and digits, in any case; one that ends in `*` stands for all that
    begin so. A phrase is words that follow each other. The index must be written with `terms`:
    the terms' entries tell which stretches of rows to read, before any document is. A record
    indexed more than once is given once. Times are as in `search_logs`.
    """
    all_of, any_of, none_of = _words(all_of), _words(any_of), _words(none_of)
    wanted = _phrase(phrase)
    must = [*all_of, *wanted]
    loads = _loads(spark, path, since, until)
    if not loads:
        return read_index(spark, path).filter(F.lit(False))
    if must or any_of:
        rows = _rows_of(spark, path, loads, _hits(_terms_table(spark, path, loads), must, any_of))
    else:
        rows = read_loads(spark, path, loads)
    terms = F.col("_terms")
    test = _matches(terms, must, any_of, none_of)
    if wanted:
        test = test & _phrase_in(terms, wanted)
    found = _with_terms(rows).filter(test).drop("_terms")
    return search_logs(found, since=since, until=until)


def _phrase(phrase: str | None) -> list[str]:
    """The words of a phrase, cut as those of a log are."""
    return re.findall(r"[^\W_]+", phrase.lower()) if phrase else []


def _phrase_in(terms: Column, words: Sequence[str]) -> Column:
    """Whether the words follow each other; no word holds a space, so a text of them tells."""
    whole = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    return F.contains(whole, F.lit(f" {' '.join(words)} "))


def _with_terms(rows: DataFrame) -> DataFrame:
    """Adds `_terms`, by a generator: a plain column would be made anew wherever it is used."""
    return rows.select("*", F.explode(F.array(terms_of("text"))).alias("_terms"))


def _count(terms: str, word: str) -> Column:
    return F.size(F.filter(terms, lambda term: term == word))


def ranked_logs(
    spark: SparkSession,
    path: str,
    words: Sequence[str],
    most: int = 10,
    phrase: str | None = None,
    since: dt.datetime | None = None,
    until: dt.datetime | None = None,
) -> DataFrame:
    """The `most` logs that fit some words best, by BM25, with their `score`.

    How rare a word is and how long logs are on average comes from the index' own counts, of the
    dates searched; only stretches of rows with one of the words are read. With a `phrase`, logs
    must hold it. Scores are rounded to six decimals, equal ones ranked by topic, partition and
    offset. Each partition keeps its best, which are merged; nothing is sorted as a whole.
    """
    asked = list(dict.fromkeys(_words(words)))
    loads = _loads(spark, path, since, until)
    found = search_terms(spark, path, any_of=asked, phrase=phrase, since=since, until=until)
    counts = {}
    if loads:
        entries = _terms_table(spark, path, loads).filter(reduce(or_, [_entry(w) for w in asked]))
        counts = {r.term: r.n for r in entries.groupBy("term").agg(F.sum("rows").alias("n")).collect()}
    rows, total = sum(load.rows for load in loads), sum(load.terms for load in loads)
    average = total / rows if rows else 1.0
    length = F.size("_terms")
    score = F.lit(0.0)
    for word in asked:
        if not counts.get(word):
            continue
        rare = F.log(F.lit(1 + (rows - counts[word] + 0.5) / (counts[word] + 0.5)))
        often = _count("_terms", word)
        score = score + rare * often * (K1 + 1) / (often + K1 * (1 - B + B * length / F.lit(average)))
    scored = _with_terms(found).withColumn("score", F.round(score, 6)).drop("_terms")
    return scored.orderBy(F.desc("score"), *ID).limit(most)


def log_counts(found: DataFrame, every: str = "1 hour", by: Sequence[str] = ()) -> DataFrame:
    """How many logs there are per stretch of time, and per value of the `by` fields."""
    return (
        found.groupBy(
            F.window("log_time", every).start.alias("since"),
            *[_field(found, name).alias(name) for name in by],
        )
        .agg(F.count("*").alias("count"))
    )
