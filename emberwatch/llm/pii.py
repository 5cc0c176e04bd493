"""Personal data by patterns, and more of it by labelers whose reliability is estimated."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from emberwatch.session import stored

KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "iban")
BASE_KINDS = KINDS[:4]

#: Each pattern finds the same matches as its plain form, without going back over long runs: a
#: match can only begin where a run begins, or where the last match has ended (\G).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be personal as well. Candidates only: the labelers say which are. Of any length, but
#: for formats that set one themselves (IBAN, and the 127 parts of a host's name).
CANDIDATES = {
    "email": r"(?:\G|(?<![._%-]))[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++"
    r"(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]++){1,126}+",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?",
    "phone": r"(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}",
    "secret": r"[A-Za-z0-9]{20,}+",
}
_CANDIDATE = rf"(?<![A-Za-z0-9+])(?:{'|'.join(CANDIDATES.values())})(?![A-Za-z0-9])"
_BEFORE, _AFTER = 40, 2

#: Words of context and content that the gazetteers hold.
OWNERS = ("token", "secret", "password", "passwd", "pwd", "key", "auth", "bearer", "credential",
          "login", "pin", "account", "iban", "ssn", "social", "phone", "tel", "call", "mobile",
          "fax", "mail", "contact")
STRANGERS = ("sha", "sha1", "sha256", "md5", "commit", "checksum", "hash", "revision", "build",
             "version", "isbn", "issn", "doi", "uuid", "etag", "serial", "order", "ticket")


def _found(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)


_SPAN = "struct<kind:string,start:int,end:int>"


def _spans(kind: str, matches: Column, gaps: Column, valid: Callable[[Column], Column]) -> Column:
    """The valid matches with their places: each begins where the lengths before it end."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["g"])
        end = first + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), first.alias("start"), end.alias("end"))
        spans = F.when(valid(x["m"]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    pairs = F.zip_with(
        matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g"))
    )
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, ends in zero."""
    each = F.split(F.reverse(digits), "(?!^)(?=.)")
    values = F.transform(
        each,
        lambda d, i: F.when(i % 2 == 0, d.cast("int"))
        .when(d.cast("int") > 4, d.cast("int") * 2 - 9)
        .otherwise(d.cast("int") * 2),
    )
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    def between(match: Column, least: int, most: int) -> Column:
        return F.length(_digits(match)).between(least, most)

    def small(part: Column) -> Column:
        plain = F.ltrim(part, F.lit("0"))
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    return {
        "email": lambda m: F.lit(True),
        "ip": lambda m: F.forall(F.split(m, r"\."), small),
        "card": lambda m: F.when(between(m, 13, 19), _luhn(_digits(m))).otherwise(F.lit(False)),
        "phone": lambda m: between(m, 9, 15),
    }[kind]


# candidates, their votes and features

_CANDIDATE_TYPE = (
    "struct<kind:string,start:int,end:int,votes:array<int>,features:array<string>>"
)


def _kind_of(match: Column) -> Column:
    whole = [F.when(match.rlike(f"^(?:{p})$"), F.lit(kind)) for kind, p in CANDIDATES.items()]
    return F.coalesce(*whole, F.lit("secret"))


def _words(words: Sequence[str]) -> str:
    return rf"(?i)(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"


#: How far each labeler is believed at first, before its reliability is known.
TRUST = (1, 1, 3, 2, 2, 1)


def labelers(match: Column, kind: Column, before: Column, after: Column) -> list[Column]:
    """Votes on one candidate: 1 personal, 0 not, -1 no opinion."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, F.lit(1)).when(no, F.lit(0)).otherwise(F.lit(-1))

    digits = F.length(_digits(match))
    letters = F.length(match) - digits
    near = F.substring(before, -12, 12)
    none = F.lit(False)
    return [
        # regex: the strict shape of its kind
        vote(
            F.when(kind == "secret", match.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"))
            .otherwise(F.lit(True)),
            (kind == "secret") & ((digits < 3) | (letters < 3)),
        ),
        # gazetteer of owners, anywhere in the context
        vote(before.rlike(_words(OWNERS)), ~before.rlike("[A-Za-z]{3}")),
        # gazetteer of things that look alike
        vote(none, before.rlike(_words(STRANGERS))),
        # context: something is assigned or told
        vote(near.rlike("[=:][ \"']*$"), none),
        # context: in quotes or brackets of its own
        vote(near.rlike("[\"'(<]$") & after.rlike("^[\"')>]"), none),
        # regex: letters and digits mixed throughout, as in no word
        vote((kind != "secret") | ((digits > 0) & ~match.rlike("[A-Za-z]{7}")),
             match.rlike("^[A-Za-z]+[0-9]{0,2}$")),
    ]


def features(match: Column, kind: Column, before: Column, after: Column) -> list[Column]:
    """What the classifier sees of a candidate; each has a bounded number of values."""
    shape = F.regexp_replace(F.regexp_replace(match, "[0-9]+", "9"), "[A-Za-z]+", "a")
    near = F.regexp_replace(F.substring(before, -3, 3), "[A-Za-z0-9]", "a")
    return [
        F.concat(F.lit("kind "), kind),
        F.concat(F.lit("length "), F.least(F.floor(F.length(match) / 4), F.lit(16)).cast("string")),
        F.concat(F.lit("runs "), F.least(F.floor(F.length(shape) / 4), F.lit(8)).cast("string")),
        F.concat(F.lit("digits "), F.floor(F.length(_digits(match)) * 8 / F.length(match)).cast("string")),
        F.concat(F.lit("case "), match.rlike("[a-z]").cast("string"), match.rlike("[A-Z]").cast("string")),
        F.concat(F.lit("assigned "), near.rlike("[=:]").cast("string")),
        F.concat(F.lit("quoted "), near.rlike("[\"']$").cast("string"), after.rlike("^[\"']").cast("string")),
        F.concat(F.lit("owner "), before.rlike(_words(OWNERS)).cast("string")),
        F.concat(F.lit("stranger "), before.rlike(_words(STRANGERS)).cast("string")),
    ]


def _candidates(matches: Column, gaps: Column) -> Column:
    """Candidates with their places, votes and features; both columns are used by index."""
    empty = F.array().cast(f"array<{_CANDIDATE_TYPE}>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("found"))
    items = F.transform(
        matches,
        lambda m, i: F.struct(
            m.alias("m"),
            F.length(F.get(gaps, i)).alias("skip"),
            F.substring(F.get(gaps, i), -_BEFORE, _BEFORE).alias("before"),
            F.substring(F.get(gaps, i + 1), 1, _AFTER).alias("after"),
            _kind_of(m).alias("kind"),
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["skip"]
        end = first + F.length(x["m"])
        seen = (x["m"], x["kind"], x["before"], x["after"])
        one = F.struct(
            x["kind"].alias("kind"), first.alias("start"), end.alias("end"),
            F.array(*labelers(*seen)).alias("votes"), F.array(*features(*seen)).alias("features"),
        )
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    return F.aggregate(items, start, step, lambda acc: acc["found"])


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans of the patterns), candidates (what does not touch those)."""
    text = F.coalesce("text", F.lit(""))
    needs = {"email": "@", "phone": "+"}
    told = {}
    for kind, pattern in BASE.items():
        seen = F.when(F.contains(text, F.lit(needs[kind])), text) if kind in needs else text
        matches, gaps = _found(F.coalesce(seen, F.lit("")), pattern)
        told[kind] = _spans(kind, matches, gaps, _valid(kind))
    matches, gaps = _found(text, _CANDIDATE)
    looked = docs.select(
        "doc_id",
        F.concat(*told.values()).alias("base"),
        matches.alias("matches"),
        gaps.alias("gaps"),
    )
    base = F.col("base")
    apart = F.filter(
        _candidates(F.col("matches"), F.col("gaps")),
        lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
    )
    return looked.select("doc_id", "base", apart.alias("candidates"))


# reliabilities and the classifier


def estimate(patterns: list[Row], n_labelers: int, rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Probability of "personal" for each pattern of votes, by expectation-maximisation.

    Two unseen classes; a labeler has a rate of each of its three answers in each class, and
    answers by itself given the class. The number of patterns is at most 3 to the labelers, so
    the sums fit the driver whatever the corpus.
    """
    counts = [(tuple(row["votes"]), row["n"]) for row in patterns]

    def start(votes: tuple[int, ...]) -> float:
        trust = TRUST[:n_labelers] if n_labelers <= len(TRUST) else [1] * n_labelers
        said = [(v, t) for v, t in zip(votes, trust, strict=True) if v >= 0]
        return (sum(v * t for v, t in said) + 0.5) / (sum(t for _, t in said) + 1)

    belief = {votes: start(votes) for votes, _ in counts}
    for _ in range(rounds):
        weight = [1.0, 1.0]
        rate = [[[0.5, 0.5, 0.5] for _ in range(n_labelers)] for _ in range(2)]
        for votes, n in counts:
            for c, p in ((1, belief[votes]), (0, 1 - belief[votes])):
                weight[c] += n * p
                for labeler, vote in enumerate(votes):
                    rate[c][labeler][vote] += n * p
        new = {}
        for votes, _ in counts:
            odds = math.log(weight[1] / weight[0])
            for labeler, vote in enumerate(votes):
                odds += math.log(rate[1][labeler][vote] / sum(rate[1][labeler]))
                odds -= math.log(rate[0][labeler][vote] / sum(rate[0][labeler]))
            new[votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(new[v] - belief[v]) for v in belief), default=0.0)
        belief = new
        if moved < 1e-6:
            break
    return belief


def _lookup(values: dict, default: float) -> Callable[[Column], Column]:
    if not values:
        return lambda key: F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return lambda key: F.coalesce(F.try_element_at(table, key), F.lit(default))


def span_classifier(found: DataFrame) -> Callable[[Column], Column]:
    """Learn from all candidates; gives the test of one candidate, a column to a column.

    The labelers' votes give each candidate a probability; from these, naive Bayes over the
    features learns what personal spans look like, also where no labeler has an opinion.
    """
    each = found.select(F.explode("candidates").alias("c")).select("c.votes", "c.features")
    patterns = each.groupBy("votes").agg(F.count("*").alias("n")).collect()
    n_labelers = len(patterns[0]["votes"]) if patterns else 0
    belief = estimate(patterns, n_labelers)
    by_votes = _lookup({" ".join(map(str, v)): p for v, p in belief.items()}, 0.5)
    weighed = each.select(
        "features", by_votes(F.array_join(F.col("votes").cast("array<string>"), " ")).alias("p")
    )
    whole = weighed.agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).first()
    yes, no = (whole["yes"] or 0) + 1, (whole["no"] or 0) + 1
    sums = (
        weighed.select("p", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
        .collect()
    )
    odds = {r["feature"]: math.log((r["yes"] + 0.5) / yes) - math.log((r["no"] + 0.5) / no) for r in sums}
    weight = _lookup(odds, 0.0)
    prior = math.log(yes / no)
    return lambda c: F.aggregate(
        F.transform(c["features"], weight), F.lit(prior), lambda acc, x: acc + x
    ) > 0


def personal_spans(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, base, spans; arrays of (kind, start, end) in code points.

    Base spans are the matches of the patterns, leftmost and not overlapping within a kind, that
    pass the kind's test. `spans` has these and the candidates that the classifier takes, sorted
    by kind and start. A null or empty text has none; repeated rows each give a row; an empty
    table gives none, and a corpus without candidates adds none.
    """
    found = stored(find_spans(docs))
    personal = span_classifier(found)
    order = F.create_map(*[x for i, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(i))])

    def placed(spans: Column) -> Column:
        keyed = F.transform(spans, lambda s: F.struct(
            order[s["kind"]].alias("order"), s["start"].alias("start"),
            s["end"].alias("end"), s["kind"].alias("kind"),
        ))
        return F.transform(F.array_sort(keyed), lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")
        ))

    more = F.transform(F.filter("candidates", personal), lambda c: F.struct(
        c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")
    ))
    return found.select(
        "doc_id", placed(F.col("base")).alias("base"), placed(F.concat("base", more)).alias("spans")
    )


def _told(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return personal_spans(docs).select(
        "doc_id",
        *[
            F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS
        ],
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(F.col("spans")).alias("spans"),
    )
