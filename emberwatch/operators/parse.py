"""Turn raw messages into logs."""

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# (name, regular expression, one field name per group)
Pattern = tuple[str, str, Sequence[str]]


def parse_logs(
    df: DataFrame,
    schema: str,
    mode: str = "permissive",
    value: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Parse a JSON message into the columns of `schema`, after the `keep` columns.

    `permissive` gives nulls for a message that does not parse (a null event time later
    drops the row); `strict` fails the query on it.

    The struct is taken apart by a generator, below which no filter is pushed: a filter on
    a plain projection would parse every message a second time.
    """
    modes = {"permissive": "PERMISSIVE", "strict": "FAILFAST"}
    if mode not in modes:
        raise ValueError(f"mode must be 'permissive' or 'strict', not {mode!r}")
    parsed = F.from_json(F.col(value).cast("string"), schema, {"mode": modes[mode]})
    return df.select(*keep, F.inline(F.array(parsed)))


def _variant(text: Column) -> Column:
    """The one JSON value that `text` is, else null.

    The parser stops at the end of a value, whatever follows. So the value is taken from inside an
    object, and must parse inside an array as well: text that goes on after its value does not
    fit both. `NaN`, `Infinity` and `-Infinity` are numbers, as most writers of logs have it.
    """
    inside, listed = (F.concat(F.lit(a), text, F.lit(b)) for a, b in (('{"d":', "}"), ("[", "]")))
    strict = F.when(F.try_parse_json(listed).isNotNull(), F.try_parse_json(inside))
    odd = text.rlike(r"NaN|Infinity") & ~text.rlike(r"[:,\[]\s*(\+|-INF)")
    kind = T.VariantType()
    lenient = F.when(odd & F.from_json(listed, kind).isNotNull(), F.from_json(inside, kind))
    return F.variant_get(F.coalesce(strict, lenient), "$.d", "variant")


def read_documents(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds `text`, `doc` and `reason` to every message: the document, or why there is none.

    Reasons are `empty` (no value, or nothing but white space), `not UTF-8`, `quotes` (it would
    parse if its single quotes were left alone) and `not JSON`.
    """
    raw = F.try_validate_utf8(F.col(value).cast("string"))
    repaired = df.withColumn("text", F.translate(raw, "'", '"'))
    # by a generator, below which no filter is pushed: a message is parsed once
    parsed = repaired.select("*", F.explode(F.array(_variant(F.col("text")))).alias("doc"))
    blank = F.col(value).isNull() | (F.trim(F.coalesce("text", F.lit("x"))) == "")
    reason = (
        F.when(F.col("doc").isNotNull(), None)
        .when(blank, "empty")
        .when(F.col("text").isNull(), "not UTF-8")
        .when(F.contains("text", F.lit('"')) & _variant(raw).isNotNull(), "quotes")
        .otherwise("not JSON")
    )
    return parsed.withColumn("reason", reason)


def parse_documents(
    df: DataFrame, value: str = "value", observed: str | None = None
) -> DataFrame:
    """Parse any JSON message into a variant column `doc`; messages that do not parse go.

    The message must be valid UTF-8 and one JSON value. Single quotes are first made double
    quotes, which repairs `{'a': 1}` and breaks `{"a": "it's"}`; `text` is the repaired message. A
    key repeated inside one object has its last value, if the session sets
    `spark.sql.variant.allowDuplicateKeys` as `build_session` does; else the message counts
    as not parseable. `read_documents` tells why a message goes. Under the name
    `observed`, a streaming query's progress tells how many `messages` came and how many
    `documents` they gave.
    """
    text = F.try_validate_utf8(F.col(value).cast("string"))
    repaired = df.withColumn("text", F.translate(text, "'", '"'))
    # by a generator for the same reason as in parse_logs
    parsed = F.explode(F.array(_variant(F.col("text")))).alias("doc")
    documents = repaired.select("*", parsed)
    if observed:
        documents = documents.observe(
            observed, F.count("*").alias("messages"), F.count("doc").alias("documents")
        )
    return documents.filter(F.col("doc").isNotNull())


def required_text(pattern: str) -> str:
    """The longest text that every match of a regular expression holds; empty if none is sure.

    Only plain characters outside of groups are taken; whatever may be left out, or is one of
    several choices, parts them. A pattern with flags or quotes tells nothing.
    """
    runs, run, depth, i = [], "", 0, 0
    if re.search(r"\\Q|\(\?[a-zA-Z-]*[ix]", pattern):
        return ""
    while i < len(pattern):
        char, step, plain = pattern[i], 1, None
        if char == "\\":
            following = pattern[i + 1 : i + 2]
            step, plain = 2, (None if following.isalnum() else following)
            if following in "xucpPkN" and following:
                # what the escape goes on with is no text of its own
                rest = re.match(r"\\(x\{[0-9A-Fa-f]+\}|x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|c.|[pP]\{?[^}]*\}?|k<[^>]*>|N\{[^}]*\})", pattern[i:])
                step = len(rest[0]) if rest else 2
        elif char == "[":
            inner = 0
            end = i
            while end < len(pattern):
                if pattern[end] == "\\":
                    end += 1
                elif pattern[end] == "[":
                    inner += 1
                elif pattern[end] == "]" and end > i + 1 and pattern[i + 1 : end] != "^":
                    inner -= 1
                    if not inner:
                        break
                end += 1
            step = end + 1 - i
        elif char == "(":
            depth += 1
        elif char == ")":
            depth -= 1
        elif char == "|" and depth == 0:
            return ""
        elif char not in "^$.*+?{}|":
            plain = char
        if char == "{":
            step = max(pattern.find("}", i) + 1 - i, 1)
        after = pattern[i + step : i + step + 1]
        if plain is not None and depth == 0 and after not in ("*", "?", "{"):
            run += plain
            if after == "+":
                runs, run = [*runs, run], ""
        else:
            runs, run = [*runs, run], ""
        i += step
    return max([*runs, run], key=len)


def _one_of(texts: Sequence[str]) -> str:
    """A regular expression for the longest of some texts at a place, each character tried once."""
    heads: dict[str, list[str]] = {}
    for text in texts:
        if text:
            heads.setdefault(text[0], []).append(text[1:])
    branches = [re.escape(head) + _one_of(rest) for head, rest in sorted(heads.items())]
    if not branches:
        return ""
    whole = f"(?:{'|'.join(branches)})"
    return whole + "?" if "" in texts else whole


def pattern_candidates(line: Column, patterns: Sequence[Pattern]) -> Column:
    """Numbers of the patterns that may match a line: those whose required text is in it.

    All texts are looked for in one pass. At each place the longest one is found, and with it those
    it begins with; patterns without such a text are always candidates.
    """
    texts = [required_text(pattern) for _, pattern, _ in patterns]
    always = F.array(*[F.lit(i) for i, text in enumerate(texts) if not text]).cast("array<int>")
    known = sorted({text for text in texts if text})
    if not known:
        return always
    found = F.array_distinct(F.regexp_extract_all(line, F.lit(f"(?=({_one_of(known)}))"), F.lit(1)))
    by_text = F.create_map(*[
        part
        for text in known
        for part in (
            F.lit(text),
            F.array(*[F.lit(i) for i, own in enumerate(texts) if own and text.startswith(own)]),
        )
    ])
    return F.concat(always, F.flatten(F.transform(found, lambda text: F.element_at(by_text, text))))


#: Parts the groups of a match, and stands for a field that a pattern does not have.
_NEXT, _NONE = "\x01", "\x02"


def normalize_logs(
    df: DataFrame, patterns: Sequence[Pattern], value: str = "value", unmatched: bool = False
) -> DataFrame:
    """Give raw lines named fields; the first pattern that is found in the line wins.

    Adds `pattern` and one string column per field name. Lines no pattern fits are left
    out, or kept with nulls when `unmatched` is set. `as_envelope` makes messages of the
    result again. A line is matched only against the patterns whose required text it holds, and
    the groups of the one that wins are taken out together.
    """
    line = F.col(value).cast("string")
    names = list(dict.fromkeys(field for _, _, fields in patterns for field in fields))
    clash = [name for name in ("pattern", *names) if name in df.columns]

    def matched() -> Column:
        tests = [
            F.when(F.array_contains("_candidates", i) & line.rlike(pattern), F.lit(i))
            for i, (_, pattern, _) in enumerate(patterns)
        ]
        return F.coalesce(*tests)

    def groups(pattern: Pattern) -> Column:
        _, expression, fields = pattern
        own = [list(fields).index(name) + 1 if name in fields else None for name in names]
        one_by_one = F.array(*[
            F.lit(_NONE) if group is None else F.regexp_extract(line, expression, group) for group in own
        ])
        template = _NEXT.join(_NONE if group is None else f"${group}" for group in own)
        whole = F.regexp_replace(line, f"(?s)^.*?(?-s:{expression}).*$", template)
        return F.when(line.rlike(f"[{_NEXT}{_NONE}]"), one_by_one).otherwise(F.split(whole, _NEXT))

    if not patterns:
        raise ValueError("no patterns")
    looked = df.drop(*clash).select("*", F.explode(F.array(pattern_candidates(line, patterns))).alias("_candidates"))
    named = looked.select("*", F.explode(F.array(matched())).alias("_which")).drop("_candidates")
    if not unmatched:
        named = named.filter(F.col("_which").isNotNull())
    start = F.when(F.lit(False), F.lit(None).cast("array<string>"))
    parts = reduce(
        lambda chain, i: chain.when(F.col("_which") == i, groups(patterns[i])), range(len(patterns)), start
    )
    told = F.array(*[F.lit(name) for name, _, _ in patterns])
    taken = named.select("*", F.explode(F.array(parts)).alias("_parts")) if names else named
    return taken.withColumns(
        {"pattern": F.get(told, F.col("_which"))}
        | {name: F.nullif(F.get("_parts", F.lit(i)), F.lit(_NONE)) for i, name in enumerate(names)}
    ).drop("_which", "_parts")
