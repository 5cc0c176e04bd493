import math
import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from emberwatch import (
    as_envelope,
    index_logs,
    keyword_alert,
    normalize_logs,
    parse_documents,
    parse_logs,
    read_documents,
    read_index,
)
from emberwatch.functions.timeparts import micros
from emberwatch.operators.parse import pattern_candidates, required_text
from emberwatch.schemas import ENVELOPE, USER_LOG


def test_strict_fails_on_a_broken_message(spark):
    df = spark.createDataFrame([('{"timestamp": 1, "username": "a"}',), ("{broken",)], "value string")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        parse_logs(df, USER_LOG, mode="strict").collect()
    with pytest.raises(ValueError):
        parse_logs(df, USER_LOG, mode="loose")


def test_permissive_gives_nulls_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, b'{"timestamp": 5, "x": 1}'), (2, b"{broken"), (3, None)], "id long, value binary")
    rows = parse_logs(df, USER_LOG, keep=["id"]).collect()
    assert [tuple(r) for r in rows] == [(1, 5, None), (2, None, None), (3, None, None)]


DOCUMENTS = {
    b'{"timestamp": 1718381882, "username": "a"}': True,
    b"{'timestamp': 1718381882, 'username': 'a'}": True,
    b'{"username": "it\'s"}': False,
    b"garbage": False,
    b"": False,
    None: False,
    b'{"a": 1, "extra": {"b": [1]}}': True,
    b"\xff\xfe{}": False,
    b"42": True,
    b"[1,2]": True,
    b"null": True,
    b' {"a": 1}\n': True,
    b'{"a": 1} {"b": 2}': False,
    b'{"a": 1},': False,
    b'{"a": 1}}': False,
    b"1] [2": False,
    b"1, 2": False,
    b'1, "e": 2': False,
    b'{"a": NaN, "b": [Infinity, -Infinity]}': True,
    b"NaN": True,
    b'{"a": NaN} x': False,
    b'{"a": nan}': False,
    b'{"a": +Infinity}': False,
    b'{"a": "NaN", "b": }': False,
    b'{"a": "NaN, Infinity"}': True,
}

REASONS = {
    b'{"a": 1}': None,
    None: "empty",
    b"": "empty",
    b"  ": "empty",
    b"\xff{}": "not UTF-8",
    b'{"a": "it\'s"}': "quotes",
    b"{'a': 'b": "not JSON",
    b"garbage": "not JSON",
    b'{"a": 1} {"b": 2}': "not JSON",
}


def test_reasons(spark):
    df = spark.createDataFrame(list(enumerate(REASONS)), "id int, value binary")
    told = {r.id: r.reason for r in read_documents(df).select("id", "reason").collect()}
    assert told == dict(enumerate(REASONS.values()))


def test_odd_numbers_are_kept(spark):
    df = spark.createDataFrame([(b'{"a": NaN, "b": -Infinity}',)], "value binary")
    row = parse_documents(df).selectExpr(
        "variant_get(doc, '$.a', 'double') a", "variant_get(doc, '$.b', 'double') b").first()
    assert math.isnan(row.a) and row.b == -math.inf


def test_rejects_and_documents_come_from_one_parse(spark, tmp_path):
    df = spark.createDataFrame([(v, "logs", 0, i, None) for i, v in enumerate(REASONS)], ENVELOPE)
    index_logs(df, f"{tmp_path}/index", load="one", rejects=f"{tmp_path}/rejects")
    index_logs(df, f"{tmp_path}/index", load="one", rejects=f"{tmp_path}/rejects")  # again, as in a replay
    gone = spark.read.parquet(f"{tmp_path}/rejects").collect()
    assert {(r.offset, r.reason) for r in gone} == {(i, r) for i, r in enumerate(REASONS.values()) if r}
    assert len(gone) == len(REASONS) - 1
    assert [r.offset for r in read_index(spark, f"{tmp_path}/index").collect()] == [0]


def test_a_streams_rejects(spark, feed, tmp_path):
    values = ['{"timestamp": 1}', "garbage", "{'timestamp': 2}"]
    stream = feed(values).selectExpr("CAST(value AS BINARY) AS value", "'logs' AS topic", "0 AS partition", "CAST(length(value) AS LONG) AS offset")
    query = index_logs(stream, f"{tmp_path}/index", f"{tmp_path}/check", trigger="available", rejects=f"{tmp_path}/rejects")
    query.awaitTermination(60)
    assert query.exception() is None
    assert [(r.value, r.reason) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()] == [(b"garbage", "not JSON")]
    assert read_index(spark, f"{tmp_path}/index").count() == 2
    plan = read_documents(spark.createDataFrame([(b"1",)], "value binary"))._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Generate") == 1


def test_documents(spark):
    values = list(DOCUMENTS)
    df = spark.createDataFrame(list(enumerate(values)), "id int, value binary")
    parsed = parse_documents(df).select("id", F.to_json("doc").alias("doc")).collect()
    assert {values[r.id] for r in parsed} == {v for v, good in DOCUMENTS.items() if good}
    assert [r.doc for r in parsed if r.id == 6] == ['{"a":1,"extra":{"b":[1]}}']


def test_keyword(spark):
    texts = ["a threat here", "threats", "fine", "THREAT", None]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert [r.value for r in keyword_alert(df).collect()] == texts[:2]
    binary = df.select(F.col("value").cast("binary").alias("value"))
    assert [r.value for r in keyword_alert(binary).collect()] == texts[:2]


PATTERNS = [
    ("failed", r"Failed login for (\w+) from ([\d.]+)", ("username", "address")),
    ("login", r"login for (\w+)", ("username",)),
    ("disk", r"disk (\d+)% full", ("percent",)),
]


def test_normalize_first_match_wins(spark):
    lines = [
        "Jan 1 Failed login for bob from 10.0.0.1",
        "Jan 1 login for eve",
        "disk 93% full",
        "nothing known",
        None,
    ]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    rows = [tuple(r)[1:] for r in normalize_logs(df, PATTERNS, unmatched=True).collect()]
    assert rows == [
        ("failed", "bob", "10.0.0.1", None),
        ("login", "eve", None, None),
        ("disk", None, None, "93"),
        (None, None, None, None),
        (None, None, None, None),
    ]
    named = normalize_logs(df, PATTERNS)
    assert named.count() == 3
    messages = as_envelope(named, ["pattern", "username"]).select(F.col("value").cast("string"))
    assert messages.first()[0] == '{"pattern":"failed","username":"bob"}'


def test_durations():
    assert micros("10 minutes") == 600_000_000
    assert micros("1 day 6 hours") == 30 * 3_600_000_000
    assert micros("1 Week") == 7 * micros("1 day")
    for wrong in ("1 month", "ten minutes", "10", "", "5 minutes or so"):
        with pytest.raises(ValueError):
            micros(wrong)


def test_long_properties_of_views_are_read_whole(spark, tmp_path):
    props = '{"k": 7, "more": "' + "x" * 200 + '"}'
    events = spark.read.parquet(f"{SF}/events.parquet").limit(3)
    events = events.withColumn("event_type", F.lit("view")).withColumn("props", F.lit(props))
    events.write.parquet(f"{tmp_path}/events.parquet")
    rows = spark_entry.parse_documents(spark, str(tmp_path)).collect()
    assert [r.k for r in rows] == [7, 7, 7] and all("x" * 200 in r.text for r in rows)


@pytest.mark.parametrize(("pattern", "text"), [
    (r"Failed login for (\w+) from ([\d.]+)", "Failed login for "),
    (r"disk (\d+)% full", "% full"),
    (r"^https?://([^/]+)/", "http"),
    (r"colou?r", "colo"),
    (r"ab+c", "ab"),
    (r"(foo|bar) baz", " baz"),
    (r"one|two", ""),
    (r"(?i)error", ""),
    (r"a{2}bc", "bc"),
    (r"\[warn\] x", "[warn] x"),
    (r"[]a]xyz[^]]q", "xyz"),
    (r"\Qa.b\E", ""),
    (r"\x41bc\p{L}de", "bc"),
    (r"(a(b)c)?long text", "long text"),
    (r"\d+\s*", ""),
])
def test_text_that_a_match_must_hold(pattern, text):
    assert required_text(pattern) == text


def many_patterns(rng, n):
    words = ["disk", "disk full", "login", "log", "in for", "error", "err", "user", "er u", "failed", "timeout", "full"]
    told = []
    for i in range(n):
        a, b = rng.choice(words), rng.choice(words)
        told.append(rng.choice([
            (f"p{i}", rf"{a} (\w+) {b}{i % 7}", ("x",)),
            (f"p{i}", rf"{a}{i}=(\d+)(?: of (\d+))?", ("x", "y")),
            (f"p{i}", rf"^{a}.*{b}(\d)$", ("z",)),
            (f"p{i}", rf"(?i){a}-{i}", ()),
            (f"p{i}", rf"(?:{a}|{b}) code {i}", ()),
        ]))
    return words, told


def test_three_hundred_patterns_as_one_after_the_other(spark):
    rng = random.Random(11)
    words, patterns = many_patterns(rng, 300)
    lines = []
    for _ in range(600):
        i = rng.randrange(300)
        a, b = rng.choice(words), rng.choice(words)
        lines.append(rng.choice([
            f"x {a} word {b}{i % 7} y", f"{a}{i}={i}", f"{a}{i}=4 of 5 more", f"{a} and {b}{i % 10}",
            f"{a.upper()}-{i}", f"{b} code {i}", "nothing", "", f"{a}\x01{i}=7\x02 {a}{i}=3", f"{a} one {b}1\n{a}{i}=9",
        ]))
    df = spark.createDataFrame(list(enumerate([*lines, None])), "id int, value string")
    got = {r.id: r for r in normalize_logs(df, patterns, unmatched=True).collect()}
    for i, line in enumerate(lines):
        for name, pattern, fields in patterns:
            found = re.search(pattern, line)
            if found:
                want = {f: found[k + 1] or "" for k, f in enumerate(fields)}
                break
        else:
            name, want = None, {}
        row = got[i]
        assert (row.pattern, row.x, row.y, row.z) == (name, want.get("x"), want.get("y"), want.get("z")), line
    assert got[len(lines)].pattern is None
    tried = df.filter("value IS NOT NULL").select(F.size(pattern_candidates(F.col("value"), patterns)).alias("n"))
    sure = sum(not required_text(p) for _, p, _ in patterns)
    mean = tried.agg(F.avg("n")).first()[0]
    assert sure <= mean < 120  # of 300; patterns with flags are tried always


def test_each_candidate_holds_its_text(spark):
    patterns = [("a", "disk full", ()), ("b", "disk", ()), ("c", "k fu", ()), ("d", "fullness", ()), ("e", "(x)?", ())]
    df = spark.createDataFrame([("a disk full of",), ("disks",), ("fullness",), ("",)], "value string")
    told = [sorted(r.c) for r in df.select(pattern_candidates(F.col("value"), patterns).alias("c")).collect()]
    assert told == [[0, 1, 2, 4], [1, 4], [3, 4], [4]]
