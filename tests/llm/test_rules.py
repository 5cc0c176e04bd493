import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from emberwatch.llm.queries import QUERIES, SQL
from emberwatch.llm.rules import _op1_sql, choose_cutoffs, most_errors, quality_rules, text_statistics

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    w = "".join(" " if c in SPACE else c for c in text).split(" ")
    w = [x for x in w if x]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return sum(map(len, w)), symbols, len(w), len(lines), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, small, odd):
    odd_texts = ["a b c a b c", "a a a a", "x y x y x", "a\n\na\n a\na", "## $ <b>|\x0b&", "1 2 3 4 1 2 3 9 2 3 4"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd_texts)], "doc_id long, text string")
    for df in (small["documents"], odd, more):
        texts = sorted(map(repr, ((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect())))
        assert sorted(repr(tuple(r)) for r in text_statistics(df).collect()) == texts


def test_bounds_are_exact(spark):
    def slow(n, rate, level):
        total, k = 0.0, -1
        for j in range(n + 1):
            total += math.comb(n, j) * rate**j * (1 - rate) ** (n - j)
            if total > level:
                return k
            k = j
        return k

    for n, rate, level in [(10, 0.1, 0.05), (100, 0.05, 0.01), (900, 0.0125, 1e-4), (3000, 0.0125, 1e-3), (0, 0.1, 0.1)]:
        got = spark.range(1).select(most_errors(F.lit(n).cast("long"), rate, level).alias("k")).first().k
        assert got == (slow(n, rate, level) if n else -1)
    large = spark.range(1).select(most_errors(F.lit(2_000_000).cast("long"), 0.01, 1e-4).alias("k")).first().k
    assert 19_400 < large < 19_600


def test_risk_is_kept(spark):
    """The least cutoff that few enough good rows exceed; none where rows are too few."""
    rows = [("a", i / 1000) for i in range(1000)] + [("b", 0.0)] * 20
    chosen = choose_cutoffs(
        spark.createDataFrame(rows, "stratum string, rule double"), {"rule": (0.5, 0.96, 0.985, 0.999)}, 0.05, 0.05
    )
    assert {r.stratum: r.rule for r in chosen.collect()} == {"a": 0.985, "b": None}


def test_a_sequence_needs_no_share_for_each_cutoff(spark):
    """With no error at all a rule needs 1,000 good rows at rate 0.003 and doubt 0.05, however many cutoffs."""
    rows = spark.createDataFrame([("a", 0.0)] * 1000, "stratum string, rule double")
    cuts = tuple(i / 100 for i in range(1, 100))
    assert choose_cutoffs(rows, {"rule": cuts}, 0.003, 0.05).first().rule == 0.01
    assert choose_cutoffs(rows.limit(990), {"rule": cuts}, 0.003, 0.05).first().rule is None


def test_false_rejections_stay_limited(spark):
    """Of 200 holdouts, all from a rule value spread evenly, few choose a cutoff that loses over a tenth."""
    rows = spark.range(200 * 300).select(F.col("id") % 200, F.rand(7)).toDF("stratum", "rule")
    cuts = tuple(i / 100 for i in range(80, 100))
    one = [r.rule for r in choose_cutoffs(rows, {"rule": cuts}, 0.1, 0.05).collect()]
    assert not any(cut is not None and cut < 0.9 for cut in one)
    # With the whole doubt for each holdout alone, about one in twenty may be wrong.
    alone = [r.rule for r in choose_cutoffs(rows, {"rule": cuts}, 0.1, 0.05 * 200).collect()]
    assert sum(cut is not None and cut < 0.9 for cut in alone) <= 20 and any(cut == 0.95 for cut in alone)


def test_chosen_cutoffs_as_sql(spark):
    """At a risk that this many labels can bound, so that cutoffs are chosen and reject."""
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(_op1_sql(risk=0.4)).df()
    docs, marks = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules(docs, marks, risk=0.4).toPandas()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and (~got.kept & ~got.base_failed).sum() > 10
    assert sorted(map(tuple, got[names].astype(str).values)) == sorted(map(tuple, want[names].astype(str).values))


def test_odd_rows(odd, nothing, labels):
    got = quality_rules(odd, labels).collect()
    assert len(got) == odd.count() and {r.kept for r in got if r.doc_id == 1} == {False}
    assert quality_rules(nothing, labels).count() == 0
    assert quality_rules(odd, labels.limit(0)).count() == odd.count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{folder}/{table}'")
    got, want = QUERIES[name](spark, folder).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(tuple, got[names].astype(str).values)) == sorted(map(tuple, want[names].astype(str).values))
