"""Search by terms, ranked search, merging of loads and the list of live loads."""

import datetime as dt
import json
import math
import random
import re
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emberwatch import delete_merged, index_logs, merge_loads, ranked_logs, read_index, search_logs, search_terms
from emberwatch.plans.search import _hits, _loads, _terms_table
from emberwatch.schemas import ENVELOPE
from emberwatch.streaming import index as index_module
from emberwatch.streaming.index import SEGMENT
from emberwatch.streaming.live import LiveList, Load

DAY = 86_400
START = 1718323200  # 2024-06-14


def message(offset, at, text):
    value = json.dumps({"timestamp": at, "username": f"u{offset % 5}", "line": text}, ensure_ascii=False)
    return (value.encode(), "logs", 0, offset, None)


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(9)
    vocabulary = [f"w{int(rng.paretovariate(0.8))}" for _ in range(400)] + ["Straße", "日本", "disk", "full"]
    told = [(n, START + n * 60, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12)))) for n in range(6000)]
    told[4321] = (4321, told[4321][1], "The DISK-is_full: error42 (Straße)")
    told[77] = (77, told[77][1], "error42 disk is fine")
    told[5000] = (5000, told[5000][1], "disk full is error42")
    return told


@pytest.fixture(scope="module")
def index(spark, lines, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    half = len(lines) // 2
    for name, part in (("one", lines[:half]), ("two", lines[half:])):
        df = spark.createDataFrame([message(*line) for line in part], ENVELOPE)
        index_logs(df, path, load=name, terms=True)
    return path


def offsets(df):
    return sorted(r.offset for r in df.collect())


def texts(lines):
    return {n: words_of(json.dumps({"timestamp": at, "username": f"u{n % 5}", "line": t}, ensure_ascii=False).replace("'", '"'))
            for n, at, t in lines}


CASES = [
    {"all_of": ["error42"]},
    {"all_of": ["error42", "disk"]},
    {"all_of": ["error42"], "none_of": ["fine"]},
    {"any_of": ["w1", "error42"], "none_of": ["w2", "w3"]},
    {"all_of": ["DISK"], "any_of": ["w3*", "straße"]},
    {"any_of": ["erro*"]},
    {"all_of": ["u3", "日本"]},
    {"none_of": ["w1"]},
    {"all_of": ["unheard"]},
    {"all_of": ["w1", "w1"], "any_of": ["unheard", "w2"]},
]


@pytest.mark.parametrize("case", CASES)
def test_terms_as_brute_force(spark, index, lines, case):
    def has(words, word):
        return any(w.startswith(word[:-1]) for w in words) if word.endswith("*") else word in words

    want = [
        n for n, words in texts(lines).items()
        if all(has(words, w.lower()) for w in case.get("all_of", []))
        and (not case.get("any_of") or any(has(words, w.lower()) for w in case["any_of"]))
        and not any(has(words, w.lower()) for w in case.get("none_of", []))
    ]
    assert offsets(search_terms(spark, index, **case)) == want


def test_phrases(spark, index):
    assert offsets(search_terms(spark, index, phrase="disk is FULL")) == [4321]
    assert offsets(search_terms(spark, index, phrase="error42 disk")) == [77]
    assert offsets(search_terms(spark, index, all_of=["error42"], phrase="disk full")) == [5000]
    assert offsets(search_terms(spark, index, phrase="full disk is")) == []


def test_times_prune_loads(spark, index, lines):
    since = dt.datetime(2024, 6, 16)
    want = [n for n, words in texts(lines).items() if "w1" in words and lines[n][1] >= START + 2 * DAY]
    assert offsets(search_terms(spark, index, all_of=["w1"], since=since)) == want
    assert offsets(search_terms(spark, index, all_of=["w1"], since=dt.datetime(2030, 1, 1))) == []
    assert {load.date for load in _loads(spark, index, since, None)} == {"2024-06-16", "2024-06-17", "2024-06-18"}


def rows_read(df):
    """Rows that the scans of documents gave, from the plan that ran."""
    df.collect()

    def scans(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            node = node.executedPlan()
        if node.nodeName().startswith("Scan") or "Scan parquet" in node.nodeName():
            yield node.metrics().apply("numOutputRows").value()
        children = node.children()
        for i in range(children.size()):
            yield from scans(children.apply(i))
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            yield from scans(node.plan())

    return sum(scans(df._jdf.queryExecution().executedPlan()))


def test_only_hit_pages_are_read(spark, tmp_path):
    """One word in one of many segments: the scan gives that segment's rows and no others."""
    rows = [message(n, START + n, f"filler number{n}") for n in range(20 * SEGMENT)]
    rows[7 * SEGMENT + 5] = message(7 * SEGMENT + 5, START + 7 * SEGMENT + 5, "needle")
    path = str(tmp_path / "index")
    index_logs(spark.createDataFrame(rows, ENVELOPE).coalesce(1), path, terms=True)
    found = search_terms(spark, path, all_of=["needle"])
    assert offsets(found) == [7 * SEGMENT + 5]
    assert rows_read(found) <= 2 * SEGMENT
    hits = _hits(_terms_table(spark, path, LiveList(spark, path).loads()), ["needle"], [])
    assert hits.count() == 1
    plan = hits._jdf.queryExecution().toString()
    assert "EqualTo(term,needle)" in plan


def bm25(words, asked, counts, total, average):
    score = 0.0
    for w in asked:
        if counts[w]:
            rare = math.log(1 + (total - counts[w] + 0.5) / (counts[w] + 0.5))
            often = words.count(w)
            score += rare * often * 2.2 / (often + 1.2 * (0.25 + 0.75 * len(words) / average))
    return round(score, 6)


@pytest.mark.parametrize("asked", [["w1", "w2", "error42"], ["disk", "日本"], ["unheard", "full"], ["unheard"]])
def test_ranked_as_brute_force(spark, index, lines, asked):
    held = texts(lines)
    counts = Counter(w for words in held.values() for w in set(words))
    average = sum(map(len, held.values())) / len(held)
    scored = [(-bm25(words, asked, counts, len(held), average), n) for n, words in held.items() if set(words) & set(asked)]
    got = ranked_logs(spark, index, asked, most=15)
    assert [(r.offset, r.score) for r in got.collect()] == [(n, pytest.approx(-s, abs=2e-6)) for s, n in sorted(scored)[:15]]


def test_ranked_logs_are_not_sorted_as_a_whole(spark, index):
    plan = ranked_logs(spark, index, ["w1"], most=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan
    got = ranked_logs(spark, index, ["disk"], phrase="disk full", most=100).collect()
    assert 5000 in {r.offset for r in got}


def test_words_must_be_words(spark, index):
    for bad in (["two words"], ["a*b"], [""], ["*"]):
        with pytest.raises(ValueError, match="not one word"):
            search_terms(spark, index, all_of=bad)


# loads


def load(spark, path, name, *numbers, terms=False):
    index_logs(spark.createDataFrame([message(n, START + n * 3600, f"line w{n}") for n in numbers], ENVELOPE), path, load=name, terms=terms)


def test_two_hundred_loads_become_few_files(spark, tmp_path):
    """Many small loads of two dates, put in place as micro-batches do, then merged."""
    path = str(tmp_path / "index")
    rows = index_module.documents(
        spark.createDataFrame([message(n, START + (n % 2) * DAY, f"line w{n}") for n in range(400)], ENVELOPE), {"username": "string"})
    # as 200 micro-batches leave it: one folder a load and date, all live
    rows = rows.withColumn("load", F.concat(F.lit("query-"), (F.col("offset") / 2).cast("int"))).withColumn("segment", F.lit(0).cast("long"))
    rows.repartition(1).write.partitionBy("log_date", "load").parquet(path)
    dates = ["2024-06-14", "2024-06-15"]
    live = LiveList(spark, path)
    for n in range(0, 200, 20):
        live.change([Load(date, f"query-{k}", 1, 5) for k in range(n, n + 20) for date in dates])
    before = sorted(map(str, search_logs(read_index(spark, path)).select("offset", "text").collect()))
    assert len(before) == 400
    merged = merge_loads(spark, path, terms=True)
    assert len(merged) == 2 and len(live.loads()) == 2
    after = read_index(spark, path)
    assert sorted(map(str, search_logs(after).select("offset", "text").collect())) == before
    assert all(len([f for f in after.inputFiles() if f"log_date={d}" in f]) < 10 for d in dates)
    assert offsets(search_terms(spark, path, all_of=["w123"])) == [123]
    assert delete_merged(spark, path) == 0  # readers may still be at it
    assert delete_merged(spark, path, older_than=-1) == 400
    assert sorted(map(str, search_logs(read_index(spark, path)).select("offset", "text").collect())) == before


def test_a_merge_killed_half_way_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    for n in range(4):
        load(spark, path, f"l{n}", n, n + 10)
    want = offsets(read_index(spark, path))

    def killed(*args):
        raise RuntimeError("killed")

    monkeypatch.setattr(index_module.LiveList, "change", killed)
    with pytest.raises(RuntimeError):
        merge_loads(spark, path)
    monkeypatch.undo()
    assert offsets(read_index(spark, path)) == want and len(LiveList(spark, path).loads()) == 4
    merge_loads(spark, path)
    assert offsets(read_index(spark, path)) == want and len(LiveList(spark, path).loads()) == 1


def test_a_reader_sees_each_record_once_whatever_is_merged(spark, tmp_path):
    path = str(tmp_path / "index")
    for n in range(3):
        load(spark, path, f"l{n}", n)
    begun = read_index(spark, path)
    merge_loads(spark, path)
    assert offsets(begun) == [0, 1, 2] == offsets(read_index(spark, path))


def test_a_replay_of_a_merged_load_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "index")
    load(spark, path, "query-0", 0, 1)
    load(spark, path, "query-1", 2)
    merge_loads(spark, path)
    load(spark, path, "query-1", 2)
    assert offsets(read_index(spark, path)) == [0, 1, 2]


def test_only_some_dates_and_enough_loads_are_merged(spark, tmp_path):
    path = str(tmp_path / "index")
    load(spark, path, "a", 0, 30)
    load(spark, path, "b", 1)
    assert merge_loads(spark, path, dates=["2024-06-15"]) == []
    assert merge_loads(spark, path, least=3) == []
    assert [m.date for m in merge_loads(spark, path)] == ["2024-06-14"]
    assert offsets(read_index(spark, path)) == [0, 1, 30]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "index")

    def add(n):
        LiveList(spark, path).change([Load("2024-06-14", f"l{n}")])

    threads = [threading.Thread(target=add, args=(n,)) for n in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    live = LiveList(spark, path)
    assert {x.load for x in live.loads()} == {f"l{n}" for n in range(8)}
    live.shorten()
    live.change(go=[Load("2024-06-14", "l3")])
    live.shorten()
    live.change([Load("2024-06-15", "new")])
    assert {x.load for x in live.loads()} == {*(f"l{n}" for n in range(8) if n != 3), "new"}


def test_a_stream_merges_as_it_goes(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "index")
    for n in range(5):
        spark.createDataFrame([message(n, START + n, f"line w{n}")], ENVELOPE).coalesce(1).write.mode("append").parquet(source)
    df = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 1).parquet(source)
    query = index_logs(df, path, str(tmp_path / "check"), trigger="available", terms=True, merge_every=2)
    query.awaitTermination(120)
    assert query.exception() is None
    assert offsets(read_index(spark, path)) == [0, 1, 2, 3, 4]
    assert len(LiveList(spark, path).loads()) == 2
    assert offsets(search_terms(spark, path, all_of=["w3"])) == [3]
    assert offsets(search_terms(spark, path, any_of=["w1", "w4"])) == [1, 4]


def test_nothing_indexed_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing is indexed"):
        read_index(spark, str(tmp_path))
    df = spark.createDataFrame([(b"broken", "logs", 0, 1, None)], ENVELOPE)
    index_logs(df, str(tmp_path), load="empty", terms=True)
    with pytest.raises(ValueError, match="nothing is indexed"):
        read_index(spark, str(tmp_path))
