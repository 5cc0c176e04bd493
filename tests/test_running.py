import datetime as dt
import json
import os
import signal
import threading
import time

import pytest
from conftest import BASE

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from emberwatch import (
    Rule,
    alert_log,
    apply_rules,
    burst_alert,
    event_time,
    file_logs,
    format_alert,
    index_logs,
    kafka_logs,
    keyword_alert,
    latest_alerts,
    log_counts,
    notify_per_batch,
    parse_logs,
    print_alerts,
    read_alerts,
    read_index,
    run_alerts,
    run_rules,
    run_with_retry,
    search_logs,
    search_terms,
)
from emberwatch.__main__ import arguments, run_all, starters
from emberwatch.schemas import ENVELOPE, LOGIN_LOG, USER_LOG


def test_one_notice_per_batch_with_a_hit(feed, tmp_path):
    told = []
    stream = keyword_alert(feed(["a threat", "threats"], ["ok"], ["threat"], ["THREAT"]))
    query = run_alerts(
        stream, str(tmp_path / "c"), sink=notify_per_batch(told.append), mode="append", trigger="available"
    )
    query.awaitTermination(60)
    assert told == ["Alert fired"] * 2


def test_alert_log_keeps_the_last_value(spark, feed, tmp_path):
    batches = [[{"timestamp": BASE + s, "username": "a"}] * 3 for s in range(3)]
    alerts = burst_alert(event_time(parse_logs(feed(*batches), USER_LOG)))
    path = str(tmp_path / "alerts")
    query = run_alerts(alerts, str(tmp_path / "c"), sink=alert_log(path), trigger="available")
    query.awaitTermination(60)
    last = latest_alerts(spark, path, ["username", "window_start", "window_end"])
    assert [r["count"] for r in last.collect()] == [9]
    assert read_alerts(spark, path).count() == 3
    # a query that starts over with a new checkpoint adds to the log
    again = run_alerts(alerts, str(tmp_path / "d"), sink=alert_log(path), trigger="available")
    again.awaitTermination(60)
    assert read_alerts(spark, path).count() == 6
    assert latest_alerts(spark, path, ["username", "window_start", "window_end"]).collect() == last.collect()
    assert set(read_alerts(spark, path).columns) == set(last.columns)


def test_every_alert_is_printed(feed, tmp_path):
    """More than a console shows of a micro-batch, and cells longer than it shows."""
    told = []
    name = "n" * 60
    source = feed([{"timestamp": BASE, "username": f"{name}{i // 3}"} for i in range(90)])
    alerts = burst_alert(event_time(parse_logs(source, USER_LOG)))
    run_alerts(alerts, str(tmp_path / "c"), print_alerts(told.append), trigger="available").awaitTermination(60)
    assert {json.loads(line)["username"] for line in told} == {f"{name}{i}" for i in range(30)}
    told.clear()
    lines = alerts.withColumn("alert", format_alert(2, "10 minutes"))
    run_alerts(lines, str(tmp_path / "d"), print_alerts(told.append), trigger="available").awaitTermination(60)
    assert len(told) == 30 and all(line.startswith("Alert fired; user=n") for line in told)


def test_interrupt_ends_a_pause():
    """Other threads wait to start again when the main one is interrupted."""
    began = time.monotonic()

    def fails():
        raise RuntimeError("no broker")

    def interrupted():
        time.sleep(0.3)
        os.kill(os.getpid(), signal.SIGINT)
        raise RuntimeError("no broker")

    run_all({"a": fails, "b": interrupted}, lambda: None, pause=60)
    assert time.monotonic() - began < 20


def test_one_that_gives_up_is_told_at_once():
    began = time.monotonic()
    stopped = threading.Event()

    class Running:
        isActive = True

        def awaitTermination(self):
            stopped.wait(60)

        def stop(self):
            stopped.set()

    with pytest.raises(ZeroDivisionError):
        run_all({"runs": Running, "fails": lambda: 1 / 0}, stopped.set, restarts=0)
    assert time.monotonic() - began < 20


def test_times_of_any_unit_are_indexed(spark, tmp_path):
    """Seconds, milliseconds, times before 1970 and text; a repeated key has its last value."""
    values = [
        '{"timestamp": 1718381400}', '{"timestamp": 1718381400123}', '{"timestamp": -86400}',
        '{"timestamp": "2024-06-14T16:10:00Z"}', '{"timestamp": 1, "timestamp": 1718381400}',
    ]
    rows = [(v.encode(), "logs", 0, i, None) for i, v in enumerate(values)]
    index_logs(spark.createDataFrame(rows, ENVELOPE), str(tmp_path / "index"))
    index = read_index(spark, str(tmp_path / "index"))
    times = {r.offset: r.us for r in index.select("offset", F.unix_micros("log_time").alias("us")).collect()}
    base = BASE * 10**6
    assert times == {0: base, 1: base + 123_000, 2: -86400 * 10**6, 3: base, 4: base}
    assert search_logs(index, since=dt.datetime(2020, 1, 1)).count() == 4


def records(*offsets, partition=0):
    return [
        (
            json.dumps({"timestamp": BASE + o, "username": f"u{o % 3}", "nested": {"n": o}}).encode(),
            "logs",
            partition,
            o,
            None,
        )
        for o in offsets
    ]


def write(spark, folder, rows):
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return file_logs(spark, folder, ENVELOPE, max_files=1)


def offsets(df):
    return sorted(r.offset for r in df.collect())


def test_index_restart_and_replay(spark, tmp_path):
    source, index, checkpoint = (str(tmp_path / name) for name in ("in", "index", "check"))

    def run(where=checkpoint):
        index_logs(stream(spark, source), index, where, trigger="available").awaitTermination(60)

    write(spark, source, records(0, 1, 2))
    run()
    write(spark, source, records(3, 4))
    run()
    assert offsets(read_index(spark, index)) == [0, 1, 2, 3, 4]
    # the last micro-batch is done again, as after a crash before it was committed
    (tmp_path / "check" / "commits" / "1").unlink()
    (tmp_path / "check" / "commits" / ".1.crc").unlink(missing_ok=True)
    run()
    assert offsets(read_index(spark, index)) == [0, 1, 2, 3, 4]
    # a new checkpoint reads all again; a search gives each record once
    run(str(tmp_path / "other"))
    assert len(offsets(read_index(spark, index))) == 10
    assert offsets(search_logs(read_index(spark, index))) == [0, 1, 2, 3, 4]


def test_index_counts_what_it_skips(spark, tmp_path):
    source = str(tmp_path / "in")
    broken = [(b"broken", "logs", 0, 9, None), (None, "logs", 0, 10, None)]
    write(spark, source, records(0, 1, 2) + broken)
    query = index_logs(stream(spark, source), str(tmp_path / "i"), str(tmp_path / "c"), trigger="available")
    query.awaitTermination(60)
    [seen] = [p["observedMetrics"]["index"] for p in query.recentProgress if p["numInputRows"]]
    assert (seen["messages"], seen["documents"]) == (5, 3)


def test_index_of_a_table_is_repeatable_by_name(spark, tmp_path):
    index = str(tmp_path / "index")
    df = spark.createDataFrame(records(0, 1, 1), ENVELOPE)
    for _ in range(2):
        index_logs(df, index, load="first")
    index_logs(spark.createDataFrame(records(2), ENVELOPE), index, load="second")
    assert offsets(read_index(spark, index)) == [0, 1, 1, 2]
    assert offsets(search_logs(read_index(spark, index))) == [0, 1, 2]


def test_index_times_of_all_kinds(spark, tmp_path):
    index = str(tmp_path / "index")
    times = [BASE, BASE + 0.5, "2024-06-14 16:10:00", 1e17, -5, "soon", None]
    values = [
        (json.dumps({"timestamp": t, "username": "a"}).encode(), "logs", 0, i, None)
        for i, t in enumerate(times)
    ]
    index_logs(spark.createDataFrame(values, ENVELOPE), index)
    rows = {r.offset: r.log_time for r in read_index(spark, index).collect()}
    base = dt.datetime(2024, 6, 14, 16, 10)
    assert [rows[i] for i in range(3)] == [base, base + dt.timedelta(seconds=0.5), base]
    assert rows[4] == dt.datetime(1969, 12, 31, 23, 59, 55)  # before 1970, and not dropped
    assert len(rows) == 7 and [rows[i] for i in (3, 5, 6)] == [None] * 3


@pytest.mark.parametrize("zone", ["Asia/Kathmandu", "America/New_York"])
def test_index_and_search_in_any_session_zone(spark, tmp_path, zone):
    index = str(tmp_path / "index")
    df = spark.createDataFrame(records(*range(0, 200_000, 1_000)), ENVELOPE)
    since, until = dt.datetime(2024, 6, 15), dt.datetime(2024, 6, 15, 23)
    start = int((since - dt.datetime(2024, 6, 14, 16, 10)).total_seconds())
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        index_logs(df, index)
        found = offsets(search_logs(read_index(spark, index), since=since, until=until))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == [o for o in range(0, 200_000, 1_000) if start <= o < start + 23 * 3_600]


def test_search_and_counts(spark, tmp_path):
    index = str(tmp_path / "index")
    index_logs(spark.createDataFrame(records(*range(0, 200_000, 1_000)), ENVELOPE), index)
    found = read_index(spark, index)
    assert offsets(search_logs(found, term='"N": 5000')) == []
    assert offsets(search_logs(found, term='"n": 5000}')) == [5000]
    assert offsets(search_logs(found, fields={"username": "u1", "nested.n": 7000})) == [7000]
    since = dt.datetime(2024, 6, 15)
    until = dt.datetime(2024, 6, 15, 0, 30)
    inside = search_logs(found, since=since, until=until)
    start = int((since - dt.datetime(2024, 6, 14, 16, 10)).total_seconds())
    assert offsets(inside) == [o for o in range(0, 200_000, 1_000) if start <= o < start + 1800]
    counts = log_counts(found, "1 day", ["username"]).collect()
    assert sum(r["count"] for r in counts) == 200
    assert {r.username for r in counts} == {"u0", "u1", "u2"}


def test_search_prunes_partitions(spark, tmp_path):
    index = str(tmp_path / "index")
    index_logs(spark.createDataFrame(records(0, 90_000, 180_000), ENVELOPE), index)
    found = search_logs(read_index(spark, index), since=dt.datetime(2024, 6, 15), until=dt.datetime(2024, 6, 16))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(log_date" in plan
    assert "GreaterThanOrEqual(log_time" in plan


def test_retry_goes_on_from_the_checkpoint(spark, feed, tmp_path):
    seen, starts = [], []
    source = feed(["one"], ["two"], ["three"])

    def sink(batch, number):
        if number == 1 and len(starts) < 3:
            raise RuntimeError("sink is down")
        seen.extend(r.value for r in batch.collect())

    def start():
        starts.append(1)
        return run_alerts(source, str(tmp_path / "c"), sink=sink, mode="append", trigger="available")

    assert run_with_retry(start, pause=0) == 2
    assert seen == ["one", "two", "three"]
    starts.clear()
    with pytest.raises(ZeroDivisionError):
        run_with_retry(lambda: 1 / 0, pause=0, restarts=1)


RULES = [
    Rule("many", "burst", {"threshold": 2}),
    Rule("close", "span_burst", {"threshold": 1}),
]


def test_rules_on_tables_and_streams(spark, feed, tmp_path):
    values = [{"timestamp": BASE + s, "username": "a"} for s in (0, 1, 2)]
    values.append({"timestamp": BASE + 90_000, "username": "z"})
    df = event_time(spark.createDataFrame([(v["timestamp"], v["username"]) for v in values], USER_LOG))
    rows = [(r.rule, json.loads(r.alert)["count"]) for r in apply_rules(df, RULES).collect()]
    assert sorted(rows) == [("close", 2), ("many", 3)]

    got = {}
    queries = run_rules(
        event_time(parse_logs(feed(values), USER_LOG)),
        RULES,
        str(tmp_path / "checks"),
        sink=lambda rule: lambda batch, n: got.setdefault(rule.name, []).extend(batch.collect()),
        trigger="available",
    )
    for query in queries.values():
        query.awaitTermination(60)
    assert {name: [r["count"] for r in rows] for name, rows in got.items()} == {"many": [3], "close": [2]}
    assert (tmp_path / "checks" / "many").is_dir() and (tmp_path / "checks" / "close").is_dir()


def test_command_line_jobs(feed, tmp_path, monkeypatch):
    """Each job, with a file stream in the place of the topic."""
    rules = tmp_path / "rules.json"
    rules.write_text(
        json.dumps(
            [
                {"name": "many", "kind": "burst"},
                {"name": "bad word", "kind": "keyword", "params": {"word": "denied"}},
            ]
        )
    )
    lines = [
        {"timestamp": BASE + s, "username": "a", "action": "denied", "login_action": "failed"}
        for s in range(5)
    ]
    line = (
        'Alert fired; user=a, window="2024-06-14 16:10:00 to 2024-06-14 16:20:00", '
        "count=6, threshold=2, timerange=10 minutes"
    )
    lines.append({"timestamp": BASE + 5, "username": "a", "action": "accessed", "login_action": "success"})
    source = feed(lines)
    got = []

    def collected(alerts, checkpoint, sink="console", **settings):
        settings = {k: v for k, v in settings.items() if k in ("mode", "trigger", "name")}
        return run_alerts(alerts, checkpoint, lambda batch, n: got.extend(batch.collect()), **settings)

    monkeypatch.setattr("emberwatch.__main__.run_alerts", collected)
    monkeypatch.setattr("emberwatch.plans.rules.run_alerts", collected)
    for job, columns, expected in [
        ("burst", ["alert"], [line]),
        ("login", ["failed_count", "success_count"], [(5, 1)]),
        ("keyword", [], []),
        ("sliding-burst", ["count"], [6] * 10),
        ("access", ["alert"], ["ALERT: User a accessed after 5 denials"]),
        ("rules", [], None),
    ]:
        got.clear()
        told = [job, "--servers", "none", "--checkpoint", str(tmp_path / job), "--trigger", "available"]
        for start in starters(arguments([*told, "--rules", str(rules)]), lambda: source).values():
            assert run_with_retry(start, restarts=0) == 0
        if job == "rules":
            assert sorted(len(row) for row in got) == [1] * 5 + [4]
        else:
            values = [tuple(row[c] for c in columns) for row in got]
            assert values == [v if isinstance(v, tuple) else (v,) for v in expected]
    given = ["--servers", "x", "--checkpoint", "y"]
    for wrong in (["index"], ["burst", "--sink", "table"], ["rules", "--rules", "r", "--unit", "auto"]):
        with pytest.raises(SystemExit):
            arguments([wrong[0], *given, *wrong[1:]])


def test_a_rule_set_and_an_index_by_command(spark, feed, tmp_path):
    (tmp_path / "rules").mkdir()
    rule = {"name": "many", "kind": "burst", "params": {"threshold": 2}}
    (tmp_path / "rules" / "first.json").write_text(json.dumps(rule) + "\n")
    source = feed([{"timestamp": BASE + s, "username": "a", "action": "x"} for s in range(4)] + ["broken"])
    told = ["rule-set", "--servers", "x", "--checkpoint", str(tmp_path / "c"), "--trigger", "available"]
    told += ["--rules", str(tmp_path / "rules"), "--sink", "table", "--output", str(tmp_path / "out")]
    [start] = starters(arguments(told), lambda: source).values()
    assert run_with_retry(start, restarts=0) == 0
    [row] = read_alerts(spark, str(tmp_path / "out")).collect()
    assert (row.rule, row.username, json.loads(row.alert)["count"]) == ("many", "a", 4)
    envelope = source.selectExpr(
        "CAST(value AS BINARY) AS value", "'logs' AS topic", "0 AS partition", "CAST(get_json_object(value, '$.timestamp') AS LONG) AS offset")
    told = ["index", "--servers", "x", "--checkpoint", str(tmp_path / "i"), "--trigger", "available", "--terms"]
    told += ["--table", str(tmp_path / "index"), "--rejects", str(tmp_path / "gone"), "--merge-every", "2"]
    [start] = starters(arguments(told), lambda: envelope).values()
    assert run_with_retry(start, restarts=0) == 0
    assert search_terms(spark, str(tmp_path / "index"), all_of=["x"]).count() == 4
    assert [r.reason for r in spark.read.parquet(str(tmp_path / "gone")).collect()] == ["not JSON"]


def test_normalize_gives_messages(spark, feed, tmp_path):
    file = tmp_path / "patterns.json"
    file.write_text(json.dumps([
        {"name": "login", "pattern": r"^(\w+) logged in from (\S+)", "fields": ["username", "host"]},
        {"name": "plain", "pattern": r"^user=(\w+)", "fields": ["username"]},
    ]))
    source = feed(["ann logged in from h1", "nothing"], ["user=bob", "user=cy"])
    told = ["normalize", "--servers", "x", "--checkpoint", str(tmp_path / "c"), "--patterns", str(file)]
    told += ["--sink", "table", "--output", str(tmp_path / "out"), "--trigger", "available"]
    [start] = starters(arguments(told), lambda: source).values()
    assert run_with_retry(start, restarts=0) == 0
    rows = sorted(map(tuple, read_alerts(spark, str(tmp_path / "out")).collect()))
    assert rows == [("login", "ann", "h1"), ("plain", "bob", None), ("plain", "cy", None)]


def test_rules_with_layouts_of_their_own(spark, feed, tmp_path):
    """All kinds from one topic, whose messages have several layouts, into tables."""
    second = [{"timestamp": BASE + s, "username": "a"} for s in range(6)]
    rules = [
        {"name": "many/of one", "kind": "burst"},
        {"name": "slide", "kind": "sliding_burst"},
        {"name": "word", "kind": "keyword", "params": {"word": "failed"}},
        {"name": "login", "kind": "followed_by_window", "schema": LOGIN_LOG},
        {"name": "span", "kind": "span_burst", "unit": "ms"},
        {"name": "access", "kind": "followed_by_span", "unit": "ms", "params": {"threshold": 2}},
    ]
    file = tmp_path / "rules.json"
    file.write_text(json.dumps(rules))
    lines = second + [{"timestamp": 10**12, "username": "end"}]
    lines += [{"timestamp": BASE + s, "username": "b", "login_action": "failed"} for s in range(5)]
    lines += [{"timestamp": BASE + 9, "username": "b", "login_action": "success"}]
    lines += [{"timestamp": BASE * 1000 + s, "username": "c", "action": "denied"} for s in range(3)]
    lines += [{"timestamp": BASE * 1000 + 5, "username": "c", "action": "accessed"}]
    source = feed(lines)
    told = ["rules", "--servers", "x", "--checkpoint", str(tmp_path / "c"), "--rules", str(file)]
    told += ["--sink", "table", "--output", str(tmp_path / "out"), "--trigger", "available"]
    for start in starters(arguments(told), lambda: source).values():
        assert run_with_retry(start, restarts=0) == 0
    found = {p.name: read_alerts(spark, str(p)) for p in (tmp_path / "out").iterdir()}
    assert set(found) == {"many%2Fof one", "slide", "word", "login", "span", "access"}
    assert {r.username for r in found["many%2Fof one"].select("username").collect()} >= {"a", "b"}
    assert [(r.username, r.failed_count) for r in found["login"].select("username", "failed_count").collect()] == [("b", 5)]
    assert found["word"].count() == 5
    assert [(r.username, r.denied_count) for r in found["access"].select("username", "denied_count").collect()] == [("c", 3)]
    assert {r.username for r in found["span"].select("username").collect()} >= {"a", "b"}


def test_wrong_rules():
    with pytest.raises(ValueError):
        Rule("x", "unknown")
    with pytest.raises(ValueError):
        run_rules(None, [RULES[0], RULES[0]], "nowhere")


def test_a_table_does_not_start_at_the_latest_record(spark):
    with pytest.raises(ValueError):
        kafka_logs(spark, "localhost:1", start="latest", stream=False)


def test_kafka_needs_its_package(spark):
    for streaming in (True, False):
        with pytest.raises(AnalysisException, match="kafka"):
            kafka_logs(spark, "localhost:1", start="earliest", stream=streaming, max_per_trigger=10)


def test_console(feed, tmp_path):
    alerts = burst_alert(event_time(parse_logs(feed([{"timestamp": BASE, "username": "a"}] * 3), USER_LOG)))
    query = run_alerts(alerts, str(tmp_path / "c"), trigger="available", name="shown")
    query.awaitTermination(60)
    assert query.name == "shown" and query.exception() is None
