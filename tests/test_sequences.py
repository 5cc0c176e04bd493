import random

import pytest
from conftest import BASE
from pyspark.sql import functions as F

from emberwatch import (
    cleared_sequences,
    event_time,
    followed_by_span,
    format_denial_alert,
    parse_logs,
    run_alerts,
    waiting_sequences,
)
from emberwatch.schemas import ACCESS_LOG

WORDS = {"D": "denied", "A": "accessed", "O": "other"}


def steps(text, user="a"):
    """`D0 A3` as logs."""
    return [
        {"timestamp": (BASE + int(s[1:])) * 1000, "username": user, "action": WORDS[s[0]]}
        for s in text.split()
    ]


CASES = {
    "a": (["D0 D1 D2 A3"], False, [("a", 3, 3)]),
    "b": (["D0 D1 A2"], False, []),
    "c": (["D0 D1 D2 A61"], False, []),
    "d": (["D0 D1 D2 A60"], False, [("a", 60, 3)]),
    "e": (["D0 A10 D20 D30 D65 A70"], False, []),
    "e cancel": (["D0 A10 D20 D30 D65 A70"], True, [("a", 70, 3)]),
    "f": (["D0 D1 D2 A3 A4"], False, [("a", 3, 3)]),
    "g": (["D0 D30 D59 D61 A62"], False, []),
    "h": (["A3 D0 D1 D2"], False, [("a", 3, 3)]),
    "i": (["D0 O1 D2 D3 A4"], False, [("a", 4, 3)]),
    "j": (["D0 D1 D2 A3", "D0 D1 A2"], False, [("a", 3, 3)]),
}


def shape(rows):
    return sorted((r.username, int(r.accessed_at.timestamp()) - BASE, r.denied_count) for r in rows)


@pytest.mark.parametrize("case", CASES)
def test_cases(spark, feed, drain, case):
    texts, cancel, expected = CASES[case]
    values = [v for user, text in zip("ab", texts) for v in steps(text, user)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v["timestamp"], v["username"], v["action"]) for v in values], ACCESS_LOG)
    table = followed_by_span(event_time(df, unit="ms"), cancel_timers=cancel)
    assert shape(table.collect()) == expected
    parsed = event_time(parse_logs(feed(values), ACCESS_LOG, mode="strict"), unit="ms")
    got, _ = drain(followed_by_span(parsed, cancel_timers=cancel))
    assert shape([r for b in got for r in b]) == expected


def test_line(spark):
    df = event_time(
        spark.createDataFrame([tuple(v.values()) for v in steps("D0 D1 D2 A3")], ACCESS_LOG), unit="ms"
    )
    line = followed_by_span(df).select(format_denial_alert().alias("line")).first().line
    assert line == "ALERT: User a accessed after 3 denials"


def machine(rows, span, threshold, cancel):
    """One user's (time, order, action), one after the other."""
    n, waiting, timers, found = 0, False, [], []
    for t, _, action in sorted(rows):
        if any(end < t for end in timers):
            n, waiting = 0, False
            timers = [end for end in timers if end >= t]
        if action == "denied":
            n += 1
            if not waiting:
                waiting = True
                timers.append(t + span)
        elif action == "accessed":
            if n >= threshold:
                found.append((t, n))
            n, waiting = 0, False
            if cancel:
                timers = []
    return found


def random_logs(seed):
    rng = random.Random(seed)
    density = rng.choice([300, 1_500, 6_000])
    weights = rng.choice([(8, 1, 1), (3, 1, 1), (30, 1, 0)])
    return [
        (
            i,
            rng.choice(["hot", "hot", "b", None]),
            rng.randrange(-density, density),
            rng.choices(["denied", "accessed", "other"], weights)[0],
        )
        for i in range(700)
    ]


@pytest.mark.parametrize("cancel", [False, True])
@pytest.mark.parametrize("seed", range(6))
def test_against_state_machine(spark, seed, cancel):
    logs = random_logs(seed)
    df = spark.createDataFrame(logs, "id long, username string, timestamp long, action string")
    alerts = followed_by_span(event_time(df), "20 seconds", 2, cancel_timers=cancel, order="id")
    got = sorted(
        (str(r.username), int(r.accessed_at.timestamp()), r.denied_count) for r in alerts.collect()
    )
    expected = [
        (str(user), t, n)
        for user in ("hot", "b", None)
        for t, n in machine([(t, i, a) for i, u, t, a in logs if u == user], 20, 2, cancel)
    ]
    assert got == sorted(expected)


def test_logs_of_one_time_without_an_order(spark, feed, drain):
    rng = random.Random(5)
    logs = [
        ((BASE + rng.randrange(400)) * 1000, rng.choice(["u", "v"]), rng.choice(["denied"] * 4 + ["accessed"]))
        for _ in range(1_500)
    ]
    table = followed_by_span(event_time(spark.createDataFrame(logs, ACCESS_LOG), unit="ms"), "20 seconds")
    expected = sorted(
        (user, t // 1000 - BASE, n)
        for user in "uv"
        for t, n in machine(
            [(t, a == "accessed", a) for t, u, a in logs if u == user], 20_000, 3, False
        )
    )
    assert shape(table.collect()) == expected and expected
    names = ("timestamp", "username", "action")
    stream = event_time(parse_logs(feed([dict(zip(names, v)) for v in logs]), ACCESS_LOG), unit="ms")
    got, _ = drain(followed_by_span(stream, "20 seconds"))
    assert shape([r for b in got for r in b]) == expected


@pytest.mark.parametrize("period", [1, 7])
def test_a_chain_without_any_gap(spark, period):
    # one denial every period for many chunks: each opener follows from the one before
    span = 20
    logs = [(i, "u", i * period, "denied") for i in range(4_000)]
    logs += [(10_000 + k, "u", k, "accessed") for k in range(3_900, 3_990, 13)]
    df = spark.createDataFrame(logs, "id long, username string, timestamp long, action string")
    alerts = followed_by_span(event_time(df), f"{span} seconds", 2, order="id")
    got = sorted((int(r.accessed_at.timestamp()), r.denied_count) for r in alerts.collect())
    assert got == machine([(t, i, a) for i, _, t, a in logs], span, 2, False)
    assert got


def test_stream_in_order_equals_table(spark, feed, drain):
    rng = random.Random(3)
    values = sorted(
        ((BASE + s) * 1000, rng.choice("abc"), rng.choice(["denied", "denied", "accessed"]))
        for s in rng.sample(range(3_000), 600)
    )
    names = ("timestamp", "username", "action")
    batches = [[dict(zip(names, v)) for v in values[i : i + 90]] for i in range(0, 600, 90)]
    parsed = event_time(parse_logs(feed(*batches), ACCESS_LOG), unit="ms")
    got, _ = drain(followed_by_span(parsed))
    table = followed_by_span(event_time(spark.createDataFrame(values, ACCESS_LOG), unit="ms"))
    stream = shape([r for b in got for r in b])
    assert stream == shape(table.collect())
    assert stream


def test_state_is_freed(feed, drain):
    parsed = event_time(
        parse_logs(feed(steps("D0 D1"), steps("O500", "z"), steps("O900", "z")), ACCESS_LOG), unit="ms"
    )
    _, query = drain(followed_by_span(parsed))
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


def test_what_waits_is_read_back(spark, feed, drain, tmp_path):
    """After each micro-batch: who has a timer, and who has none any more."""
    batches = [
        steps("D0 D1") + steps("D0", "b") + steps("D5", None),
        steps("A50") + steps("D55", "b"),
        steps("O500", "z"),
        steps("O900", "z"),
    ]
    checkpoint = str(tmp_path / "kept")
    parsed = event_time(parse_logs(feed(*batches), ACCESS_LOG), unit="ms")
    drain(followed_by_span(parsed), checkpoint=checkpoint)

    def told(df):
        rows = [(r.username, r.denied_count, [int(t.timestamp()) - BASE for t in r.timers]) for r in df.collect()]
        return sorted(rows, key=str)

    assert told(waiting_sequences(spark, checkpoint, batch=0)) == [("a", 2, [60]), ("b", 1, [60]), (None, 1, [65])]
    # the access has read the count, its timer still runs
    assert told(waiting_sequences(spark, checkpoint, batch=1)) == [("a", 0, [60]), ("b", 2, [60]), (None, 1, [65])]
    at = F.timestamp_seconds(F.lit(BASE + 61))
    assert told(waiting_sequences(spark, checkpoint, at, batch=1)) == [(None, 1, [65])]
    assert told(waiting_sequences(spark, checkpoint)) == []
    last = max(int(p.stem) for p in (tmp_path / "kept" / "commits").glob("[0-9]*"))
    assert [r[0] for r in told(cleared_sequences(spark, checkpoint, 1, last))] == ["a", "b", None]
    assert told(cleared_sequences(spark, checkpoint, 0, 1)) == []


def test_order_of_one_micro_batch_for_many_rows(feed, drain):
    # 25,000 rows of one user, the access first in the file and last in time
    values = steps("A50") + [v for s in range(24_999) for v in steps(f"D{s % 50}")]
    got, _ = drain(followed_by_span(event_time(parse_logs(feed(values), ACCESS_LOG), unit="ms")))
    assert shape([r for b in got for r in b]) == [("a", 50, 24_999)]


def test_restart_keeps_counts(feed, drain, tmp_path):
    checkpoint = str(tmp_path / "kept")
    seen = []
    for text in ("D0 D1", "D2", "A50"):
        parsed = event_time(parse_logs(feed(steps(text)), ACCESS_LOG), unit="ms")
        got, _ = drain(followed_by_span(parsed), checkpoint=checkpoint)
        seen += shape([r for b in got for r in b])
    assert seen == [("a", 50, 3)]


@pytest.mark.parametrize("buckets", [1, 5])
def test_logs_without_a_user_on_a_stream(feed, drain, buckets):
    batches = [steps("D0 D1", None) + steps("D0"), steps("D2 A3", None) + steps("A3")]
    parsed = event_time(parse_logs(feed(*batches), ACCESS_LOG), unit="ms")
    got, _ = drain(followed_by_span(parsed, buckets=buckets))
    assert [(r.username, r.denied_count) for b in got for r in b] == [(None, 3)]


@pytest.mark.parametrize("cancel", [False, True])
def test_stream_of_many_users_against_state_machine(feed, drain, cancel):
    rng = random.Random(11)
    logs = sorted(
        (rng.randrange(900), rng.choice("abcdefgh"), rng.choices(["denied", "accessed"], [3, 1])[0])
        for _ in range(1_200)
    )
    # one log per user and second, so that the order is plain
    logs = list({(t, u): (t, u, a) for t, u, a in logs}.values())
    values = [{"timestamp": (BASE + t) * 1000, "username": u, "action": a} for t, u, a in logs]
    cuts = [next(i for i, log in enumerate(logs) if log[0] >= t) for t in range(0, 900, 150)]
    batches = [values[i:j] for i, j in zip(cuts, [*cuts[1:], len(values)])]
    parsed = event_time(parse_logs(feed(*batches), ACCESS_LOG), unit="ms")
    got, _ = drain(followed_by_span(parsed, "20 seconds", 2, cancel_timers=cancel, buckets=3))
    expected = sorted(
        (u, t, n)
        for u in "abcdefgh"
        for t, n in machine([(t, 0, a) for t, who, a in logs if who == u], 20, 2, cancel)
    )
    assert shape([r for b in got for r in b]) == expected and expected


def test_a_batch_costs_what_it_touches(feed, tmp_path):
    """Three hundred users wait with a denial each; a log of one of them reads and writes one entry."""
    checkpoint = str(tmp_path / "checkpoint")
    waiting = [v for n in range(300) for v in steps("D0", f"u{n}")]

    def run(values):
        parsed = event_time(parse_logs(feed(values), ACCESS_LOG), unit="ms")
        alerts = followed_by_span(parsed, "1 hour", buckets=4)
        query = run_alerts(alerts, checkpoint, sink=lambda batch, number: batch.collect(), mode="append", trigger="available")
        query.awaitTermination(120)
        assert query.exception() is None
        told = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        return sum(p["numRowsUpdated"] for p in told), told[-1]["numRowsTotal"]

    first, total = run(waiting)
    assert first >= 300 and total >= 300
    second, total = run(steps("D5", "u7"))
    assert second <= 5 and total >= 300
