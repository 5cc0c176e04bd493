"""Late logs: windows that fire at their close and again, spans and sequences judged on arrival."""

import random
from collections import defaultdict

import pytest
from conftest import BASE

from emberwatch import (
    closing_burst_alert,
    event_time,
    followed_by_span,
    parse_logs,
    run_alerts,
    sliding_burst_alert,
    span_burst_alert,
)
from emberwatch.schemas import ACCESS_LOG, USER_LOG

WORDS = {"D": "denied", "A": "accessed", "O": "other"}


def logs(user, *seconds):
    return [{"timestamp": BASE + s, "username": user} for s in seconds]


@pytest.fixture
def turns(feed, tmp_path):
    """Feeds one micro-batch after the other; gives the alerts sent after each."""

    def run(alerts_of, batches):
        got = []
        for batch in batches:
            sent = []
            query = run_alerts(
                alerts_of(feed(batch)),
                str(tmp_path / "checkpoint"),
                sink=lambda df, number, sent=sent: sent.extend(df.collect()),
                mode="append",
                trigger="available",
            )
            query.awaitTermination(120)
            assert query.exception() is None
            got.append(sent)
        return got

    return run


def closing(window="10 minutes", slide="1 minute", **more):
    return lambda feed: closing_burst_alert(event_time(parse_logs(feed, USER_LOG)), window, slide, **more)


def fired(rows):
    return sorted((str(r.username), int(r.window_start.timestamp()) - BASE, r["count"], r.refired) for r in rows)


def test_nothing_is_sent_before_the_close(turns):
    """The batches of fixture J4-b: ten windows of three or four logs close, then late logs come."""
    batches = [logs("a", 0, 1, 2), logs("a", 3), logs("b", 2000), logs("a", 4), logs("b", 2001), logs("a", 5)]
    got = turns(closing(buckets=2), batches)
    starts = [60 * k for k in range(-9, 1)]
    assert [fired(b) for b in got] == [
        [], [],
        [("a", s, 4, False) for s in starts],
        [("a", s, 5, True) for s in starts],
        [],
        [("a", s, 6, True) for s in starts],
    ]


def test_each_late_log_sends_its_windows_until_the_lateness_is_over(turns):
    batches = [
        logs("a", 0, 1), logs("b", 1000), logs("a", 2, 3),  # the second and third log come late
        logs("b", 660), logs("b", 1260), logs("a", 4), logs("b", 1300), logs("a", 5),
    ]
    got = turns(closing("10 minutes", "5 minutes", lateness="10 minutes", buckets=2), batches)
    # windows from -300 and 0 end at 300 and 600, their lateness at 900 and 1200
    assert [fired(b) for b in got] == [
        [], [], [("a", 0, 3, True), ("a", 0, 4, True)], [], [], [], [], []]


def brute(batches, window, slide, threshold, lateness):
    """Per micro-batch what is sent, log by log; times in seconds."""
    counts, clock, sent, closed = defaultdict(int), None, [], set()
    for batch in batches:
        out = []
        for t, user in sorted(batch, key=lambda row: row[0]):
            first = (t - window) // slide * slide + slide
            for start in range(first, t + 1, slide):
                end = start + window
                if clock is not None and end + lateness <= clock:
                    continue
                counts[user, start] += 1
                if clock is not None and end <= clock and counts[user, start] > threshold:
                    out.append((user, start, counts[user, start], True))
                if clock is not None and end <= clock:
                    closed.add((user, start))
        clock = max([t for t, _ in batch] + ([] if clock is None else [clock]))
        for (user, start), n in counts.items():
            if start + window <= clock and (user, start) not in closed:
                closed.add((user, start))
                if n > threshold:
                    out.append((user, start, n, False))
        sent.append(sorted((str(u), s, n, r) for u, s, n, r in out))
    return sent


@pytest.mark.parametrize(("window", "slide", "lateness", "seed"), [(60, 20, 90, 1), (50, 20, 200, 2)])
def test_windows_against_brute_force(turns, window, slide, lateness, seed):
    """Random logs with many late ones, also where the slide does not divide the window."""
    rng = random.Random(seed)
    batches = []
    for k in range(4):
        at = 100 * k
        batches.append([(max(0, at + rng.randrange(-250, 60)), rng.choice(["u", "v", None])) for _ in range(60)])
    batches[0] = [(t % 60, u) for t, u in batches[0]]
    told = [[{"timestamp": BASE + t, "username": u} for t, u in batch] for batch in batches]
    alerts = closing(f"{window} seconds", f"{slide} seconds", lateness=f"{lateness} seconds", buckets=3)
    got = turns(alerts, told)
    shift = BASE % slide  # windows start at multiples of the slide since 1970
    want = brute([[(t + shift, u) for t, u in b] for b in batches], window, slide, 2, lateness)
    assert [sorted((str(u), s + shift, n, r) for u, s, n, r in fired(b)) for b in got] == want


def test_on_a_table_each_window_once(spark):
    df = event_time(spark.createDataFrame([(BASE + s, "a") for s in (0, 1, 2)], USER_LOG))
    rows = closing_burst_alert(df).collect()
    assert len(rows) == 10 and not any(r.refired for r in rows)
    assert {r[:4] for r in rows} == {r[:4] for r in sliding_burst_alert(df).collect()}


def test_settings_that_make_no_sense(spark):
    stream = spark.readStream.format("rate").load().selectExpr("timestamp", "'a' AS username")
    with pytest.raises(ValueError, match="longer"):
        closing_burst_alert(stream, "1 minute", "2 minutes")
    with pytest.raises(ValueError, match="milliseconds"):
        closing_burst_alert(stream, "1 second", "1 microsecond")
    with pytest.raises(ValueError, match="late"):
        span_burst_alert(stream, late="kept")


def spans(feed, **more):
    return span_burst_alert(event_time(parse_logs(feed, USER_LOG)), "60 seconds", buckets=2, **more)


def span_shape(rows):
    return sorted((str(r.username), int(r.span_start.timestamp()) - BASE, r["count"]) for r in rows)


LATE_SPANS = [
    # the log that opens the span comes last, when the clock is at 65
    ([logs("a", 10, 20, 30), logs("b", 65), logs("a", 0)], [[], [], [("a", 0, 3)]]),
    # the clock is past the spans of the other logs, which are gone
    ([logs("a", 10, 20, 30), logs("b", 200), logs("a", 0)], [[], [], []]),
    # a late log counts in a span that is still open
    ([logs("a", 0, 10, 20), logs("b", 55), logs("a", 30), logs("b", 70)], [[], [], [], [("a", 0, 3)]]),
    # late logs of one micro-batch count for each other
    ([logs("b", 500), logs("a", 0, 10, 20, 30)], [[], [("a", 0, 3)]]),
]


@pytest.mark.parametrize(("batches", "expected"), LATE_SPANS)
def test_late_spans_are_judged_on_arrival(turns, batches, expected):
    got = turns(lambda f: spans(f, delay="0 seconds", late="taken"), batches)
    assert [span_shape(b) for b in got] == expected


def test_late_spans_may_be_dropped(turns):
    batches, _ = LATE_SPANS[3]
    assert turns(lambda f: spans(f, delay="0 seconds"), batches) == [[], []]


def late_spans(batches, span, threshold):
    """The rule of one log after the other; a log is kept until the clock has passed its span."""
    kept, clock, sent = [], None, []
    for batch in batches:
        out = []
        kept += [(t, u) for t, u in batch]
        for now in (clock, max([t for t, _ in batch] + ([] if clock is None else [clock]))):
            if now is None:
                continue
            for t, u in sorted({(t, u) for t, u in kept if t + span <= now}, key=str):
                n = sum(v == u and t < s <= t + span for s, v in kept)
                if n > threshold:
                    out.append((str(u), t, n))
            kept = [(t, u) for t, u in kept if t + span > now]
        clock = max([t for t, _ in batch] + ([] if clock is None else [clock]))
        sent.append(sorted(out))
    return sent


@pytest.mark.parametrize("seed", [1])
def test_late_spans_against_brute_force(turns, seed):
    rng = random.Random(seed)
    batches = [
        [(max(0, 150 * k + rng.randrange(-200, 150)), rng.choice(["u", "v", None])) for _ in range(40)]
        for k in range(4)
    ]
    told = [[{"timestamp": BASE + t, "username": u} for t, u in batch] for batch in batches]
    got = turns(lambda f: spans(f, delay="0 seconds", late="taken"), told)
    assert [sorted((str(u), t, n) for u, t, n in span_shape(b)) for b in got] == late_spans(batches, 60, 2)


def steps(text, user="a"):
    return [
        {"timestamp": (BASE + int(s[1:])) * 1000, "username": user, "action": WORDS[s[0]]}
        for s in text.split()
    ]


def sequences(feed, **more):
    parsed = event_time(parse_logs(feed, ACCESS_LOG), unit="ms")
    return followed_by_span(parsed, buckets=2, **more)


def sequence_shape(rows):
    return sorted((str(r.username), int(r.accessed_at.timestamp()) - BASE, r.denied_count) for r in rows)


LATE_SEQUENCES = [
    # a late access reads the denials that are there
    ([steps("D0 D1 D2"), steps("O50", "b"), steps("A3")], [[], [], [("a", 3, 3)]]),
    # the clock, moved by another user, has passed the timer
    ([steps("D0 D1 D2"), steps("O1000", "b"), steps("A3")], [[], [], []]),
    # a late denial counts
    ([steps("D0 D1"), steps("O50", "b"), steps("D2"), steps("A10")], [[], [], [], [("a", 10, 3)]]),
    # late logs of one micro-batch are a sequence of their own, which then is over
    ([steps("O1000", "b"), steps("D0 D1 D2 A3"), steps("D4 D5"), steps("D6 A7")], [[], [("a", 3, 3)], [], []]),
]


@pytest.mark.parametrize(("batches", "expected"), LATE_SEQUENCES)
def test_late_sequences_are_taken_on_arrival(turns, batches, expected):
    got = turns(lambda f: sequences(f, delay="0 seconds", late="taken"), batches)
    assert [sequence_shape(b) for b in got] == expected


def test_late_sequences_may_be_dropped(turns):
    batches, _ = LATE_SEQUENCES[3]
    assert turns(lambda f: sequences(f, delay="0 seconds"), batches) == [[], [], [], []]


def late_machine(batches, span, threshold, cancel):
    """One user at a time, as the logs arrive; timers end by the log's time, or by the clock."""
    clock, sent = None, []
    state = defaultdict(lambda: [0, []])
    for batch in batches:
        out, seen = [], set()
        for t, _, user, action in sorted(batch, key=lambda r: r[:2]):
            if action == "other":
                continue
            own = state[user]
            by = t if user in seen or clock is None else max(t, clock)
            seen.add(user)
            left = [end for end in own[1] if end >= by]
            if len(left) < len(own[1]):
                own[:] = [0, left]
            if action == "denied":
                if own[0] == 0:
                    own[1].append(t + span)
                own[0] += 1
            else:
                if own[0] >= threshold:
                    out.append((str(user), t, own[0]))
                own[0] = 0
                if cancel:
                    own[1].clear()
        clock = max([r[0] for r in batch] + ([] if clock is None else [clock]))
        sent.append(sorted(out))
    return sent


@pytest.mark.parametrize(("seed", "cancel"), [(1, False), (2, True)])
def test_late_sequences_against_the_machine(turns, seed, cancel):
    rng = random.Random(seed)
    numbers = iter(range(10_000))
    batches = [
        [(max(0, 60 * k + rng.randrange(-90, 60)), next(numbers), rng.choice(["u", "v", None]),
          rng.choices(["denied", "accessed", "other"], (6, 1, 1))[0]) for _ in range(60)]
        for k in range(4)
    ]
    told = [
        [{"timestamp": (BASE + t) * 1000, "username": u, "action": a, "id": i} for t, i, u, a in batch]
        for batch in batches
    ]
    kind = ACCESS_LOG + ", id long"

    def alerts(feed):
        parsed = event_time(parse_logs(feed, kind), unit="ms")
        return followed_by_span(parsed, "20 seconds", 2, "0 seconds", cancel, order="id", buckets=2, late="taken")

    got = turns(alerts, told)
    assert [sorted((str(u), t, n) for u, t, n in sequence_shape(b)) for b in got] == late_machine(batches, 20, 2, cancel)
