"""Rules as data: kinds of a user's own, many rules in one query, rules that change while it runs."""

import json
import random

import pytest
from conftest import BASE
from pyspark.sql import functions as F

from emberwatch import Machine, Rule, apply_rules, event_time, load_rules, parse_logs, register_kind, run_rule_set, run_rules
from emberwatch.schemas import ACCESS_LOG
from emberwatch.streaming.machines import MACHINES, definition_of, rule_set_alerts, unregister_kind


def streak_machine():
    # made in a function, so that it travels to the workers as it is
    class Streak(Machine):
        """So many logs of one action in a row; told once the streak has been quiet for a while."""

        alert = "began timestamp, action string, count long"
        columns = ("action",)
        delay = "0 seconds"

        def __init__(self, least: int = 3, quiet: int = 60):
            self.least, self.quiet = least, quiet * 1_000_000

        def over(self, state):
            action, began, _, n = state
            return [{"began": began, "action": action, "count": n}] if n >= self.least else []

        def take(self, state, logs, clock):
            alerts = []
            for log in logs:
                if state and (state[0] != log["action"] or log["us"] > state[2] + self.quiet):
                    alerts += self.over(state)
                    state = None
                state = [log["action"], state[1] if state else log["us"], log["us"], (state[3] if state else 0) + 1]
            return state, alerts

        def due(self, state):
            return state[2] + self.quiet + 1 if state else None

        def wake(self, state, clock):
            return (None, self.over(state)) if state[2] + self.quiet < clock else (state, [])

    return Streak


@pytest.fixture
def streak():
    register_kind("streak", streak_machine())
    yield "streak"
    unregister_kind("streak")


def log(second, action="denied", user="a"):
    return {"timestamp": (BASE + second) * 1000, "username": user, "action": action}


def parsed(values):
    return event_time(parse_logs(values, ACCESS_LOG), unit="ms")


def table(spark, values):
    return parsed(spark.createDataFrame([(json.dumps(v),) for v in values], "value string"))


LOGS = [log(0), log(1), log(2), log(3, "accessed"), log(4), log(5), log(100), log(101), log(102), log(103, user="b")]
END = [log(10_000, "other", "z")]


def streaks(alerts):
    return sorted((a["username"], a["action"], a["count"]) for a in map(json.loads, alerts))


def test_a_kind_of_ones_own_on_a_table(spark, streak):
    alerts = apply_rules(table(spark, LOGS + END), [Rule("rows", streak, {"least": 3})]).collect()
    assert streaks(r.alert for r in alerts) == [("a", "denied", 3), ("a", "denied", 3)]
    assert {r.rule for r in alerts} == {"rows"}


def test_a_kind_of_ones_own_on_a_stream(spark, feed, streak, tmp_path):
    got = []
    stream = parsed(feed(LOGS[:4], LOGS[4:8], LOGS[8:] + END))
    [query] = run_rules(
        stream, [Rule("rows", streak, {"least": 3, "buckets": 2})], str(tmp_path / "check"),
        sink=lambda rule: lambda batch, number: got.extend(batch.select(F.to_json(F.struct("*")).alias("j")).collect()),
        trigger="available",
    ).values()
    query.awaitTermination(120)
    assert query.exception() is None
    assert streaks(r.j for r in got) == [("a", "denied", 3), ("a", "denied", 3)]


def test_kinds_that_are_there_stay(streak):
    for name in ("burst", "keyword"):
        with pytest.raises(ValueError, match="already"):
            register_kind(name, Machine)
    assert issubclass(MACHINES["streak"], Machine)
    with pytest.raises(ValueError, match="no kind"):
        Rule("x", "unheard")


@pytest.fixture
def turns(spark, feed, tmp_path):
    """Feeds logs and new rules turn by turn; gives the alerts sent in each."""
    (tmp_path / "rules").mkdir()

    def run(batches, **settings):
        got = []
        for n, (lines, values) in enumerate(batches):
            if lines:
                (tmp_path / "rules" / f"{n}.json").write_text("\n".join(lines) + "\n")
            sent = []
            query = run_rule_set(
                parsed(feed(values)), spark.readStream.text(str(tmp_path / "rules")), str(tmp_path / "check"),
                sink=lambda batch, number, sent=sent: sent.extend(batch.collect()), trigger="available", buckets=2, **settings)
            query.awaitTermination(180)
            assert query.exception() is None
            got.append(sorted((r.rule, r.username, json.loads(r.alert).get("count")) for r in sent))
        return got

    return run


def burst(name, threshold, window="10 minutes"):
    return definition_of(name, "burst", {"threshold": threshold, "window": window})


def test_rules_come_change_and_go(turns):
    """A rule counts from its micro-batch on; a changed one starts anew; others go on."""
    batches = [
        ([burst("kept", 1), burst("changed", 2)], [log(0), log(1)]),
        ([burst("added", 1)], [log(2)]),
        ([burst("changed", 1)], [log(3)]),
        ([], [log(4)]),
        ([definition_of("kept", None, {})], [log(5)]),
    ]
    assert turns(batches) == [
        [("kept", "a", 2)],
        [("changed", "a", 3), ("kept", "a", 3)],  # `added` has seen one log
        [("added", "a", 2), ("kept", "a", 4)],  # `changed` begins anew
        [("added", "a", 3), ("changed", "a", 2), ("kept", "a", 5)],
        [("added", "a", 4), ("changed", "a", 3)],
    ]


def test_spans_are_told_by_the_clock(turns):
    """A span that ends while its user is silent is told, by the clock others move."""
    rule = definition_of("span", "span_burst", {"span": "60 seconds", "threshold": 1, "delay": "0 seconds"})
    assert turns([([rule], [log(0), log(10), log(20)]), ([], [log(61, user="b")]), ([], [log(500, user="b")])]) == [
        [], [("span", "a", 2)], []]


def test_five_hundred_rules_in_one_query(spark, feed, tmp_path):
    """Whole alerts, against the alerts of the operators on a table."""
    rng = random.Random(6)
    values = [log(rng.randrange(3000), rng.choice(["denied", "denied", "accessed"]), rng.choice("abc")) for _ in range(150)]
    base = [
        Rule("tumbling", "burst", {"window": "5 minutes"}),
        Rule("sliding", "sliding_burst", {"window": "10 minutes", "slide": "4 minutes"}),
        Rule("both", "followed_by_window", {"window": "5 minutes", "failures": 1, "action": "action", "failed": "denied", "success": "accessed"}),
        Rule("span", "span_burst", {"span": "3 minutes", "threshold": 0}),
        Rule("sequence", "followed_by_span", {"span": "4 minutes", "threshold": 1}),
    ]
    low = [Rule(r.name, r.kind, r.params | ({"threshold": 0} if r.kind in ("burst", "sliding_burst") else {})) for r in base]
    every = [(r.rule, json.loads(r.alert)) for r in apply_rules(table(spark, values + END), low).collect()]
    rules, want = [], set()
    for t in range(100):
        for rule in base:
            key = "failures" if rule.kind == "followed_by_window" else "threshold"
            rules.append(Rule(f"{rule.name} {t}", rule.kind, rule.params | {key: t}))
            for name, alert in every:
                if name == rule.name and not (alert["username"] == "z"):
                    n = alert.get("count", alert.get("failed_count", alert.get("denied_count")))
                    if n >= t if rule.kind in ("followed_by_window", "followed_by_span") else n > t:
                        want.add((f"{rule.name} {t}", json.dumps(alert, sort_keys=True)))
    # denials of none are no row of the low rule
    rules = [r for r in rules if not r.name.endswith(" 0") or r.kind != "followed_by_span"]
    want = {w for w in want if w[0] not in ("both 0", "sequence 0")}
    got = []
    query = run_rule_set(
        parsed(feed(values + END)), rules, str(tmp_path / "check"),
        sink=lambda batch, number: got.extend(batch.collect()), trigger="available", buckets=2)
    query.awaitTermination(300)
    assert query.exception() is None
    told = {(r.rule, json.dumps(json.loads(r.alert), sort_keys=True)) for r in got if r.username != "z"}
    assert len(rules) > 490
    assert {t for t in told if t[0] != "both 0"} == want


def test_sets_take_only_kinds_with_a_state(spark, feed):
    with pytest.raises(ValueError, match="does not run in a set"):
        run_rule_set(parsed(feed([])), [Rule("w", "keyword")], "unused")
    [rule] = load_rules('[{"name": "n", "kind": "burst", "params": {"threshold": 9}}]')
    assert json.loads(rule.definition) == {"name": "n", "kind": "burst", "params": {"threshold": 9}}


def test_users_that_are_numbers_stay_numbers(spark, feed, drain):
    stream = parsed(feed([log(0), log(1)])).withColumn("username", F.lit(7).cast("long"))
    alerts = rule_set_alerts(stream, [definition_of("n", "burst", {"threshold": 1})], buckets=2)
    got, _ = drain(alerts)
    [row] = [r for batch in got for r in batch]
    assert row.username == 7 and json.loads(row.alert)["username"] == 7
