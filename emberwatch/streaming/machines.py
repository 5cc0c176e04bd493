"""Kinds of rules as small state machines, and one streaming query that runs many rules at once.

A machine says what to do with one user's logs; it knows nothing of streams. `register_kind` makes
one of a user's own a kind of rule. On a table each user's logs are taken in order, as one group;
on a stream the machines' states are kept by user, for all rules together.
"""

import datetime as dt
import hashlib
import json
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from emberwatch.functions.timeparts import as_micros, micros, watermarked
from emberwatch.streaming.buckets import BUCKETS, in_buckets
from emberwatch.streaming.processors import clock_of, wake_at

LONG_AGO, FAR_AHEAD = -(2**62), 2**62


class Machine:
    """A kind of rule. Its state is whatever JSON can hold; None keeps nothing.

    Times are microseconds since 1970. A log is a dict with `us`, its time, and the columns in
    `columns`; logs come in order of time within a micro-batch. An alert is a dict of the fields
    in `alert`, a list of names and types in SQL; fields of type timestamp are microseconds. The
    clock is the time up to which all is taken to have come; earlier logs are late, and `late` says
    whether a machine gets them.
    """

    alert = ""
    columns: tuple[str, ...] = ()
    late = False
    #: how far the clock stays behind the greatest time seen, unless the rule says otherwise
    delay = "1 minute"

    def take(self, state: Any, logs: list[dict], clock: int) -> tuple[Any, list[dict]]:
        """The state after some logs, and what they raise."""
        raise NotImplementedError

    def due(self, state: Any) -> int | None:
        """The clock at which `wake` is to be called; None: never."""
        return None

    def wake(self, state: Any, clock: int) -> tuple[Any, list[dict]]:
        """The state once the clock has moved, and what that raises."""
        return state, []


class Burst(Machine):
    """More than so many logs in a window that moves by `slide`; sent at every change."""

    alert = "window_start timestamp, window_end timestamp, count long"
    late = True  # a log counts as long as one of its windows is open
    delay = "10 minutes"

    def __init__(self, window: str = "10 minutes", slide: str | None = None, threshold: int = 2):
        self.window, self.slide = micros(window), micros(slide or window)
        self.threshold = threshold

    def starts(self, us: int) -> range:
        return range((us - self.window) // self.slide * self.slide + self.slide, us + 1, self.slide)

    def added(self, counts: list[int] | None, log: dict) -> list[int]:
        return [(counts[0] if counts else 0) + 1]

    def told(self, counts: list[int]) -> dict | None:
        return {"count": counts[0]} if counts[0] > self.threshold else None

    def take(self, state: Any, logs: list[dict], clock: int) -> tuple[Any, list[dict]]:
        windows = {int(start): counts for start, counts in (state or {}).items()}
        changed = {}
        for log in logs:
            for start in self.starts(log["us"]):
                if start + self.window > clock:
                    windows[start] = changed[start] = self.added(windows.get(start), log)
        alerts = [
            {"window_start": start, "window_end": start + self.window} | found
            for start, counts in sorted(changed.items())
            if (found := self.told(counts)) is not None
        ]
        return self.wake(windows, clock)[0], alerts

    def due(self, state: Any) -> int | None:
        return min(map(int, state), default=None) + self.window if state else None

    def wake(self, state: Any, clock: int) -> tuple[Any, list[dict]]:
        left = {start: n for start, n in (state or {}).items() if int(start) + self.window > clock}
        return left or None, []


class FollowedByWindow(Burst):
    """At least so many failures and successes in one window; sent at every change."""

    alert = "window_start timestamp, window_end timestamp, failed_count long, success_count long"
    delay = "1 minute"

    def __init__(
        self, window: str = "1 minute", failures: int = 5, successes: int = 1,
        action: str = "login_action", failed: str = "failed", success: str = "success",
    ):
        super().__init__(window)
        self.failures, self.successes = failures, successes
        self.action, self.failed, self.success = action, failed, success
        self.columns = (action,)

    def added(self, counts: list[int] | None, log: dict) -> list[int]:
        failed, success = counts or [0, 0]
        return [failed + (log[self.action] == self.failed), success + (log[self.action] == self.success)]

    def told(self, counts: list[int]) -> dict | None:
        if counts[0] >= self.failures and counts[1] >= self.successes:
            return {"failed_count": counts[0], "success_count": counts[1]}
        return None


class SpanBurst(Machine):
    """More than so many further logs in the span after a log."""

    alert = "span_start timestamp, span_end timestamp, count long"

    def __init__(self, span: str = "60 seconds", threshold: int = 2):
        self.span, self.threshold = micros(span), threshold

    def take(self, state: Any, logs: list[dict], clock: int) -> tuple[Any, list[dict]]:
        return self.wake(sorted((state or []) + [log["us"] for log in logs]), clock)

    def due(self, state: Any) -> int | None:
        return state[0] + self.span if state else None

    def wake(self, state: Any, clock: int) -> tuple[Any, list[dict]]:
        times, alerts, first, last = state or [], [], 0, 0
        over = [us for us in dict.fromkeys(times) if us + self.span <= clock]
        for us in over:  # both ends of the span only move on
            while first < len(times) and times[first] <= us:
                first += 1
            while last < len(times) and times[last] <= us + self.span:
                last += 1
            if last - first > self.threshold:
                alerts.append({"span_start": us, "span_end": us + self.span, "count": last - first})
        left = [us for us in times if us + self.span > clock]
        return left or None, alerts


class FollowedBySpan(Machine):
    """An access after so many denials since the last reset; see `followed_by_span`."""

    alert = "accessed_at timestamp, denied_count long"

    def __init__(
        self, span: str = "60 seconds", threshold: int = 3, cancel_timers: bool = False,
        action: str = "action", denied: str = "denied", accessed: str = "accessed",
    ):
        self.span, self.threshold, self.cancel = micros(span), threshold, cancel_timers
        self.action, self.denied, self.accessed = action, denied, accessed
        self.columns = (action,)

    def take(self, state: Any, logs: list[dict], clock: int) -> tuple[Any, list[dict]]:
        n, ends = (self.wake(state, clock)[0] if state else None) or (0, [])
        alerts = []
        for log in logs:
            us, what = log["us"], log[self.action]
            if what not in (self.denied, self.accessed):
                continue
            left = [end for end in ends if end >= us]
            n, ends = (n if len(left) == len(ends) else 0), left
            if what == self.denied:
                ends += [us + self.span] if n == 0 else []
                n += 1
            else:
                if n >= self.threshold:
                    alerts.append({"accessed_at": us, "denied_count": n})
                n, ends = 0, [] if self.cancel else ends
        return ([n, ends] if ends else None), alerts

    def due(self, state: Any) -> int | None:
        return max(state[1]) + 1 if state else None

    def wake(self, state: Any, clock: int) -> tuple[Any, list[dict]]:
        n, ends = state or (0, [])
        left = [end for end in ends if end >= clock]
        return ([n if len(left) == len(ends) else 0, left] if left else None), []


#: The machine of each kind of rule.
MACHINES: dict[str, type[Machine]] = {
    "burst": Burst,
    "sliding_burst": Burst,
    "followed_by_window": FollowedByWindow,
    "span_burst": SpanBurst,
    "followed_by_span": FollowedBySpan,
}
BUILT_IN = frozenset(MACHINES)


def register_kind(name: str, machine: type[Machine]) -> None:
    """Make a machine a kind of rule, for tables and streams."""
    if name in BUILT_IN or name == "keyword":
        raise ValueError(f"{name!r} is a kind already")
    MACHINES[name] = machine


def unregister_kind(name: str) -> None:
    if name not in BUILT_IN:
        MACHINES.pop(name, None)


# one rule: what is in its definition

# parameters that say how logs are read, not what a machine does with them
HOW = {"delay", "user", "time", "order", "late", "retention", "buckets"}


class Running:
    """A rule's machine with its delay; `version` tells one definition of a name from another."""

    def __init__(self, kind: str, params: dict, machines: dict[str, type[Machine]]):
        told = {k: v for k, v in params.items() if k not in HOW}
        self.machine = machines[kind](**told)
        self.delay = micros(params.get("delay", self.machine.delay))
        text = json.dumps([kind, params], sort_keys=True)
        self.version = hashlib.sha256(text.encode()).hexdigest()[:16]
        self.times = {
            part.split()[0] for part in self.machine.alert.split(",") if part.split()[1] == "timestamp"
        }

    def alert(self, found: dict) -> dict:
        return {name: _stamp(value) if name in self.times else value for name, value in found.items()}


def _stamp(us: int) -> str:
    """A time in UTC as Spark writes it in JSON, with microseconds if there are any."""
    when = dt.datetime.fromtimestamp(us // 1_000_000, dt.UTC)
    rest = us % 1_000_000
    return f"{when:%Y-%m-%dT%H:%M:%S}." + (f"{rest:06d}" if rest % 1000 else f"{rest // 1000:03d}") + "Z"


class RuleSetProcessor(StatefulProcessor):
    """Runs every rule of a bucket on the logs of its users.

    Rules come as rows of their own, to each bucket, ahead of the logs of their micro-batch. A
    changed rule has another version, whose states begin anew. A user's states are one entry, so a
    log costs one read and one write however many rules there are, and users that are left alone
    cost nothing until a machine asks to be woken.
    """

    def __init__(
        self, behind: int, user: str, numeric: bool, machines: dict[str, type[Machine]], fixed: list[str]
    ) -> None:
        self.behind, self.user, self.numeric, self.machines = behind, user, numeric, machines
        self.fixed = fixed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rules = handle.getMapState("rules", "name string", "definition string")
        self.users = handle.getMapState("users", "who string", "states string, ms long")
        self.due = handle.getMapState("due", "ms long", "who array<string>")
        self.known: dict[str, Running] = {}

    def _active(self) -> dict[str, Running]:
        found = {json.loads(text)["name"]: text for text in self.fixed}
        found |= {name: definition for (name,), (definition,) in self.rules.iterator()}
        for definition in found.values():
            if definition not in self.known:
                told = json.loads(definition)
                self.known[definition] = Running(told["kind"], told["params"], self.machines)
        return {name: self.known[definition] for name, definition in found.items()}

    def _learn(self, rows: list[str]) -> None:
        for text in rows:
            told = json.loads(text)
            if told.get("kind") is None:
                if self.rules.containsKey((told["name"],)):
                    self.rules.removeKey((told["name"],))
            else:
                definition = json.dumps({"kind": told["kind"], "params": told.get("params", {})}, sort_keys=True)
                self.rules.updateValue((told["name"],), (definition,))

    def _step(self, who: str | None, active: dict[str, Running], logs: list[dict], now: int,
              due: dict[int, list]) -> list[tuple]:
        """All rules on one user: its logs, or only the clock."""
        held = self.users.getValue((who,))
        states = json.loads(held[0]) if held is not None else {}
        waiting = held[1] if held is not None else None
        left, alerts, wakes = {}, [], []
        for name, rule in active.items():
            clock = max(now - rule.delay, LONG_AGO)
            key = f"{rule.version} {name}"
            state = states.get(key)
            found = []
            if logs:
                own = logs if rule.machine.late else [log for log in logs if log["us"] >= clock]
                if own:
                    state, found = rule.machine.take(state, own, clock)
            at = rule.machine.due(state) if state is not None else None
            if at is not None and at <= clock:
                state, more = rule.machine.wake(state, clock)
                found = found + more
                at = rule.machine.due(state) if state is not None else None
            alerts += [(name, rule.version, who, self._json(who, rule.alert(a))) for a in found]
            if state is not None:
                left[key] = state
                if at is not None:
                    wakes.append(wake_at(at + rule.delay, self.behind))
        ms = min(wakes, default=None)
        if left:
            self.users.updateValue((who,), (json.dumps(left), ms))
        elif held is not None:
            self.users.removeKey((who,))
        if ms is not None and ms != waiting:
            due.setdefault(ms, []).append(who)
        return alerts

    def _json(self, who: str | None, alert: dict) -> str:
        user = int(who) if self.numeric and who is not None else who
        told = alert if user is None else {self.user: user} | alert
        return json.dumps(told, separators=(",", ":"), ensure_ascii=False)

    def _wait(self, due: dict[int, list]) -> None:
        for ms, whos in due.items():
            held = self.due.getValue((ms,))
            self.handle.registerTimer(ms)
            self.due.updateValue((ms,), ((list(held[0]) if held else []) + whos,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        told = batch[batch["at_rule"].notna()]
        self._learn(told.sort_values("at_order")["at_rule"].tolist())
        active = self._active()
        logs = batch[batch["at_rule"].isna()].sort_values(
            ["at_us", "at_order"], kind="stable", na_position="first"
        )
        wanted = sorted({c for rule in active.values() for c in rule.machine.columns})
        now, due, alerts = clock_of(timerValues, self.behind), {}, []
        for name, own in logs.groupby("at_who", dropna=False, sort=False):
            columns = [own["at_us"].astype("int64").tolist(), *(own[c].tolist() for c in wanted)]
            dicts = [dict(zip(("us", *wanted), row, strict=True)) for row in zip(*columns, strict=True)]
            alerts += self._step(None if pd.isna(name) else name, active, dicts, now, due)
        self._wait(due)
        if alerts:
            yield pd.DataFrame(alerts, columns=["at_rule", "at_version", "at_who", "at_alert"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        held = self.due.getValue((ms,))
        if held is None:
            return
        self.due.removeKey((ms,))
        active, now = self._active(), clock_of(timerValues, self.behind)
        due: dict[int, list] = {}
        alerts = []
        for who in dict.fromkeys(held[0]):
            alerts += self._step(who, active, [], now, due)
        self._wait(due)
        if alerts:
            yield pd.DataFrame(alerts, columns=["at_rule", "at_version", "at_who", "at_alert"])

    def close(self) -> None:
        pass


def definition_of(name: str, kind: str | None, params: dict) -> str:
    """A rule as one line of a stream of rules; without a kind it ends the rule."""
    return json.dumps({"name": name, "kind": kind, "params": params}, sort_keys=True)


def rule_set_alerts(
    logs: DataFrame,
    rules: DataFrame | Sequence[str],
    user: str = "username",
    time: str = "timestamp",
    order: str | None = None,
    buckets: int = BUCKETS,
    retention: str = "1 day",
    numbered: str | None = None,
) -> DataFrame:
    """All rules on one stream of logs: (rule, version, user, alert as JSON).

    `rules` are definitions as `definition_of` writes them, fixed or as a stream with a `value`
    column; of a stream the last definition of a name counts, from its micro-batch on, in order of
    the column `numbered` if given. `order` and `numbered` are numbers. Logs may come up to `retention` after the greatest time seen, and that must cover each
    rule's own delay and window. The logs are read once and shuffled once for all rules; a rule's
    row goes to every bucket.
    """
    numeric = logs.schema[user].dataType.typeName() in ("long", "integer", "short", "byte")
    behind = micros(retention)
    others = [c for c in logs.columns if c not in (user, time)]
    known = in_buckets(logs.filter(F.col(time).isNotNull()), user, buckets)
    known = known.select(
        "at_bucket", "at_who", F.col(time).cast("timestamp").alias("at_time"),
        (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("at_order"),
        F.lit(None).cast("string").alias("at_rule"), *others,
    )
    if not isinstance(rules, DataFrame):
        return _run_set(known, list(rules), user, numeric, logs, behind)
    number = F.col(numbered).cast("long") if numbered else F.lit(0).cast("long")
    told = rules.select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("at_bucket"),
        F.lit(None).cast("string").alias("at_who"), F.lit(None).cast("timestamp").alias("at_time"),
        number.alias("at_order"), F.col("value").cast("string").alias("at_rule"),
        *[F.lit(None).cast(logs.schema[c].dataType).alias(c) for c in others],
    )
    return _run_set(known.unionByName(told), [], user, numeric, logs, behind)


def _run_set(
    rows: DataFrame, fixed: list[str], user: str, numeric: bool, logs: DataFrame, behind: int
) -> DataFrame:
    rows = watermarked(rows, "at_time", f"{behind // 1000} milliseconds")
    rows = rows.withColumn("at_us", as_micros(rows, "at_time"))
    found = rows.groupBy("at_bucket").transformWithStateInPandas(
        RuleSetProcessor(behind, user, numeric, dict(MACHINES), fixed),
        outputStructType="at_rule string, at_version string, at_who string, at_alert string",
        outputMode="append",
        timeMode="EventTime",
    )
    return found.select(
        F.col("at_rule").alias("rule"),
        F.col("at_version").alias("version"),
        F.col("at_who").cast(logs.schema[user].dataType).alias(user),
        F.col("at_alert").alias("alert"),
    )


def machine_alerts(
    logs: DataFrame, kind: str, params: dict, buckets: int = BUCKETS
) -> DataFrame:
    """One rule of a machine's kind on a table or stream: the user and the fields of the alert.

    On a table a user's logs are one group, taken in order of (time, `order`), and all has come at
    the end.
    """
    user, time = params.get("user", "username"), params.get("time", "timestamp")
    order = params.get("order")
    rule = Running(kind, params, MACHINES)
    who = logs.schema[user].dataType
    fields = [part.strip() for part in rule.machine.alert.split(",")]
    if logs.isStreaming:
        retention = params.get("retention", f"{rule.delay // 1000 + 86_400_000} milliseconds")
        only = [definition_of(kind, kind, params)]
        found = rule_set_alerts(logs, only, user, time, order, buckets, retention)
        parsed = F.from_json("alert", rule.machine.alert)
        return found.select(user, F.inline(F.array(parsed)))
    schema = StructType().add(user, who)
    for field in fields:
        name, type_ = field.split()
        schema = schema.add(name, "long" if type_ == "timestamp" else type_)
    needed = list(rule.machine.columns)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["at_us", "at_order"], kind="stable", na_position="first")
        columns = [frame["at_us"].tolist(), *(frame[c].tolist() for c in needed)]
        taken = [dict(zip(("us", *needed), row, strict=True)) for row in zip(*columns, strict=True)]
        state, alerts = rule.machine.take(None, taken, LONG_AGO)
        if state is not None:
            alerts = alerts + rule.machine.wake(state, FAR_AHEAD)[1]
        rows = [(key[0], *(alert[field.split()[0]] for field in fields)) for alert in alerts]
        return pd.DataFrame(rows, columns=schema.names)

    rank = F.col(order) if order else F.lit(0)
    rows = logs.filter(F.col(time).isNotNull()).select(
        user, as_micros(logs, time).alias("at_us"), rank.alias("at_order"), *needed
    )
    found = rows.groupBy(user).applyInPandas(run, schema)
    stamped = {
        name: F.timestamp_micros(name) for name, type_ in (f.split() for f in fields) if type_ == "timestamp"
    }
    return found.withColumns(stamped)
