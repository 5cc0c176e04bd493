"""Alert rules as data: a name, a kind of alert and its parameters."""

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.functions.timeparts import event_time
from emberwatch.operators.keyword import keyword_alert
from emberwatch.operators.parse import parse_logs
from emberwatch.operators.sequences import followed_by_span
from emberwatch.operators.spans import span_burst_alert
from emberwatch.operators.windows import burst_alert, followed_by_window, sliding_burst_alert
from emberwatch.streaming.machines import MACHINES, definition_of, machine_alerts, rule_set_alerts
from emberwatch.streaming.runner import BatchSink, run_alerts

KINDS: dict[str, Callable[..., DataFrame]] = {
    "keyword": keyword_alert,
    "burst": burst_alert,
    "sliding_burst": sliding_burst_alert,
    "followed_by_window": followed_by_window,
    "span_burst": span_burst_alert,
    "followed_by_span": followed_by_span,
}

# kinds whose alerts change while their window is open
CHANGING = {"burst", "sliding_burst", "followed_by_window"}


@dataclass(frozen=True)
class Rule:
    """A kind of alert with its parameters, and how the messages it looks at are laid out.

    `schema`, `unit` (of a time that is a number) and `mode` are needed only where the rule
    is to read messages; `order` columns and the like belong into `params`.
    """

    name: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    schema: str | None = None
    unit: str | None = None
    mode: str = "permissive"

    def __post_init__(self) -> None:
        if self.kind not in KINDS and self.kind not in MACHINES:
            kinds = ", ".join(sorted({*KINDS, *MACHINES}))
            raise ValueError(f"rule {self.name!r}: {self.kind!r} is no kind; kinds are {kinds}")

    def logs(self, messages: DataFrame, schema: str, unit: str = "s") -> DataFrame:
        """What the rule looks at: parsed messages, with its own layout or the one given."""
        if self.kind == "keyword":
            return messages
        time = self.params.get("time", "timestamp")
        order = self.params.get("order")
        keep = [order] if order in messages.columns else []
        parsed = parse_logs(messages, self.schema or schema, mode=self.mode, keep=keep)
        if parsed.schema[time].dataType.typeName() in ("long", "integer"):
            return event_time(parsed, time, self.unit or unit)
        return parsed

    def alerts(self, logs: DataFrame) -> DataFrame:
        if self.kind in KINDS:
            return KINDS[self.kind](logs, **self.params)
        return machine_alerts(logs, self.kind, self.params)

    @property
    def definition(self) -> str:
        """The rule as a line of a stream of rules."""
        return definition_of(self.name, self.kind, self.params)


def load_rules(text: str) -> list[Rule]:
    """Rules from JSON: a list of objects with `name`, `kind` and, if need be, the others."""
    return list(_checked([Rule(**told) for told in json.loads(text)]))


def _checked(rules: Sequence[Rule]) -> Sequence[Rule]:
    names = [rule.name for rule in rules]
    if len(set(names)) < len(names):
        raise ValueError(f"rule names must differ: {names}")
    return rules


def apply_rules(logs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All rules' alerts on a table: the rule's name and the alert as JSON."""
    named = [
        alerts.select(
            F.lit(rule.name).alias("rule"), F.to_json(F.struct(*alerts.columns)).alias("alert")
        )
        for rule in _checked(rules)
        for alerts in [rule.alerts(logs)]
    ]
    return reduce(DataFrame.unionByName, named)


def run_rules(
    logs: DataFrame,
    rules: Sequence[Rule],
    checkpoints: str,
    sink: str | Callable[[Rule], BatchSink] = "console",
    trigger: str | None = None,
) -> dict[str, StreamingQuery]:
    """One streaming query per rule, each with its own checkpoint below `checkpoints`."""
    return {
        rule.name: run_alerts(
            rule.alerts(logs),
            f"{checkpoints}/{quote(rule.name, safe=' ')}",
            sink if isinstance(sink, str) else sink(rule),
            mode="update" if rule.kind in CHANGING else "append",
            trigger=trigger,
            name=rule.name,
        )
        for rule in _checked(rules)
    }


def run_rule_set(
    logs: DataFrame,
    rules: Sequence[Rule] | DataFrame,
    checkpoint: str,
    sink: str | BatchSink = "console",
    trigger: str | None = None,
    **settings: Any,
) -> StreamingQuery:
    """All rules in one streaming query: one scan, one shuffle and one checkpoint for all of them.

    `rules` is a fixed list, or a stream of definitions (`Rule.definition`, one a row in the column
    `value`), with which rules come, change and, with a null kind, end while the query runs. Each
    alert has the rule's name and version, the user and the alert as JSON. Rules that look at
    messages (`keyword`) are stateless and run by `run_rules`.
    """
    if not isinstance(rules, DataFrame):
        for rule in _checked(rules):
            if rule.kind not in MACHINES:
                raise ValueError(f"rule {rule.name!r}: kind {rule.kind!r} does not run in a set")
        rules = [rule.definition for rule in rules]
    alerts = rule_set_alerts(logs, rules, **settings)
    return run_alerts(alerts, checkpoint, sink, mode="append", trigger=trigger, name="rule set")
