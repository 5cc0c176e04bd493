"""Run a job on a Kafka topic until it is interrupted."""

import argparse
import json
import threading
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.operators.parse import normalize_logs
from emberwatch.plans.jobs import CHANGING, JOBS, STARTS, TOPICS
from emberwatch.plans.rules import CHANGING as CHANGING_RULES
from emberwatch.plans.rules import Rule, load_rules
from emberwatch.schemas import ACCESS_LOG
from emberwatch.session import build_session
from emberwatch.sources.kafka import kafka_logs
from emberwatch.streaming.index import index_logs
from emberwatch.streaming.machines import rule_set_alerts
from emberwatch.streaming.runner import (
    alert_log,
    notify_per_batch,
    print_alerts,
    run_alerts,
    run_with_retry,
)


def deliver(
    given: argparse.Namespace, alerts: DataFrame, name: str, changing: bool, notice: bool = False
) -> StreamingQuery:
    """Start one query with the sink that was asked for; each keeps every alert."""
    own = quote(name, safe=" ")
    checkpoint = given.checkpoint if given.job != "rules" else f"{given.checkpoint}/{own}"
    settings = {
        "mode": "update" if changing else "append",
        "trigger": given.trigger,
        "name": name,
    }
    if given.sink == "topic":
        value = F.to_json(F.struct(*alerts.columns)).alias("value")
        options = {"kafka.bootstrap.servers": given.servers, "topic": given.output}
        return run_alerts(alerts.select(value), checkpoint, "kafka", **settings, **options)
    if given.sink == "table":
        table = given.output if given.job != "rules" else f"{given.output}/{own}"
        return run_alerts(alerts, checkpoint, alert_log(table), **settings)
    sink = notify_per_batch() if notice else print_alerts()
    return run_alerts(alerts, checkpoint, sink, **settings)


def starters(
    given: argparse.Namespace, read: Callable[[], DataFrame]
) -> dict[str, Callable[[], StreamingQuery]]:
    """How to start each query of the job, by name: one, or one for each rule."""

    def job() -> StreamingQuery:
        if given.job == "index":
            unit = given.unit or "auto"
            return index_logs(
                read(), given.table, given.checkpoint, unit=unit, trigger=given.trigger,
                terms=given.terms, rejects=given.rejects, merge_every=given.merge_every,
            )
        if given.job == "rule-set":
            logs = Rule("all", "burst", schema=given.schema, unit=given.unit).logs(read(), given.schema)
            rules = logs.sparkSession.readStream.text(given.rules)
            alerts = rule_set_alerts(logs, rules, retention=given.retention)
            return deliver(given, alerts, given.job, changing=False)
        if given.job == "normalize":
            told = json.loads(Path(given.patterns).read_text())
            patterns = [(one["name"], one["pattern"], one["fields"]) for one in told]
            fields = dict.fromkeys(name for _, _, names in patterns for name in names)
            named = normalize_logs(read(), patterns).select("pattern", *fields)
            return deliver(given, named, given.job, changing=False)
        alerts = JOBS[given.job](read())
        return deliver(given, alerts, given.job, given.job in CHANGING, given.job == "keyword")

    def rule_query(rule: Rule) -> Callable[[], StreamingQuery]:
        def start() -> StreamingQuery:
            logs = rule.logs(read(), given.schema, given.unit or "s")
            return deliver(given, rule.alerts(logs), rule.name, rule.kind in CHANGING_RULES)

        return start

    if given.job != "rules":
        return {given.job: job}
    return {rule.name: rule_query(rule) for rule in load_rules(Path(given.rules).read_text())}


def arguments(told: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="emberwatch", description=__doc__)
    parser.add_argument("job", choices=[*JOBS, "index", "normalize", "rules", "rule-set"])
    parser.add_argument("--servers", required=True, help="Kafka bootstrap servers")
    parser.add_argument("--checkpoint", required=True, help="folder all executors can reach")
    parser.add_argument("--topic")
    parser.add_argument("--start", help="earliest or latest")
    parser.add_argument(
        "--max-per-trigger", type=int, default=10_000_000, help="most records in a micro-batch"
    )
    parser.add_argument("--trigger", help="such as `10 seconds`; default: as fast as possible")
    parser.add_argument("--restarts", type=int, help="give up after so many errors; default: never")
    parser.add_argument("--table", help="for the job `index`: its folder")
    parser.add_argument("--terms", action="store_true", help="for `index`: with the terms of each load")
    parser.add_argument("--rejects", help="for `index`: folder of the messages that are no documents")
    parser.add_argument("--merge-every", type=int, help="for `index`: merge after so many micro-batches")
    parser.add_argument(
        "--rules",
        help="for `rules` a JSON file; for `rule-set` a folder of files with a definition per line, "
        "to which files may be added while it runs",
    )
    parser.add_argument("--retention", default="1 day", help="for `rule-set`: how late logs may come")
    parser.add_argument(
        "--patterns",
        help="for the job `normalize`: a JSON file with a list of `name`, `pattern`, `fields`",
    )
    parser.add_argument(
        "--schema", default=ACCESS_LOG, help="for rules: of messages, if a rule has none"
    )
    parser.add_argument(
        "--unit",
        choices=["s", "ms", "auto"],
        help="of the time: for rules s (default) or ms, for `index` also auto (default)",
    )
    parser.add_argument(
        "--sink",
        default="console",
        choices=["console", "table", "topic"],
        help="where alerts go; every one of them goes there",
    )
    parser.add_argument("--output", help="folder of the table, or name of the topic, of alerts")
    given = parser.parse_args(told)
    needs = (("index", "table"), ("rules", "rules"), ("rule-set", "rules"), ("normalize", "patterns"))
    for job, needed in needs:
        if given.job == job and not getattr(given, needed):
            parser.error(f"the job `{job}` needs --{needed}")
    if given.sink != "console" and not given.output:
        parser.error(f"the sink `{given.sink}` needs --output")
    if given.job in ("rules", "rule-set") and given.unit == "auto":
        parser.error(f"the job `{given.job}` needs the unit s or ms")
    return given


def run_all(
    starts: dict[str, Callable[[], StreamingQuery]],
    stop_queries: Callable[[], None],
    restarts: int | None = None,
    pause: float = 5.0,
) -> None:
    """Keep all queries running until an interrupt, or until one gives up, which is raised."""
    stop = threading.Event()
    with ThreadPoolExecutor(len(starts)) as pool:
        running = {
            pool.submit(run_with_retry, start, pause, restarts, stop) for start in starts.values()
        }
        try:
            while running:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for each in done:
                    each.result()
        except KeyboardInterrupt:
            pass
        finally:
            stop.set()
            stop_queries()


def main() -> None:
    given = arguments()
    spark = build_session(f"emberwatch {given.job}")

    def read() -> DataFrame:
        return kafka_logs(
            spark,
            given.servers,
            given.topic or TOPICS.get(given.job, "logs"),
            given.start or STARTS.get(given.job, "latest"),
            max_per_trigger=given.max_per_trigger,
        )

    def stop_queries() -> None:
        for query in spark.streams.active:
            query.stop()

    run_all(starters(given, read), stop_queries, given.restarts)
    spark.stop()


if __name__ == "__main__":
    main()
