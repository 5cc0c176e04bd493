"""The library's alerts, parsers, index and search as queries on the given tables.

The tables spread each user's rows over a month, so windows and spans are wider here than
their defaults; `error` stands for a failure or denial and `purchase` for a success or
access. `oracle_sql` holds the same questions in plain SQL.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import emberwatch as ew  # noqa: E402
from emberwatch.plans import jobs  # noqa: E402
from emberwatch.plans.rules import CHANGING  # noqa: E402
from emberwatch.schemas import ACCESS_LOG, LOGIN_LOG, USER_LOG  # noqa: E402
from emberwatch.session import ROCKSDB, scratch_folder  # noqa: E402

try:
    import corpus_pipeline
    from emberwatch.llm import queries as llm
except ModuleNotFoundError as missing:  # both go together; any other missing module is a fault
    if not str(missing.name).startswith(("corpus_pipeline", "emberwatch.llm")):
        raise
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

LOGIN_WORDS = {"action": "action", "failed": "error", "success": "purchase"}
ACCESS_WORDS = {"denied": "error", "accessed": "purchase"}
URL_PATTERNS = [
    ("paged", r"^https?://([^/]+)/(\w+)/(\d+)\?page=(\d+)", ("host", "lang", "number", "page")),
    ("plain", r"^https?://([^/]+)/(\w+)/(\d+)", ("host", "lang", "number")),
]
TENTH = (dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11))
SEARCH = {"all_of": ["the"], "any_of": ["threat", "licen*"], "none_of": ["token"]}
RULES = [
    ew.Rule("busy day", "burst", {"window": "1 day", "threshold": 4}),
    ew.Rule("busy span", "span_burst", {"span": "12 hours", "threshold": 3, "delay": "0 seconds"}),
    ew.Rule("bad week", "followed_by_window", {"window": "7 days", "failures": 4, **LOGIN_WORDS}),
]


# inputs


def _prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    local = spark.sparkContext.master.startswith("local")
    if local and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark


def _logs(spark: SparkSession, folder: str) -> DataFrame:
    return ew.events_as_logs(_prepare(spark), folder)


def _log_stream(spark: SparkSession, folder: str) -> DataFrame:
    return ew.stream_table(_prepare(spark), folder, "events").select(
        "event_id",
        F.col("user_id").alias("username"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_type").alias("action"),
        "props",
    )


def _messages(logs: DataFrame, unit: str = "ms", action: str = "action") -> DataFrame:
    """The logs as JSON messages with times as epoch numbers, the event's id as offset."""
    epoch = {"s": F.unix_seconds, "ms": F.unix_millis}[unit]
    told = logs.select(
        "event_id",
        epoch(F.col("timestamp").cast("timestamp")).alias("timestamp"),
        F.col("username").cast("string").alias("username"),
        F.col("action").alias(action),
    )
    return ew.as_envelope(told, ["timestamp", "username", action], offset="event_id")


def _naive(df: DataFrame) -> DataFrame:
    """Zoned timestamps as plain ones, as the SQL has them."""
    zoned = [name for name, kind in df.dtypes if kind == "timestamp"]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned})


def _new_folder(spark: SparkSession) -> str:
    return scratch_folder(spark)


def _buckets(spark: SparkSession) -> int:
    """A few buckets of users for each state task; each run has a checkpoint of its own."""
    return 4 * int(_prepare(spark).conf.get("spark.sql.shuffle.partitions"))


def _drained(alerts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there into a table; with `keys`, the last value of each."""
    spark = alerts.sparkSession
    folder = _new_folder(spark)
    ew.run_alerts(
        alerts,
        f"{folder}/checkpoint",
        sink=ew.alert_log(f"{folder}/alerts"),
        mode="update" if keys else "append",
        trigger="available",
    ).awaitTermination()
    if keys:
        return _naive(ew.latest_alerts(spark, f"{folder}/alerts", keys))
    return _naive(ew.read_alerts(spark, f"{folder}/alerts"))


def _arrival(day, number):
    """Every seventh event comes one to five days late; what comes in six days is a micro-batch."""
    return F.floor((F.unix_date(day.cast("date")) + F.when(number % 7 == 3, number % 5 + 1).otherwise(0)) / 6)


def _in_turns(spark: SparkSession, folder: str, alerts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Alerts of a stream that gets the events as they arrive, stopped and restarted in between."""
    path = _new_folder(_prepare(spark))
    logs = _logs(spark, folder).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    logs = logs.withColumn("arrival", _arrival(F.col("timestamp"), F.col("event_id")))
    logs.write.partitionBy("arrival").parquet(f"{path}/all")
    every = spark.read.parquet(f"{path}/all")
    for arrival in sorted(row.arrival for row in every.select("arrival").distinct().collect()):
        every.filter(F.col("arrival") == arrival).drop("arrival").write.mode("append").parquet(f"{path}/come")
        come = spark.readStream.schema(every.drop("arrival").schema).parquet(f"{path}/come")
        ew.run_alerts(
            alerts_of(come),
            f"{path}/checkpoint",
            sink=ew.alert_log(f"{path}/alerts"),
            mode="append",
            trigger="available",
        ).awaitTermination()
    return _naive(ew.read_alerts(spark, f"{path}/alerts"))


# queries


def keyword_alert(spark: SparkSession, folder: str) -> DataFrame:
    documents = ew.read_table(_prepare(spark), folder, "documents")
    return ew.keyword_alert(documents.select("doc_id", "text"), "threat", "text")


def keyword_alert_stream(spark: SparkSession, folder: str) -> DataFrame:
    documents = ew.stream_table(_prepare(spark), folder, "documents")
    messages = documents.select("doc_id", F.col("text").cast("binary").alias("value"))
    return _drained(
        ew.keyword_alert(messages).select("doc_id", F.col("value").cast("string").alias("text"))
    )


def job_keyword(spark: SparkSession, folder: str) -> DataFrame:
    documents = ew.read_table(_prepare(spark), folder, "documents")
    found = jobs.keyword(documents.select(F.col("text").cast("binary").alias("value")), "thing")
    return found.select(F.col("value").cast("string").alias("text"))


def burst_alert(spark: SparkSession, folder: str) -> DataFrame:
    return ew.burst_alert(_logs(spark, folder), "1 day")


def burst_alert_stream(spark: SparkSession, folder: str) -> DataFrame:
    alerts = ew.burst_alert(_log_stream(spark, folder), "1 day")
    return _drained(alerts, ["username", "window_start", "window_end"])


def burst_alert_closed(spark: SparkSession, folder: str) -> DataFrame:
    return _drained(ew.burst_alert(_log_stream(spark, folder), "1 day"))


def job_burst(spark: SparkSession, folder: str) -> DataFrame:
    return _naive(jobs.burst(_messages(_logs(spark, folder), "s"), "1 day"))


def sliding_burst_alert(spark: SparkSession, folder: str) -> DataFrame:
    return ew.sliding_burst_alert(_logs(spark, folder), "1 day", "6 hours")


def sliding_burst_stream(spark: SparkSession, folder: str) -> DataFrame:
    alerts = ew.sliding_burst_alert(_log_stream(spark, folder), "1 day", "6 hours")
    return _drained(alerts, ["username", "window_start", "window_end"])


def closing_burst_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Every alert that is sent: at a window's close, and again for each late log."""
    return _in_turns(spark, folder, lambda logs: ew.closing_burst_alert(
        logs, "1 day", "6 hours", lateness="3 days", order="event_id", buckets=_buckets(spark)))


def job_sliding_burst(spark: SparkSession, folder: str) -> DataFrame:
    messages = _messages(_logs(spark, folder), "s")
    return jobs.sliding_burst(messages, window="1 day", slide="6 hours")


def followed_by_window(spark: SparkSession, folder: str) -> DataFrame:
    return ew.followed_by_window(_logs(spark, folder), "7 days", **LOGIN_WORDS)


def followed_by_window_stream(spark: SparkSession, folder: str) -> DataFrame:
    alerts = ew.followed_by_window(_log_stream(spark, folder), "7 days", **LOGIN_WORDS)
    return _drained(alerts, ["username", "window_start", "window_end"])


def job_login(spark: SparkSession, folder: str) -> DataFrame:
    messages = _messages(_logs(spark, folder), "s", action="login_action")
    words = {"failed": "error", "success": "purchase"}
    return _naive(jobs.login(messages, window="7 days", failures=4, **words))


def span_burst_alert(spark: SparkSession, folder: str) -> DataFrame:
    return ew.span_burst_alert(_logs(spark, folder), "1 day")


def span_burst_stream(spark: SparkSession, folder: str) -> DataFrame:
    logs = _log_stream(spark, folder)
    alerts = ew.span_burst_alert(logs, "1 day", delay="0 seconds", buckets=_buckets(spark))
    return _drained(alerts)


def late_span_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _in_turns(spark, folder, lambda logs: ew.span_burst_alert(
        logs, "1 day", delay="0 seconds", late="taken", buckets=_buckets(spark)))


def job_span_burst(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.span_burst(_messages(_logs(spark, folder)), span="1 day")


def followed_by_span(spark: SparkSession, folder: str) -> DataFrame:
    return ew.followed_by_span(_logs(spark, folder), "3 days", 2, order="event_id", **ACCESS_WORDS)


def followed_by_span_cancelled(spark: SparkSession, folder: str) -> DataFrame:
    return ew.followed_by_span(
        _logs(spark, folder), "3 days", 2, order="event_id", cancel_timers=True, **ACCESS_WORDS
    )


def followed_by_span_stream(spark: SparkSession, folder: str) -> DataFrame:
    logs = _log_stream(spark, folder)
    alerts = ew.followed_by_span(
        logs, "3 days", 2, order="event_id", buckets=_buckets(spark), **ACCESS_WORDS
    )
    return _drained(alerts)


def late_sequence_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _in_turns(spark, folder, lambda logs: ew.followed_by_span(
        logs, "3 days", 2, delay="0 seconds", order="event_id", late="taken",
        buckets=_buckets(spark), **ACCESS_WORDS))


def waiting_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Read from the state that a stream over all events leaves: who waits, as of the last event."""
    logs = _log_stream(spark, folder)
    path = _new_folder(spark)
    ew.run_alerts(
        ew.followed_by_span(
            logs, "3 days", 2, order="event_id", buckets=_buckets(spark), **ACCESS_WORDS
        ),
        f"{path}/checkpoint",
        sink=ew.alert_log(f"{path}/alerts"),
        trigger="available",
    ).awaitTermination()
    last = _logs(spark, folder).agg(F.unix_micros(F.max("timestamp").cast("timestamp"))).first()[0]
    held = ew.waiting_sequences(spark, f"{path}/checkpoint", F.timestamp_micros(F.lit(last)))
    return _naive(held.select("username", "denied_count", F.explode("timers").alias("timer_ends")))


def job_access(spark: SparkSession, folder: str) -> DataFrame:
    messages = _messages(_logs(spark, folder))
    return _naive(jobs.access(messages, "offset", span="2 days", threshold=3, **ACCESS_WORDS))


def parse_logs(spark: SparkSession, folder: str) -> DataFrame:
    parsed = ew.parse_logs(_messages(_logs(spark, folder), "s"), USER_LOG, keep=["offset"])
    return _naive(ew.event_time(parsed, unit="s"))


def parse_logs_strict(spark: SparkSession, folder: str) -> DataFrame:
    messages = _messages(_logs(spark, folder))
    parsed = ew.parse_logs(messages, ACCESS_LOG, mode="strict", keep=["offset"])
    return _naive(ew.event_time(parsed, unit="ms"))


def parse_login_logs(spark: SparkSession, folder: str) -> DataFrame:
    messages = _messages(_logs(spark, folder), "s", action="login_action")
    return _naive(ew.parse_logs(messages, LOGIN_LOG, keep=["offset"]))


def parse_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks with single quotes, views with a key twice, signups cut short, others as they are."""
    value = (
        F.when(F.col("action") == "click", F.translate("props", '"', "'"))
        .when(F.col("action") == "view", F.concat(F.lit('{"k": 0, '), F.expr("substring(props, 2)")))
        .when(F.col("action") == "signup", F.rtrim("props", F.lit("}")))
        .otherwise(F.col("props"))
    )
    parsed = ew.parse_documents(_logs(spark, folder).withColumn("value", value.cast("binary")))
    return parsed.select("event_id", "text", F.try_variant_get("doc", "$.k", "long").alias("k"))


def _broken(logs: DataFrame) -> DataFrame:
    """Properties as messages, some of them broken in one way or another."""
    value = (
        F.when(F.col("action") == "click", F.translate("props", '"', "'"))
        .when(F.col("action") == "view", F.concat("props", F.lit(" {}")))
        .when(F.col("action") == "signup", F.concat(F.lit("""{"k": "it's", "p": """), "props", F.lit("}")))
        .when(F.col("event_id") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 11 == 1, F.rtrim("props", F.lit("}")))
        .when(F.col("event_id") % 11 == 2, F.lit('{"k": NaN}'))
        .otherwise(F.col("props"))
    )
    return logs.select(
        value.cast("binary").alias("value"), F.lit("logs").alias("topic"), F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
    )


def index_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """What an index does not take, with the reason, beside how many it takes."""
    path = _new_folder(_prepare(spark))
    ew.index_logs(_broken(_logs(spark, folder)), f"{path}/index", fields={"k": "string"}, rejects=f"{path}/rejects")
    taken = ew.read_index(spark, f"{path}/index").select("offset", F.lit(None).cast("string").alias("reason"))
    return taken.unionByName(spark.read.parquet(f"{path}/rejects").select("offset", "reason"))


def readable_time(spark: SparkSession, folder: str) -> DataFrame:
    logs = _logs(spark, folder)
    return logs.select("event_id", ew.readable_time(F.col("timestamp")).alias("clock"))


def echo_events(spark: SparkSession, folder: str) -> DataFrame:
    received = F.lit(TENTH[0]).cast("timestamp_ntz")
    return ew.echo_events(_logs(spark, folder), received)


def normalize_logs(spark: SparkSession, folder: str) -> DataFrame:
    pages = ew.read_table(_prepare(spark), folder, "pages").select("page_id", "url")
    return ew.normalize_logs(pages, URL_PATTERNS, "url", unmatched=True).drop("url")


def normalized_messages(spark: SparkSession, folder: str) -> DataFrame:
    pages = ew.read_table(_prepare(spark), folder, "pages").select("page_id", "url")
    named = ew.normalize_logs(pages, URL_PATTERNS, "url")
    messages = ew.as_envelope(named, ["pattern", "host", "number"], offset="page_id")
    return messages.select("offset", F.col("value").cast("string").alias("value"))


def _index(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    path = _new_folder(spark)
    fields = {"username": "string", "action": "string"}
    logs = (_log_stream if stream else _logs)(spark, folder)
    started = ew.index_logs(
        _messages(logs),
        f"{path}/index",
        f"{path}/checkpoint",
        fields=fields,
        unit="ms",
        trigger="available",
    )
    if started is not None:
        started.awaitTermination()
    return ew.read_index(spark, f"{path}/index")


def index_logs(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["topic", "partition", "offset", "log_time", "username", "action", "text", "log_date"]
    return _naive(_index(spark, folder).select(*columns))


def index_logs_stream(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["topic", "partition", "offset", "log_time", "username", "action", "text", "log_date"]
    return _naive(_index(spark, folder, stream=True).select(*columns))


def search_logs(spark: SparkSession, folder: str) -> DataFrame:
    found = ew.search_logs(_index(spark, folder), term="error", since=TENTH[0], until=TENTH[1])
    return _naive(found.select("offset", "log_time", "username"))


def search_fields(spark: SparkSession, folder: str) -> DataFrame:
    found = ew.search_logs(_index(spark, folder), fields={"username": "7", "action": "purchase"})
    return _naive(found.select("offset", "log_time"))


def log_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = ew.search_logs(_index(spark, folder), since=TENTH[0])
    return _naive(ew.log_counts(found, "6 hours", ["action"]))


def merged_index(spark: SparkSession, folder: str) -> DataFrame:
    """Six loads of the same dates, merged into one."""
    path = f"{_new_folder(spark)}/index"
    messages = _messages(_logs(spark, folder))
    for part in range(6):
        load = messages.filter(F.col("offset") % 6 == part)
        ew.index_logs(load, path, fields={"action": "string"}, unit="ms", load=f"load-{part}")
    ew.merge_loads(spark, path, fields=["action"])
    columns = ["topic", "partition", "offset", "log_time", "action", "text", "log_date"]
    merged = ew.read_index(spark, path).filter(F.col("load").startswith("merged-"))
    return _naive(merged.select(*columns))


def _lines(spark: SparkSession, folder: str) -> str:
    """An index with terms of the documents as log lines, without what JSON would escape."""
    documents = ew.read_table(_prepare(spark), folder, "documents")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"""[\x00-\x1F\x7F"'\\]""", " ")
    lines = documents.select("doc_id", clean.alias("line"))
    path = f"{_new_folder(spark)}/index"
    ew.index_logs(ew.as_envelope(lines, ["doc_id", "line"], offset="doc_id"), path, fields={}, terms=True)
    return path


def search_terms(spark: SparkSession, folder: str) -> DataFrame:
    found = ew.search_terms(spark, _lines(spark, folder), **SEARCH)
    return found.select("offset")


def search_phrase(spark: SparkSession, folder: str) -> DataFrame:
    found = ew.search_terms(spark, _lines(spark, folder), phrase="of the", none_of=["threat"])
    return found.select("offset")


def ranked_logs(spark: SparkSession, folder: str) -> DataFrame:
    found = ew.ranked_logs(spark, _lines(spark, folder), ["threat", "license", "thing"], most=50)
    return found.select("offset", "score")


def _whole_alerts(alerts: DataFrame) -> DataFrame:
    """Alerts as JSON taken apart: who, from when, until when, and the counts."""
    def field(*names):
        return F.coalesce(*[F.get_json_object("alert", f"$.{name}") for name in names])

    def time(*names):
        return F.rtrim(field(*names), F.lit("Z")).cast("timestamp_ntz")

    return alerts.select(
        "rule", field("username").alias("username"),
        F.date_trunc("millisecond", time("window_start", "span_start")).cast("timestamp_ntz").alias("since"),
        F.date_trunc("millisecond", time("window_end", "span_end")).cast("timestamp_ntz").alias("until"),
        *[field(name).cast("long").alias(name) for name in ("count", "failed_count", "success_count")],
    )


def apply_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _whole_alerts(ew.apply_rules(_logs(spark, folder), RULES))


def run_rules(spark: SparkSession, folder: str) -> DataFrame:
    """One stream per rule, each rule's alerts read back from its own table."""
    path = _new_folder(_prepare(spark))
    running = ew.run_rules(
        _log_stream(spark, folder),
        RULES,
        f"{path}/checkpoints",
        sink=lambda rule: ew.alert_log(f"{path}/{rule.kind}"),
        trigger="available",
    )
    told = []
    for rule in RULES:
        running[rule.name].awaitTermination()
        if rule.kind in CHANGING:
            keys = ["username", "window_start", "window_end"]
            alerts = ew.latest_alerts(spark, f"{path}/{rule.kind}", keys)
        else:
            alerts = ew.read_alerts(spark, f"{path}/{rule.kind}")
        alert = F.to_json(F.struct(*alerts.columns)).alias("alert")
        told.append(alerts.select(F.lit(rule.name).alias("rule"), alert))
    return _whole_alerts(reduce(DataFrame.unionByName, told))


def rule_set_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same rules in one stream, which reads them from a folder."""
    path = _new_folder(_prepare(spark))
    lines = spark.createDataFrame([(rule.definition,) for rule in RULES], "value string")
    lines.write.text(f"{path}/rules")
    ew.run_rule_set(
        _log_stream(spark, folder),
        spark.readStream.text(f"{path}/rules"),
        f"{path}/checkpoint",
        sink=ew.alert_log(f"{path}/alerts"),
        trigger="available",
        order="event_id",
        buckets=_buckets(spark),
        retention="14 days",
    ).awaitTermination()
    return _whole_alerts(ew.read_alerts(spark, f"{path}/alerts"))


def queries() -> dict[str, Query]:
    more = {**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}
    return more | {
        query.__name__: query
        for query in (
            keyword_alert,
            keyword_alert_stream,
            job_keyword,
            burst_alert,
            burst_alert_stream,
            burst_alert_closed,
            job_burst,
            sliding_burst_alert,
            sliding_burst_stream,
            closing_burst_stream,
            job_sliding_burst,
            followed_by_window,
            followed_by_window_stream,
            job_login,
            span_burst_alert,
            span_burst_stream,
            late_span_stream,
            job_span_burst,
            followed_by_span,
            followed_by_span_cancelled,
            followed_by_span_stream,
            late_sequence_stream,
            waiting_sequences,
            job_access,
            parse_logs,
            parse_logs_strict,
            parse_login_logs,
            parse_documents,
            index_rejects,
            readable_time,
            echo_events,
            normalize_logs,
            normalized_messages,
            index_logs,
            index_logs_stream,
            search_logs,
            search_fields,
            log_counts,
            merged_index,
            search_terms,
            search_phrase,
            ranked_logs,
            apply_rules,
            run_rules,
            rule_set_stream,
        )
    }


def entry(spark: SparkSession) -> DataFrame:
    return burst_alert(spark, "/root/testdata/sf0.001")


# the same in SQL

# windows start at the epoch, which time_bucket must be told
EPOCH = "TIMESTAMP '1970-01-01'"


def _tumbling(width: str, counts: str, having: str, rows: str = "events") -> str:
    return f"""
        SELECT user_id AS username,
               time_bucket(INTERVAL {width}, ts, {EPOCH}) AS window_start,
               time_bucket(INTERVAL {width}, ts, {EPOCH}) + INTERVAL {width} AS window_end,
               {counts}
        FROM {rows} GROUP BY ALL HAVING {having}"""


def _sliding() -> str:
    return f"""
        SELECT user_id AS username,
               time_bucket(INTERVAL 6 HOUR, ts, {EPOCH}) - k * INTERVAL 6 HOUR AS window_start,
               time_bucket(INTERVAL 6 HOUR, ts, {EPOCH}) - k * INTERVAL 6 HOUR + INTERVAL 1 DAY
                   AS window_end,
               count(*) AS count
        FROM events, range(0, 4) AS steps(k) GROUP BY ALL HAVING count(*) > 2"""


def _spans(width: str, rows: str = "events") -> str:
    return f"""
        SELECT DISTINCT user_id AS username, ts AS span_start, ts + INTERVAL {width} AS span_end,
               count
        FROM (SELECT user_id, ts, count(*) OVER (
                  PARTITION BY user_id ORDER BY ts
                  RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND INTERVAL {width} FOLLOWING
              ) AS count FROM {rows})"""


def _sequences(
    width: str, least: int, cancel: bool = False, rows: str = "events",
    order: str = "ts, event_id", by: str = "ts", told: str | None = None,
) -> str:
    """`by`: the time up to which timers have ended before a row; `told`: what to tell of it."""
    kept = "[]::TIMESTAMP[]" if cancel else "live"
    return f"""
        WITH RECURSIVE numbered AS (
            SELECT user_id, ts, event_type = 'error' AS denied, {by} AS until,
                   row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS rn
            FROM {rows} WHERE event_type IN ('error', 'purchase')
        ), walked AS (
            SELECT user_id, ts, rn, CASE WHEN denied THEN 1 ELSE 0 END AS n,
                   CASE WHEN denied THEN [ts + INTERVAL {width}] ELSE []::TIMESTAMP[] END AS timers,
                   0 AS hit
            FROM numbered WHERE rn = 1
            UNION ALL
            SELECT user_id, ts, rn, CASE WHEN denied THEN before + 1 ELSE 0 END,
                   CASE WHEN NOT denied THEN {kept}
                        WHEN before = 0 THEN list_append(live, ts + INTERVAL {width})
                        ELSE live END,
                   CASE WHEN denied THEN 0 ELSE before END
            FROM (SELECT r.user_id, r.ts, r.rn, r.denied,
                         CASE WHEN len(list_filter(w.timers, lambda t: t < r.until)) > 0 THEN 0
                              ELSE w.n END AS before,
                         list_filter(w.timers, lambda t: t >= r.until) AS live
                  FROM walked w JOIN numbered r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
        )
        """ + (told or f"""
        SELECT user_id AS username, ts AS accessed_at, hit::BIGINT AS denied_count
        FROM walked WHERE hit >= {least}""")


WAITING = """
        SELECT username, timer_ends,
               CASE WHEN len(list_filter(timers, lambda t: t < last)) > 0 THEN 0
                    ELSE n END::BIGINT AS denied_count
        FROM (SELECT user_id::VARCHAR AS username, n, timers, unnest(timers) AS timer_ends, last
              FROM walked CROSS JOIN (SELECT max(ts) AS last FROM events)
              QUALIFY rn = max(rn) OVER (PARTITION BY user_id))
        WHERE timer_ends >= last"""


# the events with their micro-batch, and the clock before it
ARRIVED = f"""(
    WITH placed AS (
        SELECT *, floor((ts::DATE - DATE '1970-01-01' + CASE WHEN event_id % 7 = 3
                         THEN event_id % 5 + 1 ELSE 0 END) / 6)::BIGINT AS k
        FROM events
    ), clocks AS (
        SELECT k, max(max(date_trunc('millisecond', ts))) OVER (ORDER BY k) AS after
        FROM placed GROUP BY k
    )
    SELECT placed.*, after, before FROM placed
    JOIN (SELECT k, after, lag(after) OVER (ORDER BY k) AS before FROM clocks) USING (k))"""

CLOSING = f"""
    WITH counted AS (
        SELECT user_id AS username, s AS window_start, s + INTERVAL 1 DAY AS window_end,
               coalesce(s + INTERVAL 1 DAY <= before, FALSE) AS refired,
               row_number() OVER (PARTITION BY user_id, s ORDER BY k, ts, event_id) AS count
        FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, {EPOCH}) - i * INTERVAL 6 HOUR AS s
              FROM {ARRIVED}, range(0, 4) AS steps(i))
        WHERE before IS NULL OR s + INTERVAL 4 DAY > before
    )
    SELECT * FROM counted WHERE refired AND count > 2
    UNION ALL
    SELECT username, window_start, window_end, FALSE, max(count) FROM counted
    WHERE NOT refired AND window_end <= (SELECT max(after) FROM {ARRIVED})
    GROUP BY ALL HAVING max(count) > 2"""

# a span is judged with the micro-batch of its log if it is over then, else after the first one
# that moves the clock past its end; it holds the logs that have come and are not judged before
LATE_SPANS = f"""
    WITH judged AS (
        SELECT user_id AS username, ts, 2 * k AS come,
               CASE WHEN before >= ts + INTERVAL 1 DAY THEN 2 * k
                    ELSE (SELECT 2 * min(c.k) + 1 FROM (SELECT DISTINCT k, after FROM {ARRIVED}) c
                          WHERE c.k >= a.k AND c.after >= a.ts + INTERVAL 1 DAY) END AS judged
        FROM {ARRIVED} a
    )
    SELECT s.username, s.ts AS span_start, s.ts + INTERVAL 1 DAY AS span_end, count(*) AS count
    FROM (SELECT DISTINCT username, ts, judged FROM judged WHERE judged IS NOT NULL) s
    JOIN judged l ON l.username = s.username AND l.ts > s.ts AND l.ts <= s.ts + INTERVAL 1 DAY
                 AND l.come <= s.judged AND (l.judged IS NULL OR l.judged >= s.judged)
    GROUP BY s.username, s.ts, s.judged HAVING count(*) > 2"""

LATE_SEQUENCES = _sequences(
    "3 DAY", 2, rows=ARRIVED, order="k, ts, event_id",
    by="""CASE WHEN before > ts AND row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) = 1
               THEN before ELSE ts END""")


def _whole(unit: str) -> str:
    return f"""(SELECT event_id, date_trunc('{unit}', ts) AS ts, user_id::VARCHAR AS user_id,
                       event_type FROM events)"""


def _clock(ts: str) -> str:
    return f"strftime({ts} + INTERVAL 345 MINUTE, '%H:%M:%S')"


def _rules(closed: str = "") -> str:
    bad = f"{FAILED} >= 4 AND {SUCCESS} >= 1"

    def told(name: str, rows: str, start: str, end: str, counts: str) -> str:
        return f"""
        SELECT '{name}' AS rule, username::VARCHAR AS username,
               date_trunc('millisecond', {start}) AS since, date_trunc('millisecond', {end}) AS until,
               {counts}
        FROM ({rows})"""

    one = "count, NULL::BIGINT AS failed_count, NULL::BIGINT AS success_count"
    two = "NULL::BIGINT AS count, failed_count, success_count"
    day = _tumbling("1 DAY", "count(*) AS count", "count(*) > 4")
    return " UNION ALL ".join([
        told("busy day", day, "window_start", "window_end", one),
        told("busy span", _spans("12 HOUR"), "span_start", "span_end", one) + f"WHERE count > 3 {closed}",
        told("bad week", _tumbling("7 DAY", BOTH, bad), "window_start", "window_end", two),
    ])


CLOSED = "AND span_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events)"
DAY_BURST = _tumbling("1 DAY", "count(*) AS count", "count(*) > 2")
FAILED = "count(*) FILTER (WHERE event_type = 'error')"
SUCCESS = "count(*) FILTER (WHERE event_type = 'purchase')"
BOTH = f"{FAILED} AS failed_count, {SUCCESS} AS success_count"
LOGIN = _tumbling("7 DAY", BOTH, f"{FAILED} >= 5 AND {SUCCESS} >= 1")
DOCUMENT = """'{"timestamp":' || epoch_ms(date_trunc('millisecond', ts))
              || ',"username":"' || user_id || '","action":"'
              || event_type || '"}'"""
INDEX = f"""
    SELECT 'logs' AS topic, 0::INTEGER AS partition, event_id AS "offset",
           date_trunc('millisecond', ts) AS log_time, user_id::VARCHAR AS username,
           event_type AS action, {DOCUMENT} AS text, ts::DATE AS log_date
    FROM events"""
PAGED, PLAIN = (f"'{pattern}'" for _, pattern, _ in URL_PATTERNS)


# the words of the documents as log lines
LINES = r"""(
    SELECT doc_id AS "offset", regexp_extract_all(lower('{"doc_id":' || doc_id || ',"line":"'
           || regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F"''\\]', ' ', 'g') || '"}'), '[\p{L}\p{N}]+') AS w
    FROM documents)"""

RANKED = f"""
    WITH lines AS (SELECT * FROM {LINES}), counts AS (
        SELECT count(*) AS n, sum(len(w)) / count(*) AS average,
               {", ".join(f"count(*) FILTER (list_contains(w, '{t}')) AS n{i}"
                          for i, t in enumerate(("threat", "license", "thing")))}
        FROM lines
    ), often AS (
        SELECT "offset", len(w) AS length,
               {", ".join(f"len(list_filter(w, lambda t: t = '{t}')) AS f{i}"
                          for i, t in enumerate(("threat", "license", "thing")))}
        FROM lines
    )
    SELECT "offset", round({" + ".join(
        f"ln(1 + (n - n{i} + 0.5) / (n{i} + 0.5)) * f{i} * 2.2::DOUBLE"
        f" / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average))"
        for i in range(3))}, 6) AS score
    FROM often, counts WHERE f0 + f1 + f2 > 0 ORDER BY score DESC, "offset" LIMIT 50"""


def oracle_sql() -> dict[str, str]:
    return (llm.SQL if llm else {}) | {
        "keyword_alert": "SELECT doc_id, text FROM documents WHERE contains(text, 'threat')",
        "keyword_alert_stream": "SELECT doc_id, text FROM documents WHERE contains(text, 'threat')",
        "job_keyword": "SELECT text FROM documents WHERE contains(text, 'thing')",
        "burst_alert": DAY_BURST,
        "burst_alert_stream": DAY_BURST,
        "burst_alert_closed": f"""
            SELECT * FROM ({DAY_BURST})
            WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
        "job_burst": f"""
            SELECT username::VARCHAR AS username, window_start, window_end, count,
                   'Alert fired; user=' || username || ', window="'
                   || strftime(window_start, '%Y-%m-%d %H:%M:%S') || ' to '
                   || strftime(window_end, '%Y-%m-%d %H:%M:%S') || '", count=' || count
                   || ', threshold=2, timerange=1 day' AS alert
            FROM ({DAY_BURST})""",
        "sliding_burst_alert": _sliding(),
        "sliding_burst_stream": _sliding(),
        "closing_burst_stream": CLOSING,
        "job_sliding_burst": f"""
            SELECT username::VARCHAR AS username, {_clock("window_start")} AS start,
                   {_clock("window_end")} AS "end", count::INTEGER AS count FROM ({_sliding()})""",
        "followed_by_window": LOGIN,
        "followed_by_window_stream": LOGIN,
        "job_login": _tumbling(
            "7 DAY", BOTH, f"{FAILED} >= 4 AND {SUCCESS} >= 1", _whole("second")
        ),
        "span_burst_alert": f"SELECT * FROM ({_spans('1 DAY')}) WHERE count > 2",
        "span_burst_stream": f"""
            SELECT * FROM ({_spans('1 DAY')}) WHERE count > 2
            AND span_end <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
        "late_span_stream": LATE_SPANS,
        "job_span_burst": f"""
            SELECT username, {_clock("span_start")} AS start, {_clock("span_end")} AS "end",
                   count::INTEGER AS count
            FROM ({_spans('1 DAY', _whole("millisecond"))}) WHERE count > 2""",
        "followed_by_span": _sequences("3 DAY", 2),
        "followed_by_span_cancelled": _sequences("3 DAY", 2, cancel=True),
        "followed_by_span_stream": _sequences("3 DAY", 2),
        "late_sequence_stream": LATE_SEQUENCES,
        "waiting_sequences": _sequences("3 DAY", 2, told=WAITING),
        "job_access": f"""
            SELECT *, 'ALERT: User ' || username || ' accessed after ' || denied_count
                      || ' denials' AS alert
            FROM ({_sequences("2 DAY", 3, rows=_whole("millisecond"))})""",
        "parse_logs": """
            SELECT event_id AS "offset", date_trunc('second', ts) AS timestamp,
                   user_id::VARCHAR AS username FROM events""",
        "parse_logs_strict": """
            SELECT event_id AS "offset", date_trunc('millisecond', ts) AS timestamp,
                   user_id::VARCHAR AS username, event_type AS action FROM events""",
        "parse_login_logs": """
            SELECT event_id AS "offset", user_id::VARCHAR AS username,
                   date_trunc('second', ts) AS timestamp, event_type AS login_action FROM events""",
        "parse_documents": """
            SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k,
                   CASE WHEN event_type = 'view' THEN '{"k": 0, ' || substr(props, 2)
                        ELSE props END AS text
            FROM events WHERE event_type <> 'signup'""",
        "index_rejects": """
            SELECT event_id AS "offset", CASE
                WHEN event_type = 'click' THEN NULL WHEN event_type = 'view' THEN 'not JSON'
                WHEN event_type = 'signup' THEN 'quotes' WHEN event_id % 11 = 0 THEN 'empty'
                WHEN event_id % 11 = 1 THEN 'not JSON' END AS reason
            FROM events""",
        "readable_time": f"SELECT event_id, {_clock('ts')} AS clock FROM events",
        "echo_events": f"""
            SELECT user_id AS username, ts AS timestamp,
                   'received @' || {_clock("TIMESTAMP '2024-01-10'")} || ' => ' || user_id || ', '
                   || {_clock("ts")} AS line
            FROM events""",
        "normalize_logs": f"""
            SELECT page_id, CASE WHEN regexp_matches(url, {PAGED}) THEN 'paged'
                                 WHEN regexp_matches(url, {PLAIN}) THEN 'plain' END AS pattern,
                   CASE WHEN regexp_matches(url, {PLAIN}) THEN regexp_extract(url, {PLAIN}, 1) END
                       AS host,
                   CASE WHEN regexp_matches(url, {PLAIN}) THEN regexp_extract(url, {PLAIN}, 2) END
                       AS lang,
                   CASE WHEN regexp_matches(url, {PLAIN}) THEN regexp_extract(url, {PLAIN}, 3) END
                       AS number,
                   CASE WHEN regexp_matches(url, {PAGED}) THEN regexp_extract(url, {PAGED}, 4) END
                       AS page
            FROM pages""",
        "normalized_messages": f"""
            SELECT page_id AS "offset",
                   '{{"pattern":"' || CASE WHEN regexp_matches(url, {PAGED}) THEN 'paged'
                                           ELSE 'plain' END
                   || '","host":"' || regexp_extract(url, {PLAIN}, 1)
                   || '","number":"' || regexp_extract(url, {PLAIN}, 3) || '"}}' AS value
            FROM pages WHERE regexp_matches(url, {PLAIN})""",
        "index_logs": INDEX,
        "index_logs_stream": INDEX,
        "search_logs": f"""
            SELECT "offset", log_time, username FROM ({INDEX})
            WHERE contains(text, 'error') AND log_date = DATE '2024-01-10'""",
        "search_fields": f"""
            SELECT "offset", log_time FROM ({INDEX})
            WHERE username = '7' AND action = 'purchase'""",
        "log_counts": f"""
            SELECT time_bucket(INTERVAL 6 HOUR, log_time, {EPOCH}) AS since, action,
                   count(*) AS count
            FROM ({INDEX}) WHERE log_time >= TIMESTAMP '2024-01-10' GROUP BY ALL""",
        "merged_index": f"""
            SELECT topic, partition, "offset", log_time, action, text, log_date FROM ({INDEX})""",
        "search_terms": f"""
            SELECT "offset" FROM {LINES} WHERE list_contains(w, 'the')
            AND len(list_filter(w, lambda t: t = 'threat' OR starts_with(t, 'licen'))) > 0
            AND NOT list_contains(w, 'token')""",
        "search_phrase": f"""
            SELECT "offset" FROM {LINES} WHERE NOT list_contains(w, 'threat')
            AND contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')""",
        "ranked_logs": RANKED,
        "apply_rules": _rules(),
        "run_rules": _rules(CLOSED),
        "rule_set_stream": _rules(CLOSED),
    }
