"""The ready-made jobs: from raw messages to alerts, with their usual settings.

Each takes a DataFrame with a `value` column (table or stream) and gives alerts with a
printable `alert` line where the job has one. Settings go to the alert underneath. A job
with a `mode` fails on a message that does not parse, unless it is set to `permissive`.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.text import format_alert, format_denial_alert
from emberwatch.functions.timeparts import event_time, readable_time
from emberwatch.operators.keyword import keyword_alert
from emberwatch.operators.parse import parse_logs
from emberwatch.operators.sequences import followed_by_span
from emberwatch.operators.spans import span_burst_alert
from emberwatch.operators.windows import burst_alert, followed_by_window, sliding_burst_alert
from emberwatch.schemas import ACCESS_LOG, LOGIN_LOG, USER_LOG


def _clock(alerts: DataFrame, start: str, end: str) -> DataFrame:
    """The four-part alert: user, clock times of the stretch, and the count."""
    return alerts.select(
        "username",
        readable_time(F.col(start)).alias("start"),
        readable_time(F.col(end)).alias("end"),
        F.col("count").cast("int").alias("count"),
    )


def burst(
    messages: DataFrame, window: str = "10 minutes", threshold: int = 2, **settings
) -> DataFrame:
    """More than two logs of a user in ten minutes; time in seconds."""
    logs = event_time(parse_logs(messages, USER_LOG), unit="s")
    alerts = burst_alert(logs, window, threshold, **settings)
    return alerts.withColumn("alert", format_alert(threshold, window))


def login(messages: DataFrame, **settings) -> DataFrame:
    """Five failed logins and a success in one minute."""
    return followed_by_window(parse_logs(messages, LOGIN_LOG), **settings)


def keyword(messages: DataFrame, word: str = "threat") -> DataFrame:
    """Messages with the word in them."""
    return keyword_alert(messages, word).select("value")


def sliding_burst(messages: DataFrame, mode: str = "strict", **settings) -> DataFrame:
    """More than two logs of a user in ten minutes, looked at every minute; time in seconds."""
    logs = event_time(parse_logs(messages, USER_LOG, mode=mode), unit="s")
    return _clock(sliding_burst_alert(logs, **settings), "window_start", "window_end")


def span_burst(messages: DataFrame, mode: str = "strict", **settings) -> DataFrame:
    """More than two further logs of a user in the minute after a log; time in milliseconds."""
    logs = event_time(parse_logs(messages, USER_LOG, mode=mode), unit="ms")
    return _clock(span_burst_alert(logs, **settings), "span_start", "span_end")


def access(
    messages: DataFrame, order: str | None = None, mode: str = "strict", **settings
) -> DataFrame:
    """An access after three denials within a minute; time in milliseconds."""
    keep = [order] if order else []
    logs = event_time(parse_logs(messages, ACCESS_LOG, mode=mode, keep=keep), unit="ms")
    alerts = followed_by_span(logs, order=order, **settings)
    return alerts.withColumn("alert", format_denial_alert())


JOBS: dict[str, Callable[..., DataFrame]] = {
    "burst": burst,
    "login": login,
    "keyword": keyword,
    "sliding-burst": sliding_burst,
    "span-burst": span_burst,
    "access": access,
}

# fixed values: the topic and start each job reads from unless told otherwise
TOPICS = {"keyword": "test"}
STARTS = {"burst": "earliest", "index": "earliest"}

# jobs whose alerts change while their window is open
CHANGING = {"burst", "login", "sliding-burst"}
