"""Each log opens a span of its own; alert when enough further logs fall into it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.timeparts import (
    as_micros,
    behind_clock,
    from_micros,
    is_ntz,
    kept_for,
    micros,
)
from emberwatch.operators.balance import STRETCHES_PER_CHUNK, running_balance, spread
from emberwatch.streaming.buckets import BUCKETS, in_buckets, out_of_buckets
from emberwatch.streaming.processors import PARTS, SpanBurstProcessor

def span_burst_alert(
    df: DataFrame,
    span: str = "60 seconds",
    threshold: int = 2,
    delay: str = "1 minute",
    user: str = "username",
    time: str = "timestamp",
    buckets: int = BUCKETS,
    late: str = "dropped",
    retention: str = "7 days",
) -> DataFrame:
    """Spans `(t, t + span]` after a user's log at t that hold more than `threshold` logs.

    The opening log and others of the very same time do not count, and logs of one time
    open one span. On a stream a span is judged when the clock, the greatest event time of
    earlier micro-batches less `delay`, passes its end. Logs below the clock are `dropped`, so
    `delay` should cover how late logs arrive, and how far the topic's partitions lie apart, for
    they have one clock. Or they are `taken`, as long as they are not more than `retention` below
    it: a late log counts in the spans that are still open, and its own span is judged at once if
    it is over, with the logs whose spans are open. The state of the users is kept in so many
    `buckets`.
    """
    ntz = is_ntz(df, time)
    logs = df.select(user, time)
    if df.isStreaming:
        behind = kept_for(late, retention)
        logs = behind_clock(logs, time, delay, behind)
        found = _judged_on_stream(logs, span, threshold, user, time, buckets, behind)
    else:
        found = _judged_on_table(logs, span, threshold, user, time)
    return found.select(
        user,
        from_micros(F.col("at_us"), ntz and not df.isStreaming).alias("span_start"),
        from_micros(F.col("at_us") + micros(span), ntz and not df.isStreaming).alias("span_end"),
        "count",
    )


def _judged_on_table(df: DataFrame, span: str, threshold: int, user: str, time: str) -> DataFrame:
    """The balance at the end of a log's span is the number of logs in the span.

    The logs of one time are counted before the shuffle. At its own end the span is
    already taken off, so that the opening log does not count.
    """
    length = micros(span)
    logs = (
        df.filter(F.col(time).isNotNull())
        .groupBy(user, as_micros(df, time).alias("at_us"))
        .agg(F.count("*").alias("_n"))
    )
    begin = F.col("at_us")
    return (
        running_balance(logs, user, begin, begin + length, F.col("_n"), length)
        .filter(F.col("ends") & (F.col("balance") > threshold))
        .select(user, (F.col("at") - length).alias("at_us"), F.col("balance").alias("count"))
    )


def _judged_on_stream(
    df: DataFrame, span: str, threshold: int, user: str, time: str, buckets: int, behind: int
) -> DataFrame:
    """State is kept for (user, chunk of time) pairs, so that a user's backlog is spread.

    A chunk also gets the logs up to one span behind it, which its last spans hold.
    """
    length = micros(span)
    width = length * STRETCHES_PER_CHUNK
    logs = df.filter(F.col(time).isNotNull()).withColumn("at_us", as_micros(df, time))
    near = spread(logs, F.col("at_us"), after=length, width=width)
    part = F.pmod(F.xxhash64("at_who"), F.lit(PARTS))
    found = (
        in_buckets(near, user, buckets, "at_chunk")
        .withColumn("at_part", part)
        .groupBy("at_bucket")
        .transformWithStateInPandas(
            SpanBurstProcessor(length, width, threshold, behind),
            outputStructType="at_who string, at_us long, count long",
            outputMode="append",
            timeMode="EventTime",
        )
    )
    return out_of_buckets(found, df, user)
