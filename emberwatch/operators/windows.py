"""Alerts that count logs per user in fixed time windows, on tables and streams alike.

On a stream the rows below the watermark are dropped. In update mode a window is sent
again whenever its count changes; in append mode once, when the watermark closes it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.functions.timeparts import (
    as_micros,
    from_micros,
    is_ntz,
    micros,
    readable_time,
    watermarked,
)
from emberwatch.operators.balance import running_balance
from emberwatch.streaming.buckets import BUCKETS, in_buckets, out_of_buckets
from emberwatch.streaming.processors import ClosingWindowProcessor


def _flat(df: DataFrame, user: str, *counts: str) -> DataFrame:
    return df.select(
        user,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *counts,
    )


def burst_alert(
    df: DataFrame,
    window: str = "10 minutes",
    threshold: int = 2,
    delay: str = "10 minutes",
    user: str = "username",
    time: str = "timestamp",
) -> DataFrame:
    """Users with more than `threshold` logs in a tumbling window."""
    logs = watermarked(df.select(user, time), time, delay)
    counts = logs.groupBy(F.window(time, window), user).agg(F.count("*").alias("count"))
    return _flat(counts.filter(F.col("count") > threshold), user, "count")


def sliding_burst_alert(
    df: DataFrame,
    window: str = "10 minutes",
    slide: str = "1 minute",
    threshold: int = 2,
    delay: str = "7 days",
    user: str = "username",
    time: str = "timestamp",
) -> DataFrame:
    """Users with more than `threshold` logs in a window that moves by `slide`.

    A stream uses Spark's own sliding window, which state and watermark understand;
    `delay` is how late a log may still change its windows. On a table a log is not copied
    to each of its windows: it counts as a stretch of window starts, and windows are made
    only where enough stretches overlap.
    """
    logs = watermarked(df.select(user, time), time, delay)
    if micros(slide) > micros(window):
        raise ValueError(f"slide {slide!r} is longer than window {window!r}")
    if df.isStreaming:
        counts = logs.groupBy(F.window(time, window, slide), user).agg(F.count("*").alias("count"))
        return _flat(counts.filter(F.col("count") > threshold), user, "count")
    return _slid_on_table(logs, micros(window), micros(slide), threshold, user, time)


def closing_burst_alert(
    df: DataFrame,
    window: str = "10 minutes",
    slide: str = "1 minute",
    threshold: int = 2,
    delay: str = "0 seconds",
    lateness: str = "7 days",
    user: str = "username",
    time: str = "timestamp",
    order: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Users with more than `threshold` logs in a sliding window, sent when the window closes.

    On a stream a window closes when the clock, the greatest event time of earlier micro-batches
    less `delay`, reaches its end; nothing is sent before. Each log that comes later sends each
    closed window it lies in once more, with the count up to it and `refired` set, until the clock
    is `lateness` past the window's end; from then on logs count in that window no more. Late logs
    of one micro-batch are taken in order of (time, `order`). Counts are kept per user and pane of
    time, in so many `buckets`. On a table all logs have come, so each window is sent once.
    """
    if not df.isStreaming:
        alerts = sliding_burst_alert(df, window, slide, threshold, user=user, time=time)
        return alerts.withColumn("refired", F.lit(False))
    wide, step, late, wait = micros(window), micros(slide), micros(lateness), micros(delay)
    if step > wide:
        raise ValueError(f"slide {slide!r} is longer than window {window!r}")
    if any(length % 1000 for length in (wide, step, late, wait)):
        raise ValueError("window, slide, lateness and delay must be whole milliseconds")
    # a log may come so late that all its windows are past their lateness: below that none counts
    behind = late + wide
    rank = F.col(order) if order else F.lit(0)
    logs = watermarked(df.select(user, time, rank.alias("at_order")), time, f"{(behind + wait) // 1000} milliseconds")
    logs = logs.filter(F.col(time).isNotNull()).withColumn("at_us", as_micros(logs, time))
    found = (
        in_buckets(logs, user, buckets)
        .groupBy("at_bucket")
        .transformWithStateInPandas(
            ClosingWindowProcessor(wide, step, threshold, late, behind),
            outputStructType="at_who string, at_us long, count long, refired boolean",
            outputMode="append",
            timeMode="EventTime",
        )
    )
    return out_of_buckets(found, df, user).select(
        user,
        F.timestamp_micros("at_us").alias("window_start"),
        F.timestamp_micros(F.col("at_us") + wide).alias("window_end"),
        "count",
        "refired",
    )


def _slid_on_table(
    df: DataFrame, window: int, slide: int, threshold: int, user: str, time: str
) -> DataFrame:
    ntz = is_ntz(df, time)
    us = as_micros(df, time)
    # the windows with the log start from the first multiple of slide after us - window
    # up to the last one that is not after us
    stretches = (
        df.filter(F.col(time).isNotNull())
        .groupBy(
            user,
            (us - window - F.pmod(us - window, F.lit(slide)) + slide).alias("_begin"),
            (us - F.pmod(us, F.lit(slide)) + slide).alias("_end"),
        )
        .agg(F.count("*").alias("_n"))
    )
    # all begins and ends, and so the chunk's edges, must be multiples of slide
    longest = slide * -(-window // slide)
    steps = running_balance(stretches, user, F.col("_begin"), F.col("_end"), F.col("_n"), longest)
    starts = F.explode(F.sequence("at", F.col("next") - slide, F.lit(slide)))
    return (
        steps.filter((F.col("balance") > max(threshold, 0)) & (F.col("next") > F.col("at")))
        .select(user, starts.alias("_start"), F.col("balance").alias("count"))
        .select(
            user,
            from_micros(F.col("_start"), ntz).alias("window_start"),
            from_micros(F.col("_start") + window, ntz).alias("window_end"),
            "count",
        )
    )


def followed_by_window(
    df: DataFrame,
    window: str = "1 minute",
    failures: int = 5,
    successes: int = 1,
    delay: str = "1 minute",
    user: str = "username",
    time: str = "timestamp",
    action: str = "login_action",
    failed: str = "failed",
    success: str = "success",
) -> DataFrame:
    """Users with at least so many failures and successes in one tumbling window.

    Only the counts inside the window decide, not the order of the logs.
    """
    logs = watermarked(df.select(user, time, action), time, delay)
    if not df.isStreaming and failures + successes > 0:
        # on a stream every log moves the watermark, so there all rows stay
        logs = logs.filter(F.col(action).isin(failed, success))
    counts = logs.groupBy(F.window(time, window), user).agg(
        F.count(F.when(F.col(action) == failed, 1)).alias("failed_count"),
        F.count(F.when(F.col(action) == success, 1)).alias("success_count"),
    )
    alerts = counts.filter(
        (F.col("failed_count") >= failures) & (F.col("success_count") >= successes)
    )
    return _flat(alerts, user, "failed_count", "success_count")


def echo_events(
    df: DataFrame,
    received: Column | None = None,
    zone: str = "Asia/Kathmandu",
    user: str = "username",
    time: str = "timestamp",
) -> DataFrame:
    """One line per log: when it was received, whose it is and its own time."""
    received = F.current_timestamp() if received is None else received
    return df.select(
        user,
        time,
        F.format_string(
            "received @%s => %s, %s",
            readable_time(received, zone),
            F.col(user).cast("string"),
            readable_time(F.col(time), zone),
        ).alias("line"),
    )
