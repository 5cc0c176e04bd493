"""What streams with keyed state are waiting for, read back from their checkpoints.

Spark's own state source reads the maps that the processors keep, so a running query is not asked
and pays nothing. A checkpoint keeps the state of its last hundred micro-batches by default.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.functions.timeparts import from_micros


def _state(spark: SparkSession, checkpoint: str, name: str, batch: int | None) -> DataFrame:
    source = spark.read.format("statestore").option("stateVarName", name)
    if batch is not None:
        source = source.option("batchId", batch)
    return source.load(checkpoint)


def waiting_sequences(
    spark: SparkSession,
    checkpoint: str,
    at: Column | None = None,
    batch: int | None = None,
    user: str = "username",
) -> DataFrame:
    """Users with a timer of `followed_by_span`: (user, denied_count, timers), the name as text.

    `denied_count` are the denials since the last reset and `timers` the times at which timers end.
    Those that end before the time `at` count as ended, also where their state is still to be
    freed. The state is that after micro-batch `batch`, the last one if None.
    """
    held = _state(spark, checkpoint, "users", batch).select(
        F.col("user_map_key.who").alias(user), "user_map_value.n", "user_map_value.ends"
    )
    now = F.unix_micros(at.cast("timestamp")) if at is not None else F.lit(-(2**62))
    live = held.withColumn("left", F.filter("ends", lambda end: end >= now))
    ended = F.size("left") < F.size("ends")
    return live.filter(F.size("left") > 0).select(
        user,
        F.when(ended, 0).otherwise(F.col("n")).alias("denied_count"),
        F.transform(F.array_sort("left"), lambda end: from_micros(end, False)).alias("timers"),
    )


def open_spans(
    spark: SparkSession, checkpoint: str, batch: int | None = None, user: str = "username"
) -> DataFrame:
    """Logs that `span_burst_alert` still needs: (user, logged_at, logs), the name as text.

    A time that is kept for two chunks is told once.
    """
    entry = F.arrays_zip("user_map_value.who", "user_map_value.us", "user_map_value.n")
    held = _state(spark, checkpoint, "logs", batch).select(F.explode(entry).alias("log"))
    told = held.groupBy(F.col("log.who").alias(user), "log.us").agg(F.max("log.n").alias("logs"))
    return told.select(user, from_micros(F.col("us"), False).alias("logged_at"), "logs")


def cleared_sequences(
    spark: SparkSession, checkpoint: str, first: int, last: int, user: str = "username"
) -> DataFrame:
    """Users whose state of `followed_by_span` was there after micro-batch `first` and is gone
    after `last`: (user, denied_count, timers) as they were.
    """
    before = waiting_sequences(spark, checkpoint, batch=first, user=user)
    after = waiting_sequences(spark, checkpoint, batch=last, user=user).select(F.col(user).alias("_user"))
    return before.join(after, F.col(user).eqNullSafe(F.col("_user")), "left_anti")
