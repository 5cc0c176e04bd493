"""Start alerts as streaming queries, and keep them running."""

import logging
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

log = logging.getLogger(__name__)

BatchSink = Callable[[DataFrame, int], None]


def run_alerts(
    alerts: DataFrame,
    checkpoint: str,
    sink: str | BatchSink = "console",
    mode: str = "update",
    trigger: str | None = None,
    name: str | None = None,
    **options: str,
) -> StreamingQuery:
    """Start one streaming query and return it.

    `sink` is a format (`console`, `kafka`, `parquet`, ...) with its `options`, or a
    function of a micro-batch and its number. `mode` is `update` (a window again at every
    change) or `append` (a window once, when it is closed; also for keyword, span and
    sequence alerts). `trigger` is an interval such as `10 seconds`, `available` to take
    what is there and end, or None to go as fast as possible.
    """
    writer = alerts.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if trigger == "available":
        writer = writer.trigger(availableNow=True)
    elif trigger:
        writer = writer.trigger(processingTime=trigger)
    writer = writer.foreachBatch(sink) if callable(sink) else writer.format(sink)
    return writer.options(**options).start()


def notify_per_batch(notify: Callable[[str], None] = print, text: str = "Alert fired") -> BatchSink:
    """A sink that notifies once for each micro-batch with any row in it."""

    def sink(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            notify(text)

    return sink


def print_alerts(tell: Callable[[str], None] = print) -> BatchSink:
    """A sink that tells every alert: its line if it has one, else the row as JSON.

    Rows come to the driver one partition at a time.
    """

    def sink(batch: DataFrame, number: int) -> None:
        line = F.col("alert") if "alert" in batch.columns else F.to_json(F.struct(*batch.columns))
        for row in batch.select(line.alias("line")).toLocalIterator():
            tell(row.line)

    return sink


def alert_log(path: str) -> BatchSink:
    """A sink that keeps each micro-batch in a folder of its own, replaced if replayed.

    Folders are named by query and number, so further queries, and a query that starts over
    with a new checkpoint, add to the same log. `sent` says when a micro-batch was written.
    """

    def sink(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        told = batch.withColumn("sent", F.current_timestamp())
        told.write.mode("overwrite").parquet(f"{path}/query={query or 'table'}/batch={number}")

    return sink


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All alerts of an `alert_log`."""
    return spark.read.parquet(path).drop("query", "batch", "sent")


def latest_alerts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """From an `alert_log` written in update mode, the last value of every alert."""
    sent = spark.read.parquet(path)
    values = [name for name in sent.columns if name not in (*keys, "query", "batch", "sent")]
    order = F.struct("sent", "batch")
    last = sent.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("last"))
    return last.select(*keys, "last.*")


def run_with_retry(
    start: Callable[[], StreamingQuery],
    pause: float = 5.0,
    restarts: int | None = None,
    stop: threading.Event | None = None,
) -> int:
    """Run a query to its end, starting it again after an error; returns the restarts.

    `start` must use one checkpoint, so that each start goes on where the last one
    stopped. Without `restarts` it tries forever. An interrupt, or any other way out,
    stops the query first. Once `stop` is set, by another thread, nothing is started again;
    it ends a pause at once.
    """
    done = 0
    stop = stop or threading.Event()
    try:
        while not stop.is_set():
            query = None
            try:
                query = start()
                query.awaitTermination()
                return done
            except Exception as error:
                if stop.is_set():
                    return done
                if restarts is not None and done >= restarts:
                    raise
                log.error("query failed, starting again in %s s: %s", pause, error)
            finally:
                if query is not None and query.isActive:
                    query.stop()
            done += 1
            stop.wait(pause)
    except KeyboardInterrupt:
        pass
    return done
