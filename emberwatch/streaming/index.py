"""Write every log that parses to a table that can be searched.

Below the index' folder lie the documents by date and load; the list of live loads (`_live`), which
tells a reader what to read; and, if asked for, for each load the terms that occur in it with the
stretches of rows that hold them (`_terms`).
"""

import time
import uuid
from collections.abc import Iterable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberwatch.functions.text import terms_of
from emberwatch.operators.parse import parse_documents, read_documents
from emberwatch.streaming.live import NO_DATE, LiveList, Load

# fixed values: the epoch seconds a timestamp should hold, from year 1 to year 9999
FIRST_SECOND, LAST_SECOND = -62135596800, 253402300799

# with the unit `auto`, larger numbers are milliseconds: as seconds they lie after year 5000,
# as milliseconds from 1973 on
LARGEST_SECONDS = 100_000_000_000

ID = ["topic", "partition", "offset"]

#: Rows of a load that a term's entry points to together.
SEGMENT = 1024


def _log_time(field: str, unit: str) -> Column:
    """A document's own time: an epoch number, else a time in text, else null."""
    number = F.try_variant_get("doc", f"$.{field}", "decimal(24,6)")
    if unit not in ("s", "ms", "auto"):
        raise ValueError(f"unit must be 's', 'ms' or 'auto', not {unit!r}")
    thousandth = (number / 1000).cast("decimal(24,6)")
    seconds = {
        "s": number,
        "ms": thousandth,
        "auto": F.when(F.abs(number) > LARGEST_SECONDS, thousandth).otherwise(number),
    }[unit]
    return F.when(seconds.between(FIRST_SECOND, LAST_SECOND), F.timestamp_seconds(seconds)).when(
        number.isNull(), F.try_variant_get("doc", f"$.{field}", "timestamp")
    )


def documents(
    df: DataFrame,
    fields: Mapping[str, str],
    time_field: str = "timestamp",
    unit: str = "auto",
) -> DataFrame:
    """Rows of the index from records with `value` and the id columns.

    Besides the whole document, `fields` (name to type) become columns of their own, so
    that a search on them reads only these columns and can skip row groups. `unit` is that
    of a number in `time_field`: `s`, `ms`, or `auto` to tell by its size.
    """
    observed = "index" if df.isStreaming else None
    return _columns(parse_documents(df, observed=observed), fields, time_field, unit)


def _columns(parsed: DataFrame, fields: Mapping[str, str], time_field: str, unit: str) -> DataFrame:
    timed = parsed.withColumn("log_time", _log_time(time_field, unit))
    # the date in UTC, whatever zone a session has
    date = F.date_from_unix_date(F.floor(F.unix_seconds("log_time") / 86400).cast("int"))
    return timed.select(
        *ID,
        "log_time",
        *[F.try_variant_get("doc", f"$.{name}", kind).alias(name) for name, kind in fields.items()],
        "text",
        "doc",
        date.alias("log_date"),
    )


def _write(rows: DataFrame, path: str, load: str, fields: Iterable[str]) -> list[Load]:
    """Write one load; writing the same load again replaces it. Tells the dates it has.

    The rebalance evens out the files by size, also where most rows have one date. Times
    are sorted inside a file and the fields get bloom filters, so that a search skips most
    row groups. Rows are numbered as they lie; so many in a row are a segment, whose number a
    search by terms can look for, and pages end where segments do.
    """
    seen = Observation()
    date = F.coalesce(F.col("log_date").cast("string"), F.lit(NO_DATE))
    writer = (
        rows.observe(seen, F.collect_set(date).alias("dates"))
        .withColumn("load", F.lit(load))
        .hint("rebalance", "log_date")
        .sortWithinPartitions("log_date", "log_time")
        .withColumn("segment", F.expr(f"monotonically_increasing_id() div {SEGMENT}"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .option("parquet.page.row.count.limit", SEGMENT)
    )
    for name in fields:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true")
    writer.partitionBy("log_date", "load").parquet(path)
    try:
        dates = sorted(seen.get["dates"] or [])
    except Py4JJavaError:  # rows that Spark knows to be none are not observed
        dates = LiveList(rows.sparkSession, path).dates_of(path, load)
    return [Load(date, load) for date in dates]


def _write_terms(spark: SparkSession, path: str, loads: Sequence[Load]) -> None:
    """For each date of a load its terms: how many rows hold one, and in which segments."""
    rows = read_loads(spark, path, loads).select("log_date", "load", "segment", terms_of("text").alias("terms"))
    each = rows.select("log_date", "load", "segment", F.explode(F.array_distinct("terms")).alias("term"))
    held = each.groupBy("log_date", "load", "term", "segment").agg(F.count("*").alias("rows"))
    told = held.groupBy("log_date", "load", "term").agg(
        F.sum("rows").alias("rows"), F.sort_array(F.collect_list("segment")).alias("segments")
    )
    (
        told.hint("rebalance", "log_date")
        .sortWithinPartitions("log_date", "term")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("log_date", "load")
        .parquet(f"{path}/_terms")
    )


def read_loads(spark: SparkSession, path: str, loads: Sequence[Load]) -> DataFrame:
    """The rows of the given loads; their folders are named, so none is looked for."""
    folders = [f"{path}/{load.folder}" for load in loads]
    # all loads of an index are alike; the folders' names alone would not tell a null date's type
    kind = spark.read.parquet(folders[0]).schema.add("log_date", "date").add("load", "string")
    return spark.read.schema(kind).option("basePath", path).parquet(*folders)


def _make_live(
    spark: SparkSession, path: str, written: Sequence[Load], terms: bool, instead_of: Sequence[Load] = ()
) -> list[Load]:
    """Count the rows of written loads, add their terms, and show them to readers."""
    if not written:
        return []
    found = read_loads(spark, path, written)
    lengths = F.sum(F.size(terms_of("text"))) if terms else F.lit(0)
    counts = found.groupBy("log_date", "load").agg(F.count("*").alias("rows"), lengths.alias("terms"))
    come = [
        Load(str(r.log_date) if r.log_date else NO_DATE, r.load, r.rows, r.terms)
        for r in counts.collect()
    ]
    if terms:
        _write_terms(spark, path, come)
    LiveList(spark, path).change(come, instead_of)
    return come


def merge_loads(
    spark: SparkSession,
    path: str,
    fields: Iterable[str] = ("username",),
    terms: bool = False,
    dates: Sequence[str] | None = None,
    least: int = 2,
) -> list[Load]:
    """Pack all loads of a date into one, for each date (or the given ones) that has `least`.

    The packed load is sorted by time like any other. Readers see the old loads until all of the
    new one is written, and from then on only that; a merge that is killed before has changed
    nothing. The replaced files stay for readers that have begun: `delete_merged` removes them.
    `fields` and `terms` should be those the index is written with.
    """
    live: dict[str, list[Load]] = {}
    for load in LiveList(spark, path).loads():
        if dates is None or load.date in dates:
            live.setdefault(load.date, []).append(load)
    old = [load for loads in live.values() if len(loads) >= least for load in loads]
    if not old:
        return []
    name = f"merged-{uuid.uuid4().hex}"
    rows = read_loads(spark, path, old).drop("load", "segment")
    come = _make_live(spark, path, _write(rows, path, name, fields), terms, old)
    LiveList(spark, path).shorten()
    return come


def delete_merged(spark: SparkSession, path: str, older_than: float = 86400) -> int:
    """Delete the files of loads that a merge replaced so many seconds ago; tells how many."""
    live = LiveList(spark, path)
    found = live.gone(time.time() - older_than)
    for load in found:
        live.delete(load, path)
        live.delete(load, f"{path}/_terms")
    return len(found)


def index_logs(
    df: DataFrame,
    path: str,
    checkpoint: str | None = None,
    fields: Mapping[str, str] | None = None,
    time_field: str = "timestamp",
    unit: str = "auto",
    load: str | None = None,
    trigger: str | None = None,
    terms: bool = False,
    merge_every: int | None = None,
    rejects: str | None = None,
) -> StreamingQuery | None:
    """Add the records of a table, or endlessly those of a stream, to the index at `path`.

    The index is partitioned by the logs' own date and by load. A micro-batch is a load
    named by query and number, so one that is replayed after a failure replaces itself. A
    table's load may be named to be repeatable in the same way. A record that comes again
    otherwise, as when a new checkpoint starts over, is given once by `search_logs`. The
    progress of a stream's query counts messages and documents under `index`.

    With `terms`, each load also gets a table of its terms, which `search_terms` and
    `ranked_logs` need. A stream may merge its small loads after every so many micro-batches;
    `merge_loads` does it at any time. Into the folder `rejects`, if given, go the messages that
    are no documents, load by load, with the reason.
    """
    fields = {"username": "string"} if fields is None else fields
    rows = documents(df, fields, time_field, unit)
    if rejects is not None:
        rows = read_documents(df)

    def add(rows: DataFrame, name: str) -> None:
        spark = rows.sparkSession
        if rejects is None:
            _make_live(spark, path, _write(rows, path, name, fields), terms)
            return
        # both outputs come from one parse, which is kept while they are written
        both = rows.persist()
        try:
            gone = both.filter("reason IS NOT NULL").select(*ID, "value", "reason", F.lit(name).alias("load"))
            gone.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(rejects)
            taken = _columns(both.filter("reason IS NULL"), fields, time_field, unit)
            _make_live(spark, path, _write(taken, path, name, fields), terms)
        finally:
            both.unpersist()
    if not df.isStreaming:
        name = load or f"table-{uuid.uuid4().hex}"
        add(rows, name)
        return None
    if checkpoint is None:
        raise ValueError("a stream needs a checkpoint folder")

    def write_batch(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        add(batch, f"{query}-{number}")
        if merge_every and number % merge_every == merge_every - 1:
            merge_loads(batch.sparkSession, path, fields, terms)

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    if trigger == "available":
        writer = writer.trigger(availableNow=True)
    elif trigger:
        writer = writer.trigger(processingTime=trigger)
    return writer.start()
