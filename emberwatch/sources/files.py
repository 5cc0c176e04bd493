"""Logs from files, and logs made into messages again."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_logs(
    spark: SparkSession,
    path: str,
    schema: str | None = None,
    stream: bool = True,
    max_files: int | None = None,
    **options: str,
) -> DataFrame:
    """Lines of text files as a `value` column, or Parquet files of the given `schema`.

    A stream takes new files of the folder in the order they came, `max_files` at a time.
    """
    reader = spark.readStream if stream else spark.read
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    reader = reader.options(**options)
    if schema is None:
        return reader.text(path)
    return reader.schema(schema).parquet(path)


def as_envelope(
    df: DataFrame,
    fields: Sequence[str],
    topic: str = "logs",
    offset: str | None = None,
    time: str | None = None,
) -> DataFrame:
    """Rows as JSON messages of the Kafka record's shape, ready for a Kafka sink.

    `offset` and `time` name the columns that stand for the record's own offset and time;
    without an offset the messages have no place in the topic yet.
    """
    value = F.to_json(F.struct(*fields)).cast("binary")
    columns = [value.alias("value"), F.lit(topic).alias("topic")]
    if offset:
        columns += [F.lit(0).alias("partition"), F.col(offset).cast("long").alias("offset")]
    if time:
        columns.append(F.col(time).cast("timestamp").alias("timestamp"))
    return df.select(*columns)
