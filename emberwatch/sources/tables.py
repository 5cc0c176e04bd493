"""The Parquet tables the queries run on."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_as_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The `events` table as logs: who, when and what, with its id and properties."""
    return read_table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("username"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("action"),
        "props",
    )


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a file stream; a pattern as the path lets the table be one file too."""
    schema = read_table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")
