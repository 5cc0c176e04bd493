"""Logs from a Kafka topic."""

from pyspark.sql import DataFrame, SparkSession


def kafka_logs(
    spark: SparkSession,
    servers: str,
    topic: str = "logs",
    start: str | None = None,
    stream: bool = True,
    max_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """The topic's records as an endless stream, or (`stream=False`) what it holds now.

    `start` is `earliest` or `latest`, or Spark's JSON of offsets; if not given, a stream
    starts at the latest record and a table at the earliest. A restarted query goes on from
    its checkpoint instead. `max_per_trigger` bounds a micro-batch, and so a busy
    user's share of it. Needs the spark-sql-kafka package; further options, such as
    `minPartitions`, go to the source as they are.
    """
    start = start or ("latest" if stream else "earliest")
    if not stream and start == "latest":
        raise ValueError("a table of what the topic holds cannot start at `latest`")
    reader = spark.readStream if stream else spark.read
    reader = (
        reader.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", start)
    )
    if stream and max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.options(**options).load()
