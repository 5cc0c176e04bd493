"""A corpus made ready for training: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.bpe import bpe_digests
from emberwatch.llm.contamination import decontaminate
from emberwatch.llm.lines import dedup_lines
from emberwatch.llm.simhash import first_of_each
from emberwatch.llm.toxicity import without_toxic
from emberwatch.session import stored


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a score of 0.7 or more go; the labels beside the corpus train the scores.

    A null text is scored as an empty one.
    """
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    return without_toxic(docs, labels)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that three documents or more share stay in one; `n_chars` follows the text.

    A null text becomes an empty one. Other columns stay, whatever their names.
    """
    kept = dedup_lines(docs, counts=False)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of near copies the document with the smallest id stays.

    Linked are fingerprints of three-word shingles that differ in three bits of 64 or fewer; null
    and empty texts are alike. Rows without a doc_id stay.
    """
    return first_of_each(docs, size=3, most=3)


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark text go; null texts have no words."""
    return decontaminate(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded text."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages on the documents; each is written as a table that the next one reads."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)


#: The first stage learns its scores from labels, which SQL cannot express.
ORACLE_SQL = None
