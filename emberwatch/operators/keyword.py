"""Alert on logs that contain a word."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_alert(df: DataFrame, word: str = "threat", column: str = "value") -> DataFrame:
    """Rows whose text contains `word`, case-sensitively and anywhere in the text.

    A binary column (a Kafka value) is read as a string. On a string column the test is
    pushed down to Parquet.
    """
    text = F.col(column)
    if df.schema[column].dataType.typeName() == "binary":
        df = df.withColumn(column, text.cast("string"))
    return df.filter(text.contains(word))
