"""Keep the state of many users under one key.

Calling Python and its state once per user costs far more than a user's few rows, so users
are put into buckets by hash and a processor works on all users of a bucket at once. The
number of buckets is part of a query's state: a query keeps the number its checkpoint
began with.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# enough for about a thousand tasks; each bucket costs some milliseconds per micro-batch
BUCKETS = 1024


def in_buckets(df: DataFrame, user: str, buckets: int, *also: str) -> DataFrame:
    """Add `at_who`, the user as text, and `at_bucket`, by the user and the columns `also`."""
    return df.withColumns(
        {
            "at_who": F.col(user).cast("string"),
            "at_bucket": F.pmod(F.hash(user, *also), F.lit(buckets)),
        }
    ).drop(user)


def out_of_buckets(found: DataFrame, df: DataFrame, user: str) -> DataFrame:
    """Give `at_who` the name and type back that the user has in `df`."""
    who = F.col("at_who").cast(df.schema[user].dataType).alias(user)
    return found.select(who, *[name for name in found.columns if name != "at_who"])
