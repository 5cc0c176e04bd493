"""Count overlapping stretches of time without copying or pairing rows.

A stretch [begin, end) adds to a balance at its begin and is taken off at its end, so the
running sum over a user's time tells how many stretches are open. Time is cut into chunks,
and a stretch that reaches into the next chunk is carried over the edge: taken up again at
the start of that chunk. A busy user is thus spread over many (user, chunk) groups.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# a chunk is this many stretches long, so that few stretches cross its edge
STRETCHES_PER_CHUNK = 8


def chunk_start(us: Column, width: int) -> Column:
    """Start of the chunk of `width` microseconds that `us` lies in."""
    return us - F.pmod(us, F.lit(width))


def spread(df: DataFrame, at: Column, before: int = 0, after: int = 0, width: int = 1) -> DataFrame:
    """Give each row its chunk, `at_chunk`, and a copy to a chunk it is close to.

    A chunk then also holds the rows up to `before` ahead of it and `after` behind it;
    `at_own` is false for them.
    """
    start = chunk_start(at, width)

    def home(chunk: Column, own: bool) -> Column:
        return F.struct(chunk.alias("at_chunk"), F.lit(own).alias("at_own"))

    homes = [home(start, True)]
    if before:
        homes.append(F.when(at >= start + width - before, home(start + width, False)))
    if after:
        homes.append(F.when(at < start + after, home(start - width, False)))
    return df.select("*", F.inline(F.array_compact(F.array(*homes))))


def running_balance(
    df: DataFrame, user: str, begin: Column, end: Column, amount: Column, longest: int
) -> DataFrame:
    """The steps of the balance: `user`, `at`, `balance`, `next` and whether a stretch `ends`.

    `balance` holds from `at`, with all steps of that very time, up to `next`, the user's
    following step or the end of the chunk. No stretch may be longer than `longest`.
    """
    width = longest * STRETCHES_PER_CHUNK
    first, last = chunk_start(begin, width), chunk_start(end, width)

    def step(chunk: Column, at: Column, change: Column, ends: bool) -> Column:
        return F.struct(
            chunk.alias("chunk"), at.alias("at"), change.alias("change"), F.lit(ends).alias("ends")
        )

    own = [step(first, begin, amount, False), step(last, end, -amount, True)]
    carried = step(last, last, amount, False)
    steps = F.when(first == last, F.array(*own)).otherwise(F.array(*own, carried))
    # the default frame takes in the steps of equal time
    by_time = Window.partitionBy(user, "chunk").orderBy("at")
    return (
        df.select(user, F.inline(steps))
        .withColumn("balance", F.sum("change").over(by_time))
        .withColumn("next", F.coalesce(F.lead("at").over(by_time), F.col("chunk") + width))
        .select(user, "at", "balance", "next", "ends")
    )
