"""Denied, denied, denied, accessed: a count of failures that an access reads and resets.

Per user, in order of time: the first denial after a reset is an opener and starts a timer
that ends one span later. A reset is an access, or the end of any timer started earlier; a
row at the very end of a timer is still inside. An access with enough denials since the
last reset is an alert. A timer left over from a finished sequence also resets a newer
one, unless `cancel_timers` lets an access stop it.

Which denial is an opener depends on the timers of earlier openers, without limit into the
past. Folding each user's rows in order would put a busy user into one task, so the table
form follows the chains of openers by joins:

* A denial is a *sure* opener when no denial comes right before it within a span.
* Any other denial is an opener exactly if a timer ends between its predecessor and it.
  Each opener's timer so leads to at most one later denial: a *hop*.
* Openers are what can be reached from sure openers by hops. Hops are doubled, so a chain
  of n hops takes log2(n) rounds, each an equal-key join on (user, time).
* With the timers known, counts since the last reset are two running sums.

All ordered work is done in (user, chunk of time) groups with one span of overlap.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from emberwatch.functions.timeparts import (
    as_micros,
    behind_clock,
    from_micros,
    is_ntz,
    kept_for,
    micros,
)
from emberwatch.operators.balance import STRETCHES_PER_CHUNK, spread
from emberwatch.session import stored
from emberwatch.streaming.buckets import BUCKETS, in_buckets, out_of_buckets
from emberwatch.streaming.processors import FollowedBySpanProcessor

def followed_by_span(
    df: DataFrame,
    span: str = "60 seconds",
    threshold: int = 3,
    delay: str = "1 minute",
    cancel_timers: bool = False,
    user: str = "username",
    time: str = "timestamp",
    action: str = "action",
    denied: str = "denied",
    accessed: str = "accessed",
    order: str | None = None,
    buckets: int = BUCKETS,
    late: str = "dropped",
    retention: str = "7 days",
) -> DataFrame:
    """Accesses that follow at least `threshold` denials since the last reset.

    `order` names the column that orders a user's logs of one time, such as an offset;
    without it denials come before accesses. A table is taken in order of (time, order).
    A stream is taken in that order inside a micro-batch and as it arrives across them. Logs
    below the clock, the greatest event time of earlier micro-batches less `delay`, are
    `dropped`; or they are `taken` as they arrive, as long as they are not more than `retention`
    below it: a late denial counts and a late access reads what is there, while timers that the
    clock has passed have ended. The state of the users is kept in so many `buckets`. On a table
    the chains of timers are followed at once, by Spark jobs that keep their steps as tables in
    the checkpoint folder until the driver ends.
    """
    ntz = is_ntz(df, time) and not df.isStreaming
    what = F.col(action)
    rank = F.col(order) if order else what == accessed
    length = micros(span)
    if df.isStreaming:
        logs = df.select(user, time, what.alias("at_action"), rank.alias("at_order"))
        behind = kept_for(late, retention)
        logs = behind_clock(logs, time, delay, behind)
        # other actions go by a generator: a filter would be pushed below the watermark,
        # which all logs are to move
        denial = F.when(F.col("at_action") == denied, F.array(F.lit(True))).when(
            F.col("at_action") == accessed, F.array(F.lit(False))
        )
        found = _on_stream(
            logs.select(user, time, "at_order", F.explode(denial).alias("at_denied")),
            FollowedBySpanProcessor(length, threshold, cancel_timers, behind),
            user,
            time,
            buckets,
        )
    else:
        rows = df.filter(what.isin(denied, accessed) & F.col(time).isNotNull()).select(
            F.col(user).alias("_user"),
            as_micros(df, time).alias("_us"),
            rank.alias("_order"),
            (what == denied).alias("_denied"),
            F.lit(1).alias("_n"),
        )
        if not order:
            # logs of one user, time and action are alike: count them before the shuffle
            rows = rows.groupBy("_user", "_us", "_order", "_denied").agg(F.sum("_n").alias("_n"))
        found = _on_table(rows, length, threshold, cancel_timers)
        found = found.withColumnRenamed("_user", user)
    return found.select(
        user, from_micros(F.col("at_us"), ntz).alias("accessed_at"), "denied_count"
    )


def _on_stream(
    df: DataFrame, processor: FollowedBySpanProcessor, user: str, time: str, buckets: int
) -> DataFrame:
    logs = df.filter(F.col(time).isNotNull()).withColumn("at_us", as_micros(df, time))
    found = (
        in_buckets(logs, user, buckets)
        .groupBy("at_bucket")
        .transformWithStateInPandas(
            processor,
            outputStructType="at_who string, at_us long, denied_count long",
            outputMode="append",
            timeMode="EventTime",
        )
    )
    return out_of_buckets(found, df, user)


def _since_access(in_order: WindowSpec, resets: Column) -> tuple[Column, Column]:
    """Denials so far, and how many of them came up to the last of the `resets` before."""
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.when(F.col("_denied"), F.col("_n")).otherwise(0)).over(so_far)
    base = F.coalesce(F.max(F.when(resets, F.col("_total"))).over(before), F.lit(0))
    return total, base


def _marked(rows: DataFrame, length: int, cancel: bool) -> DataFrame:
    """Denials that are `sure` openers or `maybe` so: (user, time, kind), the one right before.

    With `cancel`, only denials whose timer no access stops are marked.
    """
    width = length * STRETCHES_PER_CHUNK
    near = spread(rows, F.col("_us"), before=length, after=length if cancel else 0, width=width)
    group = Window.partitionBy("_user", "at_chunk")
    in_order = group.orderBy("_us", "_order")
    marked = near.withColumn("_previous", F.lag(F.struct("_us", "_denied")).over(in_order))
    stopped = F.lit(False)
    if cancel:
        backwards = group.orderBy(F.desc("_us"), F.desc("_order")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        stop = F.last(F.when(~F.col("_denied"), F.col("_us")), ignorenulls=True).over(backwards)
        marked = marked.withColumn("_stop", stop)
        stopped = F.coalesce(F.col("_stop") <= F.col("_us") + length, F.lit(False))
    previous = F.col("_previous")
    close = previous["_denied"] & (F.col("_us") - previous["_us"] <= length)
    kind = (
        F.when(~F.col("_denied") | stopped, None)
        .when(previous.isNull() | ~close, "sure")
        .when(F.col("_us") > previous["_us"], "maybe")
    )
    return (
        marked.filter("at_own")
        .select("_user", "_us", kind.alias("_kind"), previous["_us"].alias("_before"))
        .filter(F.col("_kind").isNotNull())
    )


def _hops(nodes: DataFrame, length: int) -> DataFrame:
    """(user, from, to): the timer of an opener at `from` makes the denial at `to` one.

    Unsure denials claim the times from their predecessor to just before themselves;
    these stretches are disjoint, so the next claim after a timer's end is the only one
    that can hold it.
    """
    width = length * STRETCHES_PER_CHUNK
    nodes = nodes.withColumn("_sure", F.col("_kind") == "sure")
    unsure = nodes.filter(~F.col("_sure"))
    claims = spread(
        unsure.select("_user", F.col("_us").alias("_at"), "_us", "_before", "_sure"),
        F.col("_at"),
        after=length,
        width=width,
    )
    ends = spread(
        nodes.select(
            "_user",
            (F.col("_us") + length).alias("_at"),
            "_us",
            F.lit(None).cast("long").alias("_before"),
            "_sure",
        ),
        F.col("_at"),
        width=width,
    )
    # from late to early; a claim at the timer's own end comes after it, for it lies outside
    backwards = (
        Window.partitionBy("_user", "at_chunk")
        .orderBy(F.desc("_at"), F.col("_before").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    claim = F.when(F.col("_before").isNotNull(), F.struct(F.col("_us").alias("to"), "_before"))
    return (
        ends.unionByName(claims)
        .withColumn("_claim", F.last(claim, ignorenulls=True).over(backwards))
        .filter(F.col("_before").isNull() & (F.col("_claim._before") <= F.col("_at")))
        .groupBy("_user", F.col("_us").alias("_from"), F.col("_claim.to").alias("_to"))
        .agg(F.max("_sure").alias("_sure"))
    )


def _same_user() -> Column:
    return F.col("l._user").eqNullSafe(F.col("r._user"))


def _same(left: str, right: str) -> Column:
    return _same_user() & (F.col(left) == F.col(right))


def _openers(nodes: DataFrame, length: int) -> DataFrame:
    """(user, time) of every opener whose timer counts.

    The first table of hops leads one hop on, each further one twice as far as the one
    before; the last is where no chain is longer. Any number of hops is a choice among
    the tables, so the openers are found by taking or leaving each of them in turn.
    """
    hops = stored(_hops(nodes, length))
    known = hops.filter("_sure").select("_user", F.col("_from").alias("_us")).distinct()
    hops = hops.drop("_sure")
    while not hops.isEmpty():
        both = F.array_compact(F.array("l._us", "r._to"))
        known = (
            known.alias("l")
            .join(hops.alias("r"), _same("l._us", "r._from"), "left")
            .select("l._user", F.explode(both).alias("_us"))
            .distinct()
        )
        hops = stored(
            hops.alias("l")
            .join(hops.alias("r"), _same("l._to", "r._from"))
            .select("l._user", "l._from", "r._to")
        )
    sure = nodes.filter(F.col("_kind") == "sure").select("_user", "_us")
    return sure.union(known).distinct()


def _counted(rows: DataFrame, openers: DataFrame, length: int, threshold: int) -> DataFrame:
    """Accesses whose denials since the last reset reach the threshold.

    The denials that count lie within one span before the access, so the overlap of the
    chunks holds them, and the running count less its value at the last reset is theirs.
    """
    timers = openers.select(
        "_user",
        (F.col("_us") + length).alias("_us"),
        F.lit(None).cast(rows.schema["_order"].dataType).alias("_order"),
        F.lit(None).cast("boolean").alias("_denied"),
        F.lit(0).alias("_n"),
    )
    both = rows.withColumn("_timer", F.lit(False)).unionByName(
        timers.withColumn("_timer", F.lit(True))
    )
    near = spread(both, F.col("_us"), before=length, width=length * STRETCHES_PER_CHUNK)
    access = ~F.col("_timer") & ~F.col("_denied")
    in_order = Window.partitionBy("_user", "at_chunk").orderBy("_us", "_timer", "_order")
    total, base = _since_access(in_order, F.col("_timer") | access)
    return (
        near.withColumn("_total", total)
        .withColumn("denied_count", F.col("_total") - base)
        .filter(F.col("at_own") & access & (F.col("denied_count") >= threshold))
        .select("_user", F.col("_us").alias("at_us"), "denied_count")
    )


def _on_table(rows: DataFrame, length: int, threshold: int, cancel: bool) -> DataFrame:
    # read twice, and parsing or scanning the logs is the dear part
    rows = stored(rows)
    nodes = stored(_marked(rows, length, cancel))
    return _counted(rows, _openers(nodes, length), length, threshold)
