"""Shards of equal bytes by a k-d tree over metadata, split at distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.session import stored

DIMENSIONS = ("lang", "source", "n_chars", "doc_id")

#: The tables of nodes that are broadcast have a row per shard at most.
MOST_SHARDS = 65_536
#: A row's place on a dimension has 31 bits, and 32 more from a hash of the row, so that many
#: rows of one place can be split as well. The median's 63 bits are found 16 (then 15) at a time.
PLACE_BITS, TIE_BITS = 31, 32
_STEPS = (47, 31, 15, 0)
#: Slots are numbered within so many stretches of a shard, then over them.
STRETCHES = 1024


def _positions(docs: DataFrame, meta: DataFrame, dimensions: tuple[str, ...]) -> list[Column]:
    """Numbers and dates scaled from their least to their greatest value, other values hashed."""
    kinds = dict(docs.dtypes)
    numeric = {d: kinds[d] not in ("string", "binary", "boolean") for d in dimensions}
    ends = meta.agg(
        *[f(d).alias(f"{f.__name__}_{d}") for d in dimensions if numeric[d] for f in (F.min, F.max)]
    ).first()
    out = []
    for d in dimensions:
        if numeric[d]:
            low, high = ends[f"min_{d}"], ends[f"max_{d}"]
            wide = (high - low) if high is not None else 0
            share = (F.col(d) - F.lit(low)) / F.lit(wide) if wide else F.lit(0.0)
            place = F.floor(share * F.lit(float(2**PLACE_BITS - 1)))
        else:
            place = F.shiftright(F.crc32(F.col(d).cast("binary")), 32 - PLACE_BITS)
        out.append(F.coalesce(place.cast("long"), F.lit(0).cast("long")).alias(f"at_{d}"))
    return out


def _median(rows: DataFrame) -> DataFrame:
    """For each node the key at which half of its bytes are reached: (node, cut).

    `rows` has node, key, size. A histogram of 16 bits of the key tells which of its bins holds
    the median, the next one splits that bin; sums are made before the shuffle, and a bin
    lighter than a thousandth of its node is not split further.
    """
    heads = stored(
        rows.groupBy("node").agg((F.sum("size") / 2).alias("need"), (F.sum("size") / 1000).alias("little"))
        .select("node", "need", "little", F.lit(0).cast("long").alias("prefix"))
    )
    for shift in _STEPS:
        wide = 63 if shift == 47 else _STEPS[_STEPS.index(shift) - 1]
        inside = rows.join(F.broadcast(heads.select("node", "prefix")), "node").filter(
            F.shiftright("key", wide) == F.col("prefix") if wide < 63 else F.lit(True)
        )
        bins = inside.groupBy("node", F.shiftright("key", shift).alias("bin")).agg(
            F.sum("size").alias("bytes")
        )
        before = Window.partitionBy("node").orderBy("bin")
        heads = stored(
            bins.withColumn("upto", F.sum("bytes").over(before))
            .join(F.broadcast(heads.drop("prefix", "bytes")), "node")
            .filter("upto >= need")
            .groupBy("node")
            .agg(F.min_by(F.struct("bin", "bytes", "upto", "need", "little"), "bin").alias("b"))
            .select(
                "node",
                (F.col("b.need") - F.col("b.upto") + F.col("b.bytes")).alias("need"),
                F.col("b.little").alias("little"),
                F.col("b.bin").alias("prefix"),
                F.col("b.bytes").alias("bytes"),
            )
        )
        cut = F.when(
            F.col("need") * 2 >= F.col("bytes"), F.shiftleft(F.col("prefix") + 1, shift) - 1
        ).otherwise(F.shiftleft("prefix", shift) - 1)
        if heads.filter("bytes > little").isEmpty():
            break
    return heads.select("node", cut.alias("cut"))


def kd_shards(
    docs: DataFrame,
    target_bytes: int | None = None,
    shards: int | None = None,
    dimensions: tuple[str, ...] = DIMENSIONS,
) -> DataFrame:
    """Per row of `docs`: doc_id, size, text_crc32, shard, slot.

    Every node of the tree is split on its widest dimension (its range as a share of the whole
    table's) at the median weighted by size, until no node holds more than `target_bytes`; with
    `shards`, a power of two, the target is the bytes over `shards` and the depth its logarithm.
    Rows of one place are parted by a hash of the row, so a value that holds a third of all rows
    is split like any other. Size is the UTF-8 bytes of the text plus 1, so a null or empty text
    has size 1. Nulls in a dimension come first on it. Repeated rows are rows like any other and
    share a shard; an empty table gives an empty table.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    meta = stored(
        docs.select("doc_id", "text", *[d for d in dimensions if d != "doc_id"]).select(
            "doc_id",
            *[d for d in dimensions if d != "doc_id"],
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        )
    )
    total = meta.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        levels = max(0, -(-total // target_bytes) - 1).bit_length()
    else:
        levels = shards.bit_length() - 1
        if 2**levels != shards:
            raise ValueError("shards must be a power of two")
    if 2**levels > MOST_SHARDS:
        raise ValueError(f"at most {MOST_SHARDS} shards; choose more target_bytes")
    row_hash = F.xxhash64("doc_id", "text_crc32", "size")
    rows = meta.select(
        "doc_id", "size", "text_crc32", row_hash.alias("row_hash"), F.lit(0).alias("node"),
        *_positions(docs, meta, dimensions),
    )
    places = [f"at_{d}" for d in dimensions]
    for _ in range(levels):
        rows = stored(rows)
        widths = [(F.max(p) - F.min(p)).alias(p) for p in places]
        widest = F.greatest(*places)
        chosen = F.coalesce(*[F.when(F.col(p) == widest, F.lit(i)) for i, p in enumerate(places)])
        nodes = stored(rows.groupBy("node").agg(*widths).select("node", chosen.alias("dim")))
        place = F.coalesce(*[F.when(F.col("dim") == i, F.col(p)) for i, p in enumerate(places)])
        tie = F.shiftrightunsigned("row_hash", 64 - TIE_BITS)
        keyed = rows.join(F.broadcast(nodes), "node").withColumn(
            "key", F.shiftleft(place, TIE_BITS) + tie
        )
        cuts = _median(keyed.select("node", "key", "size"))
        after = (F.col("key") > F.col("cut")).cast("int")
        rows = keyed.join(F.broadcast(cuts), "node").withColumn("node", F.col("node") * 2 + after)
        rows = rows.drop("dim", "key", "cut")
    return slots(
        rows.select("doc_id", "size", "text_crc32", "row_hash", F.col("node").alias("shard"))
    ).select("doc_id", "size", "text_crc32", "shard", "slot")


def slots(rows: DataFrame) -> DataFrame:
    """`rows` with `slot`, 0, 1, 2 ... in each shard in the order of `row_hash`.

    A shard is numbered in stretches by the leading bits of the hash, each from the count of
    rows before it, so no task needs a whole shard.
    """
    bits = STRETCHES.bit_length() - 1
    rows = stored(rows.withColumn("stretch", F.shiftrightunsigned("row_hash", 64 - bits)))
    ahead = Window.partitionBy("shard").orderBy("stretch")
    starts = stored(
        rows.groupBy("shard", "stretch").agg(F.count("*").alias("n"))
        .select("shard", "stretch", (F.sum("n").over(ahead) - F.col("n")).alias("start"))
    )
    order = Window.partitionBy("shard", "stretch").orderBy("row_hash", "doc_id", "text_crc32")
    numbered = rows.withColumn("number", F.row_number().over(order) - 1)
    return numbered.join(starts, ["shard", "stretch"]).withColumn(
        "slot", F.col("number") + F.col("start")
    )


def op9_kd_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return kd_shards(docs, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
