import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberwatch.llm.kdtree import kd_shards


def checked(docs, **how):
    """Sizes of the shards, after what holds for any sharding."""
    rows = kd_shards(docs, **how).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        texts[r.doc_id].append((len(data) + 1, zlib.crc32(data)))
    told, slots, sizes = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in rows:
        told[r.doc_id].append((r.size, r.text_crc32))
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert {k: sorted(v) for k, v in told.items()} == {k: sorted(v) for k, v in texts.items()}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_equal_bytes(small):
    docs = small["documents"]
    sizes = checked(docs, shards=4)
    assert set(sizes) == {0, 1, 2, 3}
    largest = max(len((r.text or "").encode()) for r in docs.collect()) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 4 * largest


def test_one_value_that_most_rows_hold_is_split(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 > 0, "src0").otherwise("src1").alias("source"), F.lit(9).alias("n_chars"),
    )
    sizes = checked(docs, shards=16)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    assert len(checked(docs, target_bytes=4000)) == 16


def test_odd_rows(odd, nothing):
    assert sum(checked(odd, shards=4).values()) > 0
    assert kd_shards(nothing, shards=16).count() == 0
    assert kd_shards(nothing, target_bytes=100).count() == 0
    with pytest.raises(ValueError):
        kd_shards(odd, shards=6)
