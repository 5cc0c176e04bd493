"""Near duplicates by SimHash fingerprints, linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.text import encoded, per_batch
from emberwatch.session import stored

BITS = 64
#: A bucket of more fingerprints than this is dealt out anew by more of its bits.
BUCKET_ROWS = 50_000
#: Children of a node of the index; queries searched together; pairs held at a time.
FANOUT, QUERIES, PAIRS = 16, 4096, 100_000


# fingerprints


def shingle_hashes(text: str | None, size: int = 3) -> list[int]:
    words = encoded(text).lower().split()
    if len(words) <= size:
        runs = [b" ".join(words)] if words else []
    else:
        runs = [b" ".join(run) for run in zip(*(words[i:] for i in range(size)), strict=False)]
    return [xxhash.xxh64_intdigest(run, 42) for run in runs]


def fingerprint(hashes: list[int]) -> int:
    """Bits set in over half of the hashes, as a signed number; no hashes: zero."""
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(octets), 1 << 16):
        part = octets[i : i + (1 << 16)]
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    def tell(rows: dict[str, list]) -> dict[str, list]:
        marks = [fingerprint(shingle_hashes(text, size)) for text in rows["text"]]
        return {"doc_id": rows["doc_id"], "mark": marks}

    return per_batch(docs.select("doc_id", "text"), tell, "doc_id long, mark long")


# the index of one run of buckets


def gray_rank(marks: np.ndarray) -> np.ndarray:
    """Places of the marks in Gray order, where neighbours differ in one bit."""
    rank = marks.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order below nodes that hold the bits all of theirs share.

    A node keeps only shared bits that its parent does not have, so on the way down the
    differences of a query add up, and a group is left as soon as they are too many. Level 0
    are the fingerprints; each bucket ends in one node of the last level.
    """

    def __init__(self, marks: np.ndarray, buckets: np.ndarray):
        self.marks, n = marks, len(marks)
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
        self.root_of = group
        every, some = marks, marks
        self.first = [np.arange(n)]  # of each level: the first fingerprint below a node
        self.child = [np.arange(n)]  # of each level: the first child, on the level below
        shared = [(np.full(n, ~np.uint64(0)), marks)]
        while len(self.first[-1]) > len(starts):
            place = np.arange(len(group)) - np.searchsorted(group, group)
            cut = np.flatnonzero(place % FANOUT == 0)
            every, some = np.bitwise_and.reduceat(every, cut), np.bitwise_or.reduceat(some, cut)
            self.child.append(cut)
            self.first.append(self.first[-1][cut])
            group = group[cut]
            shared.append((~(every ^ some), every))
        self.end = [np.r_[first[1:], n] for first in self.first]
        self.mask, self.bits = [m for m, _ in shared], [b & m for m, b in shared]
        for level in range(len(shared) - 1):
            count = np.diff(np.r_[self.child[level + 1], len(self.first[level])])
            self.mask[level] = self.mask[level] & ~np.repeat(self.mask[level + 1], count)
            self.bits[level] = self.bits[level] & self.mask[level]
        self.parent = np.arange(n)

    def _find(self, nodes: np.ndarray) -> np.ndarray:
        while not np.array_equal(up := self.parent[nodes], nodes):
            nodes = up
        return nodes

    def _unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._find(a), self._find(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)
            a, b = low[low != high], high[low != high]

    def components(self, most: int) -> np.ndarray:
        """For each fingerprint the first of those it is linked to, over any number of links.

        Groups that are already one component with the query are left too: all that counts is
        what is connected.
        """
        top = len(self.first) - 1
        for start in range(0, len(self.marks), QUERIES):
            self.parent = self._find(self.parent)
            one = []  # of each level: the component of a node's fingerprints, -1 if several
            for first in self.first:
                low = np.minimum.reduceat(self.parent, first)
                high = np.maximum.reduceat(self.parent, first)
                one.append(np.where(low == high, low, -1))
            query = np.arange(start, min(start + QUERIES, len(self.marks)))
            todo = [(top, query, self.root_of[query], np.zeros(len(query), np.uint8))]
            while todo:
                level, query, node, apart = todo.pop()
                if len(query) > PAIRS:
                    todo.append((level, query[PAIRS:], node[PAIRS:], apart[PAIRS:]))
                    query, node, apart = query[:PAIRS], node[:PAIRS], apart[:PAIRS]
                differ = (self.marks[query] ^ self.bits[level][node]) & self.mask[level][node]
                apart = apart + np.bitwise_count(differ)
                on = (apart <= most) & (self.end[level][node] > query + 1)
                on &= one[level][node] != self.parent[query]
                query, node, apart = query[on], node[on], apart[on]
                if not level:
                    self._unite(query, node)
                elif len(query):
                    begin = self.child[level][node]
                    ends = np.r_[self.child[level][1:], len(self.first[level - 1])][node]
                    count = ends - begin
                    below = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    todo.append((
                        level - 1,
                        np.repeat(query, count),
                        np.repeat(begin, count) + below,
                        np.repeat(apart, count),
                    ))
        return self._find(self.parent)


def _linked(marks: np.ndarray, buckets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of each fingerprint to the first one of its component in its bucket."""
    order = np.lexsort((gray_rank(marks), buckets))
    marks = marks[order]
    first = GrayIndex(marks, buckets[order]).components(most)
    linked = first != np.arange(len(marks))
    return marks[linked], marks[first[linked]]


# dealing out


def split_masks(mask: int, most: int = 3) -> list[int]:
    """`mask` with one of `most` + 1 stretches of its other bits added, as signed numbers.

    Marks that agree on `mask` and differ in `most` bits agree on one of these as well.
    """
    free = [bit for bit in range(BITS) if not mask >> bit & 1]
    stretches = [free[len(free) * i // (most + 1) : len(free) * (i + 1) // (most + 1)]
                 for i in range(most + 1)]
    masks = [(mask % 2**BITS) | sum(1 << bit for bit in stretch) for stretch in stretches]
    return [m - 2**BITS if m >= 2 ** (BITS - 1) else m for m in masks]


def deal(marks: DataFrame, most: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (mask, fixed, mark): two marks within `most` bits share a bucket (mask, fixed).

    Buckets above `bucket_rows` are dealt out anew by further bits until none is above it; six
    rounds leave 15 free bits, so a bucket cannot stay larger than that.
    """
    ready = None
    todo = marks.select("mark", F.lit(0).cast("long").alias("mask"))
    masks = [0]
    while masks:
        further = {mask: split_masks(mask, most) for mask in masks}
        whole = {m: F.array(*[F.lit(x).cast("long") for x in ms]) for m, ms in further.items()}
        lookup = F.create_map(*[x for m in masks for x in (F.lit(m).cast("long"), whole[m])])
        dealt = stored(
            todo.select("mark", F.explode(lookup[F.col("mask")]).alias("mask"))
            .withColumn("fixed", F.col("mark").bitwiseAND(F.col("mask")))
        )
        large = stored(
            dealt.groupBy("mask", "fixed").count().filter(F.col("count") > bucket_rows).drop("count")
        )
        masks = [] if large.isEmpty() else sorted({m for ms in further.values() for m in ms})
        fine = dealt.join(large, ["mask", "fixed"], "left_anti") if masks else dealt
        ready = fine if ready is None else ready.unionByName(fine)
        if masks:
            todo = dealt.join(large, ["mask", "fixed"], "left_semi").select("mark", "mask")
    return ready


def mark_links(marks: DataFrame, most: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect all marks within `most` bits of each other.

    Not every close pair is listed: within a bucket each mark has at most one link, to the
    first of its component there.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.empty((0, 3), np.int64)

        def links(rows: np.ndarray) -> pa.RecordBatch:
            change = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
            a, b = _linked(rows[:, 2].view(np.uint64), np.r_[0, np.cumsum(change)], most)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"]
            )

        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            kept = np.concatenate([kept, rows])
            if len(kept) > 4 * bucket_rows:
                last = np.flatnonzero((kept[:, :2] != kept[-1, :2]).any(axis=1))
                whole = last[-1] + 1 if len(last) else 0
                if whole:
                    yield links(np.ascontiguousarray(kept[:whole]))
                    kept = kept[whole:]
        if len(kept):
            yield links(np.ascontiguousarray(kept))

    dealt = deal(marks, most, bucket_rows).select("mask", "fixed", "mark")
    ordered = dealt.repartition("mask", "fixed").sortWithinPartitions("mask", "fixed")
    return ordered.mapInArrow(search, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links; nodes joined over any number have one root.

    Each round every node goes to its least neighbour, twice over, and links are drawn anew
    between where their ends went, until none is left.
    """
    links = stored(links.distinct())
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(
            both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node")
        )
        again = least.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = stored(
            least.join(again, "to", "left").select("node", F.coalesce("further", "to").alias("to"))
        )
        if roots is None:
            roots = step.withColumnRenamed("to", "root")
        else:
            moved = roots.join(step, roots["root"] == step["node"], "left")
            roots = stored(moved.select(roots["node"], F.coalesce("to", "root").alias("root")))
        from_a = step.select(F.col("node").alias("a"), F.col("to").alias("new_a"))
        from_b = step.select(F.col("node").alias("b"), F.col("to").alias("new_b"))
        moved = links.join(from_a, "a").join(from_b, "b")
        links = stored(
            moved.filter("new_a <> new_b")
            .select(F.greatest("new_a", "new_b").alias("a"), F.least("new_a", "new_b").alias("b"))
            .distinct()
        )
    return roots if roots is not None else links.select(
        F.col("a").alias("node"), F.col("b").alias("root")
    )


def near_duplicates(
    docs: DataFrame, size: int = 3, most: int = 3, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Per row of `docs`: doc_id, mark (the fingerprint as a signed number), component_id.

    Words are what ASCII white space parts, A-Z in lower case. Null and empty texts have mark
    zero and are linked like any other. A component's id is its smallest doc_id. Rows with a
    null doc_id get a mark, link nothing and have component null, unless a row with an id has
    the same mark. Rows repeated under one doc_id each give a row; empty tables give none.
    """
    marked = stored(fingerprints(docs, size))
    groups = stored(
        marked.filter("doc_id IS NOT NULL").groupBy("mark").agg(F.min("doc_id").alias("first_id"))
    )
    roots = connected(mark_links(groups.select("mark"), most, bucket_rows))
    placed = stored(
        groups.join(roots.withColumnRenamed("node", "mark"), "mark", "left").select(
            "mark", "first_id", F.coalesce("root", "mark").alias("root")
        )
    )
    ids = stored(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = stored(placed.join(ids, "root").select("mark", "component_id"))
    return marked.join(named, "mark", "left").select("doc_id", "mark", "component_id")


def first_of_each(docs: DataFrame, size: int = 3, most: int = 3) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component, all columns.

    Rows without a doc_id stay, as do all rows repeated under one doc_id that stays.
    """
    found = near_duplicates(docs, size, most)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id"
    )
