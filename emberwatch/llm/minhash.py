"""Near duplicates by MinHash: banded candidates, pruned batch by batch under Bayesian bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.simhash import connected, shingle_hashes
from emberwatch.llm.text import per_batch
from emberwatch.session import stored

#: Least hashes of a signature, one byte of each kept; how many are compared at a time.
HASHES, BATCH = 128, 32
#: Bands of least hashes: two sets of similarity s share none with chance (1 - s^LEAST)^BANDS,
#: which is 2.7e-5 at 0.8.
BANDS, LEAST = 20, 4
#: Bands of the first pass, which already joins most groups.
FIRST = 2
#: Sets compared with each other in one go, and shingles in them; larger buckets are cut into blocks.
BLOCK, SHINGLES = 4096, 4_000_000
#: Chance at which a pair at the threshold may be given up at each batch.
MISS = 1e-6
#: Shingle hashes taken at a time.
PART = 512

_FACTORS = np.random.default_rng(12).integers(0, 2**64, (HASHES, 1), np.uint64) | np.uint64(1)


# signatures


def shingle_set(text: str | None, size: int = 4) -> np.ndarray:
    """The distinct hashes of a text's runs of `size` words, in order; no words: none."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, ~np.uint64(0))
    for i in range(0, len(hashes), PART):
        least = np.minimum(least, (_FACTORS * hashes[i : i + PART]).min(axis=1))
    return least


def signature(least: np.ndarray) -> bytes:
    return (least >> np.uint64(20)).astype(np.uint8).tobytes()


def bands(least: np.ndarray) -> list[int]:
    """A signed number for each band."""
    rows = least[: BANDS * LEAST].astype("<u8").reshape(BANDS, LEAST)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def mark_of(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def sketches(docs: DataFrame, size: int = 4) -> DataFrame:
    """Per row of `docs`: doc_id, mark, n (the set's size), bands and signature (null if empty)."""

    def tell(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": rows["doc_id"], "mark": [], "n": [], "bands": [], "signature": []}
        for text in rows["text"]:
            hashes = shingle_set(text, size)
            least = least_hashes(hashes) if len(hashes) else None
            out["mark"].append(mark_of(hashes))
            out["n"].append(len(hashes))
            out["bands"].append(None if least is None else bands(least))
            out["signature"].append(None if least is None else signature(least))
        return out

    kinds = "doc_id long, mark binary, n long, bands array<long>, signature binary"
    return per_batch(docs.select("doc_id", "text"), tell, kinds)


# comparing signatures


def _at_most(n: int, p: float, k: int) -> float:
    """Chance of `k` or fewer hits in `n` draws of chance `p`."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def chance_similar(matches: int, n: int, least: float) -> float:
    """Posterior chance that the similarity is `least` or more, after `matches` of `n` bytes.

    Before any byte, each similarity is as likely as any other. Two bytes match if the least
    hashes do, and else with chance 1/256; the chance of a match so lies between 1/256 and 1, and
    its posterior is a beta distribution cut off there, whose tails are sums of binomials.
    """
    other = 1 / 256
    above = _at_most(n + 1, other + (1 - other) * least, matches)
    return above / _at_most(n + 1, other, matches)


def cutoffs(least: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(bytes compared, matches needed to go on) after each batch."""
    told = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = 0
        while chance_similar(m, n, least) < miss:
            m += 1
        told.append((n, m))
    return told


class Sets:
    """The sets of a block with their signatures, in order of their nodes."""

    def __init__(self, roots: np.ndarray, sides: np.ndarray, bands: np.ndarray, at: int,
                 signatures: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
        self.roots, self.sides, self.signatures = roots, sides, signatures
        self.sizes, self.hashes, self.starts = sizes, hashes, np.r_[0, np.cumsum(sizes)]
        # what two sets share in an earlier band was looked at there
        self.earlier = bands[:, :at] if at > 0 else None

    def near(self, j: int, labels: np.ndarray, needed: list[tuple[int, int]], percent: int) -> np.ndarray:
        """Sets before `j` that are not linked with it and may be similar, the most alike first."""
        open_ = (labels[:j] != labels[j]) & (
            100 * np.minimum(self.sizes[:j], self.sizes[j]) >= percent * np.maximum(self.sizes[:j], self.sizes[j]))
        if self.sides is not None:
            open_ &= self.sides[:j] != self.sides[j]
        left = np.flatnonzero(open_)
        if self.earlier is not None and len(left):
            left = left[~(self.earlier[left] == self.earlier[j]).any(axis=1)]
        matches, done = np.zeros(len(left), np.int64), 0
        for n, least in needed:
            if not len(left):
                break
            same = self.signatures[left, done:n] == self.signatures[j, done:n]
            matches, done = matches + np.count_nonzero(same, axis=1), n
            on = matches >= least
            left, matches = left[on], matches[on]
        return left[np.argsort(-matches, kind="stable")]

    def similar(self, j: int, among: np.ndarray, percent: int) -> np.ndarray:
        """Of the sets `among` those with 100 * intersection >= `percent` * union, on the whole sets."""
        own = self.hashes[self.starts[j] : self.starts[j + 1]]
        parts = [self.hashes[self.starts[i] : self.starts[i + 1]] for i in among.tolist()]
        every = np.concatenate(parts)
        place = np.minimum(np.searchsorted(own, every), len(own) - 1)
        ends = np.r_[0, np.cumsum(self.sizes[among])]
        shared = np.add.reduceat(own[place] == every, ends[:-1], dtype=np.int64)
        return among[100 * shared >= percent * (len(own) + self.sizes[among] - shared)]


#: Sets compared exactly at a time.
AT_ONCE = 64


def links_of(sets: Sets, needed: list[tuple[int, int]], percent: int) -> tuple[list[int], list[int]]:
    """Links (i, j) that connect all sets which are similar: fewer than there are sets.

    What links connect already is compared no more, so copies of one text cost one comparison each.
    """
    labels, first, second = np.unique(sets.roots, return_inverse=True)[1], [], []
    for j in range(1, len(labels)):
        left = sets.near(j, labels, needed, percent)
        step = 1  # the most alike alone, for it mostly is similar, then more and more of the others
        while len(left):
            part, left = left[:step], left[step:]
            for i in sets.similar(j, part, percent).tolist():
                if labels[i] != labels[j]:
                    first.append(i)
                    second.append(j)
                    labels[labels == labels[i]] = labels[j]
            left = left[labels[left] != labels[j]]
            step = min(4 * step, AT_ONCE)
    return first, second


def search(placed: DataFrame, percent: int, miss: float) -> DataFrame:
    """Links (a, b) from rows (bucket, low, high, node, root, side, band, bands, signature, hashes).

    Rows of one (bucket, low, high) are a block, in which the links are searched.
    """
    needed = cutoffs(percent / 100, miss)
    keys = ["bucket", "low", "high"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            node, root, side = (rows[name].to_numpy() for name in ("node", "root", "side"))
            hashes = rows["hashes"].combine_chunks()
            bands_ = rows["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            signatures = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(-1, HASHES)
            sets = Sets(root, side if (side != side[0]).any() else None, bands_, rows["band"][0].as_py(),
                        signatures, np.diff(hashes.offsets.to_numpy()).astype(np.int64),
                        hashes.flatten().to_numpy().view(np.uint64))
            i, j = links_of(sets, needed, percent)
            return pa.RecordBatch.from_arrays(
                [pa.array(node[i] if i else [], pa.int64()), pa.array(node[j] if j else [], pa.int64())], ["a", "b"])

        held: list[pa.RecordBatch] = []  # the rows of a block that is not known to be whole
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.column_stack([batch.column(name).to_numpy() for name in keys])
            if held and held[-1].slice(held[-1].num_rows - 1).select(keys) != batch.slice(0, 1).select(keys):
                yield told(pa.Table.from_batches(held))
                held = []
            cuts = np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1
            start = 0
            for end in [*cuts.tolist(), batch.num_rows]:
                held.append(batch.slice(start, end - start))
                if end < batch.num_rows:
                    yield told(pa.Table.from_batches(held))
                    held = []
                start = end
        if held:
            yield told(pa.Table.from_batches(held))

    laid = placed.select(*keys, "node", "root", "side", "band", "bands", "signature", "hashes")
    return laid.repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(look, "a long, b long")


def in_blocks(rows: DataFrame, every: bool) -> DataFrame:
    """Rows (bucket, node, first, parts, ...) placed into the blocks of their bucket.

    A bucket of several parts is cut by a hash of the node. With `every`, each two parts meet, so
    all pairs do, in tasks of bounded size; else each part stays alone but for the bucket's first
    row, which joins all of them: enough to find a group of copies of one text.
    """
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    if every:
        met = rows.withColumn("_with", F.explode(others))
        # two unlike parts meet once, without their own pairs, which are looked at in one place
        return met.withColumns({"low": F.least("side", "_with"), "high": F.greatest("side", "_with")})
    mine = F.when(F.col("node") == F.col("first"), others).otherwise(F.array("side"))
    alone = rows.withColumn("low", F.explode(mine)).withColumn("high", F.col("low"))
    return alone.withColumn("side", F.lit(0))


# sets


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of the rows (node, mark, first_id) of `wanted`."""

    def tell(rows: dict[str, list]) -> dict[str, list]:
        sets = [shingle_set(text, size) for text in rows["text"]]
        return {"_id": rows["doc_id"], "_mark": [mark_of(s) for s in sets],
                "hashes": [s.view(np.int64).tolist() for s in sets]}

    ids = wanted.select(F.col("first_id").alias("doc_id")).distinct()
    few = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    told = per_batch(few, tell, "_id long, _mark binary, hashes array<long>")
    same = (told["_id"] == wanted["first_id"]) & (told["_mark"] == wanted["mark"])
    return told.join(wanted, same).dropDuplicates(["node"]).select("node", "hashes")


def rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, node): each set under its rarest shingles, as many as two similar sets must share.

    Similar sets have `percent` of a set's n shingles in common, so of any n - that + 1 of them one
    at least; the rarest are taken, so what many sets have alike brings none of them together.
    """
    each = stored(sets.select("node", F.size("hashes").alias("_n"), F.explode("hashes").alias("bucket")))
    often = stored(each.groupBy("bucket").agg(F.count("*").alias("_often")))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("_often", "bucket"))
    need = F.col("_n") - F.ceil(F.col("_n") * percent / 100) + 1
    told = each.join(often, "bucket").withColumn("_rank", rank)
    return told.filter((F.col("_rank") <= need) & (F.col("_often") > 1)).select("bucket", "node")


# all of it


class Linker:
    """Finds links between sets, pass after pass; each pass leaves out what is linked already.

    `nodes` has (node, n, bands, signature, hashes).
    """

    def __init__(self, nodes: DataFrame, percent: int, miss: float, block: int):
        self.nodes, self.percent, self.miss, self.block = nodes, percent, miss, block
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def open(self, rows: DataFrame) -> DataFrame:
        """Rows (bucket, band, node) in buckets that hold several roots, with root and parts."""
        if self.roots is None:
            rows = rows.withColumn("root", F.col("node"))
        else:
            rows = rows.join(self.roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = stored(rows.join(self.nodes.select("node", "n"), "node"))
        told = rows.groupBy("bucket").agg(
            F.count("*").alias("_k"), F.sum("n").alias("_n"), F.min("node").alias("first"),
            F.min("root").alias("_low"), F.max("root").alias("_high"))
        parts = F.greatest(
            F.when(F.col("_k") > self.block, F.ceil(F.col("_k") / max(self.block // 2, 1))).otherwise(1),
            F.ceil(F.col("_n") / SHINGLES)).cast("int")
        apart = told.filter("_low <> _high").select("bucket", "first", parts.alias("parts"))
        return stored(rows.drop("n").join(apart, "bucket"))

    def take(self, rows: DataFrame, every: bool = False) -> None:
        """One pass over opened rows: all similar pairs in them are linked, over any number of links."""
        if rows.isEmpty():
            return
        placed = in_blocks(rows, every).join(self.nodes, "node")
        found = stored(search(placed, self.percent, self.miss).distinct())
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.unionByName(found)
            self.roots = stored(connected(self.links).select("node", "root"))

    def run(self, rows: DataFrame) -> None:
        """`rows` are (band, bucket, node)."""
        self.take(self.open(rows.filter(F.col("band") < FIRST)).filter("parts = 1"))
        opened = self.open(rows)
        self.take(opened)
        # a large bucket was searched part by part, which joins groups of copies; if it still holds
        # several roots, it is dealt out anew, by shingles that few sets have
        large = opened.filter("parts > 1").select("bucket", "band", "node")
        if large.isEmpty():
            return
        ids = self.open(large).select("node").distinct()
        sets = self.nodes.select("node", "hashes").join(ids, "node", "left_semi")
        finer = stored(rare_shingles(sets, self.percent).withColumn("band", F.lit(-1)))
        self.take(self.open(finer).filter("parts = 1"))
        self.take(self.open(finer).filter("parts > 1"), every=True)


def near_duplicates(
    docs: DataFrame, size: int = 4, percent: int = 80, miss: float = MISS, block: int = BLOCK
) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    A document's set is its distinct runs of `size` words (words are what ASCII white space parts,
    A-Z in lower case); with fewer words the whole is one run. Sets are linked with
    100 * intersection >= `percent` * union; candidates share a band of least hashes, are given up
    where their signatures leave a chance below `miss`, and are confirmed on the whole sets, in
    the tasks that hold them. The component's id is the smallest doc_id over any number of links. Null, empty and blank texts
    have no set and link nothing. A row without a doc_id links nothing; it has component null and
    is kept, unless a row with an id has the very same set. Rows repeated under one doc_id each
    give a row, by their own text. An empty table gives none.
    """
    marked = stored(sketches(docs, size))
    groups = marked.filter("n > 0 AND doc_id IS NOT NULL").groupBy("mark").agg(
        F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"),
        F.any_value("bands").alias("bands"), F.any_value("signature").alias("signature"),
    )
    nodes = stored(groups.withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    several = banded.groupBy("bucket").count().filter("count > 1").select("bucket")
    rows = stored(banded.join(several, "bucket", "left_semi").select("band", "bucket", "node"))
    wanted = nodes.join(rows.select("node").distinct(), "node", "left_semi")
    sets = sets_of(docs, stored(wanted.select("node", "mark", "first_id")), size)
    held = nodes.select("node", "n", "bands", "signature").join(sets, "node")
    linker = Linker(stored(held), percent, miss, block)
    linker.run(rows)
    placed = nodes.select("mark", "node", "first_id")
    if linker.roots is None:
        named = placed.select("mark", F.col("first_id").alias("component_id"))
    else:
        rooted = stored(placed.join(linker.roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
        named = rooted.select("mark", "root").join(ids, "root").select("mark", "component_id")
    told = marked.select("doc_id", "mark", F.col("n").alias("n_shingles")).join(stored(named), "mark", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return told.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Four-word shingles, similarity 0.8; see `near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"))


OP12_SQL = r"""
    WITH RECURSIVE rows AS (
        SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), words AS (
        SELECT r, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM rows
    ), runs AS (
        SELECT r, hash(t || coalesce(' ' || lead(t, 1) OVER later, '') || coalesce(' ' || lead(t, 2) OVER later, '')
                         || coalesce(' ' || lead(t, 3) OVER later, '')) AS run
        FROM words WINDOW later AS (PARTITION BY r ORDER BY i) QUALIFY i <= greatest(n - 3, 1)
    ), sets AS (
        SELECT r, list_sort(list(DISTINCT run)) AS s FROM runs GROUP BY r
    ), docs AS (
        SELECT r, doc_id, coalesce(s, []) AS s FROM rows LEFT JOIN sets USING (r)
    ), alike AS (
        SELECT s, min(doc_id) AS first_id, len(s) AS n FROM docs WHERE len(s) > 0 GROUP BY s
    ), each AS (
        SELECT first_id, n, unnest(s) AS run FROM alike
    ), links AS (
        SELECT x.first_id AS a, y.first_id AS b
        FROM each x JOIN each y ON x.run = y.run AND x.first_id < y.first_id
        GROUP BY x.first_id, y.first_id, x.n, y.n
        HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
    ), sides AS (
        SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reached AS (
        SELECT first_id AS a, first_id AS b FROM alike
        UNION
        SELECT r.a, l.b FROM reached r JOIN sides l ON l.a = r.b
    ), named AS (
        SELECT a, min(b) AS component_id FROM reached GROUP BY a
    )
    SELECT d.doc_id, len(d.s) AS n_shingles,
           CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE component_id END AS component_id,
           d.doc_id = (CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE component_id END) AS kept
    FROM docs d LEFT JOIN alike ON alike.s = d.s LEFT JOIN named ON named.a = alike.first_id"""
