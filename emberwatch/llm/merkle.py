"""A manifest of a corpus: hash trees whose blocks are stored in van Emde Boas order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.session import scratch_folder, stored

#: Nodes that share a parent; levels of nodes in a block, so 3^(LEVELS - 1) leaves at most.
ARITY, LEVELS = 3, 9

#: What a leaf of `documents` is the hash of, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

Step = tuple[bytes, bytes, int, int]  # siblings before, siblings after, own place, size of the run


# addresses inside a block


def size_of(height: int) -> int:
    """Nodes of a whole tree of `height` levels."""
    return (ARITY**height - 1) // (ARITY - 1)


def address(height: int, depth: int, index: int) -> int:
    """Where the node `index` of `depth` (the root's is 0) lies in a tree of `height` levels.

    The upper half of the levels is stored first, then each subtree of the lower half, all of
    them laid out in the same way. A walk over any number of levels so stays in few stretches of
    the array, however large the stretches are that a machine reads at once.
    """
    place = 0
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        below = depth - top
        place += size_of(top) + index // ARITY**below * size_of(height - top)
        height, depth, index = height - top, below, index % ARITY**below
    return place


@cache
def addresses(height: int) -> list[list[int]]:
    """`address` of all nodes, by depth."""
    return [[address(height, d, i) for i in range(ARITY**d)] for d in range(height)]


# a block


def digest_of(parts: Iterable[bytes]) -> bytes:
    """Hash of the concatenated digests, all as lowercase hex text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def height_for(leaves: int) -> int:
    """Levels of a tree that ends in one node."""
    height = 1
    while ARITY ** (height - 1) < leaves:
        height += 1
    return height


def block_of(leaves: list[bytes], height: int) -> bytes:
    """The nodes over `leaves` (hex text) in van Emde Boas order, 32 bytes each.

    A last run may be short, down to a single node, which is hashed as well. The array ends
    after the last node there is; gaps are zero.
    """
    where, level = addresses(height), leaves
    nodes = np.zeros((size_of(height), 32), np.uint8)
    last = 0
    for depth in range(height - 1, -1, -1):
        if depth < height - 1:
            level = [digest_of(level[i : i + ARITY]) for i in range(0, len(level), ARITY)]
        at = where[depth][: len(level)]
        nodes[at] = np.frombuffer(bytes.fromhex(b"".join(level).decode()), np.uint8).reshape(-1, 32)
        last = max(last, *at) if len(at) > 1 else max(last, at[0])
    return nodes[: last + 1].tobytes()


class Block:
    """The stored nodes of a block; finds the siblings of a leaf by their addresses."""

    def __init__(self, nodes: bytes, height: int, leaves: int):
        self.nodes, self.height, self.where = nodes, height, addresses(height)
        self.count = [-(-leaves // ARITY ** (height - 1 - d)) for d in range(height)]

    def node(self, depth: int, index: int) -> bytes:
        at = 32 * self.where[depth][index]
        return self.nodes[at : at + 32].hex().encode()

    def steps(self, leaf: int) -> list[Step]:
        """Per level, from the leaf's up to the one below the root, the siblings of its run."""
        found = []
        for depth in range(self.height - 1, 0, -1):
            first = leaf // ARITY * ARITY
            run = range(first, min(first + ARITY, self.count[depth]))
            before = b"".join(self.node(depth, i) for i in run if i < leaf)
            after = b"".join(self.node(depth, i) for i in run if i > leaf)
            found.append((before, after, leaf - first, len(run)))
            leaf //= ARITY
        return found


def proof_of(steps: list[Step]) -> bytes:
    """All siblings, level by level, left to right."""
    return b"".join(before + after for before, after, _, _ in steps)


def turns_of(steps: list[Step]) -> str:
    """Per level two digits: the own place in the run, and the run's size."""
    return "".join(f"{place}{size}" for _, _, place, size in steps)


def folded(leaf: bytes, steps: list[Step]) -> bytes:
    for before, after, _, _ in steps:
        leaf = digest_of((before, leaf, after))
    return leaf


def fold(leaf: str, proof: str, turns: str) -> str:
    """The root that a leaf and its proof lead to; whoever holds the root compares."""
    node, at = leaf.encode(), 0
    siblings = [proof[i : i + 64].encode() for i in range(0, len(proof), 64)]
    for place, size in zip(turns[::2], turns[1::2], strict=True):
        run = siblings[at : at + int(size) - 1]
        at += int(size) - 1
        node = digest_of([*run[: int(place)], node, *run[int(place) :]])
    return node.decode()


# trees as tables


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds `at`, the gapless place of a row among those of its tree, and `total`, their number.

    Rows are sorted over all machines by ranges of (tree, order); where a range begins inside its
    tree is a sum over ranges. So a tree of any size is spread over many tasks.
    """
    keys = [tree, *order]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = stored(laid.withColumn("_row", F.monotonically_increasing_id()))
    laid = laid.withColumn("_range", F.shiftright("_row", 33))
    pieces = laid.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_of")).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n")
    )
    by_tree = Window.partitionBy("_tree")
    before = by_tree.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    pieces = pieces.withColumn("total", F.sum("_n").over(by_tree))
    same = (F.col("_range") == F.col("_of")) & F.col(tree).eqNullSafe(F.col("_tree"))
    placed = laid.join(pieces, same).withColumn("at", F.expr("_row - _first + _before"))
    return placed.drop("_row", "_range", "_tree", "_of", "_first", "_n", "_before")


_BLOCK = "tree string, block long, total long, leaves int, height int, nodes binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of sorted batches as plain tuples, one at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def _blocks(nodes: DataFrame, width: int) -> DataFrame:
    """One row per block of `width` leaves from rows (tree, at, node, total)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(tree, block, total, leaves):
            height = height_for(len(leaves) if total <= width else width)
            row = (tree, block, total, len(leaves), height, block_of(leaves, height))
            names = ["tree", "block", "total", "leaves", "height", "nodes"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        key, leaves = None, []
        for tree, block, total, node in _runs(batches):
            if leaves and key != (tree, block, total):
                yield told(*key, leaves)
                leaves = []
            key = (tree, block, total)
            leaves.append(node.hex().encode())
        if leaves:
            yield told(*key, leaves)

    placed = nodes.select("tree", F.expr(f"at div {width}").alias("block"), "total", "node", "at")
    placed = placed.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    return placed.select("tree", "block", "total", "node").mapInArrow(build, _BLOCK)


def grow(nodes: DataFrame, width: int, folder: str) -> list[DataFrame]:
    """Blocks over rows (tree, at, node, total), then over the blocks' roots, until none is left.

    The blocks of each round are a table below `folder`; rounds are few, for each one has
    `width` times fewer nodes than the one before.
    """
    rounds: list[DataFrame] = []
    while True:
        path = f"{folder}/round{len(rounds)}"
        _blocks(nodes, width).write.parquet(path)
        rounds.append(nodes.sparkSession.read.schema(_BLOCK).parquet(path))
        nodes = rounds[-1].filter(F.col("total") > width).select(
            "tree", F.col("block").alias("at"), F.substring("nodes", 1, 32).alias("node"),
            F.ceil(F.col("total") / width).alias("total"),
        )
        if nodes.isEmpty():
            return rounds


def roots_of(rounds: list[DataFrame], width: int) -> DataFrame:
    """(tree, node) of the root of each tree."""
    tops = None
    for blocks in rounds:
        top = blocks.filter(F.col("total") <= width).select("tree", F.substring("nodes", 1, 32).alias("node"))
        tops = top if tops is None else tops.unionByName(top)
    return tops


_STEPS = "array<struct<before:binary,after:binary,place:int,size:int>>"


def _as_steps(told: list[dict]) -> list[Step]:
    return [(s["before"], s["after"], s["place"], s["size"]) for s in told]


def _under(rounds: list[DataFrame], width: int, above: DataFrame) -> DataFrame:
    """The blocks of the first round with `steps`, the way from their root up to the very top.

    `above` has (tree, steps, top): the way from the tree's own root on. From the last round to
    the first, each block gives its leaves, the blocks below, the way it came itself.
    """

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary()),
                                   ("place", pa.int32()), ("size", pa.int32())]))
        for tree, block, leaves, height, nodes, steps, top in _runs(batches):
            held, onward = Block(nodes, height, leaves), _as_steps(steps)
            for start in range(0, leaves, 1000):
                part = range(start, min(start + 1000, leaves))
                ways = [[dict(zip(("before", "after", "place", "size"), s, strict=True))
                         for s in held.steps(i) + onward] for i in part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(part), pa.string()),
                     pa.array([block * width + i for i in part], pa.int64()),
                     pa.array(ways, kind), pa.array([top] * len(part), pa.binary())],
                    ["_tree", "_block", "steps", "top"],
                )

    found = None
    for number in range(len(rounds) - 1, -1, -1):
        blocks = rounds[number]
        own = F.col("tree").eqNullSafe(F.col("_tree"))
        ready = blocks.filter(F.col("total") <= width).join(
            above.withColumnRenamed("tree", "_tree"), own
        ).drop("_tree")
        if found is not None:
            lower = blocks.filter(F.col("total") > width)
            same = own & (F.col("block") == F.col("_block"))
            ready = ready.unionByName(lower.join(found, same).drop("_tree", "_block"))
        if number:
            told = ready.select("tree", "block", "leaves", "height", "nodes", "steps", "top")
            found = stored(told.mapInArrow(
                descend, f"_tree string, _block long, steps {_STEPS}, top binary"))
    return ready


# the manifest


@dataclass(frozen=True)
class Manifest:
    """Tables of a corpus' trees: one tree per value of a column, and one over their roots.

    `leaves` has rows (key, tree, leaf, at, total, and what was asked to be kept); `trees` and
    `over` are blocks by round; `root` is the hash of all, None for an empty corpus.
    """

    leaves: DataFrame
    trees: list[DataFrame]
    over: list[DataFrame]
    tops: DataFrame
    root: str | None
    width: int


def leaf_of(fields: Iterable[Column]) -> Column:
    """Hash of the fields in turn: `-` for a null, else the UTF-8 byte count, `:` and the value."""
    told = []
    for field in fields:
        text = field.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*told).cast("binary"), 256)


def build_manifest(
    rows: DataFrame, width: int = ARITY ** (LEVELS - 1), folder: str | None = None
) -> Manifest:
    """The manifest of rows (key, tree, leaf, ...): `leaf` a hex digest, `tree` a string or null.

    Leaves of a tree ascend by (key, leaf), nulls first, so rows repeated under one key have a
    place each and a defined root; trees ascend by name as bytes, null first. Other columns are
    kept beside the leaf. An empty table gives a manifest without a root. The tables go to
    `folder`, else to the shared scratch folder.
    """
    spark = rows.sparkSession
    folder = folder or scratch_folder(spark)
    rows = stored(rows.withColumn("leaf", F.unhex("leaf")))
    leaves = ranked(rows, "tree", ["key", "leaf"])
    leaves.write.parquet(f"{folder}/leaves")
    leaves = spark.read.schema(leaves.schema).parquet(f"{folder}/leaves")
    nodes = leaves.select("tree", "at", F.col("leaf").alias("node"), "total")
    trees = grow(nodes, width, f"{folder}/trees")
    tops = stored(roots_of(trees, width))
    named = ranked(tops.withColumn("all", F.lit("")), "all", ["tree"])
    named = stored(named.select(F.col("all").alias("tree"), "at", "node", "total", F.col("tree").alias("name")))
    over = grow(named.drop("name"), width, f"{folder}/over")
    root = roots_of(over, width).first()
    return Manifest(leaves, trees, over, named, root["node"].hex() if root else None, width)


def prove(manifest: Manifest, leaves: DataFrame | None = None, claimed: str | None = None) -> DataFrame:
    """Per leaf: key, leaf, top (its tree's root), proof, turns and the root they fold to.

    `leaves` are rows of `manifest.leaves` (all of them by default). `proof` holds the siblings
    level by level up to the root of all, `turns` the own place and the run's size per level, as
    `fold` takes them. With `claimed`, a column of hex digests of `leaves`, the fold starts from
    that digest where it is not null: it meets the manifest's root only if nothing was changed.
    """
    leaves = manifest.leaves if leaves is None else leaves
    width = manifest.width
    nothing = leaves.sparkSession.range(1).select(
        F.lit("").alias("tree"), F.array().cast(_STEPS).alias("steps"), F.lit(b"").alias("top"))
    first = stored(_under(manifest.over, width, nothing))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("key", pa.int64()), ("leaf", pa.string()), ("top", pa.string()),
                 ("proof", pa.string()), ("turns", pa.string()), ("folded", pa.string())]
        held = onward = top = None

        def told(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [name for name, _ in kinds])

        out: list[tuple] = []
        for at, key, other, count, height, nodes, steps, above in _runs(batches):
            if nodes is not None:
                held, onward, top = Block(nodes, height, count), _as_steps(steps), above.hex()
                continue
            index = at % width
            leaf = held.node(held.height - 1, index)
            way = held.steps(index) + onward
            start = leaf if other is None else other.encode()
            out.append((key, leaf.decode(), top, proof_of(way).decode(), turns_of(way),
                        folded(start, way).decode()))
            if len(out) == 1000:
                yield told(out)
                out = []
        if out:
            yield told(out)

    def on_leaves(blocks: DataFrame, rows: DataFrame, kinds: str, task) -> DataFrame:
        """Blocks and, after each of them, the rows that ask for one of its leaves."""
        asked = rows.select(
            "tree", F.expr(f"at div {width}").alias("block"), "at", "key", "other",
            *[F.lit(None).cast(k).alias(n) for n, k in (
                ("leaves", "int"), ("height", "int"), ("nodes", "binary"), ("steps", _STEPS),
                ("top", "binary"))],
        )
        told = blocks.select(
            "tree", "block", F.lit(-1).cast("long").alias("at"),
            F.lit(None).cast("long").alias("key"), F.lit(None).cast("string").alias("other"),
            "leaves", "height", "nodes", "steps", "top",
        )
        both = told.unionByName(asked).repartition("tree", "block")
        both = both.sortWithinPartitions("tree", "block", "at")
        return both.drop("tree", "block").mapInArrow(task, kinds)

    # the way from each tree's root to the root of all, then from each leaf to there
    def upward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary()),
                                   ("place", pa.int32()), ("size", pa.int32())]))
        held = onward = None
        for at, _, _, count, height, nodes, steps, _ in _runs(batches):
            if nodes is not None:
                held, onward = Block(nodes, height, count), _as_steps(steps)
                continue
            way = [dict(zip(("before", "after", "place", "size"), s, strict=True))
                   for s in held.steps(at % width) + onward]
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([way], kind)], ["_at", "steps"])

    names = manifest.tops.select("tree", "at", F.lit(None).cast("long").alias("key"),
                                 F.lit(None).cast("string").alias("other"))
    ways = on_leaves(first, names, f"_at long, steps {_STEPS}", upward)
    above = manifest.tops.join(ways, F.col("at") == F.col("_at"))
    above = stored(above.select(F.col("name").alias("tree"), "steps", F.col("node").alias("top")))
    under = stored(_under(manifest.trees, width, above))
    asked = leaves.withColumn("other", F.col(claimed) if claimed else F.lit(None).cast("string"))
    kinds = "key long, leaf string, top string, proof string, turns string, folded string"
    return on_leaves(under, asked, kinds, walk)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and what tampered texts would fold to.

    Null fields are told from empty ones; rows repeated under one doc_id are leaves of their own;
    a null doc_id or source comes first. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tampered = F.replace("text", F.lit("\n"), F.lit(""))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf_of([tampered if name == "text" else F.col(name) for name in FIELDS])
    rows = docs.select(
        F.col("doc_id").alias("key"), F.col("source").alias("tree"),
        leaf_of(F.col(name) for name in FIELDS).alias("leaf"),
        F.when(even & F.contains("text", F.lit("\n")), changed).alias("other"),
    )
    manifest = build_manifest(rows)
    told = prove(manifest, claimed="other")
    root = F.lit(manifest.root)
    return told.select(
        F.col("key").alias("doc_id"), "leaf", F.col("top").alias("subroot"), root.alias("root"),
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(name) for name in FIELDS[:-1]) + " || {})"
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''),
            lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
            lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""

OP11_SQL = f"""
    WITH RECURSIVE leaves AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY source) AS n
        FROM (SELECT doc_id, source, {_LEAF.format(_FIELD.format("text"))} AS leaf,
                     CASE WHEN {_CRC.format("doc_id")} % 2 = 1
                          THEN {_LEAF.format(_FIELD.format("replace(text, chr(10), '')"))}
                     END AS other
              FROM documents)
    ), nodes AS (
        SELECT source, 0 AS level, pos, n, leaf AS node FROM leaves
        UNION ALL
        SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3, n
    ), tops AS (
        SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
               count(*) OVER () AS n FROM nodes WHERE n = 1
    ), over_nodes AS (
        SELECT 0 AS level, pos, n, node FROM tops
        UNION ALL
        SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos))
        FROM over_nodes WHERE n > 1 GROUP BY level, pos // 3, n
    ), walk AS (
        SELECT row_number() OVER () AS id, doc_id, leaf, source, pos, n, 0 AS level,
               coalesce(other, leaf) AS folded, '' AS proof FROM leaves
        UNION ALL
        SELECT w.id, w.doc_id, w.leaf, w.source, w.pos // 3, (w.n + 2) // 3, w.level + 1,
               sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.folded ELSE s.node END, '' ORDER BY s.pos)),
               w.proof || coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (WHERE s.pos <> w.pos), '')
        FROM walk w JOIN nodes s ON s.source IS NOT DISTINCT FROM w.source AND s.level = w.level
                                AND s.pos // 3 = w.pos // 3
        WHERE w.n > 1
        GROUP BY w.id, w.doc_id, w.leaf, w.source, w.pos, w.n, w.level, w.folded, w.proof
    ), climb AS (
        SELECT w.id, w.doc_id, w.leaf, t.node AS subroot, t.pos, t.n, 0 AS level, w.folded, w.proof
        FROM walk w JOIN tops t ON t.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
        UNION ALL
        SELECT w.id, w.doc_id, w.leaf, w.subroot, w.pos // 3, (w.n + 2) // 3, w.level + 1,
               sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.folded ELSE s.node END, '' ORDER BY s.pos)),
               w.proof || coalesce(string_agg(s.node, '' ORDER BY s.pos) FILTER (WHERE s.pos <> w.pos), '')
        FROM climb w JOIN over_nodes s ON s.level = w.level AND s.pos // 3 = w.pos // 3
        WHERE w.n > 1
        GROUP BY w.id, w.doc_id, w.leaf, w.subroot, w.pos, w.n, w.level, w.folded, w.proof
    )
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
           folded = root AS verified
    FROM climb, (SELECT node AS root FROM over_nodes WHERE n = 1) WHERE n = 1"""
