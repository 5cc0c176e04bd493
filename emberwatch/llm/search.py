"""Ranked lexical search: impact vectors by length, pruned by length and by coordinates."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.text import encoded, per_batch
from emberwatch.session import stored

#: Words are runs of ASCII letters and digits and of all that is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: UTF-8 bytes of the items searched for at a time; more of them are taken in further blocks.
BLOCK_BYTES = 4_000_000
#: Vectors of a bucket at most, and how short the last may be against the first.
BUCKET, SHORTEST = 4096, 0.9
#: Coordinates of an item that the bounds look at; the share of the longest vectors that is
#: searched first, to know from which score on a document counts.
FOCUS, LONGEST = 6, 0.02
#: Floating point bounds are widened by this much.
SLACK = 1 + 1e-9
#: Stands for a null id, which comes after all others.
NO_ID = 2**63 - 1


def terms_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case (bytes know ASCII only)."""
    return TERM.findall(encoded(text).lower())


# items


@dataclass(frozen=True)
class Items:
    """A block of items: their words numbered, and each item's words with how often they occur."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    words: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]]) -> Items:
        vocabulary: dict[bytes, int] = {}
        words = []
        for _, text in rows:
            often = Counter(terms_of(text))
            numbers = [vocabulary.setdefault(term, len(vocabulary)) for term in often]
            words.append((np.array(numbers, np.int64), np.array(list(often.values()), np.int64)))
        return Items([item for item, _ in rows], vocabulary, words)


def blocks_of(items: DataFrame, most: int) -> Iterator[Items]:
    """The items in blocks of about `most` bytes by a hash of their text, one at a time."""
    sized = items.select("item_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("_bytes"))
    total = sized.agg(F.sum("_bytes")).first()[0] or 0
    parts = max(1, math.ceil(total / most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for number in range(parts):
        rows = sized.filter(part == number).select("item_id", "text").collect()
        if rows:
            yield Items.of([tuple(row) for row in rows])


# vectors


def counted(docs: DataFrame, items: Items) -> DataFrame:
    """Per row of `docs` with a word: doc_id, n (its words), and its words that the items hold."""
    vocabulary = items.vocabulary

    def count(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"doc_id": [], "n": [], "words": [], "often": []}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            terms = terms_of(text)
            if not terms:
                continue
            told = [(vocabulary[t], k) for t, k in Counter(terms).items() if t in vocabulary]
            out["doc_id"].append(doc_id)
            out["n"].append(len(terms))
            out["words"].append([t for t, _ in told])
            out["often"].append([k for _, k in told])
        return out

    kinds = "doc_id long, n long, words array<int>, often array<int>"
    return per_batch(docs.select("doc_id", "text"), count, kinds)


def impact(often: int, n: int, documents: int, words: int) -> int:
    """What a word that occurs `often` among n adds per unit of its weight."""
    m = 100 - 25 + 25 * n * documents // words
    return 1_000_000_000 * often // (1000 * often + 12 * m)


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def vectors(counts: DataFrame, documents: int, words: int) -> DataFrame:
    """(doc_id, length, words, impacts) of the documents that share a word with the items."""

    def weigh(rows: dict[str, list]) -> dict[str, list]:
        impacts = []
        for n, often in zip(rows["n"], rows["often"], strict=True):
            known = {k: impact(k, n, documents, words) for k in set(often)}
            impacts.append([known[k] for k in often])
        lengths = [math.sqrt(sum(x * x for x in row)) for row in impacts]
        return {"doc_id": rows["doc_id"], "length": lengths, "words": rows["words"], "impacts": impacts}

    kinds = "doc_id long, length double, words array<int>, impacts array<int>"
    return per_batch(counts.filter("size(words) > 0"), weigh, kinds)


# searching a bucket


class Bucket:
    """Vectors of about one length, with a list of vectors for each word."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, words: np.ndarray,
                 impacts: np.ndarray):
        self.ids, self.lengths, self.longest = ids, lengths, float(lengths.max())
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.words, self.impacts = words, impacts
        order = np.argsort(words, kind="stable")
        self.of, self.values = np.repeat(np.arange(len(ids)), sizes)[order], impacts[order]
        self.sorted = words[order]

    def lists(self, words: np.ndarray) -> list[slice]:
        first = np.searchsorted(self.sorted, words, "left")
        last = np.searchsorted(self.sorted, words, "right")
        return [slice(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def candidates(self, words: np.ndarray, weights: np.ndarray, length: float, floor: int) -> np.ndarray | None:
        """Vectors that may reach `floor` with an item of this length; None: all of them.

        The bounds look at the item's heaviest words. A vector at the angle it needs lies, in each
        coordinate, between two bounds; where the lower one is above zero, only vectors in that
        word's list can do. Of these, what the heavy words add, and the lengths of what is left of
        both, bound the product from above.
        """
        if floor <= 0:
            return None
        needed = floor / (length * self.longest) / SLACK
        heavy = np.argsort(-weights, kind="stable")[:FOCUS]
        lists = self.lists(words[heavy])
        rest = math.sqrt(max(length**2 - float((weights[heavy].astype(float) ** 2).sum()), 0))
        found = None
        if needed < 1:
            across = math.sqrt(1 - needed**2)
            for i, part in zip(heavy.tolist(), lists, strict=True):
                share = weights[i] / length
                low = share * needed - across * math.sqrt(max(1 - share**2, 0))
                if low <= 1e-9:
                    continue  # a vector without the word can reach the floor
                high = share * needed + across * math.sqrt(max(1 - share**2, 0)) if share < needed else 1
                of = self.of[part]
                at = self.values[part] / self.lengths[of]
                fit = of[(at >= low / SLACK - 1e-9) & (at <= high * SLACK + 1e-9)]
                found = fit if found is None else found[np.isin(found, fit, assume_unique=True)]
        added, squares = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        for i, part in zip(heavy.tolist(), lists, strict=True):
            of, values = self.of[part], self.values[part].astype(float)
            added[of] += weights[i] * values
            squares[of] += values * values
        if found is None:
            left = np.sqrt(np.maximum(self.lengths**2 - squares, 0))
            return np.flatnonzero((added + rest * left) * SLACK >= floor)
        left = np.sqrt(np.maximum(self.lengths[found] ** 2 - squares[found], 0))
        return found[(added[found] + rest * left) * SLACK >= floor]

    def scores(self, words: np.ndarray, weights: np.ndarray, among: np.ndarray | None) -> np.ndarray:
        """Products in whole numbers, of all vectors or those `among`."""
        told = np.zeros(len(self.ids), np.int64)
        if among is None or 8 * len(among) > len(self.ids):
            for w, part in zip(weights.tolist(), self.lists(words), strict=True):
                told[self.of[part]] += w * self.values[part]
            return told if among is None else told[among]
        full = dict(zip(words.tolist(), weights.tolist(), strict=True))
        out = np.zeros(len(among), np.int64)
        for k, row in enumerate(among.tolist()):
            part = slice(self.starts[row], self.starts[row + 1])
            out[k] = sum(full.get(t, 0) * x for t, x in
                         zip(self.words[part].tolist(), self.impacts[part].tolist(), strict=True))
        return out


class Best:
    """The best documents of an item so far, and the score below which none counts."""

    def __init__(self, most: int, floor: int):
        self.most, self.floor = most, floor
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        on = scores >= max(self.floor, 1)
        if not on.any():
            return
        scores, ids = np.r_[self.scores, scores[on]], np.r_[self.ids, ids[on]]
        order = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.most:
            self.floor = max(self.floor, int(self.scores[-1]))


def found_in(
    rows: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], floors: list[int], most: int
) -> DataFrame:
    """(item, score, doc_id): of each task's vectors the `most` best of each item.

    The vectors are dealt out by ranges of their length, the longest first; the id is a second
    key, so vectors of one length are spread as well. A task cuts its own into buckets. A bucket
    is left out for each item whose length times the bucket's longest stays below the floor.
    """
    lengths = np.array([math.sqrt(float((w.astype(float) ** 2).sum())) for _, w in queries])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most, floor) for floor in floors]

        def search(bucket: Bucket) -> None:
            floor = np.array([max(b.floor, 1) for b in best])
            for q in np.flatnonzero(lengths * bucket.longest * SLACK >= floor).tolist():
                words, weights = queries[q]
                among = bucket.candidates(words, weights, lengths[q], best[q].floor)
                scores = bucket.scores(words, weights, among)
                best[q].add(scores, bucket.ids if among is None else bucket.ids[among])

        held: list[pa.RecordBatch] = []

        def cut(whole: bool) -> None:
            """Search the buckets that are known to be whole; keep the rest."""
            nonlocal held
            rows = pa.Table.from_batches(held).combine_chunks()
            ids = rows["doc_id"].fill_null(NO_ID).to_numpy()
            length = rows["length"].to_numpy()
            start = 0
            while start < len(ids):
                end = min(start + BUCKET, len(ids))
                shorter = np.flatnonzero(length[start:end] < SHORTEST * length[start])
                end = start + int(shorter[0]) if len(shorter) else end
                if end == len(ids) and not whole and end - start < BUCKET:
                    break
                part = rows.slice(start, end - start)
                words = part["words"].combine_chunks()
                sizes = np.diff(words.offsets.to_numpy())
                impacts = part["impacts"].combine_chunks().flatten().to_numpy().astype(np.int64)
                search(Bucket(ids[start:end], length[start:end], sizes,
                              words.flatten().to_numpy().astype(np.int64), impacts))
                start = end
            held = rows.slice(start).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= BUCKET:
                    cut(False)
        if held:
            cut(True)
        for q, b in enumerate(best):
            if len(b.ids):
                ids = pa.array(b.ids, pa.int64(), mask=b.ids == NO_ID)
                item = pa.array(np.full(len(b.ids), q), pa.int32())
                yield pa.RecordBatch.from_arrays([item, pa.array(b.scores), ids], ["item", "score", "doc_id"])

    laid = rows.repartitionByRange(F.desc("length"), F.asc("doc_id"))
    laid = laid.sortWithinPartitions(F.desc("length"), F.asc("doc_id"))
    laid = laid.select("doc_id", "length", "words", "impacts")
    return laid.mapInArrow(look, "item int, score long, doc_id long")


def top_of(found: DataFrame, most: int) -> DataFrame:
    """(item, rank, doc_id, score): the `most` best; Spark keeps so many per task before it shuffles."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def ranked_search(
    docs: DataFrame, items: DataFrame, most: int = 20, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of `items` its `most` best documents: item_id, rank, doc_id, score.

    Scores are whole numbers: over the item's words, repeats included, weight times impact. Equal
    scores are ranked by doc_id, null last. Documents and items without a word (null, empty, only
    punctuation) are in no result; repeated rows are documents, or items, of their own. Empty
    tables give an empty one.

    The documents' vectors over the items' words are ordered by length. First the longest ones are
    searched, which tells a score that an item's results reach at least; then the others, where
    bounds by length and by coordinates leave out what stays below. What is left is scored exactly.
    """
    told = None
    for block in blocks_of(items, block_bytes):
        counts = stored(counted(docs, block))
        documents, words = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        holding = counts.select(F.explode("words").alias("word")).groupBy("word").count().collect()
        weights = np.zeros(len(block.vocabulary), np.int64)
        for word, df in holding:
            weights[word] = weight(documents, df)
        queries = [(w[weights[w] > 0], (k * weights[w])[weights[w] > 0]) for w, k in block.words]
        rows = stored(vectors(counts, documents, words))
        cut = rows.agg(F.percentile_approx("length", 1 - LONGEST, 1000)).first()[0]
        if cut is None:
            continue
        first = stored(found_in(rows.filter(F.col("length") >= cut), queries, [0] * len(queries), most))
        last = top_of(first, most).filter(F.col("rank") == most).select("item", "score").collect()
        floors = [0] * len(queries)
        for item, score in last:
            floors[item] = score
        other = found_in(rows.filter(F.col("length") < cut), queries, floors, most)
        best = top_of(first.unionByName(other), most)
        ids = docs.sparkSession.createDataFrame(
            pa.table({"item": pa.array(range(len(block.ids)), pa.int32()), "item_id": pa.array(block.ids, pa.int64())}))
        best = best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")
        told = best if told is None else told.unionByName(best)
    if told is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return told


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 best documents of each benchmark item; see `ranked_search`."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return ranked_search(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
    WITH words AS (
        SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
    ), docs AS (
        SELECT r, doc_id, len(w) AS n FROM words WHERE len(w) > 0
    ), totals AS (
        SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_words FROM docs
    ), held AS (
        SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM words) GROUP BY r, t
    ), weights AS (
        SELECT t, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
        FROM held, totals GROUP BY t, all_docs
    ), asked AS (
        SELECT i, item_id, t, count(*) AS often
        FROM (SELECT i, item_id, unnest(w) AS t FROM (
                  SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark))
        GROUP BY i, item_id, t
    ), scored AS (
        SELECT i, item_id, doc_id, r, sum(often * weight * ((1000000000 * tf)
               // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_words))))::BIGINT AS score
        FROM asked JOIN weights USING (t) JOIN held USING (t) JOIN docs USING (r), totals
        GROUP BY i, item_id, doc_id, r
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
        FROM scored WHERE score > 0
    )
    SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20"""
