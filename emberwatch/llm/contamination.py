"""Benchmark texts found in documents by an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.text import encoded, per_batch

#: A word is a run of ASCII letters and digits and of all that is not ASCII; bytes other than
#: these become a space, A-Z become a-z.
_WORDS = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

#: Characters of windows in one automaton, which bounds its memory and its broadcast (about
#: 25 bytes each in a worker). A longer benchmark makes more automata, each with a pass of its own.
AUTOMATON_CHARS = 4_000_000

Windows = dict[str, list[str]]


def normal_words(text: str | None) -> list[bytes]:
    return encoded(text).translate(_WORDS).split()


def windows(text: str | None, size: int) -> Iterator[str]:
    """Each run of `size` words, or all words if they are fewer; a space on both sides."""
    words = normal_words(text)
    for i in range(max(min(len(words), 1), len(words) - size + 1)):
        yield f" {b' '.join(words[i : i + size]).decode('utf-8', 'surrogatepass')} "


def window_blocks(
    benchmark: DataFrame, size: int = 10, block_chars: int = AUTOMATON_CHARS
) -> Iterator[Windows]:
    """The items that hold each window, in blocks of at most `block_chars` and one window.

    Rows come to the driver one partition at a time; equal windows of one block are kept once.
    """
    block: Windows = {}
    chars = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    for row in rows.toLocalIterator():
        for window in windows(row.text, size):
            if window not in block:
                if block and chars + len(window) > block_chars:
                    yield block
                    block, chars = {}, 0
                block[window] = []
                chars += len(window)
            if row.item is not None and row.item not in block[window]:
                block[window].append(row.item)
    if block:
        yield block


_built: list = [None, None]


def _automaton(block: Windows) -> ahocorasick.Automaton:
    """Built once in each worker, which keeps the last one."""
    if _built[0] is not block:
        automaton = ahocorasick.Automaton()
        for window, items in block.items():
            automaton.add_word(window, (len(window), window.count(" ") - 1, items))
        automaton.make_automaton()
        _built[:] = [block, automaton]
    return _built[1]


def find_windows(text: str | None, block: Windows) -> tuple[int, list[list[int]], set[str]]:
    """Words of the text, merged ranges (first, end) of words inside windows, items found."""
    words = normal_words(text)
    ranges: list[list[int]] = []
    items: set[str] = set()
    if words and block:
        line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
        at = seen = 0  # `at`: words that end before character `seen`
        for last, (length, count, found) in _automaton(block).iter(line):
            at += line.count(" ", seen, last)
            seen = last
            items.update(found)
            ranges.append([at - count, at])
    return len(words), merged(ranges), items


def merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(map(list, ranges)):
        if out and first <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([first, end])
    return out


def _blocks(spark: SparkSession, benchmark: DataFrame, size: int, chars: int) -> list[Broadcast]:
    return [spark.sparkContext.broadcast(b) for b in window_blocks(benchmark, size, chars)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = AUTOMATON_CHARS
) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, items, spans, contaminated.

    `items` holds the ids (as strings, sorted) of items with a window in the text, `spans` the
    code points (start, end) of the original text that windows cover, `n_hit` the words inside.
    Texts without words, null or empty, hold nothing; an item without words has no window; an
    item with a null id makes hits but is not listed. Repeated rows each give a row, empty
    tables none (an empty benchmark: no hits).
    """
    spark = docs.sparkSession
    blocks = _blocks(spark, benchmark, size, block_chars)
    kind = "array<array<int>>"
    found = docs.select(
        "doc_id", "text", F.lit(0).cast("long").alias("n_words"),
        F.array().cast(kind).alias("ranges"), F.array().cast("array<string>").alias("items"),
    )
    schema = f"doc_id long, text string, n_words long, ranges {kind}, items array<string>"
    for shared in blocks or [spark.sparkContext.broadcast({})]:

        def scan(rows: dict[str, list], shared: Broadcast = shared) -> dict[str, list]:
            for i, text in enumerate(rows["text"]):
                n, ranges, items = find_windows(text, shared.value)
                rows["n_words"][i] = n
                if ranges:
                    rows["ranges"][i] = merged(rows["ranges"][i] + ranges)
                    rows["items"][i] = sorted({*rows["items"][i], *items})
            return rows

        found = per_batch(found, scan, schema)

    def tell(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"n_hit": [], "spans": [], "contaminated": []}
        for text, ranges in zip(rows["text"], rows["ranges"], strict=True):
            words = [m.span() for m in _WORD.finditer(text)] if ranges else []
            out["n_hit"].append(sum(end - first for first, end in ranges))
            out["spans"].append([[words[a][0], words[b - 1][1]] for a, b in ranges])
            out["contaminated"].append(bool(ranges))
        return {c: rows[c] for c in ("doc_id", "n_words", "items")} | out

    return per_batch(
        found,
        tell,
        f"doc_id long, n_words long, n_hit long, items array<string>, spans {kind}, "
        "contaminated boolean",
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = AUTOMATON_CHARS
) -> DataFrame:
    """The rows of `docs`, all columns, without a window of any benchmark text."""
    for shared in _blocks(docs.sparkSession, benchmark, size, block_chars):
        docs = docs.filter(_clean(shared)(docs["text"]))
    return docs


def _clean(shared: Broadcast):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not find_windows(t, shared.value)[1] for t in texts], dtype="boolean")

    return clean


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    items = F.col("items")
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), "contaminated",
    )


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP5_SQL = f"""
    WITH b AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
    sized AS (SELECT item, w, least(10, len(w)) AS size FROM b WHERE len(w) > 0),
    patterns AS (
        SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS p
        FROM (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM sized)
    ),
    d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
    hits AS (
        SELECT doc_id, i, size, item FROM (
            SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS p
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
                  FROM d, (SELECT DISTINCT size FROM sized) WHERE len(w) >= size)
        ) JOIN patterns USING (size, p)
    ),
    words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit
              FROM (SELECT doc_id, i, unnest(range(0, size)) AS k FROM hits) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
              FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
