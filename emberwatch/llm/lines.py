"""Lines that many documents share are dropped, all but the last document's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.text import encoded, per_batch
from emberwatch.session import stored


def _key(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z in lower case (bytes know ASCII only)."""
    return line.strip().lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, least_chars: int = 20) -> DataFrame:
    """Rows (key, doc_id): the 128-bit hash of each key of a document, once per document."""

    def keys(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "doc_id": []}
        for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
            found = {_key(line) for line in encoded(text).split(b"\n")}
            found = [_hash(key) for key in found if _long_enough(key, least_chars)]
            out["key"] += found
            out["doc_id"] += [doc_id] * len(found)
        return out

    return per_batch(docs.select("doc_id", "text"), keys, "key binary, doc_id long")


def shared_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """Per document the hashes of the lines it loses: (doc_id, drops).

    Documents are counted, not lines: a key repeated in one document counts once, as do rows
    repeated under one doc_id. The largest doc_id that holds a key keeps its lines.
    """
    pairs = stored(line_keys(docs, least_chars))
    shared = stored(  # read from a table, so that a join can split a key most documents hold
        pairs.groupBy("key")
        .agg(F.count_distinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= least_docs)
    )
    return (
        pairs.join(shared, "key")
        .filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id")
        .agg(F.collect_set("key").alias("drops"))
    )


def dedup_lines(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, counts: bool = True
) -> DataFrame:
    """All columns of `docs` with the kept text, and, with `counts`, `n_lines` and `n_dropped`.

    A null or empty text is one empty line. A line's key is the line without white space at
    both ends, A-Z in lower case; keys of at least `least_chars` code points that at least
    `least_docs` documents hold lose all their lines but those of the largest doc_id. A null
    doc_id counts as a document below all others. With `counts`, columns of `docs` named
    `n_lines` or `n_dropped` are replaced; without, they stay as they are. An empty table gives
    an empty table.
    """

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drops in parts:
            rows = []
            for text, drop in zip(texts, drops, strict=True):
                if drop is None or not len(drop):
                    rows.append((text or "", (text or "").count("\n") + 1, 0))
                    continue
                gone = {bytes(key) for key in drop}
                lines = encoded(text).split(b"\n")
                kept = [
                    line for line in lines
                    if not _long_enough(key := _key(line), least_chars) or _hash(key) not in gone
                ]
                whole = b"\n".join(kept).decode("utf-8", "surrogatepass")
                rows.append((whole, len(lines), len(lines) - len(kept)))
            yield pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    drops = shared_lines(docs, least_chars, least_docs).withColumnRenamed("doc_id", "_drop_id")
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops["_drop_id"]), "left")
    kept = without(docs["text"], drops["drops"])
    added = ["n_lines", "n_dropped"] if counts else []
    told = [kept["text"].alias("text") if c == "text" else docs[c] for c in docs.columns
            if c not in added]
    return joined.select(*told, *[kept[c].alias(c) for c in added])


def op8_line_dedup(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = f"""
    WITH lines AS (
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
    ), keyed AS (
        SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines
    ), shared AS (
        SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3
    )
    SELECT doc_id, count(*) AS n_lines,
           count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
                  FILTER (WHERE keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
    FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id"""
