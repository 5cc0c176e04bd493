"""Perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberwatch.llm.text import ROWS, runs
from emberwatch.session import stored

#: Characters of the longest n-gram.
ORDER = 5
#: Entries of one shard of the model, which is what a broadcast (12 bytes each) and a worker (up
#: to 60 bytes each) hold at most. Each further shard is a pass of its own, with its own workers.
SHARD_ROWS = 4_000_000
#: Places looked at together in a worker.
PIECE = 500_000
_PAD, _DIGIT = 2, 48
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRAM, _CONTEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


# characters


def codes_of(text: str | None) -> np.ndarray:
    """Code points with white space as one space and every digit as 0."""
    line = " ".join((text or "").split())
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").copy()
    codes[(codes >= 48) & (codes <= 57)] = _DIGIT
    codes[codes < 3] = 3
    return codes


def padded(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one row with `order` - 1 pads before each; for each place its text or -1."""
    pad = np.full(order - 1, _PAD, np.uint32)
    parts, owner = [], []
    for i, text in enumerate(texts):
        codes = codes_of(text)
        parts += [pad, codes]
        owner += [np.full(order - 1, -1), np.full(len(codes), i)]
    if not parts:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.concatenate(parts), np.concatenate(owner)


def by_language(
    langs: list[str], texts: list[str | None], order: int
) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, codes, row of each place or -1) in pieces of bounded length.

    A long text comes in several pieces; each begins with the characters before it, whose row
    is -1, so that every place is told once, with its whole history.
    """
    for lang in dict.fromkeys(langs):
        rows = np.array([i for i, x in enumerate(langs) if x == lang])
        for part in runs([texts[i] for i in rows]):
            codes, owner = padded([texts[i] for i in rows[part]], order)
            owner = np.where(owner >= 0, rows[part][owner], -1)
            for start in range(0, len(codes), PIECE):
                before = max(0, start - order + 1)
                own = owner[before : start + PIECE].copy()
                own[: start - before] = -1
                yield lang, codes[before : start + PIECE], own


def run_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the runs of 0, 1 ... `order` characters that end at each place."""
    out = [np.zeros(len(codes), np.uint64)]
    power = np.uint64(1)
    for back in range(order):
        part = np.zeros(len(codes), np.uint64)
        part[back:] = codes[: len(codes) - back].astype(np.uint64) * power
        out.append(out[-1] + part)
        power = np.uint64(int(power) * int(_STEP) % 2**64)
    return out


def _mixed(hashes: np.ndarray, size: int, kind: np.uint64) -> np.ndarray:
    mixed = (hashes + np.uint64((size + 1) * int(kind) % 2**64)) * _STEP
    return (mixed ^ (mixed >> np.uint64(29))) * kind | np.uint64(1)


def keys_of(words: list[str], context: np.ndarray) -> np.ndarray:
    """The keys that runs of characters have in a table, as runs or as histories."""
    out = np.empty(len(words), np.uint64)
    sizes = np.array([len(word) for word in words], np.int64)
    for size in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == size)
        hashes = np.zeros(len(own), np.uint64)
        if size:
            codes = np.array([words[i] for i in own], f"<U{size}").view("<u4").reshape(-1, size)
            power = np.uint64(1)
            for back in range(size):
                hashes += codes[:, size - 1 - back].astype(np.uint64) * power
                power = np.uint64(int(power) * int(_STEP) % 2**64)
        out[own] = np.where(
            context[own], _mixed(hashes, size, _CONTEXT), _mixed(hashes, size, _GRAM)
        )
    return out


def _key(run: str, context: str) -> Column:
    @F.pandas_udf("long")
    def keys(runs: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series(keys_of(runs.tolist(), contexts.to_numpy(bool)).view(np.int64))

    return keys(run, context)


# counts and probabilities


def gram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each run of `order` characters is in the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS).to_pydict()
                for lang, codes, owner in by_language(rows["lang"], rows["text"], order):
                    ends = np.flatnonzero(owner >= 0)
                    _, first, n = np.unique(
                        run_hashes(codes, order)[order][ends], return_index=True, return_counts=True
                    )
                    places = ends[first][:, None] + np.arange(1 - order, 1)
                    grams = np.ascontiguousarray(codes[places].astype("<u4")).view(f"<U{order}")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(n), pa.string()),
                            pa.array(grams.ravel().tolist(), pa.string()),
                            pa.array(n, pa.int64()),
                        ],
                        ["lang", "gram", "n"],
                    )

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(grams: DataFrame) -> DataFrame:
    """D1, D2, D3 of each language from how many n-grams have counts 1, 2, 3, 4."""
    ones = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    base = F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0.0))

    def discount(i: int) -> Column:
        value = i - (i + 1) * base * F.col(f"n{i + 1}") / F.nullif(F.col(f"n{i}"), F.lit(0.0))
        usable = value.isNotNull() & (value > 0) & (value < i)
        return F.when(usable, value).otherwise(F.lit(0.5 * i)).alias(f"d{i}")

    return grams.groupBy("lang").agg(*ones).select("lang", *map(discount, (1, 2, 3)))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, context, run, value): log probabilities of runs, log weights of contexts.

    Below the longest n-grams a run counts with the number of characters seen before it. Each
    order takes what its discounts free from the order below, down to all characters alike.
    """
    levels = {order: stored(counts)}
    for k in range(order - 1, 0, -1):
        shorter = F.substring("gram", 2, k)
        levels[k] = stored(levels[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count("*").alias("n")))
    letters = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("lower"))
    lower = letters.select("lang", F.lit("").alias("run"), "lower")
    model = lower.select("lang", F.lit(False).alias("context"), "run", F.log("lower").alias("value"))
    for k in range(1, order + 1):
        grams = levels[k].join(F.broadcast(discounts(levels[k])), "lang")
        n = F.col("n")
        cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        grams = grams.select(
            "lang", "gram", "n", F.least(cut, n).alias("cut"),
            F.substring("gram", 1, k - 1).alias("history"), F.substring("gram", 2, k - 1).alias("run"),
        )
        histories = stored(
            grams.groupBy("lang", "history").agg(F.sum("n").alias("total"), F.sum("cut").alias("freed"))
        )
        rest = F.col("freed") / F.col("total")
        chance = (F.col("n") - F.col("cut")) / F.col("total") + rest * F.col("lower")
        found = stored(
            grams.join(histories, ["lang", "history"])
            .join(lower, ["lang", "run"])
            .select("lang", "gram", chance.alias("lower"))
        )
        lower = found.select("lang", F.col("gram").alias("run"), "lower")
        model = model.unionByName(
            lower.select("lang", F.lit(False).alias("context"), "run", F.log("lower").alias("value"))
        ).unionByName(
            histories.select("lang", F.lit(True).alias("context"), F.col("history").alias("run"),
                             F.log(rest).alias("value"))
        )
    return model


# scoring


def sharded(model: DataFrame, shard_rows: int = SHARD_ROWS) -> list[DataFrame]:
    """The model in shards of at most `shard_rows`, by language and the last two characters of
    the history, so that all that a place asks for is in one shard.

    Runs too short to tell are in every shard of their language; they are as many as pairs of
    characters. A place is asked for in each shard and answered where its pair belongs.
    """
    pair = F.when(F.col("context"), F.substring("run", -2, 2)).otherwise(
        F.substring(F.expr("left(run, length(run) - 1)"), -2, 2)
    )
    tagged = stored(
        model.select("lang", F.when(F.length(pair) == 2, pair).alias("pair"),
                     _key("run", "context").alias("key"), F.col("value").cast("float").alias("value"))
    )
    sizes = tagged.groupBy("lang", "pair").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("lang").orderBy("pair")
    dealt = stored(
        sizes.filter("pair IS NOT NULL").withColumn("shard", F.floor((F.sum("n").over(upto) - 1) / shard_rows))
    )
    return [tagged, dealt]


class Table:
    """Keys and values in slots by the key's leading bits, the next free one if it is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        homes = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        place = np.arange(len(keys))
        slots = place + np.maximum.accumulate(homes - place) if len(keys) else place
        size = max(1 << self.bits, int(slots.max(initial=0)) + 1) + 1
        self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.float32)
        self.keys[slots], self.values[slots] = keys, values

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value or 0."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        found = np.zeros(len(keys), bool)
        values = np.zeros(len(keys), np.float32)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            found[todo[hit]] = True
            values[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there != 0) & (there <= keys[todo])]
            slot[todo] += 1
            todo = todo[slot[todo] < len(self.keys)]
        return found, values


def log_probabilities(codes: np.ndarray, ends: np.ndarray, table: Table, order: int) -> np.ndarray:
    """Of the characters at `ends`: the longest known run's, with the weights of the histories
    that were longer."""
    hashes = run_hashes(codes, order)
    out = np.zeros(len(ends), np.float32)
    todo = np.arange(len(ends))
    for k in range(order, -1, -1):
        at = ends[todo]
        found, value = table.find(_mixed(hashes[k][at], k, _GRAM))
        out[todo] += value
        todo, at = todo[~found], at[~found]
        if k:
            out[todo] += table.find(_mixed(hashes[k - 1][at - 1], k - 1, _CONTEXT))[1]
    return out


_tables: list = [None, {}]


def _table(shard: tuple) -> dict[str | None, Table]:
    """Tables by language, built once in each worker, which keeps the last shard's."""
    if _tables[0] is not shard:
        _tables[:] = [shard, {lang: Table(*entries) for lang, entries in shard[0].items()}]
    return _tables[1]


def load_shards(model: DataFrame, shard_rows: int = SHARD_ROWS) -> Iterator[tuple]:
    """Each shard as ({language: (keys, values)}, which pairs it answers for or None if all)."""
    tagged, dealt = sharded(model, shard_rows)
    langs = [r.lang for r in dealt.select("lang").union(tagged.select("lang")).distinct().collect()]
    for lang in sorted(langs, key=str):
        own = F.col("lang").eqNullSafe(F.lit(lang))
        last = dealt.filter(own).agg(F.max("shard")).first()[0] or 0
        for shard in range(last + 1):
            pairs = dealt.filter(own & (F.col("shard") == shard)).select("pair")
            rows = tagged.filter(own)
            if last:
                rows = rows.join(pairs, "pair", "left_semi").select("key", "value").union(
                    rows.filter("pair IS NULL").select("key", "value")
                )
            got = rows.select("key", "value").toArrow()
            keys = got["key"].to_numpy().view(np.uint64)
            if not last:
                mine = None
            elif shard:
                mine = ({r.pair for r in pairs.collect()}, True)
            else:  # the first shard answers for all pairs that no other has, unknown ones too
                others = dealt.filter(own & (F.col("shard") > 0)).select("pair")
                mine = ({r.pair for r in others.collect()}, False)
            yield ({lang: (keys, got["value"].to_numpy())}, mine)


def losses(docs: DataFrame, model: DataFrame, order: int = ORDER, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, lang, loss: a text's negative log probability per character, null if it has none.

    Each shard of the model is joined with all texts of its language in turn: broadcast, it
    answers for the characters whose history belongs to it.
    """
    spark = docs.sparkSession
    packs: list[tuple] = []
    shards: list[Broadcast] = []
    room = 0
    for tables, mine in load_shards(model, shard_rows):  # languages share a pass while they fit
        rows = sum(len(keys) for keys, _ in tables.values())
        if mine is None and packs and room + rows <= shard_rows:
            packs[-1][0].update(tables)
            room += rows
        else:
            packs.append((tables, mine))
            room = rows if mine is None else shard_rows
    shards = [spark.sparkContext.broadcast(pack) for pack in packs]
    kind = "doc_id long, lang string, text string, total double, places long"
    scored = docs.select(
        "doc_id", "lang", "text", F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("places")
    )
    for shared in shards:

        def score(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            tables, mine = _table(shared.value), shared.value[1]
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS):
                    part = batch.slice(start, ROWS)
                    langs, texts = part["lang"].to_pylist(), part["text"].to_pylist()
                    total = part["total"].to_numpy(zero_copy_only=False).copy()
                    places = part["places"].to_numpy(zero_copy_only=False).copy()
                    for lang, codes, owner in by_language(langs, texts, order):
                        if lang not in tables:
                            continue
                        ends = np.flatnonzero(owner >= 0)
                        if mine is not None:
                            before = np.column_stack([codes[ends - 2], codes[ends - 1]]).astype("<u4")
                            pairs, which = np.unique(
                                np.ascontiguousarray(before).view("<U2").ravel(), return_inverse=True
                            )
                            listed, wanted = mine
                            own = np.array([(pair in listed) == wanted for pair in pairs.tolist()], bool)
                            ends = ends[own[which]]
                        logs = log_probabilities(codes, ends, tables[lang], order)
                        total += np.bincount(owner[ends], logs, len(langs))
                        places += np.bincount(owner[ends], minlength=len(langs))
                    columns = [part["doc_id"], part["lang"], part["text"], pa.array(total), pa.array(places)]
                    yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        scored = scored.mapInArrow(score, kind)
    return scored.select(
        "doc_id", "lang", (-F.col("total") / F.nullif(F.col("places"), F.lit(0))).alias("loss")
    )


def quality_by_perplexity(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = 0.99,
    order: int = ORDER,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Per row of `docs`: doc_id, perplexity (per character), threshold, kept.

    Trusted are the documents that `labels` (doc_id, quality) marks 1. Nine tenths of them, by
    a hash of the id, train a model for each language; the others give its threshold, the
    `quantile` of their perplexities. A text is kept up to the threshold. Languages without a
    trusted text have no model: their texts have no perplexity and are kept, as are all texts
    of a language without a threshold. Texts without a character have no perplexity and are not
    kept if their language has a model. Null is a language. Repeated rows each give a row; an empty table gives none.
    """
    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), "text")
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    # labels grow with the corpus: the same join at every size, without a broadcast of them
    trusted = own.join(good.filter(~apart).hint("merge"), "doc_id", "left_semi")
    model = kneser_ney(gram_counts(trusted, order), order)
    scored = stored(losses(own, model, order, shard_rows).withColumn("row", F.lit(1)))
    held = scored.join(good.filter(apart), "doc_id", "left_semi")
    limits = held.groupBy("lang").agg(F.percentile_approx("loss", quantile, 10_000).alias("limit"))
    known = model.select("lang").distinct().withColumn("known", F.lit(True))
    limits = stored(known.join(limits, "lang", "left"))
    kept = F.coalesce(F.col("loss") <= F.col("limit"), F.col("known").isNull() | (F.col("loss").isNotNull()))
    return scored.join(limits, "lang", "left").select(
        "doc_id", F.exp("loss").alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept")
    )


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return quality_by_perplexity(docs.select("doc_id", "lang", "text"), labels)
