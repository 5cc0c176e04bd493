"""Toxic texts found by a support vector machine on a gap-weighted subsequence kernel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberwatch.llm.text import encoded, per_batch, runs

#: The kernel compares subsequences of three characters that span SPAN characters at most; each
#: character left out in between weighs DECAY.
SPAN, DECAY = 7, 0.6
#: Bounds of what is learned from: labelled documents, and words taken from them to the driver.
MOST_DOCUMENTS, MOST_WITNESSES, MOST_CLEAN, MOST_HARD, HARD_ROUNDS = 20_000, 160, 8_000, 1_000, 2
#: A text is toxic from this score on.
TOXIC = 0.7
#: Longer words are not learned from; all words are scored.
LONGEST_LEARNED = 24

_EDGE, _CODES, _GONE = 26, 43, 255
#: Letters without their case, white space as the edge of words, a character beyond ASCII by four
#: bits of its later bytes. What stands between letters and is neither, as in i-d-i-o-t, is left
#: out.
_CODE = np.full(256, _GONE, np.uint8)
_CODE[[*b"abcdefghijklmnopqrstuvwxyz"]] = _CODE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(26)
_CODE[[*b" \t\n\x0b\x0c\r"]] = _EDGE
_CODE[128:192] = 27 + np.arange(64) % 16
_BESIDE = bytes(b for b in range(128) if _CODE[b] == _GONE)

_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one row of codes, an edge before each and after the last; where each begins.

    Letters that stand alone next to each other, as in i d i o t, are joined to one word.
    """
    parts = [np.full(1, _EDGE, np.uint8)]
    starts = [0]
    for text in texts:
        codes = _CODE[np.frombuffer(encoded(text), np.uint8)]
        parts += [codes[codes != _GONE], parts[0]]
        starts.append(starts[-1] + len(parts[-2]) + 1)
    codes = np.concatenate(parts)
    edge = codes == _EDGE
    edge[starts] = False  # texts are never joined
    firm = codes == _EDGE
    alone = ~firm[1:-1] & firm[:-2] & firm[2:]  # one character between two edges
    alone = np.r_[False, alone, False]
    joint = np.flatnonzero(edge[1:-1] & alone[:-2] & alone[2:]) + 1
    if len(joint):
        keep = np.ones(len(codes), bool)
        keep[joint] = False
        place = np.cumsum(keep) - 1
        return codes[keep], place[starts]
    return codes, np.array(starts)


def word_bounds(codes: np.ndarray) -> np.ndarray:
    """Places of the edges that a word follows."""
    edge = codes == _EDGE
    return np.flatnonzero(edge[:-1] & ~edge[1:])


def _triples(codes: np.ndarray):
    """For each step within the span: the places where it stays in a word, and its triple."""
    edges = np.flatnonzero(codes == _EDGE)
    after = np.r_[edges[np.searchsorted(edges, np.arange(len(codes) - 1), "right")], 0]
    room = (after - np.arange(len(codes))).astype(np.int32)
    wide = codes.astype(np.int32)
    place = np.flatnonzero(room >= 2)
    for a, b in _STEPS:
        if a == 1:
            place = place[room[place] >= b]
            ends = wide[place] * (_CODES * _CODES) + wide[place + b]
        yield b, place, ends + wide[place + a] * _CODES


def evidence(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word the sum of the weights of its triples, by gaps."""
    out = np.zeros(len(codes), np.float32)
    for b, place, triple in _triples(codes):
        out[place] += np.float32(DECAY ** (b - 2)) * weights[triple]
    return np.add.reduceat(out, word_bounds(codes)) if len(word_bounds(codes)) else out[:0]


def own_norm(length: np.ndarray) -> np.ndarray:
    """Root of a word's kernel with itself, were all its triples different: by its length."""
    size = length + 2
    total = np.zeros(len(length))
    for _, b in _STEPS:
        total += np.maximum(size - b, 0) * DECAY ** (2 * (b - 2))
    return np.sqrt(np.maximum(total, 1e-9))


def word_lengths(codes: np.ndarray) -> np.ndarray:
    words = word_bounds(codes)
    edges = np.flatnonzero(codes == _EDGE)
    return edges[np.searchsorted(edges, words, "right")] - words - 1


def features(words: list[str], columns: np.ndarray | None = None) -> np.ndarray:
    """Rows of weighted triples of single words, scaled by their norms; of `columns` only."""
    out = []
    for i in range(0, len(words), 100):
        rows = np.zeros((len(words[i : i + 100]), _CODES**3), np.float32)
        for row, word in zip(rows, words[i : i + 100], strict=True):
            codes, _ = codes_of([word])
            for b, _, triple in _triples(codes):
                np.add.at(row, triple, np.float32(DECAY ** (b - 2)))
            row /= own_norm(np.array([len(codes) - 2]))[0]
        out.append(rows if columns is None else rows[:, columns])
    return np.concatenate(out)


#: Numbers that sum up a document's words: its three greatest margins, the sum of those above
#: none, and its length.
POOLED = 5


@dataclass
class Model:
    """Weight of each triple and offset of a word's margin; the weights of a document's score."""

    weights: np.ndarray
    offset: float
    curve: np.ndarray

    def margins(self, codes: np.ndarray) -> np.ndarray:
        """How far each word lies on the toxic side; 1 is the machine's own margin."""
        return evidence(codes, self.weights) / own_norm(word_lengths(codes)) + self.offset

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        codes, starts = codes_of(texts)
        words = word_bounds(codes)
        text = np.searchsorted(starts, words, "right") - 1
        margin = self.margins(codes)
        out = np.full((len(texts), POOLED), min(self.offset, -1.0))
        order = np.lexsort((-margin, text))
        text, margin = text[order], margin[order]
        rank = np.arange(len(text)) - np.searchsorted(text, text)
        for k in range(3):
            out[text[rank == k], k] = margin[rank == k]
        out[:, :3] = np.clip(out[:, :3], -1, 2)
        above = np.bincount(text, np.clip(margin, 0, 1), len(texts))
        count = np.bincount(text, minlength=len(texts))
        out[:, 3], out[:, 4] = np.log1p(above), np.log1p(count)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for part in runs(texts):
            out[part] = self.pooled(texts[part]) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def variants(word: str) -> list[str]:
    """The word, and with a character put in or doubled at each place."""
    return [word] + [
        word[:i] + extra + word[i:] for i in range(1, len(word)) for extra in ("x", word[i])
    ]


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last number is the offset."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        active = y * (x @ beta) < 1
        xa = x[active] * weight[active, None]
        new = np.linalg.solve(xa.T @ x[active] + np.diag(penalty), xa.T @ y[active])
        if np.allclose(new, beta, atol=1e-6):
            break
        beta = 0.5 * beta + 0.5 * new
    return beta


def fit_curve(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic regression of labels on pooled numbers, the offset last.

    More evidence never lowers a score: all weights but that of the length are 0 at least.
    """
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([0.1] * (x.shape[1] - 1) + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, x.T @ (toxic - p) - ridge @ beta)
        new = beta + np.clip(step, -2, 2) / 2
        new[: POOLED - 1] = np.maximum(new[: POOLED - 1], 0)
        if np.abs(new - beta).max() < 1e-6:
            break
        beta = new
    return beta


def document_words(docs: DataFrame) -> DataFrame:
    """(word, toxic): the words of each document once, as the kernel sees them."""

    def words(rows: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"word": [], "toxic": []}
        for text, toxic in zip(rows["text"], rows["toxic"], strict=True):
            found = {
                word.decode("utf-8", "replace")
                for word in encoded(text).translate(None, _BESIDE).lower().split()
                if 3 <= len(word) <= LONGEST_LEARNED
            }
            out["word"] += found
            out["toxic"] += [toxic] * len(found)
        return out

    return per_batch(docs.select("text", "toxic"), words, "word string, toxic int")


def train(
    docs: DataFrame, labels: DataFrame, most_documents: int = MOST_DOCUMENTS
) -> Model:
    """Learn from the documents that `labels` (doc_id, toxic) marks.

    At most `most_documents` of them are taken, by a hash of their ids. Which words of a toxic
    text make it toxic is not marked: those found in far more toxic texts than in clean ones are
    its witnesses, all words of clean texts speak against. Both kinds give landmarks, on which
    the kernel is projected (Nyström); the linear machine on that projection is turned back into
    a weight for each triple. Without labels of both kinds, or without witnesses, no text is
    toxic.
    """
    nothing = Model(np.zeros(_CODES**3, np.float32), -1.0, np.r_[np.zeros(POOLED), -2.0])
    marked = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_documents)
    sample = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic").cache()
    try:
        sizes = dict(sample.groupBy("toxic").count().collect())
        if not sizes.get(0) or not sizes.get(1):
            return nothing
        share = F.col("n") / (sizes[0] + sizes[1])
        rare = F.greatest(share * sizes[1], F.lit(1e-9))
        counted = (
            document_words(sample)
            .groupBy("word")
            .agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
            .withColumn("excess", (F.col("bad") - rare) / F.sqrt(rare * (1 - share) + 0.5))
            .cache()
        )
        telling = counted.filter("bad >= 3 AND bad >= n * 0.5 AND excess >= 4")
        witnesses = [r.word for r in telling.orderBy(F.desc("excess"), "word").limit(MOST_WITNESSES).collect()]
        known = set(witnesses)
        usual = counted.filter("bad < n * 0.5")
        clean = usual.orderBy(F.xxhash64("word"), "word").limit(MOST_CLEAN)
        others = [r.word for r in clean.select("word").collect() if r.word not in known]
        if not witnesses or not others:
            return nothing
        bad = [v for word in witnesses for v in variants(word)]
        model = fit(witnesses, bad, others, [])
        hard: set[str] = set()
        for _ in range(HARD_ROUNDS):  # learn again with the clean words that look worst so far
            margin = margin_of(model, F.col("word"))
            worst = usual.select("word", margin.alias("m")).orderBy(F.desc("m"), "word")
            hard.update(r.word for r in worst.limit(MOST_HARD).collect() if r.word not in known)
            model = fit(witnesses, bad, others, sorted(hard))
        counted.unpersist()
        told = sample.select(pooled_of(model, F.col("text")).alias("x"), "toxic").toPandas()
        curve = fit_curve(np.array(told["x"].tolist()), told["toxic"].to_numpy())
        return Model(model.weights, model.offset, curve)
    finally:
        sample.unpersist()


def fit(witnesses: list[str], bad: list[str], others: list[str], hard: list[str]) -> Model:
    """The machine that parts `bad` words from the clean ones, `hard` ones counting more."""
    chosen = witnesses + others[: len(witnesses)] + hard[: len(witnesses)]
    columns = np.unique(np.concatenate([t for w in chosen for _, _, t in _triples(codes_of([w])[0])]))
    landmarks = features(chosen, columns)
    values, vectors = np.linalg.eigh(landmarks @ landmarks.T)
    kept = values > 1e-6 * values.max()
    project = vectors[:, kept] / np.sqrt(values[kept])
    groups = (bad, others, hard)
    onto = landmarks.T @ project
    mapped = [
        features(words[i : i + 100], columns) @ onto
        for words in groups
        for i in range(0, len(words), 100)
    ]
    sizes = [len(words) for words in groups]
    y = np.repeat([1.0, -1.0, -1.0], sizes)
    weight = np.repeat([1 / max(n, 1) for n in sizes], sizes)
    beta = fit_svm(np.concatenate(mapped), y, weight, 1e-4)
    weights = np.zeros(_CODES**3, np.float32)
    weights[columns] = onto @ beta[:-1]
    return Model(weights, float(beta[-1]), np.zeros(POOLED + 1))


def margin_of(model: Model, word: Column) -> Column:
    @F.pandas_udf("double")
    def margins(words: pd.Series) -> pd.Series:
        return pd.Series(model.margins(codes_of(list(words))[0]))

    return margins(word)


def pooled_of(model: Model, text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def pooled(texts: pd.Series) -> pd.Series:
        rows = list(texts)
        return pd.Series([row for part in runs(rows) for row in model.pooled(rows[part])])

    return pooled(text)


def score_of(model: Model, text: Column) -> Column:
    """Score of each whole text, 0 to 1; that of null and empty texts is the lowest there is."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)), dtype="float64")

    return scores(text)


def held_out() -> Column:
    """Whether a document is kept out of training: every third by a checksum of its id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, score, predicted (1 from `threshold` on).

    Held-out rows, and rows without an id, train nothing. Repeated rows each give a row; an
    empty table gives none.
    """
    model = train(docs.filter(~held_out()), labels.filter(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), score_of(model, docs["text"]).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = TOXIC) -> DataFrame:
    """The rows of `docs`, all columns, whose score stays below `threshold`."""
    model = train(docs.filter(~held_out()), labels.filter(~held_out()))
    return docs.filter(score_of(model, docs["text"]) < threshold)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
