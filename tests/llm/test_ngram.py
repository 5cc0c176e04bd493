import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from emberwatch.llm.ngram import Table, by_language, gram_counts, kneser_ney, losses, quality_by_perplexity


def clean(text):
    return "".join("0" if c.isdecimal() and c.isascii() else c for c in " ".join((text or "").split()))


def brute(train, test, order):
    counts = {k: Counter() for k in range(1, order + 1)}
    for text in train:
        line = "\x02" * (order - 1) + clean(text)
        for i in range(order, len(line) + 1):
            counts[order][line[i - order : i]] += 1
    for k in range(order - 1, 0, -1):
        for gram in counts[k + 1]:
            counts[k][gram[1:]] += 1
    freed, total, cut = {}, {}, {}
    for k, grams in counts.items():
        n = [0] + [sum(v == j for v in grams.values()) for j in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else 0 for i in (1, 2, 3)]
        d = [x if 0 < x < i else 0.5 * i for i, x in enumerate(d, 1)]
        freed[k], total[k] = defaultdict(float), Counter()
        cut[k] = {g: min(v, d[min(v, 3) - 1]) for g, v in grams.items()}
        for g, v in grams.items():
            total[k][g[:-1]] += v
            freed[k][g[:-1]] += cut[k][g]

    def chance(gram):
        k = len(gram)
        if not k:
            return 1 / (len(counts[1]) + 1)
        history = gram[:-1]
        if history not in total[k]:
            return chance(gram[1:])
        own = counts[k].get(gram, 0) - cut[k].get(gram, 0)
        return own / total[k][history] + freed[k][history] / total[k][history] * chance(gram[1:])

    out = []
    for text in test:
        line = "\x02" * (order - 1) + clean(text)
        logs = [math.log(chance(line[i - order : i])) for i in range(order, len(line) + 1)]
        out.append(-sum(logs) / len(logs) if logs else None)
    return out


@pytest.mark.parametrize(("order", "shard_rows"), [(5, 1_000_000), (5, 40), (3, 1_000_000)])
def test_as_brute_force(spark, order, shard_rows):
    """The model in one shard and in many; unknown characters, empty and null texts."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    texts += ["", None, "zz  \n é9 8", "a", "日本"]
    rows = [(i, "en" if i % 3 else "fr", t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = kneser_ney(gram_counts(docs.filter("doc_id < 20"), order), order)
    got = {r.doc_id: r.loss for r in losses(docs, model, order, shard_rows).collect()}
    for lang in ("en", "fr"):
        own = [(i, t) for i, x, t in rows if x == lang]
        for (i, _), loss in zip(own, brute([t for i, t in own if i < 20], [t for _, t in own], order), strict=True):
            assert got[i] == (None if loss is None else pytest.approx(loss, abs=1e-4))


def test_pieces_tell_each_place_once(monkeypatch):
    from emberwatch.llm import ngram

    texts = ["abcdefghij" * 5, None, "xyz", ""]
    whole = [r for r in by_language(["a"] * 4, texts, 5)]
    monkeypatch.setattr(ngram, "PIECE", 7)
    places = [[], []]
    for out, parts in zip(places, (whole, by_language(["a"] * 4, texts, 5)), strict=True):
        for _, codes, owner in parts:
            out += [(int(owner[i]), codes[max(0, i - 4) : i + 1].tolist()) for i in np.flatnonzero(owner >= 0)]
    assert places[0] == places[1]


def test_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**64, 5000, dtype=np.uint64)) | np.uint64(2**62)
    table = Table(keys, np.arange(len(keys), dtype=np.float32))
    found, values = table.find(np.r_[keys, keys ^ np.uint64(2)])
    assert found[: len(keys)].all() and (values[: len(keys)] == np.arange(len(keys))).all()
    assert not found[len(keys) :].any()
    assert not Table(keys[:0], np.zeros(0, np.float32)).find(keys)[0].any()


def test_bad_texts_go_and_good_ones_stay(small):
    got = quality_by_perplexity(small["documents"], small["labels"]).join(small["labels"], "doc_id").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_odd_rows(odd, nothing, labels):
    assert quality_by_perplexity(odd, labels).count() == odd.count()
    assert quality_by_perplexity(nothing, labels).count() == 0
    assert all(r.kept for r in quality_by_perplexity(odd, labels.limit(0)).collect())
