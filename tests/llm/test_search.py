import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from emberwatch.llm.search import (
    NO_ID, OP13_SQL, Best, Bucket, Items, blocks_of, op13_ranked_search, ranked_search, terms_of, weight,
)

from .test_simhash import UPPER

WORD = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def words_of(text):
    return re.findall(WORD, (text or "").translate(UPPER))


def brute(docs, items, most=20):
    held = [(i, Counter(words_of(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    N, L = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    told = []
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 100 - 25 + 25 * n * N // L
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in words_of(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort()
        told += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(found[:most])]
    return told


def rows_of(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def zipf(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Words of Zipf's kind, so lengths and lists differ widely; repeated texts and ties."""
    rng = random.Random(13)
    docs = [(i, zipf(rng, rng.choice([3, 20, 100, 400]))) for i in range(900)]
    docs += [(2000 + i, "w1 w2 rare exact tie") for i in range(40)] + [(None, "w1 w2 rare exact tie")] * 3
    items = [(i, zipf(rng, rng.choice([1, 5, 30]))) for i in range(40)]
    items += [(100, "rare tie"), (101, "Rare, rare; TIE"), (102, "unheard"), (103, None), (104, "..."), (100, "w7 w7 w8")]
    return docs, items


@pytest.mark.parametrize(("most", "block_bytes"), [(20, 4_000_000), (3, 500)])
def test_as_brute_force(spark, corpus, most, block_bytes):
    docs, items = corpus
    got = ranked_search(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(6),
        spark.createDataFrame(items, "item_id long, text string"), most, block_bytes)
    assert rows_of(got) == sorted(map(str, brute(docs, items, most)))


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "word1 text"), (2, "日本語 Ünï"), (None, "a one TWO"), (3, "")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute(docs, [tuple(r) for r in items.collect()])
    assert rows_of(ranked_search(odd, items)) == sorted(map(str, want))
    assert ranked_search(nothing, items).count() == 0
    assert ranked_search(odd, items.limit(0)).count() == 0
    assert ranked_search(odd, items.filter("item_id = 3")).columns == ["item_id", "rank", "doc_id", "score"]


def test_words():
    rng = random.Random(2)
    alphabet = "aZ09_-.,' \t\n\x00\x7f\x80é日🎉İ"
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(30))
        assert [t.decode() for t in terms_of(text)] == words_of(text)


def bucket_of(rng, n, words):
    rows = []
    for _ in range(n):
        own = rng.sample(range(words), rng.randrange(1, words))
        rows.append({t: rng.randrange(1, 1000) for t in own})
    rows.sort(key=lambda r: -sum(x * x for x in r.values()))
    lengths = np.array([math.sqrt(sum(x * x for x in r.values())) for r in rows])
    flat = [(t, x) for r in rows for t, x in r.items()]
    return rows, Bucket(np.arange(n), lengths, np.array([len(r) for r in rows]),
                        np.array([t for t, _ in flat]), np.array([x for _, x in flat]))


def test_bounds_lose_nothing_and_leave_out_much():
    """Whatever the floor, all vectors that reach it are candidates; scores are exact."""
    rng = random.Random(7)
    left = total = 0
    for _ in range(60):
        rows, bucket = bucket_of(rng, 80, 12)
        words = np.array(sorted(rng.sample(range(14), rng.randrange(1, 9))))
        weights = np.array([rng.choice([1, 5, 50, 3000]) for _ in words])
        length = math.sqrt(float((weights.astype(float) ** 2).sum()))
        exact = np.array([sum(int(w) * r.get(int(t), 0) for t, w in zip(words, weights)) for r in rows])
        assert (bucket.scores(words, weights, None) == exact).all()
        for floor in [0, 1, *np.quantile(exact, [0.3, 0.6, 0.9, 0.99, 1]).astype(int).tolist(), int(exact.max()) + 1]:
            among = bucket.candidates(words, weights, length, floor)
            every = np.arange(len(rows)) if among is None else among
            assert set(np.flatnonzero(exact >= floor).tolist()) <= set(every.tolist()) or floor <= 0
            assert (bucket.scores(words, weights, among) == exact[every]).all()
            few = every[:3]
            assert (bucket.scores(words, weights, few) == exact[few]).all()
        top = bucket.candidates(words, weights, length, int(np.sort(exact)[-3]))
        left, total = left + (len(rows) if top is None else len(top)), total + len(rows)
    assert left < 0.5 * total


def test_best_keeps_ties_by_id():
    best = Best(3, 0)
    best.add(np.array([5, 5, 0, 9]), np.array([8, 4, 1, NO_ID]))
    best.add(np.array([5, 5, 4]), np.array([2, 9, 0]))
    assert best.ids.tolist() == [NO_ID, 2, 4] and best.floor == 5


def test_blocks_hold_all_items(spark, corpus):
    items = spark.createDataFrame(corpus[1], "item_id long, text string")
    blocks = list(blocks_of(items, 300))
    assert len(blocks) > 5 and sum(len(b.ids) for b in blocks) == len(corpus[1])
    assert all(isinstance(b, Items) and max(len(w) for w, _ in b.words) <= len(b.vocabulary) for b in blocks)


def test_weights_are_never_negative():
    assert weight(10, 10) == math.floor(1000 * math.log(22 / 21)) and weight(10**9, 10**9) == 0


def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    df = op13_ranked_search(spark, folder)
    base = duckdb.connect()
    for name in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = base.execute(OP13_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())
