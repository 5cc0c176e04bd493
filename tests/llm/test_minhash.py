import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm.minhash import (
    BANDS, HASHES, LEAST, OP12_SQL, Linker, Sets, bands, chance_similar, cutoffs, in_blocks, least_hashes,
    links_of, near_duplicates, op12_minhash, rare_shingles, search, shingle_set, signature,
)

from .test_simhash import UPPER


def runs_of(text, size=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + size]) for i in range(max(min(1, len(words)), len(words) - size + 1))}


def brute(rows, percent=80):
    """Rows (doc_id, text) to (doc_id, set size, component), by all pairs."""
    sets = [runs_of(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if None in (rows[i][0], rows[j][0]) and a != sets[j]:
                continue  # rows without an id link nothing; equal sets are one
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None and sets[i]:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [(doc, len(sets[i]), low.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def told(df):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def near_copies(rng, words, n, changes):
    base = [rng.choice(words) for _ in range(120)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randrange(changes + 1)):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def mixed():
    """Groups of near copies, texts that share a long passage only, and texts of their own."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    texts = near_copies(rng, words, 70, 5) + near_copies(rng, words, 25, 3)
    template = " ".join(rng.choice(words) for _ in range(90))
    texts += [template + " " + " ".join(rng.choice(words) for _ in range(40)) for _ in range(60)]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts += texts[:10] + ["a b c", "A  b\tc", "a b c d", None, "", " \n"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [4096, 8])
def test_as_brute_force(spark, mixed, block):
    """Also where most buckets are cut into blocks and dealt out by rare shingles."""
    df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(5)
    assert told(near_duplicates(df, block=block)) == sorted(str(r) for r in brute(mixed))


def test_every_pair_meets_in_blocks(spark):
    """Sets that are all alike below the threshold: each pair is compared, none links."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(150)]
    texts = [" ".join(common + [f"own{i}x{k}" for k in range(45)]) for i in range(40)]
    texts += [texts[5] + " more", texts[31] + " more"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, block=6)
    assert told(got) == sorted(str(r) for r in brute(rows))


def test_odd_rows(odd, nothing):
    want = brute([(r.doc_id, r.text) for r in odd.collect()])
    got = near_duplicates(odd)
    assert told(got) == sorted(map(str, want))
    assert {(r.doc_id, r.kept) for r in got.collect()} == {(d, d == c) for d, _, c in want}
    assert near_duplicates(nothing).count() == 0 and near_duplicates(nothing).columns == got.columns


def test_rows_without_an_id(spark):
    text = "one two three four five six"
    rows = [(None, text), (7, text), (None, "some other text that stands alone here"), (3, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {
        (None, 7, False), (7, 7, True), (None, None, True), (3, 3, True)}


def test_posterior_is_that_of_a_cut_off_beta():
    """Against the integral of the likelihood over all similarities."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    for m, n in [(0, 32), (20, 32), (26, 32), (90, 128), (128, 128)]:
        p = 1 / 256 + 255 / 256 * grid
        like = np.exp(m * np.log(p) + (n - m) * np.log1p(-p) - max(m, 1) * 0)
        like /= like.max()
        assert math.isclose(chance_similar(m, n, 0.8), like[grid >= 0.8].sum() / like.sum(), rel_tol=1e-2, abs_tol=1e-12)


def test_cutoffs_seldom_give_up_a_similar_pair():
    rng = np.random.default_rng(1)
    matches = np.cumsum(rng.random((20_000, HASHES)) < 1 / 256 + 255 / 256 * 0.8, axis=1)
    given_up = np.zeros(len(matches), bool)
    for n, least in cutoffs(0.8, 1e-3):
        given_up |= matches[:, n - 1] < least
    assert given_up.mean() < 0.01
    assert [n for n, _ in cutoffs(0.8)] == [32, 64, 96, 128]
    assert cutoffs(0.8)[-1][1] > 0.55 * HASHES  # dissimilar pairs go


def test_signatures_tell_the_similarity():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    for share in (0.2, 0.5, 0.8, 0.95):
        base = [rng.choice(words) for _ in range(3000)]
        cut = int(3000 * share)
        a, b = shingle_set(" ".join(base)), shingle_set(" ".join(base[:cut] + [rng.choice(words) for _ in range(3000 - cut)]))
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = (np.frombuffer(signature(least_hashes(s)), np.uint8) for s in (a, b))
        assert abs((x == y).mean() - exact) < 4.5 * math.sqrt(0.25 / HASHES)
    same = bands(least_hashes(a))
    assert len(same) == BANDS and BANDS * LEAST <= HASHES


def block_of(sets, sides=None, roots=None, bands_=None, at=0):
    sets = [np.unique(np.array(x, np.uint64)) for x in sets]
    k = len(sets)
    return Sets(
        np.arange(k) if roots is None else roots, sides, np.zeros((k, BANDS), np.int64) if bands_ is None else bands_, at,
        np.array([list(signature(least_hashes(x))) for x in sets], np.uint8),
        np.array([len(x) for x in sets]), np.concatenate(sets))


def hashes_of(rng, n):
    return [rng.getrandbits(64) for _ in range(n)]


def test_close_copies_cost_one_comparison_each(monkeypatch):
    rng = random.Random(1)
    base = hashes_of(rng, 200)
    block = block_of([base[:190] + hashes_of(rng, rng.randrange(5)) for _ in range(150)])
    compared = []
    whole = Sets.similar
    monkeypatch.setattr(Sets, "similar", lambda self, j, among, p: compared.append(len(among)) or whole(self, j, among, p))
    i, j = links_of(block, cutoffs(0.8), 80)
    assert len(i) == 149 and sum(compared) < 2 * 150
    linked = block_of([base] * 5, roots=np.zeros(5, int))
    assert links_of(linked, cutoffs(0.8), 80) == ([], [])


def test_links_connect_as_brute_force():
    """Sets around the threshold; also of two sides, and with pairs that an earlier band had."""
    rng = random.Random(4)
    base = hashes_of(rng, 100)
    sets = [set(rng.sample(base, rng.randrange(80, 101))) | set(hashes_of(rng, rng.randrange(12))) for _ in range(60)]
    sides = np.array([rng.randrange(2) for _ in sets])
    earlier = np.array([[rng.randrange(3)] + [0] * (BANDS - 1) for _ in sets])

    def groups(may):
        label = list(range(60))
        for x in range(60):
            for y in range(x):
                both = len(sets[x] & sets[y])
                if may(x, y) and 100 * both >= 80 * len(sets[x] | sets[y]):
                    label = [label[y] if a == label[x] else a for a in label]
        return {frozenset(k for k in range(60) if label[k] == a) for a in label}

    def joined(i, j):
        label = list(range(60))
        for x, y in zip(i, j, strict=True):
            assert 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
            label = [label[y] if a == label[x] else a for a in label]
        return {frozenset(k for k in range(60) if label[k] == a) for a in label}

    assert joined(*links_of(block_of(map(list, sets)), cutoffs(0.8), 80)) == groups(lambda x, y: True)
    got = links_of(block_of(map(list, sets), sides=sides), cutoffs(0.8), 80)
    assert joined(*got) == groups(lambda x, y: sides[x] != sides[y])
    got = links_of(block_of(map(list, sets), bands_=earlier, at=1), cutoffs(0.8), 80)
    assert joined(*got) == groups(lambda x, y: earlier[x][0] != earlier[y][0])


def test_similar_sets_share_a_rare_shingle(spark):
    rng = random.Random(8)
    rows, sets = [], []
    base = rng.sample(range(10_000), 200)
    for node in range(40):
        own = set(base)
        for _ in range(rng.randrange(25)):
            own.discard(rng.choice(base))
            own.add(rng.randrange(10_000, 20_000))
        sets.append(own)
        rows.append((node, sorted(own)))
    got = rare_shingles(spark.createDataFrame(rows, "node long, hashes array<long>"), 80).collect()
    held = {}
    for r in got:
        held.setdefault(r.node, set()).add(r.bucket)
    for x in range(40):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if 100 * both >= 80 * len(sets[x] | sets[y]):
                assert held[x] & held[y]


KIND = ("bucket long, low int, high int, node long, root long, side int, band int, bands array<long>, "
        "signature binary, hashes array<long>")


def test_blocks_split_over_batches(spark):
    """Blocks that end and go on at any row of a batch are taken whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(b, 0, 0, b * 100 + n, b * 100 + n, 0, 0, [0] * BANDS, bytes(range(HASHES)), list(range(50)))
                for b in range(6) for n in range(b * 3 + 1)]
        got = search(spark.createDataFrame(rows, KIND), 80, 1e-6).collect()
        assert Counter(r.a // 100 for r in got) == {b: b * 3 for b in range(1, 6)}
        assert all(r.a // 100 == r.b // 100 for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query_as_sql(spark):
    folder = "/root/testdata/sf0.001"
    df = op12_minhash(spark, folder)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = base.execute(OP12_SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_a_pass_leaves_out_what_is_linked(spark):
    """After the first pass the copies of one text are one root, so no bucket is open any more."""
    nodes = spark.createDataFrame(
        [(n, 50, [0] * BANDS, bytes(range(HASHES)), list(range(50))) for n in range(30)],
        "node long, n long, bands array<long>, signature binary, hashes array<long>")
    rows = nodes.select(F.lit(0).alias("band"), F.lit(5).cast("long").alias("bucket"), "node")
    linker = Linker(nodes, 80, 1e-6, 4096)
    linker.run(rows)
    assert linker.links.count() == 29 and linker.open(rows).isEmpty()


def test_parts_of_a_bucket_meet(spark):
    rows = spark.range(100).selectExpr("1L AS bucket", "id AS node", "0L AS first", "4 AS parts")
    met = in_blocks(rows, True).groupBy("low", "high").agg(F.collect_set("node").alias("nodes")).collect()
    pairs = {frozenset((a, b)) for r in met for a in r.nodes for b in r.nodes if a < b}
    assert len(pairs) == 100 * 99 // 2 and len(met) == 10
    alone = in_blocks(rows, False).groupBy("low", "high").agg(F.collect_set("node").alias("nodes")).collect()
    assert len(alone) == 4 and all(0 in r.nodes for r in alone) and sum(len(r.nodes) for r in alone) == 103
