import numpy as np
import pytest

from emberwatch.llm.toxicity import (
    DECAY, SPAN, Model, codes_of, evidence, features, fit_svm, held_out, toxicity, train,
    word_bounds, word_lengths, without_toxic,
)


def slow_features(word):
    """All subsequences of three characters within the span, edges included."""
    codes = codes_of([word])[0].tolist()
    out = {}
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            for k in range(j + 1, min(i + SPAN, len(codes))):
                triple = (codes[i], codes[j], codes[k])
                out[triple] = out.get(triple, 0) + DECAY ** (k - i - 2)
    return out


def test_features_are_the_kernels():
    for word in ("moron", "aaa", "ab", "é日x", "abcdefghijklmnop"):
        row = features([word])[0]
        want = slow_features(word)
        assert np.count_nonzero(row) == len(want)
        scale = [row[a * 43 * 43 + b * 43 + c] / n for (a, b, c), n in want.items()]
        assert np.allclose(scale, scale[0], rtol=1e-4)


def test_evidence_of_words_in_texts():
    rng = np.random.default_rng(1)
    weights = rng.normal(size=43**3).astype(np.float32)
    words = ["moron", "a", "the", "x" * 30, "é"]
    codes, starts = codes_of([" ".join(words), None, "", "moron"])
    assert word_lengths(codes)[:4].tolist() == [5, 1, 3, 30]
    want = [sum(n * weights[a * 43 * 43 + b * 43 + c] for (a, b, c), n in slow_features(w).items()) for w in words]
    got = evidence(codes, weights)
    assert np.allclose(got[:5], want, atol=1e-3) and np.isclose(got[-1], want[0], atol=1e-3)
    assert len(word_bounds(codes)) == 6 and len(starts) == 5


def test_gaps_and_put_in_characters():
    same = [codes_of([t])[0].tolist() for t in ("idiot", "I.D.I.O.T", "i d i o t", "id-iot", " idiot!! ")]
    assert all([c for c in x if c != 26] == same[0][1:-1] for x in same)
    assert codes_of(["a", "b"])[0].tolist() == [26, 0, 26, 1, 26]


def test_svm():
    x = np.array([[1.0, 0], [2, 1], [-1, 0], [-2, 1]])
    beta = fit_svm(x, np.array([1.0, 1, -1, -1]), np.ones(4), 1e-3)
    assert beta[0] > 0.5 and abs(beta[1]) < 0.2


@pytest.fixture(scope="module")
def corpus(spark):
    folder = "/root/testdata/sf0.01"
    return [spark.read.parquet(f"{folder}/{t}.parquet").cache() for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def scored(corpus):
    docs, labels = corpus
    return toxicity(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_labels(scored):
    known = scored[scored.held_out & scored.toxic.notna()]
    toxic, clean = known[known.toxic == 1], known[known.toxic == 0]
    assert clean.predicted.mean() <= 0.02
    assert toxic.predicted.mean() >= 0.4
    assert scored.score.between(0, 1).all() and len(scored) == 1000


def test_held_out_rows_teach_nothing(corpus, scored):
    docs, labels = corpus
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity(docs, turned).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[scored.doc_id], scored.score, atol=1e-6)


def test_odd_rows(odd, nothing, labels):
    model = train(odd, labels)
    assert (model.scores([None, "", "x"]) < 0.7).all()
    got = toxicity(odd, labels).collect()
    assert len(got) == odd.count() and {r.predicted for r in got} == {0}
    assert without_toxic(odd, labels).columns == odd.columns
    assert without_toxic(odd, labels).count() == odd.count()
    assert toxicity(nothing, labels).count() == 0 and toxicity(odd, labels.limit(0)).count() == odd.count()
    assert isinstance(model, Model)
