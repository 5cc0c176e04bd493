import re

import pytest

from emberwatch.llm.pii import estimate, find_spans, op7_pii, personal_spans

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    "a@b.com_x@y.zz a@b.c.", "x.y@z 1.2.3.4.5.6.7.8 001.002.003.004 999.1.1.1 256.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112", "a@b.c@d.e.f @x.y a@@b.c %@-.-",
    "+1 (017) 555-7713 +49--- +1 2 +123456789012345678", "é🎉 a.b@c.de 1.1.1.1 é", None, "",
    "5 5 5 5 5 5 5 5 5 5 5 5 5", "1" * 30_000 + " " + "a" * 30_000 + "@b.c", "+" * 5000 + "1 " * 5000,
    "1.1.1.1" * 500, "0000.1.1.1 1.0000255.3.4 1.2.3.0256",
]


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]


@pytest.fixture(scope="module")
def mixed(spark, small, odd):
    docs = small["documents"].select("doc_id", "text")
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    return docs.union(more).cache()


def test_base_spans_as_brute_force(mixed):
    got = {r.doc_id: r for r in personal_spans(mixed).collect()}
    for r in mixed.collect():
        assert [tuple(s) for s in got[r.doc_id].base] == brute(r.text)
        assert {tuple(s) for s in got[r.doc_id].base} <= {tuple(s) for s in got[r.doc_id].spans}


@pytest.mark.parametrize("other", ["commit {0:040x} of it", "{0} letters only " + "word" * 6])
def test_secrets_are_found_and_what_looks_alike_is_not(spark, other):
    """No secret is labelled as such: the labelers' votes alone tell."""
    rows = [(i, f'and token = "{i * 7919:040x}" is {i}') for i in range(5000, 5040)]
    rows += [(i, other.format(i * 104729)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in personal_spans(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans] == ([("secret", 13, 53)] if r.doc_id >= 5000 else [])


def test_reliabilities():
    """Two good labelers and one that says anything."""
    patterns = [((1, 1, 0), 400), ((1, 1, 1), 400), ((0, 0, 1), 500), ((0, 0, 0), 500), ((1, 0, 1), 10), ((0, -1, 1), 10)]
    belief = estimate([{"votes": v, "n": n} for v, n in patterns], 3)
    assert belief[1, 1, 0] > 0.95 and belief[0, 0, 1] < 0.05 and belief[0, -1, 1] < 0.5


def test_odd_rows(spark, odd, nothing, tmp_path):
    assert personal_spans(odd).count() == odd.count()
    assert personal_spans(nothing).count() == 0
    odd.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op7_pii(spark, str(tmp_path)).collect()
    assert len(rows) == odd.count() and {r.spans for r in rows} == {""}


def test_candidates_of_any_length(spark):
    """No candidate is cut or lost for its length, and long runs cost no more than their length."""
    long_name = "n" * 300 + " [at] " + "h" * 200 + " [dot] example" + ".part" * 20
    texts = ['token = "' + "a1" * 300 + '"', long_name, "-" * 200_000, "._%-" * 50_000 + " [at] x", "x1" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(c.kind, c.start, c.end) for c in r.candidates] for r in find_spans(docs).collect()}
    assert got == {
        0: [("secret", 9, 609)], 1: [("email", 0, len(long_name))], 2: [], 3: [], 4: [("secret", 0, 200_000)]}
