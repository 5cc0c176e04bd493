import re

import pytest

from emberwatch.llm.contamination import contamination, decontaminate, window_blocks

WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items, size=10):
    patterns = {}
    for item, text in items:
        w = words(text)
        for i in range(max(min(1, len(w)), len(w) - size + 1)):
            patterns.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(p) for p in patterns}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, names = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if items_here := patterns.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= items_here
        out.append((doc, len(w), len(hit), sorted(str(x) for x in names if x is not None), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, "One two three four five six seven eight nine ten"), (2, "two three"), (3, None), (4, ""),
        (None, "日本語"), (10, "three FOUR five"), (10, "three four five"), (5, "..."),
        (6, "this very line stands in many of the documents own line of it"),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, items, **bound):
    rows = contamination(docs, items, **bound).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows), key=repr)


def plain(df, key):
    return [tuple(r) for r in df.select(key, "text").collect()]


def test_as_brute_force(small, odd, items):
    for docs, bench in ((small["documents"], small["benchmark"]), (odd, items)):
        want = brute(plain(docs, "doc_id"), plain(bench, "item_id"))
        assert found(docs, bench) == want
    assert sum(r[4] for r in want) >= 3


def test_blocks_of_the_benchmark_give_the_same(odd, items):
    assert len(list(window_blocks(items, block_chars=60))) > 3
    assert found(odd, items, block_chars=60) == found(odd, items)


def test_spans_are_of_the_original_text(odd, items):
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in contamination(odd, items).collect():
        for start, end in r.spans:
            assert words(texts[r.doc_id][start:end]) and texts[r.doc_id][start].isalnum()
        if r.doc_id == 12:
            assert r.spans == [[0, len(texts[12]) - 1]]


def test_stage_keeps_clean_rows_whole(odd, items, nothing):
    kept = decontaminate(odd, items)
    dirty = {r[0] for r in found(odd, items) if r[4]}
    assert sorted(map(repr, kept.collect())) == sorted(
        repr(r) for r in odd.collect() if r.doc_id not in dirty
    )
    assert contamination(nothing, items).count() == 0
    assert not any(r[4] for r in found(odd, items.limit(0)))
