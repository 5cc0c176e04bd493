import pytest

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
SAME = "this very line stands in many of the documents"
TEXTS = [
    (1, None), (2, ""), (3, "  \n\t\n \x0b\x0c\r"), (4, "a"), (5, LONG), (5, LONG),
    (6, f"{SAME}\nown line of the sixth"), (7, f"{SAME.upper()}  \n{SAME}"), (8, f"\t{SAME}"),
    (9, "Ünï 日本語 🎉 é don't 12 ABC abc"), (None, f"{SAME}\nnobody"),
    (11, "one two three four five six seven eight nine ten eleven"),
    (12, "ONE two, three-four five six seven eight nine TEN!"), (13, "x" * 5000),
]
#: Columns that operators use as well, in the input.
CLASHING = (
    "lang string, source string, n_chars long, n_words long, kept string, mark string, key int, "
    "drops int, n_lines string, score string, shard string, slot string, size string, h string, "
    "words string, _kept int, _gone int, loss int, spans int, base int, node int, total int"
)


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, long, repeated and unusual texts, with columns in the way."""
    rows = [
        (i, t, ["en", "de", None][n % 3], "s" if n % 4 else None, len(t or "") if n % 5 else None)
        for n, (i, t) in enumerate(TEXTS)
    ]
    names = "doc_id long, text string, " + CLASHING
    more = len(CLASHING.split(",")) - 3
    return spark.createDataFrame([row + (None,) * more for row in rows], names)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture(scope="session")
def labels(spark):
    kind = "doc_id long, quality int, toxic int"
    return spark.createDataFrame([(9, 1, 0), (9, 1, 0), (6, 0, 1), (None, 1, 1), (99, 1, 1), (7, None, None)], kind)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest corpus, with its labels, pages and benchmark."""
    folder = "/root/testdata/sf0.001"
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark")}
