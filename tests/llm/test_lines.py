import re
from collections import defaultdict

from emberwatch.llm.lines import dedup_lines

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=20, docs=3):
    def key(line):
        return re.sub("^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).translate(UPPER)

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(-1 if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = -1 if i is None else i
        kept = [x for x in lines if len(holders[key(x)]) < docs or max(holders[key(x)]) == own]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def found(df):
    rows = dedup_lines(df).select("doc_id", "text", "n_lines", "n_dropped").collect()
    return sorted(map(tuple, rows), key=repr)


def test_as_brute_force(small, odd):
    for docs in (small["documents"], odd):
        assert found(docs) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_columns_stay_and_empty_tables_are_empty(odd, nothing):
    out = dedup_lines(odd)
    assert set(out.columns) == {*odd.columns, "n_dropped"}
    assert dedup_lines(nothing).count() == 0


def test_most_common_line_is_joined_from_tables(odd):
    """Both sides of the join on the key are shuffled, so that a large key can be split."""
    plan = dedup_lines(odd)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
