import math
from collections import Counter

import pytest

from seqloom.llm import search as R
from tests.llm import cases as C


def ranked(rows, items, top=20):
    """(item_id, rank, doc_id, score) by brute force; one list for every item row."""
    counted = [(d, Counter(C.alnum(t))) for d, t, _ in rows if C.alnum(t)]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counted:
            m = 100 - 25 + (25 * c.total() * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in C.alnum(text) if w in c
            )
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda f: f[:3])
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(found[:top])]
    return out


@pytest.fixture(scope="module")
def rows():
    return C.documents()


def items():
    words = C.prose(1, 300).split()
    return [(1, " ".join(words[40:70])), (2, " ".join(words[60:75]).upper() + " again again and"), (3, "Two, three! two"), (4, None), (5, " .. "), (None, "one two"),
            (6, "zzzzqq-qqzz"), (7, " ".join(words[40:70])), (7, " ".join(words[40:70])), (7, "été letter"), (30, C.prose(2, 60)), (31, C.prose(14, 5000))]


@pytest.mark.parametrize("top,block_bytes,block_items,cells", [(20, 1 << 20, 1 << 14, 1 << 20), (3, 300, 1 << 14, 50), (2, 1 << 20, 2, 1)])
def test_ranks(spark, rows, monkeypatch, top, block_bytes, block_items, cells):
    monkeypatch.setattr(R, "CELLS", cells)
    table = spark.createDataFrame([(i, t, "clash", 5) for i, t in items()], "item_id long, text string, score string, rank int")
    got = R.search(C.frame(spark, rows), table, top, block_bytes, block_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = ranked(rows, items(), top)
    assert {i for i, *_ in want} == {1, 2, 3, None, 7, 30, 31}
    assert C.ordered(got.collect()) == C.ordered(want)


def test_ties_stand_by_id(spark):
    rows = [(d, "same words here", "s") for d in range(60, 0, -1)] + [(None, "same words here", "s")] + [(100 + d, "others", "s") for d in range(200)]
    got = R.search(C.frame(spark, rows), spark.createDataFrame([("a", "same")], "item_id string, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 21)) and len({r.score for r in got}) == 1
    few = R.search(C.frame(spark, rows[58:61] + rows[70:]), spark.createDataFrame([("a", "same")], "item_id string, text string")).orderBy("rank")
    assert [r.doc_id for r in few.collect()] == [1, 2, None]


def test_nothing_to_search(spark, rows):
    docs, table = C.frame(spark, rows), spark.createDataFrame(items(), "item_id long, text string")
    assert R.search(docs.limit(0), table).collect() == []
    assert R.search(docs, table.limit(0)).collect() == []
    assert R.search(docs, table.where("item_id in (4, 5)")).collect() == []
    assert R.search(C.frame(spark, [(1, None, "a"), (2, " - ", "a")]), table).collect() == []
