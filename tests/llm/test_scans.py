import pytest

from seqloom.llm import benchmark, boilerplate, licenses
from tests.llm import cases as C


@pytest.fixture(scope="module")
def rows():
    return C.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return C.frame(spark, rows).persist()


@pytest.fixture(scope="module")
def items():
    words = C.prose(1, 300).split()
    return [(1, " ".join(words[40:70])), (2, " ".join(words[60:75]).upper()), (3, "Two, three!"), (4, None), (5, " .. "), (None, "one two"),
            (6, "not anywhere at all"), (7, " ".join(words[40:70])), (30, C.prose(2, 60))]


@pytest.mark.parametrize("block_bytes", [benchmark.BLOCK_BYTES, 200])
def test_items(spark, docs, rows, items, block_bytes):
    table = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, key string")
    got = benchmark.find_items(docs, table, block_bytes=block_bytes).collect()
    assert C.ordered((r.doc_id, r.n_words, r.hit, r.items) for r in got) == C.ordered(C.items_found(rows, items))
    texts = {d: t for d, t, _ in rows}
    for r in got:
        if r.doc_id is not None and block_bytes > 200:
            assert [w for s in r.spans for w in C.alnum(texts[r.doc_id][s.start : s.end])] == [C.alnum(texts[r.doc_id])[i] for i in r.hit]
    kept = benchmark.drop_contaminated(docs, table, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    clean = [d for d, _, hit, _ in C.items_found(rows, items) if not hit]
    assert C.ordered((r.doc_id,) for r in kept.collect()) == C.ordered((d,) for d in clean)


def test_no_items_and_no_documents(spark, docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r.hit == [] and r["items"] == [] for r in benchmark.find_items(docs, none).collect())
    some = spark.createDataFrame(items, "item_id long, text string")
    assert benchmark.find_items(docs.limit(0), some).collect() == []


def test_lines_of_many_sites(docs, rows):
    got = boilerplate.spread_lines(docs)
    assert got.columns == [*docs.columns, "line_numbers_removed", "n_lines", "kept_text"]
    want = C.spread(rows)
    assert any(gone for _, _, gone, _ in want)
    assert C.ordered((r.doc_id, r.n_lines, r.line_numbers_removed, r.kept_text) for r in got.collect()) == C.ordered(want)


def test_near_the_threshold(spark):
    rows = [(i, f"own {i}\nin seven\n{'in eight' if i < 8 else 'x'}\nin nine", f"s{i % 7 if i < 14 else i}") for i in range(14)]
    rows = [(i, f"seven {i}\n" + "\n".join(f"line {n}" for n in (7, 8, 9) if i < n), f"s{i}") for i in range(12)]
    got = {r.doc_id: r.kept_text for r in boilerplate.spread_lines(C.frame(spark, rows)).collect()}
    assert got[0] == "seven 0\nline 7\nline 8\nline 9" and got[1] == "seven 1\nline 7" and got[8] == "seven 8"


def test_lines_of_an_empty_table(docs):
    assert boilerplate.spread_lines(docs.limit(0)).collect() == []


def by_hand(text):
    words = C.alnum(text)
    places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    found, best = set(), 0.0
    for start in range(0, max(1, -(-len(words) // licenses.STEP) - 1)):
        block = set(words[start * licenses.STEP : start * licenses.STEP + licenses.BLOCK])
        for label, sentences in licenses.TEMPLATES.items():
            for s in sentences:
                tokens = set(s.split())
                share = len(tokens & block) / len(tokens)
                if share >= licenses.CONTAINED - 1e-9:
                    found.add(label)
                    best = max(best, share)
    base = sorted({label for _, label in places})
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
            ",".join(base), ",".join(sorted(found | set(base))), max(best, 1.0 if places else 0.0))


def test_licenses(spark, rows):
    notice = "Permission is hereby granted, free of charge, to any person obtaining a copy of this SOFTWARE and files."
    more = rows + [
        (60, C.prose(31, 500) + "\n" + notice + "\n" + C.prose(32, 40), "a"), (61, "All rights\nreserved", "a"), (62, "rights all", "a"),
        (63, "permissions cc byte mit licenses apache-license", "a"), (64, "MIT License mit license MIT LICENSE", "a"),
        (65, C.prose(33, 15) + " redistribution and use in source or binary form with or without modification are permitted provided", "a"),
    ]
    got = licenses.find_licenses(C.frame(spark, more))
    want = [(d, *by_hand(t)) for d, t, _ in more]
    assert C.ordered(got.collect()) == C.ordered(want)
    assert {r.doc_id for r in got.where("labels like '%text:mit%'").collect()} == {60}
    assert licenses.find_licenses(C.frame(spark, more).limit(0)).collect() == []
