import sys

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from tests.llm import cases as C

SF = "/root/testdata/sf0.001"


def test_every_operator_has_its_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and len(names) == 13
    assert "pipeline" in entry.queries()


def test_queries_beside_their_sql():
    sys.path.insert(0, "tools")
    import check

    assert check.main(SF, ["op3_license_scan", "op7_line_dedup", "op13_ranked_search"]) == []


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(P.STAGES)
    columns = docs.columns

    def step(name, docs):
        out = stages[name](spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == columns
        return out.persist()

    known = step("language_id", docs)
    assert known.count() == len(rows)  # every one of these is prose

    trimmed = step("line_dedup", known)
    want = {d: kept for d, _, _, kept in C.spread(rows)}
    now = [(r.doc_id, r.text, r.source) for r in trimmed.collect()]
    assert {d: t for d, t, _ in now} == want

    single = step("ngram_jaccard", trimmed)
    smallest = {d: c for d, _, c in C.classes(now)}
    now = [r for r in now if smallest[r[0]] == r[0]]
    assert {r.doc_id for r in single.collect()} == {d for d, _, _ in now}

    clean = step("decontamination", single)
    want = {d for d, _, hit, _ in C.items_found(now, items) if not hit}
    assert {r.doc_id for r in clean.collect()} == want

    pieces = step("best_fit_packing", clean)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == want


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.collect() == []


def test_line_dedup_keeps_columns_of_its_own_names(spark):
    docs = C.frame(spark, C.documents()).withColumn("n_lines", F.lit(77)).withColumn("kept_text", F.lit("mine")).withColumn("Line", F.lit(1))
    out = P.line_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(C.documents()) and {(r.n_lines, r.kept_text) for r in rows} == {(77, "mine")}
    want = [(d, kept) for d, _, _, kept in C.spread(C.documents())]
    assert C.ordered((r.doc_id, r.text) for r in rows) == C.ordered(want)
