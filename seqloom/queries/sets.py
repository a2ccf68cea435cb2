"""Ordering, chunk bookkeeping and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import sets as U
from seqloom.registry import query
from seqloom.sources import standins as D
from seqloom.sources.standins import ctes


@query("order_by_value", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def order_by_value(spark, sf):
    return U.order_by_value(D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query(
    "row_chunk",
    "SELECT doc_id AS row_id, (row_number() OVER (ORDER BY source, doc_id) - 1) AS dense, ((row_number() OVER (ORDER BY source, doc_id) - 1) // ((SELECT count(*) FROM documents) // 7 + 1))::INT AS chunk FROM documents",
)
def row_chunk(spark, sf):
    """Dense ids in order of source and document, then seven contiguous chunks."""
    rows = U.with_row_id(D.keyed(spark, sf).withColumnRenamed("row_id", "doc_id").select("doc_id", "gene"), "gene", "doc_id")
    return U.row_chunk(rows, 7).select(F.col("doc_id").alias("row_id"), F.col("row_id").alias("dense"), "chunk")


@query(
    "union_ref_var",
    ctes("seqs", "vars")
    + """
    , m AS (SELECT variant_id, chrom, pos, ref, alt, label, gene, sequence FROM vars JOIN seqs ON row_id = variant_id)
    SELECT gene, chrom AS chromosome, sequence, 0 AS target, 'wild-type' AS description FROM m
    UNION ALL SELECT gene, chrom, alt || substr(sequence, length(ref) + 1), label, 'chr' || chrom || ':' || pos || ' ' || ref || ':' || alt FROM m
    """,
)
def union_ref_var(spark, sf):
    """Every document as a transcript whose first bases the event of its number changes."""
    seqs = D.sequences(spark, sf).select(F.col("row_id").alias("variant_id"), "gene", F.col("sequence").alias("ref_sequence"))
    none = F.array().cast("array<tinyint>")
    rows = D.variants(spark, sf).join(seqs, "variant_id").withColumns(
        {
            "transcript_id": F.col("variant_id").cast("string"),
            "var_sequence": F.concat("alt", F.substr("ref_sequence", F.length("ref") + 1)),
            **{c: none for c in ("ref_cds", "ref_splice", "var_cds", "var_splice")},
        }
    )
    return U.union_ref_var(rows).select("gene", "chromosome", "sequence", "target", "description")


@query(
    "union_all",
    "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark UNION ALL SELECT page_id, html FROM pages",
)
def union_all(spark, sf):
    return U.union_all(
        [
            D.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"),
            D.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"),
            D.table(spark, sf, "pages").select(F.col("html").alias("text"), F.col("page_id").alias("id")),
        ]
    )


@query(
    "missing_chunks",
    "SELECT DISTINCT (doc_id // ((SELECT count(*) FROM documents) // 40 + 1))::INT AS chunk FROM documents EXCEPT SELECT DISTINCT (doc_id // ((SELECT count(*) FROM documents) // 40 + 1))::INT FROM documents WHERE source LIKE '%7' AND lang = 'de'",
)
def missing_chunks(spark, sf):
    """Of forty chunks, those without a German document of a source ending in 7 are still to do."""
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source", "lang")
    done = U.row_chunk(docs, 40).filter("source LIKE '%7' AND lang = 'de'")
    return U.missing_chunks(U.expected_chunks(docs, 40), done)


@query(
    "report_order",
    """
    SELECT 'm' || user_id AS model, CASE WHEN user_id % 11 > 0 THEN 'class' || user_id % 4 END AS model_class, round(avg(value), 8) AS value
    FROM events GROUP BY user_id ORDER BY model_class NULLS FIRST, model
    """,
)
def report_order(spark, sf):
    events = D.table(spark, sf, "events")
    name = F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model")
    means = events.groupBy(name).agg(F.round(F.avg("value"), 8).alias("value"))
    classes = events.filter("user_id % 11 > 0").select(name, F.concat(F.lit("class"), (F.col("user_id") % 4).cast("string")).alias("model_class")).distinct()
    return U.report_order(means, classes).select("model", "model_class", "value")
