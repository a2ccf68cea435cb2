"""Column selection, row filters and casts."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import joins as J, projections as P
from seqloom.plans.report import parse_result, result_keys, select_report_rows
from seqloom.operators.aggregates import format_ci, multi_hot, multirun_ci
from seqloom.registry import query
from seqloom.sources import standins as D
from seqloom.sources.standins import ctes


def labelled(spark, sf):
    labels = D.table(spark, sf, "labels").withColumnRenamed("doc_id", "row_id")
    return D.keyed(spark, sf).join(labels, "row_id", "left")


@query("subset_columns", "SELECT source AS gene, source AS chromosome, quality FROM documents LEFT JOIN labels USING (doc_id)")
def subset_columns(spark, sf):
    return P.subset_columns(labelled(spark, sf), ["quality", "absent"])


@query("drop_null_target", "SELECT doc_id AS row_id, toxic::DOUBLE AS target FROM labels WHERE toxic = 1 OR quality = 1")
def drop_null_target(spark, sf):
    """Unlabelled documents have no target; labelled but poor and harmless ones get NaN."""
    poor = (F.col("quality") == 0) & (F.col("toxic") == 0)
    rows = labelled(spark, sf).withColumn("target", F.when(poor, float("nan")).otherwise(F.col("toxic").cast("double")))
    return P.drop_null(rows, "target").select("row_id", "target")


@query(
    "drop_null_keys",
    "SELECT o_orderkey, left(o_orderpriority, 1)::INT AS level, o_totalprice FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' AND o_totalprice >= 1000",
)
def drop_null_keys(spark, sf):
    level = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.left("o_orderpriority", F.lit(1)).cast("int"))
    price = F.when(F.col("o_totalprice") >= 1000, F.col("o_totalprice"))
    rows = D.table(spark, sf, "orders").select("o_orderkey", level.alias("level"), price.alias("o_totalprice"))
    return P.drop_null(rows, "level", "o_totalprice")


@query(
    "drop_bad_gene",
    "SELECT c_custkey, c_mktsegment AS gene FROM customer WHERE c_custkey % 4 = 3",
)
def drop_bad_gene(spark, sf):
    gene = (
        F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).when(F.col("c_custkey") % 4 == 1, "None")
        .when(F.col("c_custkey") % 4 == 2, "").otherwise(F.col("c_mktsegment"))
    )
    return P.drop_bad_gene(D.table(spark, sf, "customer").select("c_custkey", gene.alias("gene")))


@query("filter_regex", ctes("vars") + "SELECT variant_id, match_group FROM vars WHERE match_group LIKE '5_prime%' OR match_group LIKE '3_prime%'")
def filter_regex(spark, sf):
    return P.filter_regex(D.variants(spark, sf).select("variant_id", "match_group"), "match_group", "5_prime|3_prime")


@query(
    "select_by_pattern",
    "SELECT l_orderkey, l_linenumber, l_discount AS a_log2FC, l_tax AS b_log2FC FROM lineitem",
)
def select_by_pattern(spark, sf):
    rows = D.table(spark, sf, "lineitem").withColumnsRenamed({"l_discount": "a_log2FC", "l_tax": "b_log2FC"})
    return P.select_by_pattern(rows, "log2FC", "l_orderkey", "l_linenumber")


WORDS = ("the", "and", "le", "der", "of")


@query(
    "any_label_filter",
    """
    SELECT doc_id FROM documents WHERE list_has_any(string_split(text, ' '), ['the', 'and', 'le', 'der', 'of'])
    """,
)
def any_label_filter(spark, sf):
    rows = D.table(spark, sf, "documents").select("doc_id", *multi_hot(F.col("text"), WORDS, sep=" "))
    return P.any_label_filter(rows, [f"target_{w}" for w in WORDS]).select("doc_id")


@query(
    "drop_unmatched",
    ctes("segs", "vars")
    + """
    SELECT DISTINCT v.variant_id FROM vars v JOIN segs s ON v.chrom = s.chrom AND v.region = s.kind AND s.start <= v.pos - 1 AND v.pos - 1 < s.end
    """,
)
def drop_unmatched(spark, sf):
    matched = J.variant_utr_match(D.variants(spark, sf), D.segments(spark, sf), width=1024)
    return P.drop_null(matched, "tx_id").select("variant_id")


@query("skip_empty_seq", ctes("utrs") + "SELECT row_id, utr AS sequence FROM utrs WHERE row_id % 3 <> 0 AND utr <> ''")
def skip_empty_seq(spark, sf):
    rows = D.utrs(spark, sf).select("row_id", F.when(F.col("row_id") % 3 == 0, "").otherwise(F.lower("utr")).alias("sequence"))
    return P.skip_empty_seq(rows)


@query("skip_empty_seq_whole", ctes("seqs") + "SELECT row_id, sequence FROM seqs WHERE row_id % 3 <> 0 AND sequence <> ''")
def skip_empty_seq_whole(spark, sf):
    rows = D.sequences(spark, sf).select("row_id", F.when(F.col("row_id") % 3 == 0, "").otherwise(F.lower("sequence")).alias("sequence"))
    return P.skip_empty_seq(rows)


@query(
    "prefix_targets",
    ctes("utrs") + "SELECT utr AS sequence, length(utr)::INT AS cds, 0 AS splice, row_id AS target_mrl_row_id FROM utrs",
)
def prefix_targets(spark, sf):
    rows = D.utrs(spark, sf).select("row_id", F.col("utr").alias("sequence"), F.length("utr").alias("cds"), F.lit(0).alias("splice"))
    return P.prefix_targets(rows, "target_mrl_")


@query("rename_union_ready", "SELECT o_orderkey, o_orderstatus AS sequence, o_totalprice AS cds, o_orderpriority AS splice FROM orders")
def rename_union_ready(spark, sf):
    rows = D.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("ref_sequence"), F.col("o_totalprice").alias("ref_cds"), F.col("o_orderpriority").alias("ref_splice")
    )
    return P.strip_prefix(rows, "ref_", ("sequence", "cds", "splice"))


@query(
    "cast_compact",
    ctes("tracks") + "SELECT row_id, (row_id % 100)::TINYINT AS small, (row_id / 7)::FLOAT AS single, array_to_string(cds, '') AS track FROM tracks",
)
def cast_compact(spark, sf):
    rows = D.tracks(spark, sf).withColumn("wide", F.col("cds").cast("array<bigint>"))
    return rows.select(
        "row_id",
        (F.col("row_id") % 100).cast("tinyint").alias("small"),
        (F.col("row_id") / 7).cast("float").alias("single"),
        F.array_join(P.compact_track(F.col("wide")).cast("array<string>"), "").alias("track"),
    )


@query(
    "select_report_rows",
    ctes("runs")
    + """
    , m AS (SELECT model, CASE metric WHEN 'click' THEN 'auprc' WHEN 'view' THEN 'r' ELSE metric END AS metric, round(avg(value), 9) AS value
        FROM runs WHERE NOT (metric = 'click' AND row_id % 150 < 75) GROUP BY ALL)
    SELECT model, coalesce(max(value) FILTER (WHERE metric = 'auprc'), max(value) FILTER (WHERE metric = 'r')) AS value
    FROM m WHERE metric IN ('auprc', 'r') AND NOT contains(model, 'm1') GROUP BY model
    """,
)
def report_rows(spark, sf):
    runs = D.seed_metrics(spark, sf).filter(~((F.col("metric") == "click") & (F.col("row_id") % 150 < 75)))
    metric = F.when(F.col("metric") == "click", "auprc").when(F.col("metric") == "view", "r").otherwise(F.col("metric"))
    means = runs.groupBy("model", metric.alias("metric")).agg(F.round(F.avg("value"), 9).alias("value"))
    return select_report_rows(means, ["model"], skip=("m1",))


@query(
    "validate_splits",
    """
    SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split,
      count(*) AS rows, count(*) AS features, count(*) AS labels FROM labels GROUP BY 1
    """,
)
def validate(spark, sf):
    part = F.when(F.col("doc_id") % 10 < 7, "train").when(F.col("doc_id") % 10 == 7, "val").otherwise("test")
    rows = D.table(spark, sf, "labels").select(part.alias("split"), F.col("quality").alias("target"), F.col("doc_id").alias("x"))
    return P.validate_splits(rows, "target", "x", ("train", "val", "test"))


@query(
    "parse_result",
    ctes("runs")
    + """
    SELECT model, metric, round(avg(value), 8) AS mean, round(1.96 * stddev_pop(value) / sqrt(count(*)), 8) AS ci,
      'events' AS dataset, 'reg_ridge' AS task, 'target' AS target, 'hard-kmer' AS split_type, 'all' AS seed
    FROM runs GROUP BY model, metric
    """,
)
def parsed(spark, sf):
    """Numbers written as `mean ± ci` under a result file's name, then parsed back."""
    ci = multirun_ci(D.seed_metrics(spark, sf), ["model", "metric"])
    written = ci.select(
        "metric",
        format_ci(F.col("mean"), F.col("ci")).alias("text"),
        F.concat(F.lit("result_lp_events_"), F.col("model"), F.lit("_reg_ridge_tcol-target_split-hard-kmer_rs-all.json")).alias("file"),
    )
    rows = written.select("metric", parse_result(F.col("text")).alias("v"), result_keys(F.col("file")).alias("k"))
    return rows.select("metric", "k.*", F.round("v.mean", 8).alias("mean"), F.round("v.ci", 8).alias("ci"))
