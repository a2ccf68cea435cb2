"""Reading and writing: each sink is written to a scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.constants import SEEDS
from seqloom.functions import sequence as S
from seqloom.operators import sets as U
from seqloom.plans.report import report
from seqloom.registry import query
from seqloom.session import scratch
from seqloom.sources import catalogue as C, readers as R, standins as D
from seqloom.sources.standins import ctes


DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("scan_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_parquet(spark, sf):
    return R.scan_parquet(spark, f"{sf}/documents.parquet")


@query("sink_parquet", ctes("seqs") + "SELECT row_id, gene, md5(sequence) AS digest FROM seqs")
def sink_parquet(spark, sf):
    path = scratch(spark, "dataset")
    R.sink_parquet(D.sequences(spark, sf), path)
    return R.scan_parquet(spark, path).select("row_id", "gene", F.md5("sequence").alias("digest"))


@query("scan_csv", "SELECT c_custkey AS id, c_mktsegment AS gene, c_acctbal AS value FROM customer")
def scan_csv(spark, sf):
    path = scratch(spark, "csv")
    rows = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("gene"), F.col("c_acctbal").alias("value")
    )
    rows.write.option("compression", "gzip").csv(path, header=True)
    return R.scan_csv(spark, path, rows.schema)


@query(
    "scan_csv_multi",
    """
    SELECT 'key' || l_partkey AS utr, lower(l_returnflag) AS experiment, count(*) AS n, round(avg(l_discount), 9) AS rl
    FROM lineitem GROUP BY ALL
    """,
)
def scan_csv_multi(spark, sf):
    """Line items written as one measurement file per return flag, then read as replicates."""
    path = scratch(spark, "replicates")
    items = D.table(spark, sf, "lineitem")
    for flag in ("A", "N", "R"):
        target = f"{path}/GSM1_{flag.lower()}.csv"
        part = items.filter(F.col("l_returnflag") == flag)
        part.select(F.concat(F.lit("key"), "l_partkey").alias("utr"), F.col("l_discount").alias("rl")).write.csv(target, header=True)
    rows = R.scan_csv_multi(spark, f"{path}/*.csv")
    return rows.groupBy("utr", "experiment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rl"), 9).alias("rl"))


@query("scan_tensor", ctes("tracks") + "SELECT row_id, sequence, array_to_string(cds, '') AS cds, array_to_string(splice, '') AS splice FROM tracks")
def scan_tensor(spark, sf):
    """Six-track tensors padded with zero rows, written as Parquet and read back to text and tracks."""
    path = scratch(spark, "tensor")
    R.sink_tensors(D.tracks(spark, sf).select("row_id", "sequence", "cds", "splice"), path, pad=5)
    rows = R.tensor_rows(R.scan_parquet(spark, path))
    return rows.select(
        "row_id", "sequence", *[S.digits(F.col(c)).alias(c) for c in ("cds", "splice")]
    )


@query("read_or_build", "SELECT source AS gene, count(*) AS n FROM documents GROUP BY source")
def read_or_build(spark, sf):
    path = scratch(spark, "built")

    def build():
        return D.keyed(spark, sf).groupBy("gene").agg(F.count(F.lit(1)).alias("n"))

    R.read_or_build(spark, path, build)
    return R.read_or_build(spark, path, lambda: 1 / 0)  # the second call finds the saved table


@query("from_dataframe", ctes("tracks") + "SELECT row_id, L::INT AS n, len(cds)::INT AS n_cds, len(splice)::INT AS n_splice FROM tracks")
def from_dataframe(spark, sf):
    rows = R.from_dataframe(D.tracks(spark, sf))
    return rows.select("row_id", F.length("sequence").alias("n"), F.size("cds").alias("n_cds"), F.size("splice").alias("n_splice"))


VECTOR_SQL = "SELECT vec_id AS row_id, array_to_string([floor(x::DOUBLE * 1000000)::BIGINT FOR x IN embedding], ' ') AS embedding FROM embeddings"


def vectors(spark, sf):
    return D.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")


def vector_text(v):
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * 1000000).cast("string"))
    return F.array_join(whole, " ")


def stored_chunks(spark, sf, chunks: int, drop: int | None = None):
    path = scratch(spark, "embeddings")
    parts = U.row_chunk(vectors(spark, sf), chunks)
    for i in range(chunks):
        if i != drop:
            R.sink_embeddings(parts.filter(F.col("chunk") == i).drop("chunk"), path, "docs", "base", i)
    return R.scan_embeddings(spark, path, "docs", "base")


@query("sink_embeddings", VECTOR_SQL)
def sink_embeddings(spark, sf):
    path = scratch(spark, "embeddings")
    for model in ("base", "other"):
        R.sink_embeddings(vectors(spark, sf), path, "docs", model)
    both = R.scan_embeddings(spark, path, "docs", "base")
    return both.select("row_id", vector_text("embedding").alias("embedding"))


@query("scan_embeddings", VECTOR_SQL + " WHERE vec_id < 1000000000")
def scan_embeddings(spark, sf):
    return stored_chunks(spark, sf, 2).select("row_id", vector_text("embedding").alias("embedding"))


@query("merge_chunks", VECTOR_SQL)
def merge_chunks(spark, sf):
    """Five chunks written one by one; a second model's run that lacks one adds nothing."""
    expected = U.expected_chunks(vectors(spark, sf), 5)
    complete = U.merge_chunks(stored_chunks(spark, sf, 5), expected)
    partial = U.merge_chunks(stored_chunks(spark, sf, 5, drop=3), expected)
    return complete.unionByName(partial).select("row_id", vector_text("embedding").alias("embedding"))


def results(spark, sf):
    """Mean event value per user and type as the metric of one run; the seed is a few of the fixed ones."""
    runs = D.seed_metrics(spark, sf)
    seed = F.element_at(F.array(*[F.lit(s) for s in SEEDS]), (F.col("seed") % 10 + 1).cast("int"))
    return runs.groupBy(F.concat(F.lit("m"), F.substring("model", -1, 1)).alias("model"), seed.alias("seed"), "metric").agg(
        F.round(F.avg("value"), 9).alias("value")
    ).select(
        F.lit("events").alias("dataset"), "model", F.lit("reg_ridge").alias("task"), F.lit("target").alias("target"),
        F.lit("default").alias("split_type"), "seed", F.lit("test").alias("split"), "metric", "value",
    )


# The ten seeds.
RESULTS_SQL = """
    res AS (SELECT 'm' || right(user_id::VARCHAR, 1) AS model,
        [2541, 413, 411, 412, 2547, 321, 421, 311, 2516, 2515][json_extract_string(props, '$.k')::INT % 10 + 1]::INT AS seed,
        event_type AS metric, round(avg(value), 9) AS value FROM events GROUP BY ALL)
    """


@query("sink_results", f"WITH {RESULTS_SQL} SELECT model, seed, metric, value FROM res")
def sink_results(spark, sf):
    """Written twice: a rerun replaces its own rows."""
    path = scratch(spark, "results")
    few = results(spark, sf).repartition("model", "seed")
    R.sink_results(few.filter("model = 'm1'"), path)
    R.sink_results(few, path)
    return R.scan_results(spark, path).select("model", "seed", "metric", "value")


@query(
    "scan_results",
    f"WITH {RESULTS_SQL} SELECT model, seed, metric, value FROM res WHERE seed IN (413, 321, 2515) AND model = 'm3'",
)
def scan_results(spark, sf):
    path = scratch(spark, "results")
    R.sink_results(results(spark, sf), path)
    rows = R.scan_results(spark, path, [413, 321, 2515], model="m3", dataset="events")
    return rows.select("model", "seed", "metric", "value")


@query(
    "report",
    f"""
    WITH {RESULTS_SQL}, t AS (SELECT CASE model WHEN 'm3' THEN 'm3-utronly' ELSE model END AS model,
        CASE metric WHEN 'purchase' THEN 'auprc' WHEN 'click' THEN 'r' ELSE metric END AS metric, value
      FROM res WHERE NOT (model = 'm5' AND metric = 'purchase')),
    ci AS (SELECT model, metric, avg(value) AS mean, 1.96 * stddev_pop(value) / sqrt(count(*)) AS ci FROM t GROUP BY ALL),
    best AS (SELECT * FROM ci WHERE metric = 'auprc' OR (metric = 'r' AND model NOT IN (SELECT model FROM ci WHERE metric = 'auprc')))
    SELECT 'events' AS dataset, 'target' AS target, model, round(mean, 8) AS mean, round(ci, 8) AS ci,
      CASE WHEN model <> 'm9' THEN 'class ' || right(model, 1)::INT % 2 END AS model_class
    FROM best WHERE NOT contains(model, 'utronly')
    """,
)
def report_query(spark, sf):
    """Runs of users as models: purchases stand for the preferred metric, clicks for the next; one model lacks the first."""
    marked = F.when(F.col("model") == "m3", "m3-utronly").otherwise(F.col("model"))
    metric = F.when(F.col("metric") == "purchase", "auprc").when(F.col("metric") == "click", "r").otherwise(F.col("metric"))
    rows = results(spark, sf).where(~((F.col("model") == "m5") & (F.col("metric") == "purchase"))).withColumns({"model": marked, "metric": metric})
    number = F.right("model", F.lit(1)).cast("int")
    classes = results(spark, sf).select("model").distinct().where("model <> 'm9'").withColumn("model_class", F.concat(F.lit("class "), (number % 2).cast("string")))
    out = report(rows, classes)
    return out.select("dataset", "target", "model", F.round("mean", 8).alias("mean"), F.round("ci", 8).alias("ci"), "model_class")


@query(
    "task_catalog",
    """
    SELECT source AS dataset, t.task, t.target FROM (SELECT DISTINCT source FROM documents),
      (VALUES ('classification', 'quality'), ('classification', 'toxic'), ('reg_ridge', 'n_chars')) t(task, target)
    UNION ALL SELECT DISTINCT lang, 'multilabel', 'labels' FROM documents
    """,
)
def task_catalog(spark, sf):
    docs = D.table(spark, sf, "documents")
    by_source = docs.select(F.col("source").alias("dataset")).distinct().withColumns(
        {
            "task": F.array(F.lit("classification"), F.lit("classification"), F.lit("reg_ridge")),
            "target": F.array(F.lit("quality"), F.lit("toxic"), F.lit("n_chars")),
        }
    )
    by_lang = docs.select(F.col("lang").alias("dataset")).distinct().withColumns(
        {"task": F.array(F.lit("multilabel")), "target": F.array(F.lit("labels"))}
    )
    return C.task_catalog(by_source.unionByName(by_lang))
