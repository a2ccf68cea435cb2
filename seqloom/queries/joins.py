"""Lookups, interval joins and the work grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.constants import SEEDS
from seqloom.operators import aggregates as A, joins as J
from seqloom.queries.flagship import HOMOLOGY_SQL, homology_map
from seqloom.registry import query
from seqloom.sources import standins as D
from seqloom.sources.standins import ctes


@query("genes_in_genome", "SELECT o_orderkey, o_custkey AS gene FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def genes_in_genome(spark, sf):
    genes = D.table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("gene"))
    rows = D.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("gene"))
    return J.genes_in_genome(rows, genes, "gene").select("o_orderkey", "gene")


@query(
    "versionless_join",
    """
    WITH r AS (SELECT 'T' || o_custkey AS k, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
    SELECT 'T' || c_custkey || '.' || (c_custkey % 9) AS tx, o_orderkey, o_totalprice FROM customer JOIN r ON k = 'T' || c_custkey AND rn = 1
    """,
)
def versionless_join(spark, sf):
    """Customers and orders share ids up to a version; the order that comes last counts."""
    left = D.table(spark, sf, "customer").select(F.format_string("T%d.%d", "c_custkey", F.col("c_custkey") % 9).alias("tx"))
    right = D.table(spark, sf, "orders").select(
        F.format_string("T%d.%d", "o_custkey", F.col("o_orderkey") % 7).alias("id"), "o_orderkey", "o_totalprice"
    )
    return J.versionless_join(left, "tx", right, "id", "o_orderkey").select("tx", "o_orderkey", "o_totalprice")


@query(
    "replicate_join",
    """
    WITH a AS (SELECT l_partkey // 4 AS utr, l_partkey, avg(l_discount) AS v, l_returnflag AS f FROM lineitem GROUP BY ALL)
    SELECT a.utr, round(a.v, 9) AS rep_1, round(n.v, 9) AS rep_2, round(r.v, 9) AS rep_3
    FROM a JOIN a n ON a.utr = n.utr AND n.f = 'N' JOIN a r ON a.utr = r.utr AND r.f = 'R'
    WHERE a.f = 'A'
    """,
)
def replicate_join(spark, sf):
    """Three replicates keyed by four parts each, so keys repeat and pair up many-to-many."""
    means = D.table(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.round(F.avg("l_discount"), 9).alias("v"))
    keyed = means.withColumn("utr", F.floor(F.col("l_partkey") / 4))

    def rep(flag, name):
        return keyed.filter(F.col("l_returnflag") == flag).select("utr", F.col("v").alias(name))

    return J.replicate_join([rep("A", "rep_1"), rep("N", "rep_2"), rep("R", "rep_3")], "utr")


@query(
    "chromosome_lookup",
    """
    WITH g AS (SELECT floor(c_acctbal)::INT % 200 AS gene, c_nationkey::VARCHAR AS chromosome, row_number() OVER (PARTITION BY floor(c_acctbal)::INT % 200 ORDER BY c_custkey) AS rn
      FROM customer WHERE c_acctbal >= 0)
    SELECT o_orderkey, (o_custkey % 300)::INT AS gene, chromosome FROM orders JOIN g ON gene = o_custkey % 300 AND rn = 1
    """,
)
def chromosome_lookup(spark, sf):
    """Gene names repeat; the first gene of a name counts, and orders of unknown genes drop out."""
    genes = D.table(spark, sf, "customer").filter("c_acctbal >= 0").select(
        (F.floor("c_acctbal").cast("int") % 200).alias("gene"), F.col("c_nationkey").cast("string").alias("chromosome"), F.col("c_custkey").alias("ordinal")
    )
    rows = D.table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 300).cast("int").alias("gene"))
    return J.chromosome_lookup(rows, genes).select("o_orderkey", "gene", "chromosome")


@query(
    "variant_overlap",
    ctes("segs", "vars")
    + """
    , span AS (SELECT tx_id, chrom, min("start") AS s, max("end") AS e FROM segs GROUP BY ALL)
    SELECT variant_id, tx_id FROM vars v JOIN span t ON v.chrom = t.chrom AND s <= pos - 1 AND pos - 1 < e
    """,
)
def variant_overlap(spark, sf):
    spans = J.transcript_spans(D.segments(spark, sf))
    return J.variant_overlap(D.variants(spark, sf), spans, width=1024).select("variant_id", "tx_id")


@query(
    "variant_utr_match",
    ctes("segs", "vars")
    + """
    , hit AS (SELECT v.variant_id, s.tx_id, row_number() OVER (PARTITION BY v.variant_id ORDER BY coalesce(appris, 100), CASE strand WHEN '+' THEN 0 ELSE 1 END, s.tx_id) AS rn
        FROM vars v JOIN segs s ON v.chrom = s.chrom AND v.region = s.kind AND s.start <= v.pos - 1 AND v.pos - 1 < s.end)
    SELECT v.variant_id, v.region, h.tx_id FROM vars v LEFT JOIN hit h ON v.variant_id = h.variant_id AND rn = 1
    """,
)
def variant_utr_match(spark, sf):
    matched = J.variant_utr_match(D.variants(spark, sf), D.segments(spark, sf), width=1024)
    return matched.select("variant_id", "region", "tx_id")


@query("homology_lookup", f"WITH {HOMOLOGY_SQL} SELECT doc_id AS row_id, gene_group FROM documents LEFT JOIN hom ON gene_name = source")
def homology_lookup(spark, sf):
    return J.homology_lookup(D.keyed(spark, sf), homology_map(spark, sf)).select("row_id", "gene_group")


@query("attach_embeddings", "SELECT doc_id AS row_id, source AS gene, label, list_sum([floor(v::DOUBLE * 1000000)::BIGINT FOR v IN embedding])::BIGINT AS x FROM documents JOIN embeddings ON vec_id = doc_id")
def attach_embeddings(spark, sf):
    """Documents that have a vector, joined one to one by id."""
    vectors = D.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")
    docs = D.keyed(spark, sf)
    rows = docs.join(vectors.select("row_id"), "row_id", "left_semi")
    out = J.attach_embeddings(rows, vectors.join(docs.select("row_id"), "row_id", "left_semi"))
    total = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda n, v: n + F.floor(v.cast("double") * 1000000))
    return out.select("row_id", "gene", "label", total.alias("x"))


# The ten seeds.
GRID_SQL = """
    cat AS (SELECT DISTINCT source || CASE WHEN source LIKE '%1' THEN '-mrl-sample' WHEN source LIKE '%2' THEN '-mrl-hl-lbkwk' WHEN source LIKE '%3' THEN '-vep' ELSE '' END AS dataset,
        t.task, t.target FROM documents, (VALUES ('classification', 'quality'), ('reg_ridge', 'n_chars')) t(task, target)),
    grid AS (SELECT dataset, task, target, model, split_type, seed FROM cat, (VALUES ('base'), ('wide')) m(model),
        (VALUES ('default'), ('homology'), ('kmer'), ('chromosome'), ('hard-kmer')) s(split_type),
        (SELECT unnest([2541, 413, 411, 412, 2547, 321, 421, 311, 2516, 2515])::INT AS seed)
      WHERE NOT contains(dataset, 'vep')
        AND (NOT contains(dataset, 'mrl-sample') OR split_type IN ('default', 'kmer', 'hard-kmer'))
        AND (NOT contains(dataset, 'lbkwk') OR split_type = 'default'))"""


def grid(spark, sf):
    name = F.col("source")
    mark = F.when(name.endswith("1"), "-mrl-sample").when(name.endswith("2"), "-mrl-hl-lbkwk").when(name.endswith("3"), "-vep").otherwise("")
    datasets = D.table(spark, sf, "documents").select(F.concat(name, mark).alias("dataset")).distinct()
    targets = F.array(
        F.struct(F.lit("classification").alias("task"), F.lit("quality").alias("target")),
        F.struct(F.lit("reg_ridge").alias("task"), F.lit("n_chars").alias("target")),
    )
    catalogue = datasets.select("dataset", F.inline(targets)).withColumn("split_type", F.lit("homology"))
    return J.work_grid(catalogue, ["base", "wide"], SEEDS)


@query("work_grid", f"WITH {GRID_SQL} SELECT * FROM grid")
def work_grid(spark, sf):
    return grid(spark, sf)


@query(
    "resume_pending",
    f"""WITH {GRID_SQL}
    SELECT DISTINCT dataset, task, target, model, split_type FROM grid
    WHERE NOT (model = 'base' AND task = 'reg_ridge') AND NOT (model = 'wide' AND split_type = 'default' AND NOT (seed = 2515 AND contains(dataset, 'lbkwk')))
    """,
)
def resume_pending(spark, sf):
    """Done: every ridge run of one model, and the default runs of the other but for a few seeds."""
    work = grid(spark, sf)
    lacking = (F.col("seed") == 2515) & F.col("dataset").contains("lbkwk")
    done = work.filter(
        ((F.col("model") == "base") & (F.col("task") == "reg_ridge"))
        | ((F.col("model") == "wide") & (F.col("split_type") == "default") & ~lacking)
    )
    return J.resume_pending(work, done)


@query(
    "group_pairs",
    "WITH g AS (SELECT source AS g, count(*) AS n FROM documents GROUP BY 1) SELECT a.g AS source_a, a.n AS n_a, b.g AS source_b, b.n AS n_b FROM g a JOIN g b ON a.g < b.g",
)
def group_pairs(spark, sf):
    return J.group_pairs(A.value_counts(D.table(spark, sf, "documents"), "source"), "source", ["n"])
