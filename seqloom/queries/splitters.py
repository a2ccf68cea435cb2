"""Train, validation and test assignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import splits as X
from seqloom.operators.prefix import shuffle_order
from seqloom.operators.windows import greedy_cluster_fill, greedy_group_fill
from seqloom.queries.flagship import HOMOLOGY_SQL, homology_map
from seqloom.registry import query
from seqloom.sources import standins as D

SEED, SIZE = 2541, 0.3

KEYS = "keyed AS (SELECT doc_id AS row_id, source AS gene, md5(doc_id || ':2541') AS h FROM documents)"


@query(
    "split_random",
    f"""
    WITH {KEYS}
    SELECT row_id, CASE WHEN row_number() OVER (ORDER BY h, row_id) <= ceil(0.3::DOUBLE * count(*) OVER ())
      THEN 'test' ELSE 'train' END AS side FROM keyed
    """,
)
def split_random(spark, sf):
    return X.split_random(D.keyed(spark, sf), SIZE, SEED).select("row_id", "side")


@query(
    "split_homology",
    f"""
    WITH {KEYS}, {HOMOLOGY_SQL},
    rws AS (SELECT row_id, h, coalesce('g' || gene_group, 'r' || row_id) AS grp FROM keyed LEFT JOIN hom ON gene = gene_name),
    grps AS (SELECT grp, min(h) AS first, count(*) AS n FROM rws GROUP BY grp),
    filled AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      < floor(sum(n) OVER () * 0.7::DOUBLE) AS train FROM grps)
    SELECT row_id, CASE WHEN train THEN 'train' ELSE 'test' END AS side FROM rws JOIN filled USING (grp)
    """,
)
def split_homology(spark, sf):
    out = X.split_homology(D.keyed(spark, sf), SIZE, SEED, homology_map(spark, sf))
    return out.select("row_id", "side")


@query(
    "split_chromosome",
    """
    WITH RECURSIVE cnt AS (
      SELECT source AS c, count(*) AS n, row_number() OVER (ORDER BY md5(source || ':2541')) AS k FROM documents GROUP BY source),
    fit(k, used, test) AS (
      SELECT 0::BIGINT, 0::HUGEINT, []::VARCHAR[]
      UNION ALL
      SELECT cnt.k, CASE WHEN used + n <= (SELECT floor(0.3::DOUBLE * sum(n)) FROM cnt) THEN used + n ELSE used END,
        CASE WHEN used + n <= (SELECT floor(0.3::DOUBLE * sum(n)) FROM cnt) THEN list_append(test, c) ELSE test END
      FROM fit JOIN cnt ON cnt.k = fit.k + 1),
    done AS (SELECT test FROM fit ORDER BY k DESC LIMIT 1)
    SELECT doc_id AS row_id, CASE WHEN list_contains((SELECT test FROM done), source) THEN 'test' ELSE 'train' END AS side
    FROM documents
    """,
)
def split_chromosome(spark, sf):
    return X.split_chromosome(D.keyed(spark, sf), SIZE, SEED).select("row_id", "side")


def _with_sequence(spark, sf):
    return D.sequences(spark, sf).select("row_id", "sequence")


# Which rows k-means puts together is its own affair; what a split must keep is stated beside it.
WHOLE = "SELECT count(*) AS rows, {clusters} AS clusters, 0::BIGINT AS straddling, true AS reached, true AS needed FROM documents"


def kept_whole(spark, sf, splitter, n_clusters):
    """Rows, clusters, clusters on both sides; whether test reached its share, and needed its last cluster."""
    sides = splitter(_with_sequence(spark, sf), SIZE, SEED, n_clusters=n_clusters, keep_cluster=True).select("row_id", "cluster", "side")
    each = sides.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("side").alias("sides"), F.max("side").alias("side"), shuffle_order("cluster", SEED).alias("k")
    )
    test, share = F.col("side") == "test", F.floor(F.sum("n") * SIZE)
    held = F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    last = F.coalesce(F.max_by(F.when(test, F.col("n")), F.when(test, F.col("k"))), F.lit(0))
    return each.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.count(F.when(F.col("sides") > 1, 1)).alias("straddling"),
        (held >= share).alias("reached"), (held - last < share).alias("needed"),
    )


@query("split_kmer", WHOLE.format(clusters="10::BIGINT"))
def split_kmer(spark, sf):
    return kept_whole(spark, sf, X.split_kmer, 10)


@query("split_hard_kmer", WHOLE.format(clusters="2::BIGINT"))
def split_hard_kmer(spark, sf):
    return kept_whole(spark, sf, X.split_hard_kmer, 2)


@query("kmeans_clusters", "SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, 10::BIGINT AS clusters FROM documents")
def kmeans_clusters(spark, sf):
    out = X.kmeans_clusters(_with_sequence(spark, sf), 3, 10, SEED)
    return out.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("row_id").alias("ids"), F.countDistinct("cluster").alias("clusters")
    )


# The operators' own numbers of clusters. Whole clusters, a share reached but not without the last cluster, and no train cluster
# before a test cluster: together they leave one way to fill the test side.
BY_RULE = """
    SELECT count(*) AS rows, greatest(2, count(*) // {per})::BIGINT AS clusters, 0::BIGINT AS straddling,
      true AS reached, true AS needed, true AS in_order FROM documents
    """


def filled_by_rule(spark, sf, splitter):
    sides = splitter(_with_sequence(spark, sf), SIZE, SEED, keep_cluster=True).select("row_id", "cluster", "side")
    each = sides.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("side").alias("sides"), F.max("side").alias("side"), shuffle_order("cluster", SEED).alias("k")
    )
    test, share = F.col("side") == "test", F.floor(F.sum("n") * SIZE)
    held = F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    last = F.coalesce(F.max_by(F.when(test, F.col("n")), F.when(test, F.col("k"))), F.lit(0))
    return each.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("clusters"), F.count(F.when(F.col("sides") > 1, 1)).alias("straddling"),
        (held >= share).alias("reached"), (held - last < share).alias("needed"),
        (F.max(F.when(test, F.col("k"))) < F.min(F.when(~test, F.col("k")))).alias("in_order"),
    )


@query("split_kmer_by_rule", BY_RULE.format(per=100))
def split_kmer_by_rule(spark, sf):
    return filled_by_rule(spark, sf, X.split_kmer)


@query("split_hard_kmer_by_rule", BY_RULE.format(per=1000))
def split_hard_kmer_by_rule(spark, sf):
    return filled_by_rule(spark, sf, X.split_hard_kmer)


@query(
    "kmeans_clusters_by_rule",
    """
    SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, greatest(2, count(*) // 100)::BIGINT AS clusters,
      0::BIGINT AS least, greatest(2, count(*) // 100)::INT - 1 AS most, 0::BIGINT AS parted FROM documents
    """,
)
def kmeans_clusters_by_rule(spark, sf):
    """One cluster per hundred rows, numbered without a gap; equal sequences are never in two clusters."""
    rows = _with_sequence(spark, sf)
    out = X.kmeans_clusters(rows, 3, max(2, rows.count() // 100), SEED)
    same = rows.select("row_id", F.sha2(F.lower("sequence"), 256).alias("text")).join(out, "row_id")
    each = same.groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("ids"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
    numbers = F.countDistinct("low").alias("clusters")
    return each.agg(
        F.sum("n").alias("rows"), F.sum("ids").alias("ids"), numbers, F.min("low").cast("bigint").alias("least"), F.max("high").alias("most"),
        F.count(F.when(F.col("low") < F.col("high"), 1)).alias("parted"),
    )


THREE = f"""
    WITH {KEYS},
    a AS (SELECT *, row_number() OVER (ORDER BY h, row_id) <= ceil(count(*) OVER () * 0.3::DOUBLE) AS held FROM keyed),
    b AS (SELECT row_id, row_number() OVER (ORDER BY h, row_id) <= ceil(count(*) OVER () * 0.5::DOUBLE) AS test FROM a WHERE held)
    SELECT row_id, CASE WHEN NOT held THEN 'train' WHEN test THEN 'test' ELSE 'val' END AS split
    FROM a LEFT JOIN b USING (row_id)
    """


@query("split_three_way", THREE)
def split_three_way(spark, sf):
    return X.split_three_way(X.split_random, D.keyed(spark, sf)).select("row_id", "split")


@query(
    "get_splits",
    f"""
    WITH {KEYS}, {HOMOLOGY_SQL},
    rws AS (SELECT row_id, h, coalesce('g' || gene_group, 'r' || row_id) AS grp FROM keyed LEFT JOIN hom ON gene = gene_name),
    grps AS (SELECT grp, min(h) AS first, count(*) AS n FROM rws GROUP BY grp),
    f1 AS (SELECT *, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      < floor(sum(n) OVER () * (1 - (0.15::DOUBLE + 0.15::DOUBLE))) AS train FROM grps),
    f2 AS (SELECT *, coalesce(sum(n) OVER (ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      < floor(sum(n) OVER () * 0.5::DOUBLE) AS val FROM f1 WHERE NOT train)
    SELECT row_id, CASE WHEN f1.train THEN 'train' WHEN f2.val THEN 'val' ELSE 'test' END AS split
    FROM rws JOIN f1 USING (grp) LEFT JOIN f2 USING (grp)
    """,
)
def get_splits(spark, sf):
    hom = homology_map(spark, sf).withColumn("species", F.lit("human"))
    return X.get_splits(D.keyed(spark, sf), "homology", species="human", homology=hom).select("row_id", "split")


@query(
    "custom_splitter",
    """
    SELECT doc_id AS row_id, CASE WHEN lang = 'en' THEN 'train' WHEN doc_id % 2 = 0 THEN 'test' ELSE 'val' END AS split
    FROM documents
    """,
)
def custom_splitter(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "lang")

    def two_step(df, test_size, seed):
        # the first call holds out every other language, the second one its even rows
        first = abs(test_size - 0.3) < 1e-9
        held = (F.col("lang") != "en") if first else (F.col("row_id") % 2 == 0)
        return df.withColumn("side", F.when(held, "test").otherwise("train"))

    return X.split_three_way(two_step, docs, (0.7, 0.15, 0.15)).select("row_id", "split")


@query(
    "greedy_group_fill",
    """
    WITH g AS (SELECT o_custkey AS grp, count(*) AS n, md5(o_custkey || ':7') || ':' || o_custkey AS k FROM orders GROUP BY 1)
    SELECT grp, n, CASE WHEN coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      < floor(sum(n) OVER () * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS side FROM g
    """,
)
def group_fill(spark, sf):
    groups = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return greedy_group_fill(groups.withColumn("k", shuffle_order("grp", 7)), "k", "n", 0.2).drop("k")


@query(
    "greedy_cluster_fill",
    """
    WITH g AS (SELECT l_partkey AS grp, count(*) AS n, md5(l_partkey || ':7') || ':' || l_partkey AS k FROM lineitem GROUP BY 1)
    SELECT grp, n, CASE WHEN coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      < floor(sum(n) OVER () * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS side FROM g
    """,
)
def cluster_fill(spark, sf):
    groups = D.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return greedy_cluster_fill(groups.withColumn("k", shuffle_order("grp", 7)), "k", "n", 0.2).drop("k")
