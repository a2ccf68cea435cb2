"""Per-gene selection, replicate means, label tables, feature statistics, pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import kmers as K
from seqloom.operators import aggregates as A
from seqloom.registry import query
from seqloom.sources import standins as D
from seqloom.sources.standins import ctes


@query(
    "first_per_gene",
    """
    SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS status, arg_min(left(o_orderpriority, 1), o_orderkey) FILTER (WHERE o_orderpriority <> '4-NOT SPECIFIED') AS level,
      arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_totalprice > 250000) AS price
    FROM orders GROUP BY o_custkey
    """,
)
def first_per_gene(spark, sf):
    rows = D.table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.left("o_orderpriority", F.lit(1))).alias("level"),
        F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice")).alias("price"),
    )
    return A.first_per_gene(rows, "o_custkey", "o_orderkey")


@query(
    "max_te_per_gene",
    """
    SELECT o_custkey AS gene, te, o_orderkey AS row_id, o_orderstatus AS status FROM (
      SELECT *, floor(o_totalprice / 50000) AS te, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 50000) DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1
    """,
)
def max_te_per_gene(spark, sf):
    """Prices in coarse steps, so the highest value is often shared."""
    rows = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("gene"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("te"),
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"),
    )
    return A.max_te_per_gene(rows, "gene", "te", "row_id")


@query(
    "replicate_mean",
    """
    WITH p AS (SELECT l_partkey, avg(l_discount) FILTER (WHERE l_returnflag = 'A') AS a, avg(l_discount) FILTER (WHERE l_returnflag = 'N') AS n, avg(l_tax) AS t FROM lineitem GROUP BY 1)
    SELECT l_partkey, round(CASE WHEN a IS NULL THEN n WHEN n IS NULL THEN a ELSE (a + n) / 2 END, 8) AS egfp_unmod, round(t, 8) AS egfp_pseudo FROM p
    """,
)
def replicate_mean(spark, sf):
    flag = F.col("l_returnflag")
    wide = D.table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.avg(F.when(flag == "A", F.col("l_discount"))).alias("egfp_unmod_1"),
        F.avg(F.when(flag == "N", F.col("l_discount"))).alias("egfp_unmod_2"),
        F.avg("l_tax").alias("egfp_pseudo_1"),
    )
    means = A.replicate_mean(wide, "l_partkey", ["egfp_unmod_1", "egfp_unmod_2", "egfp_pseudo_1"])
    return means.select("l_partkey", *[F.round(c, 8).alias(c) for c in ("egfp_unmod", "egfp_pseudo")])


@query(
    "multi_hot",
    """
    SELECT conv_id, turn, list_contains(w, 'the')::INT::TINYINT AS target_the, list_contains(w, 'et')::INT::TINYINT AS target_et, list_contains(w, '-')::INT::TINYINT AS "target_-"
    FROM (SELECT conv_id, turn, string_split(CASE WHEN role = 'system' THEN '-' ELSE text END, ' ') AS w FROM conversations)
    """,
)
def multi_hot(spark, sf):
    """System turns count as having no list."""
    words = F.when(F.col("role") != "system", F.col("text"))
    return D.table(spark, sf, "conversations").select("conv_id", "turn", *A.multi_hot(words, ["the", "et", "-"], sep=" "))


@query(
    "row_normalise",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, floor(a / s * 1e9)::BIGINT AS share_a, (a / s >= 0.125)::INT AS flag_a, (b / s >= 0.125)::INT AS flag_b, (c / s >= 0.125)::INT AS flag_c
    FROM (SELECT *, 2.0::DOUBLE ** (l_discount * 40) AS a, 2.0::DOUBLE ** (l_tax * 40) AS b, 2.0::DOUBLE ** (l_quantity / 10) AS c, 0.0::DOUBLE + 2.0::DOUBLE ** (l_discount * 40) + 2.0::DOUBLE ** (l_tax * 40) + 2.0::DOUBLE ** (l_quantity / 10) AS s FROM lineitem)
    """,
)
def row_normalise(spark, sf):
    shares, flags = A.row_normalise([F.col("l_discount") * 40, F.col("l_tax") * 40, F.col("l_quantity") / 10], 0.125)
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", shares.alias("s"), flags.alias("f"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.floor(F.col("s")[0] * 1e9).alias("share_a"),
        *[F.col("f")[i].alias(f"flag_{n}") for i, n in enumerate("abc")],
    )


@query("value_counts", "SELECT source AS chromosome, lang, count(*) AS n FROM documents GROUP BY ALL")
def value_counts(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("source").alias("chromosome"), "lang")
    return A.value_counts(docs, "chromosome", "lang")


@query("group_mean_ranked", "SELECT source, round(avg(n_chars), 8) AS mean, rank() OVER (ORDER BY avg(n_chars) DESC)::INT AS place FROM documents GROUP BY source")
def group_mean_ranked(spark, sf):
    from pyspark.sql import Window as W

    ranked = A.group_mean_ranked(D.table(spark, sf, "documents"), "source", "n_chars")
    place = F.rank().over(W.orderBy(F.desc("mean")))  # one row per source
    return ranked.select("source", F.round("mean", 8).alias("mean"), place.alias("place"))


@query(
    "dedupe_subset",
    "SELECT l_orderkey, l_returnflag, l_linestatus, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL",
)
def dedupe_subset(spark, sf):
    rows = D.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_partkey")
    return A.dedupe_subset(rows, ["l_orderkey", "l_returnflag", "l_linestatus"], "l_partkey")


@query("distinct_count", "SELECT count(DISTINCT l_partkey) AS n_l_partkey, count(DISTINCT l_suppkey) AS n_l_suppkey FROM lineitem")
def distinct_count(spark, sf):
    return A.distinct_count(D.table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


# ---- features ----------------------------------------------------------------------------


@query(
    "nonzero_columns",
    ctes("utrs")
    + """
    SELECT DISTINCT CASE k WHEN 3 THEN 0 WHEN 4 THEN 64 WHEN 5 THEN 320 WHEN 6 THEN 1344 ELSE 5440 END
      + list_reduce([0] || [(instr('ACGT', b) - 1)::INT FOR b IN string_split(kmer, '')], lambda a, b: a * 4 + b) AS idx
    FROM (SELECT k, substr(utr, i::INT, k::INT) AS kmer FROM (SELECT utr, k, unnest(range(1, length(utr) - k + 2)) AS i FROM utrs, range(3, 8) t(k)))
    """,
)
def nonzero_columns(spark, sf):
    counts = K.kmer_counts(D.utrs(spark, sf).withColumnRenamed("utr", "sequence"))
    return A.nonzero_columns(counts, "idx", "n")


@query(
    "nonzero_columns_whole",
    ctes("seqs")
    + """
    SELECT DISTINCT CASE k WHEN 3 THEN 0 WHEN 4 THEN 64 WHEN 5 THEN 320 WHEN 6 THEN 1344 ELSE 5440 END
      + list_reduce([0] || [(instr('ACGT', b) - 1)::INT FOR b IN string_split(kmer, '')], lambda a, b: a * 4 + b) AS idx
    FROM (SELECT DISTINCT k, substr(sequence, i::INT, k::INT) AS kmer
          FROM (SELECT sequence, k, unnest(range(1, length(sequence) - k + 2)) AS i FROM seqs, range(3, 8) t(k)))
    """,
)
def nonzero_columns_whole(spark, sf):
    return A.nonzero_columns(K.kmer_counts(D.sequences(spark, sf)), "idx", "n")


@query(
    "standard_scale",
    """
    WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1))::INT AS dim FROM embeddings),
    s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY dim)
    SELECT vec_id, dim - 1 AS dim, round((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 7) AS z FROM e JOIN s USING (dim)
    """,
)
def standard_scale(spark, sf):
    scaled = A.standard_scale(D.table(spark, sf, "embeddings"), "embedding")
    return scaled.select("vec_id", F.posexplode("embedding").alias("dim", "z")).withColumn("z", F.round("z", 7))


# ---- results -----------------------------------------------------------------------------


@query(
    "multirun_ci",
    ctes("runs") + "SELECT model, metric, round(avg(value), 8) AS mean, round(1.96 * stddev_pop(value) / sqrt(count(*)), 8) AS ci, count(*) AS seeds FROM runs GROUP BY ALL",
)
def multirun_ci(spark, sf):
    ci = A.multirun_ci(D.seed_metrics(spark, sf), ["model", "metric"])
    return ci.select("model", "metric", F.round("mean", 8).alias("mean"), F.round("ci", 8).alias("ci"), "seeds")


@query(
    "species_map_merge",
    """
    WITH t AS (SELECT l_returnflag AS species, max(l_suppkey) AS top, min(l_returnflag) AS o FROM lineitem GROUP BY 1),
    l AS (SELECT species, coalesce(sum(top) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lift FROM t)
    SELECT DISTINCT species, l_partkey AS gene_name, l_suppkey + lift AS gene_group FROM lineitem JOIN l ON species = l_returnflag
    """,
)
def species_map_merge(spark, sf):
    """Return flags as species: parts are genes, suppliers the groups to keep apart."""
    maps = D.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("species"), F.col("l_partkey").alias("gene_name"), F.col("l_suppkey").alias("gene_group")
    ).distinct().withColumn("ordinal", F.col("species"))
    return A.species_map_merge(maps).select("species", "gene_name", "gene_group")


# ---- pooling -----------------------------------------------------------------------------


def token_vectors(spark, sf):
    """Embeddings as token vectors: ten tokens per row, the first of each four has position 0."""
    return D.table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("row_id"), (F.col("vec_id") % 4).alias("pos"),
        F.concat(F.lit("layer"), (F.col("vec_id") % 10).cast("string")).alias("layer"), "label", F.col("embedding").alias("vec"), "vec_id",
    )


VECS = "e AS (SELECT vec_id // 10 AS row_id, vec_id % 4 AS pos, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding)))::INT AS dim FROM embeddings)"


def unrolled(pooled, keys):
    return pooled.select(*keys, F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 9))


@query("mean_pool", f"WITH {VECS} SELECT row_id, dim, round(avg(x), 9) AS x FROM e GROUP BY ALL")
def mean_pool(spark, sf):
    """Means of uneven chunks, weighted by their tokens, equal the mean over all tokens."""
    rows = token_vectors(spark, sf)
    chunk = F.when(F.col("pos") == 0, 0).otherwise(1)
    weighted = A.pool(rows.withColumn("chunk", chunk), ["row_id", "chunk"], "vec")
    sizes = rows.groupBy("row_id", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return unrolled(A.mean_pool(weighted.join(sizes, ["row_id", "chunk"]), ["row_id"], "vec", "n"), ["row_id"])


@query("cls_pool", f"WITH {VECS} SELECT row_id, dim, round(avg(x), 9) AS x FROM e WHERE pos = 0 GROUP BY ALL")
def cls_pool(spark, sf):
    return unrolled(A.cls_pool(token_vectors(spark, sf), ["row_id"], "vec"), ["row_id"])


@query("replicate_average", f"WITH {VECS} SELECT row_id, pos, dim, round(avg(x), 9) AS x FROM e GROUP BY ALL")
def replicate_average(spark, sf):
    return unrolled(A.replicate_average(token_vectors(spark, sf), ["row_id", "pos"], "vec"), ["row_id", "pos"])


@query(
    "layer_concat",
    """
    SELECT vec_id // 10 AS row_id, ((vec_id % 10) * 64 + i)::INT AS dim, floor(embedding[i + 1]::DOUBLE * 1000000)::BIGINT AS x
    FROM embeddings, range(64) t(i)
    """,
)
def layer_concat(spark, sf):
    out = A.layer_concat(token_vectors(spark, sf), ["row_id"], "layer", "vec")
    rows = out.select("row_id", F.posexplode("vec").alias("dim", "x"))
    return rows.withColumn("x", F.floor(F.col("x").cast("double") * 1000000))


@query("pool_fn", f"WITH {VECS} SELECT label, dim, round(avg(x), 9) AS mean, max(x) AS max, round(sum(x), 8) AS sum FROM e GROUP BY ALL")
def pool_fn(spark, sf):
    rows = token_vectors(spark, sf)
    out = None
    for how in ("mean", "max", "sum"):
        one = A.pool(rows, ["label"], "vec", how).select("label", F.posexplode("vec").alias("dim", how))
        out = one if out is None else out.join(one, ["label", "dim"])
    return out.select("label", "dim", F.round("mean", 9).alias("mean"), "max", F.round("sum", 8).alias("sum"))
