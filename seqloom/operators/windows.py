"""Ranking and running-sum operators over transcripts, groups, scores and p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from seqloom.operators.prefix import fill_cuts, least_from_here, running_totals, up_to_cut

BLOCK = 1024


def top_n_transcripts(tx: DataFrame, n: int) -> DataFrame:
    """Per gene: MANE first, then by principality level, then the rest; by id within a class.

    The `<= n` filter reaches the window, so each task keeps n rows per gene before the shuffle.
    """
    rank_class = F.when(F.col("is_mane"), 0).when(F.col("appris").isNotNull(), 1).otherwise(2)
    level = F.when(F.col("is_mane") | F.col("appris").isNull(), 0).otherwise(F.col("appris"))
    order = W.partitionBy("gene_id").orderBy(rank_class, level, "tx_id")
    return tx.withColumn("priority", F.row_number().over(order)).filter(F.col("priority") <= n)


def principal_transcript(tx: DataFrame) -> DataFrame:
    """Per gene the first transcript with a principality level, else the longest (column `len`)."""
    listed = F.col("appris").isNotNull()
    rank = F.struct(
        F.when(listed, 0).otherwise(1).alias("unlisted"),
        F.when(listed, F.col("appris").cast("bigint")).otherwise(-F.col("len").cast("bigint")).alias("level"),
        F.col("tx_id"),
    )
    return tx.groupBy("gene_id").agg(F.min(rank).alias("first")).select("gene_id", "first.tx_id")


def exon_ends(exons: DataFrame, block: int = BLOCK) -> DataFrame:
    """`exon_end`: cumulative exon length in transcript order (`tx_id`, dense `ordinal`, `len`).

    Summed in blocks of ordinals, so a transcript with very many exons is not one task's work.
    Almost all transcripts are one block; only later blocks need the sum of the earlier ones.
    """
    cut = exons.withColumn("_block", F.floor((F.col("ordinal") - 1) / block))
    within = W.partitionBy("tx_id", "_block").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("_end", F.sum("len").over(within))
    earlier = W.partitionBy("tx_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy("tx_id", "_block")
        .agg(F.sum("len").alias("_sum"))
        .withColumn("_carry", F.sum("_sum").over(earlier))
        .filter("_block > 0")
        .select("tx_id", "_block", "_carry")
    )
    return (
        local.join(carried, ["tx_id", "_block"], "left")
        .withColumn("exon_end", (F.col("_end") + F.coalesce("_carry", F.lit(0))).cast("bigint"))
        .drop("_block", "_end", "_carry")
    )


def greedy_group_fill(groups: DataFrame, order: str, size: str, test_size: float) -> DataFrame:
    """Whole groups go to train, in `order`, until train reaches its share; the last may overshoot."""
    cuts = fill_cuts(groups, order, size, lambda total: F.floor(total * (1 - test_size)))
    filled = up_to_cut(groups, order, cuts)
    return filled.withColumn("side", F.when(F.col("filled"), "train").otherwise("test")).drop("filled")


def greedy_cluster_fill(clusters: DataFrame, order: str, size: str, test_size: float) -> DataFrame:
    """As `greedy_group_fill`, with the test side filled first."""
    cuts = fill_cuts(clusters, order, size, lambda total: F.floor(total * test_size))
    filled = up_to_cut(clusters, order, cuts)
    return filled.withColumn("side", F.when(F.col("filled"), "test").otherwise("train")).drop("filled")


def value_ranks(df: DataFrame, value: str, by=()) -> DataFrame:
    """One row per distinct value: its average rank and the number of values in its group."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counts, value, ["n"], by)
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    return totals.select(*by, value, rank.alias("rank"), "n", "n_total")


def average_rank(df: DataFrame, value: str, by=()) -> DataFrame:
    """`df` with `rank`, ties sharing their mean rank."""
    ranks = value_ranks(df, value, by).drop("n", "n_total")
    return df.join(ranks, [*by, value])


def score_steps(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """Per distinct score: positives and rows at it, before it (lower scores) and in all."""
    counts = df.groupBy(*by, score).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    return running_totals(counts, score, ["pos", "n"], by)


def cumulative_pr(df: DataFrame, score: str, label: str, by=()) -> DataFrame:
    """Per distinct score: rows and true positives at or above it, with precision and recall."""
    steps = score_steps(df, score, label, by)
    tp, at = F.col("pos_total") - F.col("pos_before"), F.col("n_total") - F.col("n_before")
    return steps.select(
        *by,
        score,
        tp.alias("tp"),
        at.alias("predicted"),
        (tp / at).alias("precision"),
        F.try_divide(tp, F.col("pos_total")).alias("recall"),
    )


def bh_adjust(tests: DataFrame, p: str, by=(), alpha: float | None = None) -> DataFrame:
    """False-discovery adjusted p-values; with `alpha`, only significant rows, smallest first.

    Different p-values are counted and scanned in order: p times the family's size over the rows up to p, then the
    least of that from p on. Equal values get the same result, so neither a family nor a tie is one task's work.
    A row without a p-value is no test: it does not count and gets none.
    """
    by = list(by)
    counts = tests.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    ranked, parts = running_totals(counts, p, ["_n"], by, keep_parts=True)
    raw = F.col(p) * F.col("_n_total") / (F.col("_n_before") + F.col("_n"))
    least = least_from_here(ranked.withColumn("_raw", raw.cast("double")), parts, "_raw", "adj_p", by)
    adjusted = least.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(p).alias("_p"), F.least("adj_p", F.lit(1.0)).alias("adj_p"))
    same = F.col(p) == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = tests.join(adjusted, same, "left").drop("_p", *[f"_{c}" for c in by])
    return out if alpha is None else out.filter(F.col("adj_p") <= alpha).orderBy("adj_p")
