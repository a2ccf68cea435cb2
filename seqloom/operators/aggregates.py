"""Per-gene selection, replicate means, label tables, feature statistics and pooling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def first_per_gene(df: DataFrame, gene: str, order: str) -> DataFrame:
    """Per gene and column the first value that is not null, which may come from different rows."""
    rest = [c for c in df.columns if c not in (gene, order)]
    return df.groupBy(gene).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest]
    )


def max_te_per_gene(df: DataFrame, gene: str, te: str, order: str) -> DataFrame:
    """The row with the highest value per gene; of equal values the first in `order`."""
    rest = [c for c in df.columns if c != gene]
    best = F.max_by(F.struct(*rest), F.struct(F.col(te), -F.col(order)))
    return df.groupBy(gene).agg(best.alias("best")).select(gene, "best.*")


def replicate_mean(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Mean of the columns that share a name up to the last `_`; null replicates are left out."""
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(c.rsplit("_", 1)[0], []).append(c)

    def mean(names: list[str]) -> Column:
        present = F.filter(F.array(*[F.col(n).cast("double") for n in names]), lambda x: x.isNotNull() & ~F.isnan(x))
        total = F.aggregate(present, F.lit(0.0), lambda a, x: a + x)
        return F.when(F.size(present) > 0, total / F.size(present))

    return df.select(key, *[mean(names).alias(f) for f, names in sorted(families.items())])


def multi_hot(values: Column, names: Sequence[str], prefix: str = "target_", sep: str = ",") -> list[Column]:
    """One 0/1 column per name: whether it is an exact entry of the separated list."""
    listed = F.split(F.coalesce(values, F.lit("-")), sep)
    return [F.array_contains(listed, n).cast("tinyint").alias(f"{prefix}{n}") for n in names]


def row_normalise(log2: Sequence[Column], threshold: float) -> tuple[Column, Column]:
    """Shares of 2^x within the row, and 0/1 flags of shares reaching the threshold."""
    powers = F.array(*[F.pow(F.lit(2.0), c) for c in log2])
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(powers, lambda x: x / total)
    return shares, F.transform(shares, lambda x: (x >= threshold).cast("int"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def group_mean_ranked(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean")).orderBy(F.desc("mean"))


def dedupe_subset(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row in `order` per key combination, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*").select(*df.columns)


def distinct_count(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in columns])


# ---- features ----------------------------------------------------------------------------


def nonzero_columns(sparse: DataFrame, idx: str = "idx", value: str = "value") -> DataFrame:
    """Feature numbers that are non-zero in some row: at most the size of the vocabulary."""
    return sparse.filter(F.col(value) != 0).select(idx).distinct()


def standard_scale(df: DataFrame, vector: str) -> DataFrame:
    """Dense vectors centred and divided by the population deviation per position."""
    v = array_to_vector(F.col(vector))
    stats = df.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(
            vector_to_array("s.variance"),
            # the summary divides by n - 1
            lambda x: F.sqrt(x * (F.col("s.count") - 1) / F.col("s.count")),
        ).alias("sd"),
    )
    table = stats.select(F.arrays_zip("mean", "sd").alias("t")).scalar()
    scaled = F.zip_with(
        F.col(vector).cast("array<double>"),
        F.col("_stats"),
        lambda x, t: (x - t["mean"]) / F.when(t["sd"] > 0, t["sd"]).otherwise(1.0),
    )
    return df.withColumn("_stats", table).withColumn(vector, scaled).drop("_stats")


# ---- results -----------------------------------------------------------------------------


def multirun_ci(runs: DataFrame, keys: Sequence[str], value: str = "value", multiplier: float = 1.96) -> DataFrame:
    """Mean over seeds and the half-width `multiplier * population deviation / sqrt(seeds)`."""
    half = F.lit(multiplier) * F.stddev_pop(value) / F.sqrt(F.count(value))
    return runs.groupBy(*keys).agg(F.avg(value).alias("mean"), half.alias("ci"), F.count(value).alias("seeds"))


def format_ci(mean: Column, ci: Column) -> Column:
    return F.concat_ws(" ± ", mean.cast("string"), ci.cast("string"))


def species_map_merge(maps: DataFrame, species: str = "species", group: str = "gene_group", name: str = "ordinal") -> DataFrame:
    """Concatenate homology maps, lifting each species' groups above those of the ones before it.

    `name` orders the species. One row per species carries its highest group number.
    """
    tops = maps.groupBy(species).agg(F.max(group).alias("_top"), F.min(name).alias("_order"))
    earlier = W.orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
    lifts = tops.select(species, F.coalesce(F.sum("_top").over(earlier), F.lit(0)).alias("_lift"))
    return maps.join(lifts, species).withColumn(group, F.col(group) + F.col("_lift")).drop("_lift")


# ---- pooling -----------------------------------------------------------------------------


def pool(df: DataFrame, keys: Sequence[str], vector: str, how: str = "mean", weight: str | None = None) -> DataFrame:
    """Pool vectors per key: `mean`, `max`, `sum`, or `cls` (mean over rows with `pos = 0`).

    Vectors are summarised inside the executors' partial aggregation, so what is shuffled is one
    running summary per key and task, however many positions a key has.
    """
    if how == "cls":
        return pool(df.filter(F.col("pos") == 0), keys, vector, "mean", weight)
    if how not in ("mean", "max", "sum"):
        raise ValueError(f"unknown pooling: {how}")
    v = array_to_vector(F.col(vector).cast("array<double>"))
    summary = getattr(Summarizer, how)(v, F.col(weight).cast("double") if weight else None)
    return df.groupBy(*keys).agg(vector_to_array(summary).alias(vector))


def mean_pool(df: DataFrame, keys: Sequence[str], vector: str, tokens: str | None = None) -> DataFrame:
    """Mean over all tokens; `tokens` counts the tokens behind each partial mean."""
    return pool(df, keys, vector, "mean", tokens)


def cls_pool(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    return pool(df, keys, vector, "cls")


def replicate_average(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean of the vectors several models give for one position."""
    return pool(df, keys, vector, "mean")


def layer_concat(df: DataFrame, keys: Sequence[str], layer: str, vector: str) -> DataFrame:
    """Pooled layers of a row, one after the other in the order of their names."""
    layers = F.array_sort(F.collect_list(F.struct(layer, vector)))
    return df.groupBy(*keys).agg(F.flatten(F.transform(layers, lambda x: x[vector])).alias(vector))
