"""Lookups, interval matching, replicate joins and the grid of work to do.

No join forces a broadcast of a table that grows: adaptive execution measures each side and
broadcasts the small ones, and splits hot keys of the others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.constants import NO_PRINCIPALITY, SPLIT_TYPES
from seqloom.functions.sequence import versionless
from seqloom.session import cut_lineage

BIN = 16_384


def genes_in_genome(df: DataFrame, genes: DataFrame, on: str) -> DataFrame:
    return df.join(genes.select(on), on, "left_semi")


def last_wins(df: DataFrame, key: str | Column, order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: the one that comes last in `order`, as when filling a dictionary."""
    key = F.col(key) if isinstance(key, str) else key
    return (
        df.groupBy(key.alias("_key"))
        .agg(F.max_by(F.struct(*columns), F.col(order)).alias("_row"))
        .select("_key", "_row.*")
    )


def versionless_join(left: DataFrame, left_id: str, right: DataFrame, right_id: str, order: str) -> DataFrame:
    """Inner join on identifiers without their `.version`; of equal right ids the last one counts."""
    keep = [c for c in right.columns if c not in left.columns]
    lookup = last_wins(right, versionless(F.col(right_id)), order, keep)
    return left.withColumn("_key", versionless(F.col(left_id))).join(lookup, "_key").drop("_key")


def replicate_join(replicates: Sequence[DataFrame], on: str) -> DataFrame:
    """Inner join of all replicates; repeated keys stay many-to-many."""
    return reduce(lambda a, b: a.join(b, on), replicates)


def chromosome_lookup(df: DataFrame, genes: DataFrame, name: str = "gene", order: str = "ordinal") -> DataFrame:
    """Adds `chromosome` of the first gene with that name; rows whose gene is unknown drop out."""
    first = genes.groupBy(name).agg(F.min_by("chromosome", order).alias("chromosome"))
    return df.join(first, name)


def homology_lookup(df: DataFrame, homology: DataFrame, order: str = "ordinal") -> DataFrame:
    """Adds `gene_group`, null for unmapped genes; of repeated names the last row counts."""
    lookup = homology.groupBy(F.col("gene_name").alias("gene")).agg(
        F.max_by("gene_group", order).alias("gene_group")
    )
    return df.join(lookup, "gene", "left")


def attach_embeddings(df: DataFrame, embeddings: DataFrame, key: str = "row_id", check: bool = True) -> DataFrame:
    """Join vectors by row id. With `check`, differing row sets are an error rather than a shorter table.

    The sets are compared by count and hashes of the ids, added up without moving a row. Repeated ids of vectors
    are an error as well: with equal sets, ids are then unique on both sides.
    """

    def fingerprint(table: DataFrame):
        code = F.xxhash64(key)
        return table.agg(F.count(key), F.bit_xor(code), F.sum(code.cast("decimal(38,0)"))).first()

    if check and fingerprint(df) != fingerprint(embeddings):
        raise ValueError("rows and embeddings do not match one to one")
    if check and not embeddings.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("rows and embeddings do not match one to one: ids repeat")
    return df.join(embeddings, key)


# Widths of the bins of intervals: two finer ones than `width`, and `width` times a power of `FINER`; the widest are longer than any chromosome.
FINER = 2
LEVELS = 32
TASK_PAIRS = 1 << 24  # of a point and an interval of its bin, that a task of the join compares


def _shares(points: DataFrame, intervals: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the keys to join them by, dealt so that tasks grow in number with the pairs.

    Pairs are counted by key before. A key with more than `most` is dealt in pieces of its points, each of which meets all its intervals.
    """
    both = points.groupBy(keys).agg(F.count(F.lit(1)).alias("_n")).join(intervals.groupBy(keys).agg(F.count(F.lit(1)).alias("_m")), keys)
    counts = cut_lineage(both.select(*keys, (F.col("_n") * F.col("_m")).alias("_pairs")))
    found = counts.agg(F.sum("_pairs").alias("all"), F.count(F.when(F.col("_pairs") > most, 1)).alias("heavy")).first()
    tasks = -(-(found["all"] or 0) // most)
    if found["heavy"]:
        heavy = counts.where(F.col("_pairs") > most).select(*keys, F.ceil(F.col("_pairs") / most).cast("int").alias("_pieces"))
        row = F.xxhash64(*[c for c, kind in points.dtypes if "map" not in kind])
        piece = F.coalesce(F.pmod(row, F.col("_pieces")).cast("int"), F.lit(0))
        points = points.join(heavy, keys, "left").withColumn("_piece", piece).drop("_pieces")
        intervals = intervals.join(heavy, keys, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
        keys = [*keys, "_piece"]
    if tasks > 1:  # also where one side is then broadcast: the other is not left in the few tasks that read it
        tasks = max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        points, intervals = points.repartition(tasks, *keys), intervals.repartition(tasks, *keys)
    return points, intervals, keys


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    chrom: str = "chrom",
    at: str = "at",
    start: str = "start",
    end: str = "end",
    width: int = BIN,
    also: Sequence[str] = (),
) -> DataFrame:
    """Pairs with start <= at < end on one chromosome, as an equi-join on (chrom, level, bin).

    A plain range condition would compare every point with every interval. Bins of a level are twice or four times as wide as those of the
    level below; an interval is listed at the lowest level whose bins are no shorter than itself, so under two bins at most
    however long it is. A point asks one bin of each level that intervals are on, so no pair comes out twice.
    """
    length = F.col(end) - F.col(start)
    widths = sorted({max(1, width // 16), max(1, width // 4), *(width * FINER**i for i in range(LEVELS))})
    level = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        level = F.when(length <= widths[i], i).otherwise(level)
    wide = lambda of: F.element_at(F.array(*[F.lit(w) for w in widths]), of + 1)
    filled = intervals.filter(length > 0).withColumn("_level", level)
    binned = filled.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / wide(F.col("_level"))), F.floor((F.col(end) - 1) / wide(F.col("_level")))))
    )
    binned = cut_lineage(binned)  # often derived, and read for its levels before it is joined
    levels = sorted(r["_level"] for r in binned.select("_level").distinct().collect())  # of `widths`
    asked = points.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in levels]).cast("array<int>"))).withColumn("_bin", F.floor(F.col(at) / wide(F.col("_level"))))
    asked, binned, keys = _shares(asked, binned, [chrom, "_level", "_bin", *also], TASK_PAIRS)
    joined = asked.join(binned, keys)
    return joined.filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_bin", "_level", "_piece")


def variant_overlap(variants: DataFrame, transcripts: DataFrame, width: int = BIN) -> DataFrame:
    """Transcripts of either strand whose genomic span covers the variant. `pos` counts from 1."""
    return interval_join(variants.withColumn("at", F.col("pos") - 1), transcripts, width=width).drop("at")


def transcript_spans(segments: DataFrame) -> DataFrame:
    return segments.groupBy("tx_id", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def variant_utr_match(variants: DataFrame, segments: DataFrame, width: int = BIN) -> DataFrame:
    """The best transcript with an untranslated region of the wanted kind over the variant.

    Best is the lowest principality level (none counts as 100), then the + strand, then the id.
    Minima of ids, which hash aggregation can hold, are combined before the shuffle, one per variant, level and side; a minimum
    of structs at once would sort every candidate.
    """
    utrs = segments.filter(F.col("kind").isin("utr5", "utr3")).select(
        "chrom", "start", "end", "tx_id", F.col("kind").alias("region"),
        F.coalesce("appris", F.lit(NO_PRINCIPALITY)).alias("level"), F.when(F.col("strand") == "+", 0).otherwise(1).alias("side"),
    )
    wanted = variants.filter("region IS NOT NULL").select("variant_id", "chrom", "region", (F.col("pos") - 1).alias("at"))
    hits = interval_join(wanted, utrs, width=width, also=["region"])
    least = hits.groupBy("variant_id", "level", "side").agg(F.min("tx_id").alias("tx_id"))
    found = least.groupBy("variant_id").agg(F.min(F.struct("level", "side", "tx_id")).alias("best"))
    return variants.join(found, "variant_id", "left").select(*variants.columns, "best.tx_id")


def work_grid(
    catalogue: DataFrame, models: Sequence[str], seeds: Sequence[int], canonical: bool = False
) -> DataFrame:
    """Every (dataset, target, task) with each model, allowed split and seed.

    The catalogue is the only table; models, splits and seeds are short lists exploded per row.
    """
    name = F.col("dataset")
    few = F.array(F.lit("default"))
    kmer = F.array(*[F.lit(s) for s in ("default", "hard-kmer", "kmer")])
    every = F.array(*[F.lit(s) for s in SPLIT_TYPES])
    allowed = (
        F.when(name.contains("mrl-sample"), kmer)
        .when(name.contains("mrl-hl-lbkwk"), few)
        .otherwise(every)
    )
    if canonical:
        allowed = F.array("split_type")
    grid = catalogue.filter(~name.contains("vep") & ~name.contains("utr")).withColumn("split_type", F.explode(allowed))
    grid = grid.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return grid.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).select(
        "dataset", "task", "target", "model", "split_type", "seed"
    )


CELL = ("dataset", "task", "target", "model", "split_type")


def resume_pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Cells of the grid with at least one seed without a result."""
    key = [c for c in (*CELL, "seed") if c in grid.columns]
    missing = grid.join(done.select(*key).distinct(), key, "left_anti")
    return missing.select(*[c for c in key if c != "seed"]).distinct()


def group_pairs(groups: DataFrame, name: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of aggregated groups, columns suffixed `_a` and `_b`.

    One row per group goes in, such as the four feature combinations: never join rows this way.
    """
    by = list(by)
    if not by:
        groups, by = groups.withColumn("_family", F.lit(0)), ["_family"]
    cols = [name, *values]
    a = groups.select(*by, *[F.col(c).alias(f"{c}_a") for c in cols])
    b = groups.select(*by, *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, by).filter(F.col(f"{name}_a") < F.col(f"{name}_b")).drop("_family")
