"""Unions, chunk bookkeeping, ordering, row numbering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from seqloom.operators.projections import strip_prefix
from seqloom.session import cut_lineage


def order_by_value(df: DataFrame, value: str) -> DataFrame:
    return df.orderBy(F.desc(value))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """Dense row ids 0, 1, ... in the given order.

    The sorted rows are written once, so partition numbers and places within a partition stay the
    same for both passes: counting partitions, then adding each one's start.
    """
    placed = df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")
    )
    placed = cut_lineage(placed.withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    starts = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn("row_id", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def row_chunk(df: DataFrame, chunks: int, row_id: str = "row_id") -> DataFrame:
    """`chunk`: contiguous ranges of rows // chunks + 1 row ids; trailing chunks may get none."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.floor(rows / chunks) + 1
    return df.withColumn("chunk", F.floor(F.col(row_id) / size).cast("int"))


def expected_chunks(df: DataFrame, chunks: int, row_id: str = "row_id") -> DataFrame:
    """The chunks that hold at least one row."""
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    numbers = df.sparkSession.range(chunks).select(F.col("id").cast("int").alias("chunk"))
    return numbers.filter(F.col("chunk") * (F.floor(rows / chunks) + 1) < rows)


def missing_chunks(expected: DataFrame, done: DataFrame, key: str = "chunk") -> DataFrame:
    return expected.select(key).join(done.select(key).distinct(), key, "left_anti")


def merge_chunks(parts: DataFrame, expected: DataFrame, key: str = "chunk") -> DataFrame:
    """All parts once every expected chunk is there, else no rows."""
    missing = missing_chunks(expected, parts, key).agg(F.count(F.lit(1)).alias("n")).scalar()
    return parts.filter(missing == 0)


def union_ref_var(df: DataFrame) -> DataFrame:
    """Two rows per variant: the reference (label 0, `wild-type`) and the changed sequence."""
    tracks = ("sequence", "cds", "splice")
    shape = ["row_id", "transcript_id", "gene", "chromosome", *tracks, "target", "description"]
    renamed = df.withColumnsRenamed({"chrom": "chromosome", "label": "target", "variant_id": "row_id"})
    ref = strip_prefix(renamed, "ref_", tracks).withColumns(
        {"target": F.lit(0), "description": F.lit("wild-type"), "row_id": F.col("row_id") * 2}
    )
    what = F.format_string("chr%s:%s %s:%s", F.col("chromosome").cast("string"), F.col("pos").cast("string"), "ref", "alt")
    var = strip_prefix(renamed, "var_", tracks).withColumns({"description": what, "row_id": F.col("row_id") * 2 + 1})
    return ref.select(*shape).unionByName(var.select(*shape))


def report_order(results: DataFrame, model_class: DataFrame) -> DataFrame:
    """Results by model class, then model name; a model without a class comes first."""
    return results.join(model_class, "model", "left").orderBy("model_class", "model")
