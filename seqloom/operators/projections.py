"""Column selection, row filters and casts used while building dataset tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from seqloom.constants import INVARIANT_COLUMNS


def subset_columns(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """The invariant columns plus the targets, in their present order; absent ones are ignored."""
    keep = {*INVARIANT_COLUMNS, *targets}
    return df.select([c for c in df.columns if c in keep])


def drop_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every named column; NaN counts as missing."""
    out = df
    for c in columns:
        kind = df.schema[c].dataType
        present = F.col(c).isNotNull()
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            present = present & ~F.isnan(c)
        out = out.filter(present)
    return out


def drop_bad_gene(df: DataFrame, gene: str = "gene") -> DataFrame:
    return df.filter(F.col(gene).isNotNull() & ~F.col(gene).isin("None", ""))


def filter_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))


def select_by_pattern(df: DataFrame, pattern: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[c for c in df.columns if pattern in c and c not in keep])


def any_label_filter(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    return df.filter(sum((F.col(c).cast("int") for c in labels), F.lit(0)) > 0)


def skip_empty_seq(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    return df.filter(F.length(sequence) > 0).withColumn(sequence, F.upper(F.col(sequence)))


TRACK_COLUMNS = ("sequence", "cds", "splice")


def prefix_targets(df: DataFrame, prefix: str, front: Sequence[str] = TRACK_COLUMNS) -> DataFrame:
    """Tracks first, then every other column under the prefix."""
    rest = [c for c in df.columns if c not in front]
    return df.select(*front, *[F.col(c).alias(prefix + c) for c in rest])


def strip_prefix(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({prefix + c: c for c in columns})


def compact_track(track: Column) -> Column:
    return track.cast("array<tinyint>")


def validate_splits(df: DataFrame, target: str, features: str, needed: Sequence[str] = ("train",)) -> DataFrame:
    """Rows, features and labels per split; an error unless every needed split has all of them."""
    counts = df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count(features).alias("features"), F.count(target).alias("labels")
    )
    found = {r["split"]: r for r in counts.collect()}  # at most one row per split name
    if not found:
        raise ValueError("no splits provided")
    for name in needed:
        if name not in found:
            raise ValueError(f"split {name} is empty")
    for name, r in found.items():
        if r["features"] != r["rows"] or r["labels"] != r["rows"]:
            raise ValueError(f"split {name} lacks features or labels")
    return counts
