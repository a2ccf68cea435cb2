"""From metric rows to the table a report shows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.operators.aggregates import multirun_ci
from seqloom.operators.sets import report_order


def parse_result(text: Column) -> Column:
    """`mean ± ci` text to its two numbers."""
    parts = F.split(text, "±")
    return F.struct(
        F.trim(F.element_at(parts, 1)).cast("double").alias("mean"),
        F.trim(F.element_at(parts, 2)).cast("double").alias("ci"),
    )


def result_keys(name: Column) -> Column:
    """Dataset, model, task, target, split and seed from a result file's name."""
    pattern = r"^result_lp_([^_]*)_([^_]*)_(.*)_tcol-(.*)_split-(.*)_rs-([^.]*)\.json$"
    fields = ("dataset", "model", "task", "target", "split_type", "seed")
    return F.struct(*[F.regexp_extract(name, pattern, i + 1).alias(f) for i, f in enumerate(fields)])


def select_report_rows(
    results: DataFrame, keys: Sequence[str], prefer: Sequence[str] = ("auprc", "r"), skip: Sequence[str] = ("o250", "utronly")
) -> DataFrame:
    """One value per key: the first preferred metric it has. Models with a skipped mark are left out.

    `results` has one row per key and metric of the test split.
    """
    kept = results.filter(F.col("metric").isin(*prefer))
    for mark in skip:
        kept = kept.filter(~F.col("model").contains(mark))
    picks = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in prefer]
    return kept.groupBy(*keys).agg(*picks).select(*keys, F.coalesce(*[F.col(m) for m in prefer]).alias("value"))


def report(results: DataFrame, model_class: DataFrame) -> DataFrame:
    """Mean and interval over seeds of each model's preferred test metric, in report order."""
    keys = ["dataset", "target", "model"]
    test = results.filter("split = 'test'")
    ci = multirun_ci(test, [*keys, "metric"])
    means = select_report_rows(ci.withColumn("value", F.struct("mean", "ci")), keys)
    return report_order(means.select(*keys, "value.*"), model_class)
