"""Bounded samples of labelled rows, the fold that keeps documents out of learning, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts are wide rows: fewer of them go to a Python worker at a time, unless the session asks for less yet."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def labelled_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About `per_label` rows of each value of `label`, or all where there are fewer, chosen by the hash of doc_id.

    Only the counts per label reach the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(1.0)
    for value, n in counts.items():
        if n > per_label:
            share = F.when(F.col(label) == F.lit(value), F.lit(per_label / n)).otherwise(share)
    return rows.where(draw < share)
