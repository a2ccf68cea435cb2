"""Session settings the jobs rely on, and small helpers around them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot keys: a reducer holding far more than the median is split at run time,
    # even where that costs one more exchange further up the plan.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sequences are wide rows: keep Arrow batches to a few thousand of them.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **extra) -> SparkSession:
    """A session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input that is one file over the cores before long per-row work.

    The plan's size estimate decides, so nothing runs: an input that Spark cuts into as many tasks as there are
    cores anyway is returned unshuffled.
    """
    spark = df.sparkSession
    wanted = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= wanted * int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()):
        return df
    return df.repartition(wanted, *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, of the session or the context.

    Where it is unset, a local session, whose tasks run in the driver, gets a temporary folder; any other must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and re.match(r"local($|\[)", spark.sparkContext.master):
        folder = tempfile.mkdtemp(prefix="spark-seqloom-")
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared checkpoint folder so later passes and retries read it back."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark, name: str) -> str:
    """A new folder for a written table, within the shared folder."""
    return f"{shared_folder(spark)}/seqloom/{name}-{uuid.uuid4().hex}"
