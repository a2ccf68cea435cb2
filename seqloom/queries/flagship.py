"""Features, leakage-free split, probe and metrics in one query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.plans.embed import embed_kmer_dataset
from seqloom.plans.probe import run_probe
from seqloom.session import scratch
from seqloom.sources import standins as D
from seqloom.sources.readers import scan_embeddings, sink_embeddings


def homology_map(spark: SparkSession, sf: str) -> DataFrame:
    """Four of five sources are mapped, in groups of three; a later row overrides an earlier one."""
    names = D.table(spark, sf, "documents").groupBy("source").agg(F.min("doc_id").alias("ordinal"))
    number = F.substring("source", 4, 10).cast("bigint")
    mapped = names.filter(number % 5 != 4)
    first = mapped.select(F.col("source").alias("gene_name"), F.lit(999).cast("bigint").alias("gene_group"), (F.col("ordinal") - 1000000).alias("ordinal"))
    real = mapped.select(F.col("source").alias("gene_name"), F.floor(number / 3).alias("gene_group"), "ordinal")
    return first.unionByName(real)


HOMOLOGY_SQL = """hom AS (
    SELECT source AS gene_name, substr(source, 4)::BIGINT // 3 AS gene_group
    FROM (SELECT DISTINCT source FROM documents) WHERE substr(source, 4)::BIGINT % 5 <> 4)"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """k-mer features (3 and 4 bases) of every labelled document, probed for its quality label across homology groups."""
    seqs = D.sequences(spark, sf)
    labels = D.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("target"))
    labelled = seqs.join(labels, "row_id")
    path = scratch(spark, "embeddings")
    sink_embeddings(embed_kmer_dataset(labelled.select("row_id", "sequence"), ks=(3, 4)), path, "documents", "kmer")
    vectors = scan_embeddings(spark, path, "documents", "kmer").drop("chunk")
    data = D.keyed(spark, sf).join(labels, "row_id").join(vectors, "row_id")
    _, rows = run_probe(
        data, "classification", split_type="homology", homology=homology_map(spark, sf), eval_all_splits=True
    )
    return rows
