"""The corpus pipeline: stages that each take the documents their predecessor kept.

Every stage but the last returns the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm import benchmark, boilerplate, jaccard, language, packing
from seqloom.llm.queries import table
from seqloom.llm.samples import small_batches


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; wordless and undecidable ones go."""
    small_batches(spark)
    return language.drop_unidentified(docs, language.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their later occurrences of lines that many sites repeat.

    Columns with the names that the operator adds keep their values; null text stays null.
    """
    held = {c: f"seqloom held {c}" for c in ("line_numbers_removed", "n_lines", "kept_text") if c in docs.columns}
    found = boilerplate.spread_lines(docs.withColumnsRenamed(held))
    changed = F.size("line_numbers_removed") > 0
    length = F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    out = found.withColumns({"n_chars": length, "text": F.col("kept_text")})
    return out.select(*[F.col(held[c]).alias(c) if c in held else F.col(c) for c in docs.columns])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    small_batches(spark)
    return jaccard.drop_linked(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return benchmark.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

# Language models, classes of links and packing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
