"""Lines that many sites repeat (operator 7), with DataFrame functions alone.

Method: distinct-site spread. Sites of every line that stands in enough places are counted by HyperLogLog sketches that merge by
aggregation; lines whose estimate is near the threshold get an exact distinct count. Of a line at or above it the earliest occurrence stays,
so that an article which many sites copied is not lost with its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqloom.session import cut_lineage

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 8
LOG_REGISTERS = 12  # standard error of an estimate 1.04 / sqrt(2**12), 1.6 %
NEAR = 0.1  # estimates this close to the threshold, over six standard errors, are counted exactly
FEW_HASHES = 1 << 20  # hashes of lines that are broadcast at most: 8 MB
FEW_LINES = 1 << 17  # lines with their first places that are broadcast at most: some 15 MB

_LAST = (1 << 63) - 1
_DOC, _KEY = "seqloom doc", "seqloom key"


def spread_lines(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """`documents` with the columns line_numbers_removed, n_lines and kept_text added.

    `documents` needs `doc_id`, `text` and `source`. Lines end at a line feed; lines without anything but white space never count and stay. A null
    source is no site, a null doc_id comes last. Rows that repeat an id and its text are one document: they lose the same lines. Null
    text has no lines and stays null. An empty table gives no rows. Other columns are kept; names of the three added are replaced.
    """
    documents = documents.drop("line_numbers_removed", "n_lines", "kept_text")
    order, key = F.coalesce("doc_id", F.lit(_LAST)), F.md5(F.coalesce("text", F.lit("")))
    rows = documents.select(order.alias("doc"), key.alias("key"), "source", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("hash", F.xxhash64("line"))
    # a line that stands in fewer places than that has no more sites; most lines stand in one and need no sketch
    often = cut_lineage(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("hash"))
    often = F.broadcast(often) if often.count() <= FEW_HASHES else often
    lines = cut_lineage(rows.join(often, "hash", "left_semi").select("doc", "key", "source", "at", F.md5("line").alias("line")))

    place = F.struct("doc", "key", "at")
    low, high = (1 - NEAR) * min_sites, (1 + NEAR) * min_sites
    spread = lines.groupBy("line").agg(F.hll_sketch_agg("source", F.lit(LOG_REGISTERS)).alias("sites"), F.min(place).alias("first"))
    spread = spread.withColumn("sites", F.hll_sketch_estimate("sites")).where(F.col("sites") >= low)
    spread = cut_lineage(spread)  # lines of many sites, a small part of all
    near = spread.where(F.col("sites") <= high)
    # exact distinct counts per site first, so that a hot line is spread over its sites
    sites = lines.join(near.select("line"), "line", "left_semi").where("source is not null").groupBy("line", "source").agg(F.count(F.lit(1)))
    enough = sites.groupBy("line").agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites)
    wide = spread.where(F.col("sites") > high).unionByName(near.join(enough.select("line"), "line")).select("line", "first")

    # with few of them, a line in very many texts need not meet its first place in one task; with more, skewed joins are split
    wide = F.broadcast(wide) if spread.count() <= FEW_LINES else wide
    later = lines.join(wide, "line").where(place != F.col("first"))
    removed = later.groupBy("doc", "key").agg(F.collect_set("at").alias("line_numbers_removed"))
    joined = documents.withColumns({_DOC: order, _KEY: key}).join(
        removed.withColumnsRenamed({"doc": _DOC, "key": _KEY}), [_DOC, _KEY], "left").drop(_DOC, _KEY)
    every = F.split("text", "\n")
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "line_numbers_removed"), lambda i: F.get(every, i)), "\n")
    return joined.select(
        *documents.columns,
        F.coalesce(F.array_sort("line_numbers_removed"), F.array().cast("array<int>")).alias("line_numbers_removed"),
        F.coalesce(F.size(every).cast("long"), F.lit(0)).alias("n_lines"),
        F.when(F.col("line_numbers_removed").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )
