"""The given tables read as sequence-benchmark inputs.

Each function has a text twin in `SQL`, the same derivation as common table expressions for the
checking engine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seqloom.functions import sequence as S
from seqloom.functions.sequence import bytes_of, texts_of
from seqloom.session import spread

INTRON = 20
CONTIG = 200_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_BASE = np.zeros(256, np.uint8)  # of letters; 0 of all other bytes
for _i in range(26):
    _BASE[ord("A") + _i] = _BASE[ord("a") + _i] = ord("ACGT"[_i % 4])
_OTHER = bytes(np.flatnonzero(_BASE == 0).tolist())


def _letters_to_bases(text: pa.Array) -> pa.Array:
    raw, ends = bytes_of(text)
    dropped = np.flatnonzero(_BASE[raw] == 0)
    bases = raw.tobytes().translate(_BASE.tobytes(), _OTHER)
    return texts_of(np.frombuffer(bases, np.uint8), ends - np.searchsorted(dropped, ends), text)


def letters_to_bases(text):
    """A, C, G or T for each of the letters A to Z and a to z; everything else drops out."""
    return F.arrow_udf(_letters_to_bases, "string")(text)


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, gene, lang, n_chars, sequence: one row per document."""
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("gene"),
        "lang",
        "n_chars",
        letters_to_bases(F.col("text")).alias("sequence"),
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, sequence: the documents as they are, for `bases_of` to make sequences of in a task that goes on with them."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("sequence"))


def bases_of(batches):
    """The rows of `sequences` that have a base, from batches of `texts`, 1,000 at a time."""
    for batch in batches:
        for a in range(0, len(batch), 1000):
            ids, text = batch.slice(a, 1000).columns
            made = _letters_to_bases(text)
            yield pa.RecordBatch.from_arrays([ids, made], names=["row_id", "sequence"]).filter(pc.greater(pc.binary_length(made), 0))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, gene, chromosome: what the splitters read. The text column is never scanned."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("gene"),
        F.col("source").alias("chromosome"),
    )


def utrs(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, utr: short untranslated regions from benchmark passages and page addresses."""
    marks = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text")
    pages = table(spark, sf, "pages").select((F.col("page_id") + 1_000_000).alias("row_id"), F.col("url").alias("text"))
    both = marks.unionByName(pages)
    return both.select("row_id", F.left(letters_to_bases(F.col("text")), F.lit(50)).alias("utr"))


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with coding and splice tracks; every fifth one is non-coding."""
    seqs = sequences(spark, sf).withColumn("len", F.length("sequence"))
    quarter, third = F.floor(F.col("len") / 4).cast("int"), F.floor(F.col("len") / 3).cast("int")
    coding = F.when(F.col("row_id") % 5 == 0, 0).otherwise(F.col("len") - 2 * quarter)
    return seqs.select(
        "row_id",
        "gene",
        "lang",
        "sequence",
        S.cds_track(quarter, coding, quarter, F.col("len")).alias("cds"),
        S.splice_track(F.array(third, third, F.col("len") - 2 * third), F.col("len")).alias("splice"),
    )


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """tx_id, gene_id, chrom, strand, is_mane, appris, tx_start."""
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    tx = orders.select(
        F.col("o_orderkey").alias("tx_id"),
        F.col("o_custkey").alias("gene_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        (F.col("o_orderstatus") == "F").alias("is_mane"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.left("o_orderpriority", F.lit(1)).cast("int")).alias(
            "appris"
        ),
        (F.col("o_orderkey") * 7919 % CONTIG).alias("tx_start"),
    )
    genes = customer.select(F.col("c_custkey").alias("gene_id"), F.col("c_nationkey").cast("bigint").alias("chrom"))
    return tx.join(genes, "gene_id")


def exons(spark: SparkSession, sf: str) -> DataFrame:
    """tx_id, ordinal, len, n_exons: line items of an order, numbered within it."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    per_tx = W.partitionBy("l_orderkey")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tx_id"),
        F.row_number().over(per_tx.orderBy(*order)).alias("ordinal"),
        F.col("l_quantity").cast("int").alias("len"),
        F.count(F.lit(1)).over(per_tx).cast("int").alias("n_exons"),
    )


def exon_sequence():
    """Letters of an exon, made from its key."""
    digest = F.md5(F.concat_ws(":", F.col("tx_id").cast("string"), F.col("ordinal").cast("string")))
    text = F.translate(F.repeat(digest, F.lit(2)), "0123456789abcdef", "ACGTACGTACGTACGT")
    return F.left(text, F.col("len"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Exons placed on the genome: tx_id, kind, ordinal, len, before, chrom, strand, start, end."""
    from seqloom.operators.windows import exon_ends

    placed = exon_ends(exons(spark, sf)).withColumn("before", F.col("exon_end") - F.col("len"))
    spans = placed.groupBy("tx_id").agg(
        (F.sum("len") + (F.count(F.lit(1)) - 1) * INTRON).cast("bigint").alias("span")
    )
    offset = F.col("before") + (F.col("ordinal") - 1) * INTRON
    start = F.when(F.col("strand") == "+", F.col("tx_start") + offset).otherwise(
        F.col("tx_start") + F.col("span") - offset - F.col("len")
    )
    kind = (
        F.when(F.col("n_exons") < 3, "exon")
        .when(F.col("ordinal") == 1, "utr5")
        .when(F.col("ordinal") == F.col("n_exons"), "utr3")
        .otherwise("cds")
    )
    return (
        placed.join(spans, "tx_id")
        .join(transcripts(spark, sf), "tx_id")
        .select(
            "tx_id", "gene_id", "chrom", "strand", "is_mane", "appris", kind.alias("kind"), "ordinal", "len",
            "before", "n_exons", start.alias("start"), (start + F.col("len")).alias("end"),
        )
    )


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """variant_id, chrom, pos (1-based), ref, alt, label, match_group, region."""
    e = F.col("event_id")
    double = e % 10 == 0
    return table(spark, sf, "events").select(
        e.alias("variant_id"),
        (F.col("user_id") % 25).alias("chrom"),
        (e * 7907 % (CONTIG + 600) + 1).alias("pos"),
        F.when(double, "AC").otherwise("A").alias("ref"),
        F.when(double, "GT").otherwise(F.element_at(F.array(*map(F.lit, "CGT")), (e % 3 + 1).cast("int"))).alias("alt"),
        (F.col("value") > 50).cast("int").alias("label"),
        F.concat(F.when(e % 4 < 2, "5_prime_").when(e % 4 == 2, "3_prime_").otherwise("intron_"), F.col("event_type")).alias("match_group"),
        F.when(e % 4 < 2, "utr5").when(e % 4 == 2, "utr3").alias("region"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, run, p, y: events as predictions. Values repeat, so ties are common."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("run"),
        F.floor("value").cast("double").alias("p"),
        (F.col("user_id") % 3 == 0).cast("int").alias("y"),
        (F.col("user_id").cast("double") + F.col("event_id") % 7).alias("t"),
    )


def seed_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """model, metric, seed, value: one metric value per event."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("model"),
        F.col("event_type").alias("metric"),
        F.get_json_object("props", "$.k").cast("int").alias("seed"),
        F.col("value"),
        F.col("event_id").alias("row_id"),
    )


_BASES = (
    "translate(upper(regexp_replace({0},'[^A-Za-z]','','g')),"
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','ACGTACGTACGTACGTACGTACGTAC')"
)

SQL = {
    "seqs": f"seqs AS (SELECT doc_id AS row_id, source AS gene, lang, n_chars, {_BASES.format('text')} AS sequence FROM documents)",
    "utrs": (
        f"utrs AS (SELECT item_id AS row_id, left({_BASES.format('text')}, 50) AS utr FROM benchmark "
        f"UNION ALL SELECT page_id + 1000000, left({_BASES.format('url')}, 50) FROM pages)"
    ),
    "tracks": """tracks AS (
        SELECT row_id, gene, lang, sequence, L,
          [(CASE WHEN row_id % 5 <> 0 AND i >= L // 4 AND i < L - L // 4 AND (i - L // 4) % 3 = 0 THEN 1 ELSE 0 END)::TINYINT
            FOR i IN range(L)] AS cds,
          [(CASE WHEN i = L // 3 - 1 OR i = 2 * (L // 3) - 1 OR i = L - 1 THEN 1 ELSE 0 END)::TINYINT
            FOR i IN range(L)] AS splice
        FROM (SELECT *, length(sequence) AS L FROM seqs))""",
    "tx": """tx AS (
        SELECT o_orderkey AS tx_id, o_custkey AS gene_id, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
          o_orderstatus = 'F' AS is_mane,
          CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN left(o_orderpriority, 1)::INT END AS appris,
          o_orderkey * 7919 % 200000 AS tx_start, c_nationkey::BIGINT AS chrom
        FROM orders JOIN customer ON c_custkey = o_custkey)""",
    "exons": """exons AS (
        SELECT l_orderkey AS tx_id,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ordinal,
          l_quantity::INT AS len, count(*) OVER (PARTITION BY l_orderkey) AS n_exons
        FROM lineitem)""",
    "segs": """segs AS (
        SELECT p.*, gene_id, chrom, strand, is_mane, appris,
          CASE WHEN n_exons < 3 THEN 'exon' WHEN ordinal = 1 THEN 'utr5' WHEN ordinal = n_exons THEN 'utr3' ELSE 'cds' END AS kind,
          CASE WHEN strand = '+' THEN tx_start + before + (ordinal - 1) * 20
               ELSE tx_start + span - before - (ordinal - 1) * 20 - len END AS "start",
          CASE WHEN strand = '+' THEN tx_start + before + (ordinal - 1) * 20 + len
               ELSE tx_start + span - before - (ordinal - 1) * 20 END AS "end"
        FROM (SELECT *, sum(len) OVER (PARTITION BY tx_id ORDER BY ordinal) - len AS before,
                sum(len) OVER (PARTITION BY tx_id) + (n_exons - 1) * 20 AS span FROM exons) p JOIN tx USING (tx_id))""",
    "vars": """vars AS (
        SELECT event_id AS variant_id, user_id % 25 AS chrom, event_id * 7907 % 200600 + 1 AS pos,
          CASE WHEN event_id % 10 = 0 THEN 'AC' ELSE 'A' END AS ref,
          CASE WHEN event_id % 10 = 0 THEN 'GT' ELSE substr('CGT', (event_id % 3 + 1)::INT, 1) END AS alt,
          (value > 50)::INT AS label,
          (CASE WHEN event_id % 4 < 2 THEN '5_prime_' WHEN event_id % 4 = 2 THEN '3_prime_' ELSE 'intron_' END) || event_type AS match_group,
          CASE WHEN event_id % 4 < 2 THEN 'utr5' WHEN event_id % 4 = 2 THEN 'utr3' END AS region
        FROM events)""",
    "scores": """scores AS (
        SELECT event_id AS row_id, event_type AS run, floor(value) AS p, (user_id % 3 = 0)::INT AS y,
          user_id::DOUBLE + event_id % 7 AS t FROM events)""",
    "runs": """runs AS (
        SELECT 'm' || user_id AS model, event_type AS metric, json_extract_string(props, '$.k')::INT AS seed, value, event_id AS row_id
        FROM events)""",
}


def ctes(*names: str) -> str:
    """`WITH a AS (...), b AS (...)` for the named derivations and what they build on."""
    needs = {"tracks": ["seqs"], "segs": ["exons", "tx"]}
    ordered: list[str] = []
    for name in names:
        for part in [*needs.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    return "WITH " + ",\n".join(SQL[n] for n in ordered)
