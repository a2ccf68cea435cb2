"""Plugging in a model, and the k-mer baseline embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.plans import embed as E
from seqloom.registry import query
from seqloom.sources import standins as D
from seqloom.sources.standins import ctes


class BaseCounter:
    """A model with one token per base: its four one-hot coordinates."""

    def embed_sequence(self, sequence, pool):
        codes = np.frombuffer(sequence.encode(), dtype=np.uint8)
        tokens = (codes[:, None] == np.frombuffer(b"ACGT", dtype=np.uint8)).astype(np.float64)
        return pool(tokens if len(tokens) else np.zeros((1, 4)))

    def embed_sequence_sixtrack(self, sequence, cds, splice, pool):
        return np.concatenate([self.embed_sequence(sequence, pool), [cds.sum(), splice.sum()]])


COUNTS = ", ".join(f"length(sequence) - length(replace(sequence, '{b}', '')) AS {b.lower()}" for b in "ACGT")


def columns(v):
    """Base counts: the pooled shares times the length."""
    return [F.round(v[i].cast("double") * F.length("sequence")).cast("bigint").alias(n) for i, n in enumerate("acgt")]


@query("embed_udf", ctes("seqs") + f"SELECT row_id, {COUNTS} FROM seqs")
def embed_udf(spark, sf):
    run = E.embed_udf(BaseCounter)
    rows = D.sequences(spark, sf).select("row_id", "sequence", run("sequence").alias("v"))
    return rows.select("row_id", *columns(F.col("v")))


@query(
    "embed_dataset",
    ctes("tracks") + f"SELECT row_id, {COUNTS}, coalesce(list_sum(cds), 0)::BIGINT AS codons, coalesce(list_sum(splice), 0)::BIGINT AS exons FROM tracks",
)
def embed_dataset(spark, sf):
    rows = D.tracks(spark, sf)
    out = E.embed_dataset(rows, BaseCounter, sixtrack=True).join(rows.select("row_id", "sequence"), "row_id")
    v = F.col("embedding")
    return out.select("row_id", *columns(v), v[4].cast("bigint").alias("codons"), v[5].cast("bigint").alias("exons"))


INDEX = """CASE k WHEN 3 THEN 0 WHEN 4 THEN 64 WHEN 5 THEN 320 WHEN 6 THEN 1344 ELSE 5440 END
      + list_reduce([0] || [(instr('ACGT', b) - 1)::INT FOR b IN string_split(kmer, '')], lambda a, b: a * 4 + b)"""


@query(
    "embed_kmer_dataset",
    ctes("utrs")
    + f"""
    , u AS (SELECT row_id, utr FROM utrs WHERE utr <> '')
    , f AS (
      SELECT row_id, {INDEX} AS idx, count(*)::DOUBLE AS v
      FROM (SELECT row_id, k, substr(utr, i::INT, k::INT) AS kmer FROM (SELECT row_id, utr, k, unnest(range(1, length(utr) - k + 2)) AS i FROM u, range(3, 8) t(k)))
      GROUP BY ALL
      UNION ALL SELECT row_id, 21824, length(regexp_replace(utr, '[^GC]', '', 'g')) / length(utr) FROM u)
    , n AS (SELECT count(*) AS n FROM u)
    , m AS (SELECT idx, sum(v) / n AS mean, sum(v * v) / n AS sq FROM f, n WHERE v <> 0 GROUP BY idx, n)
    , z AS (SELECT idx, mean, CASE WHEN sq - mean * mean > 1e-12 THEN sqrt(sq - mean * mean) ELSE 1 END AS sd, row_number() OVER (ORDER BY idx) - 1 AS dim FROM m)
    SELECT row_id, dim::INT AS dim, round((v - mean) / sd, 3) AS x FROM f JOIN z USING (idx) WHERE v <> 0 AND dim % 16 = 0
    """,
)
def embed_kmer_dataset(spark, sf):
    """Scaled baseline vectors of the short regions; shown are the entries that were not zero."""
    rows = D.utrs(spark, sf).filter("utr <> ''").withColumnRenamed("utr", "sequence")
    shown = F.filter("dims", lambda d: d % 16 == 0)
    values = E.embed_kmer_dataset(rows, entries=True).select("row_id", F.explode(F.transform(shown, lambda d: F.struct(d.alias("dim"), F.element_at("embedding", d + 1).alias("x")))).alias("e"))
    return values.select("row_id", "e.dim", F.round(F.col("e.x").cast("double"), 3).alias("x"))


@query(
    "embed_kmer_dataset_whole",
    ctes("seqs")
    + f"""
    , u AS (SELECT row_id, sequence FROM seqs WHERE sequence <> '')
    , f AS (
      SELECT row_id, {INDEX} AS idx, v
      FROM (SELECT row_id, k, kmer, count(*)::DOUBLE AS v
            FROM (SELECT row_id, k, substr(sequence, i::INT, k::INT) AS kmer FROM (SELECT row_id, sequence, k, unnest(range(1, length(sequence) - k + 2)) AS i FROM u, range(3, 8) t(k)))
            GROUP BY ALL)
      UNION ALL SELECT row_id, 21824, length(regexp_replace(sequence, '[^GC]', '', 'g')) / length(sequence) FROM u)
    , n AS (SELECT count(*) AS n FROM u)
    , m AS (SELECT idx, sum(v) / n AS mean, sum(v * v) / n AS sq FROM f, n WHERE v <> 0 GROUP BY idx, n)
    , z AS (SELECT idx, mean, CASE WHEN sq - mean * mean > 1e-12 THEN sqrt(sq - mean * mean) ELSE 1 END AS sd, row_number() OVER (ORDER BY idx) - 1 AS dim FROM m)
    , x AS (SELECT u.row_id, dim, ((coalesce(v, 0) - mean) / sd)::FLOAT::DOUBLE AS x FROM u CROSS JOIN z LEFT JOIN f ON f.row_id = u.row_id AND f.idx = z.idx)
    SELECT 'row' AS kind, row_id AS id, count(*) AS n, round(sum(x * (dim % 7 + 1)), 1) AS weighted, round(sum(x * x), 1) AS squares FROM x GROUP BY row_id
    UNION ALL
    SELECT 'dim', dim, count(*), round(sum(x * (row_id % 7 + 1)), 1), round(sum(x * x), 1) FROM x GROUP BY dim
    """,
)
def embed_kmer_dataset_whole(spark, sf):
    """Scaled baseline vectors of whole documents: sums over all dimensions of each row, and over all rows of each dimension."""
    sums = E.embed_kmer_dataset(D.texts(spark, sf), first=D.bases_of, then=(sums_of, SUMS)).groupBy("kind", "id")
    return sums.agg(F.sum("n").alias("n"), F.round(F.sum("weighted"), 1).alias("weighted"), F.round(F.sum("squares"), 1).alias("squares"))


SUMS = "kind string, id bigint, n bigint, weighted double, squares double"


def sums_of(batches):
    """`kind, id, n, weighted, squares` of every row of vectors, and of every dimension by task."""

    def part(kind, ids, n, weighted, squares):
        columns = [[kind] * len(ids), ids, np.full(len(ids), n), weighted, squares]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "id", "n", "weighted", "squares"])

    n, held, rows = 0, 0, []
    for batch in batches:
        ids = np.asarray(batch.column(0))
        for a in range(0, len(ids), 64):
            some = ids[a : a + 64]
            x = batch.column(1).slice(a, 64).flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1).astype(np.float64)
            if not n:
                weights = np.arange(x.shape[1]) % 7 + 1.0
                weighted, squares = np.zeros((2, x.shape[1]))
            rows.append((some, x @ weights, np.vecdot(x, x)))
            weighted += (some % 7 + 1.0) @ x
            squares += np.einsum("ij,ij->j", x, x)
            n, held = n + len(some), held + len(some)
        if held >= 4096:
            some, *sums = map(np.concatenate, zip(*rows))
            yield part("row", some, len(weights), *sums)
            held, rows = 0, []
    if held:
        some, *sums = map(np.concatenate, zip(*rows))
        yield part("row", some, len(weights), *sums)
    if n:
        yield part("dim", np.arange(len(weights)), n, weighted, squares)


def vector_sums(vectors):
    """Those sums of a table of vectors: they are added up where they are, not exploded."""
    return vectors.mapInArrow(sums_of, SUMS)
