"""Embedding every row of a dataset with a plugged-in model, and the k-mer baseline.

A model is any object with `embed_sequence(sequence, pool)` and/or
`embed_sequence_sixtrack(sequence, cds, splice, pool)` returning a vector. A factory builds it once
per task, in the worker, so weights are never shipped row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.functions import sequence as S
from seqloom.functions.kmers import count_tables, kmer_vectors
from seqloom.functions.sequence import bytes_of, lists_of, rows_of, texts_of
from seqloom.session import cut_lineage, spread

POOLS = {
    "mean": lambda tokens: np.mean(tokens, axis=0),
    "max": lambda tokens: np.max(tokens, axis=0),
    "cls": lambda tokens: np.asarray(tokens)[0],
}


def embed_udf(factory: Callable[[], object], pool: str | Callable = "mean", sixtrack: bool = False):
    """An Arrow-batched column function: (sequence[, cds, splice]) to `array<float>`."""
    pool_fn = POOLS[pool] if isinstance(pool, str) else pool

    def vector(v) -> np.ndarray:
        return np.ravel(v).astype(np.float32)

    def lists(vectors: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate([np.zeros(0, np.float32), *vectors])
        return lists_of(pa.array(flat), np.append(0, np.cumsum([len(v) for v in vectors], dtype=np.int64)), pa.array([0] * len(vectors)))

    if sixtrack:

        def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            model = factory()
            for batch in batches:  # a row at a time: of the batch there is no second copy in other objects
                rows = zip(*batch)
                yield lists([vector(model.embed_sequence_sixtrack(s.as_py(), track(c), track(p), pool_fn)) for s, c, p in rows])

        def track(row) -> np.ndarray:
            return np.asarray(row.values.to_numpy(zero_copy_only=False), np.int32)
    else:

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = factory()
            for seq in batches:
                yield lists([vector(model.embed_sequence(s.as_py(), pool_fn)) for s in seq])

    return F.arrow_udf(run, "array<float>")


def embed_dataset(
    df: DataFrame, factory: Callable[[], object], pool: str | Callable = "mean", sixtrack: bool = False
) -> DataFrame:
    """`row_id, embedding` for every row."""
    columns = ["sequence", "cds", "splice"] if sixtrack else ["sequence"]
    rows = spread(df.select("row_id", *columns), "row_id")
    return rows.select("row_id", embed_udf(factory, pool, sixtrack)(*columns).alias("embedding"))


BASELINE_KMERS = (3, 4, 5, 6, 7)
GC_INDEX = S.kmer_offset(8)
BASELINE_WIDTH = GC_INDEX + 1
SIXTRACK_WIDTH = GC_INDEX + 3
ROWS = -1  # in place of a feature: the number of rows


def baseline_features(df: DataFrame, sixtrack: bool = False, ks=BASELINE_KMERS) -> DataFrame:
    """k-mer counts, GC share and, with tracks, coding length and exon count.

    Sparse and row-wise: `row_id, idx array<int>, val array<double>`, idx ascending. Nothing is shuffled.
    """
    extra: list[Column] = [F.coalesce(S.gc_content(F.col("sequence")), F.lit(float("nan")))]
    if sixtrack:
        extra += [S.cds_length(F.col("cds")).cast("double"), S.exon_count(F.col("splice")).cast("double")]
    prepared = df.select("row_id", "sequence", F.array(*extra).alias("extra"))
    counts = kmer_vectors(prepared, ks, keep=("extra",))
    after = S.kmer_offset(max(ks) + 1, ks)
    tail = F.array(*[F.lit(after + i) for i in range(len(extra))])
    return counts.select("row_id", F.concat("idx", tail).alias("idx"), F.concat("val", "extra").alias("val"))


def sparse_long(features: DataFrame) -> DataFrame:
    """`row_id, idx, value`, one row per stored entry."""
    return features.select("row_id", F.explode(F.arrays_zip("idx", "val")).alias("e")).select(
        "row_id", "e.idx", F.col("e.val").alias("value")
    )


def feature_tables(batch: pa.RecordBatch, ks):
    """(ids, k-mer counts for each k, GC share and extra features) of a batch of `row_id, sequence[, extra]`, some rows at a time, zeros included."""
    one = tuple(sorted({1, *ks}))  # single letters, for the GC share
    n = len(batch)
    extra = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if batch.num_columns > 2 else np.zeros((n, 0))
    for first, counts in count_tables(batch.column(1), one):
        acgt = counts[0]
        rows = slice(first, first + len(acgt))
        with np.errstate(invalid="ignore"):  # no letter, no share
            gc = (acgt[:, 1] + acgt[:, 2]) / acgt.sum(axis=1)
        yield batch.column(0)[rows], counts if 1 in ks else counts[1:], np.column_stack([gc, extra[rows]])


def scaled(rows: DataFrame, stats: DataFrame, ks, entries: bool = False, first=None, then=None) -> DataFrame:
    """Scaled dense vectors over the features in `stats`, in index order; with `entries` also `dims array<int>`, where the row's own features
    that are not zero stand in its vector.

    `stats` has one row per feature of the vocabulary, at most 21,827 of them, and is collected.
    """
    found = stats.orderBy("idx").collect()
    keep = np.array([r["idx"] for r in found], dtype=np.int64)
    mean = np.array([r["mean"] for r in found])
    sd = np.array([r["sd"] for r in found])
    shared = rows.sparkSession.sparkContext.broadcast((keep, mean, sd))

    def run(batches):
        keep, mean, sd = shared.value
        begins = [S.kmer_offset(k, ks) for k in (*ks, max(ks) + 1)]
        cuts = [*np.searchsorted(keep, begins), len(keep)]
        parts = [(a, b, keep[a:b] - begin) for a, b, begin in zip(cuts, cuts[1:], begins)]
        for batch in first(batches) if first else batches:
            for ids, counts, others in feature_tables(batch, ks):
                dense = np.empty((len(ids), len(keep)), dtype=np.float32)
                places = []
                for table, (a, b, at) in zip([*counts, others], parts):
                    own = table if len(at) == table.shape[1] else np.take(table, at, axis=1, mode="clip")
                    np.divide(own - mean[a:b], sd[a:b], out=dense[:, a:b], casting="same_kind")
                    places.append(own != 0 if entries else None)
                ends = np.arange(len(ids) + 1, dtype=np.int32) * len(keep)
                columns = [ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(dense.ravel()))]
                if entries:
                    owner, at = np.nonzero(np.concatenate(places, axis=1))
                    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=len(ids)))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(at.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["row_id", "embedding", "dims"] if entries else ["row_id", "embedding"]
    schema = "row_id bigint, embedding array<float>" + (", dims array<int>" if entries else "")
    if then is None:
        return rows.mapInArrow(run, schema)
    last, schema = then
    return rows.mapInArrow(lambda batches: last(run(batches)), schema)


class Moments:
    """Count, mean and sum of squared deviations of the entries of each feature that are not zero."""

    def __init__(self, width: int):
        self.n, self.mean, self.m2 = np.zeros((3, width))
        self.rows = 0

    def add(self, rows: int, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        total = np.maximum(self.n + n, 1)
        apart = mean - self.mean
        self.m2 += m2 + np.where(n > 0, np.square(apart) * self.n * n / total, 0.0)
        self.mean += np.where(n > 0, apart * n / total, 0.0)
        self.n += n
        self.rows += rows

    def batch(self) -> pa.RecordBatch:
        """A row for each feature met, and the number of rows."""
        met = np.flatnonzero(self.n)
        columns = [np.append(met, ROWS).astype(np.int32), np.append(self.n[met], self.rows), np.append(self.mean[met], 0.0), np.append(self.m2[met], 0.0)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["idx", "n", "mean", "m2"])


MOMENTS = "idx int, n double, mean double, m2 double"


def baseline_stats(features: DataFrame) -> DataFrame:
    """Mean and deviation of every feature that is non-zero somewhere, over all rows.

    A task keeps count, mean and sum of squared deviations of the entries of each feature and sends a row for each it met: what
    is shuffled is a vocabulary per task, not an entry per sequence and k-mer. Zeros are added in closed form.
    """

    def run(batches):
        moments = Moments(SIXTRACK_WIDTH)
        for batch in batches:
            idx, value = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
            idx, value = idx[value != 0], value[value != 0]
            count = np.bincount(idx, minlength=SIXTRACK_WIDTH)
            own = np.bincount(idx, value, minlength=SIXTRACK_WIDTH) / np.maximum(count, 1)
            moments.add(len(batch), count, own, np.bincount(idx, np.square(value - own[idx]), minlength=SIXTRACK_WIDTH))
        yield moments.batch()

    return merged(features.select("idx", "val").mapInArrow(run, MOMENTS))


def table_stats(rows: DataFrame, ks, first=None) -> DataFrame:
    """The same of `row_id, sequence[, extra]`, from tables of all counts: features are not sent to Spark and back.

    A feature that a task met has all of the task's rows for entries.
    """

    def run(batches):
        moments = None
        for batch in first(batches) if first else batches:
            n, total, squares, others = 0, 0.0, 0.0, []
            for ids, counts, other in feature_tables(batch, ks):
                n += len(ids)
                total = total + np.concatenate([t.sum(axis=0) for t in counts])
                squares = squares + np.concatenate([np.einsum("ij,ij->j", t, t) for t in counts])
                others.append(other)
            if not n:
                continue
            other = np.concatenate(others)
            mean = np.append(total, other.sum(axis=0)) / n
            m2 = np.append(np.maximum(squares - total * mean[: len(total)], 0.0), np.square(other - mean[len(total) :]).sum(axis=0))
            moments = moments or Moments(len(mean))
            moments.add(n, np.full(len(mean), n), mean, m2)
        if moments:
            moments.n[moments.mean == 0] = 0
            yield moments.batch()

    return merged(rows.mapInArrow(run, MOMENTS))


def merged(parts: DataFrame) -> DataFrame:
    """`idx, mean, sd` over all rows from the moments of all tasks."""
    weighted = F.sum(F.col("n") * F.col("mean"))
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.try_divide(weighted * weighted, F.sum("n"))
    merged = parts.groupBy("idx").agg(F.sum("n").alias("n"), F.try_divide(weighted, F.sum("n")).alias("mean"), (F.sum("m2") + F.greatest(between, F.lit(0.0))).alias("m2"))
    merged = cut_lineage(merged)  # a row per feature of the vocabulary
    rows = merged.where(F.col("idx") == ROWS).select("n").scalar()
    mean = F.col("mean") * F.col("n") / rows
    variance = F.col("m2") / rows + F.col("mean") * F.col("mean") * F.col("n") * (rows - F.col("n")) / (rows * rows)
    found = merged.where(F.col("idx") != ROWS).select("idx", mean.alias("mean"), F.sqrt(variance).alias("sd"))
    return found.withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))


def embed_kmer_dataset(
    df: DataFrame, sixtrack: bool = False, ks=BASELINE_KMERS, entries: bool = False, first=None, then=None
) -> DataFrame:
    """Baseline features without all-zero columns, scaled over the whole dataset; with `entries`, the places of those not zero in the row.

    Sequences are read twice, for the moments and for the vectors, and counted where they are read. `first` and `then` run in the same
    tasks, so that neither sequences nor vectors are sent to Spark and back: `first` is a function over the batches read, `then` one over
    the batches of vectors, and its schema.
    """
    ks = tuple(sorted(set(ks)))
    extra = [F.array(S.cds_length(F.col("cds")).cast("double"), S.exon_count(F.col("splice")).cast("double")).alias("extra")] if sixtrack else []
    rows = spread(df, "row_id").select("row_id", "sequence", *extra)
    return scaled(rows, table_stats(rows, ks, first), ks, entries, first, then)


def chunk_cds_aware(df: DataFrame, length: int) -> DataFrame:
    """`row_id, chunk, piece, cds`: windows of at most `length` bases that end between codons.

    Where a window ends depends on where the one before it ended, so each row is walked in turn.
    """

    def ends(cds: np.ndarray, n: int) -> list[int]:
        at = np.arange(n + 1)
        if not cds.any():
            return [*range(length, n, length), n] if n else []
        splits_codon = np.zeros(n + 1, dtype=bool)
        starts = np.flatnonzero(cds)
        for shift in (1, 2):
            inside = starts + shift
            splits_codon[inside[inside <= n]] = True
        clean = np.maximum.accumulate(np.where(splits_codon, -1, at))
        out, i = [], 0
        while i < n:
            end = min(i + length, n)
            i = int(clean[end]) if clean[end] > i else end
            out.append(i)
        return out

    def cuts(some: pa.RecordBatch) -> pa.RecordBatch:
        """Windows of a slice of rows. Windows tile a row: texts and tracks stay as they lie, with more cuts in them."""
        ids, seq, cds = some.columns
        raw, begins = bytes_of(seq)
        marks, marked = rows_of(cds)
        codon = marks.to_numpy(zero_copy_only=False)
        tracks = [codon[a:b] for a, b in zip(marked, marked[1:])]
        found = [np.asarray(ends(track, int(b - a)), np.int64) + a for track, a, b in zip(tracks, begins, begins[1:])]
        each = np.array([len(f) for f in found], np.int64)
        at = np.concatenate([np.zeros(1, np.int64), *found])
        chunk = np.arange(len(at) - 1) - np.repeat(np.cumsum(each) - each, each)
        rows = ids.take(pa.array(np.repeat(np.arange(len(ids)), each)))
        if np.array_equal(begins, marked):
            parts = lists_of(marks.cast(pa.int8()), at, rows)
        else:
            spans = [(track, np.append(0, f - a)) for track, f, a in zip(tracks, found, begins)]
            parts = pa.array([track[i:j] for track, f in spans for i, j in zip(f, f[1:])], pa.list_(pa.int8()))
        columns = [rows, pa.array(chunk.astype(np.int32)), texts_of(raw, at, rows), parts]
        return pa.RecordBatch.from_arrays(columns, names=["row_id", "chunk", "piece", "cds"])

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 256):
                yield cuts(batch.slice(first, 256))

    return df.select("row_id", "sequence", "cds").mapInArrow(run, "row_id bigint, chunk int, piece string, cds array<tinyint>")
