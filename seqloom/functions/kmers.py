"""Overlapping k-mer counts, one Arrow batch at a time and without shuffling k-mers.

A sequence never leaves its row, so counting needs no exchange: each batch is one byte buffer, its
k-mers are numbered in base-|alphabet| arithmetic, and the counts of all its rows come from a few
array operations. Rows longer than a slice are counted piece by piece, so memory stays flat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from seqloom.functions.sequence import kmer_name, kmer_offset

SLICE = 1 << 18  # bases per numpy pass
ROWS = 1 << 15  # rows per numpy pass
TABLE_BASES = 1 << 14  # bases per table of all counts
TABLE = 1 << 19  # counts in such a table


def _letter_codes(alphabet: str) -> np.ndarray:
    codes = np.full(256, len(alphabet), dtype=np.int64)
    for i, letter in enumerate(alphabet):
        codes[ord(letter)] = i
    return codes


def _windows(codes: np.ndarray, owner: np.ndarray, ks, letters: int):
    """For each k: (owner row, k-mer number) of every window that stays in one row and alphabet."""
    value = np.zeros(len(codes), dtype=np.int64)
    bad = np.zeros(len(codes), dtype=bool)
    for k in range(1, max(ks) + 1):
        n = len(codes) - k + 1
        if n <= 0:
            return
        value = value[:n] * letters + codes[k - 1 :]
        bad = bad[:n] | (codes[k - 1 :] >= letters)
        if k in ks:
            good = ~bad & (owner[:n] == owner[k - 1 :])
            yield k, owner[:n][good], value[good]


def _count(codes, owner, rows: int, ks, letters: int):
    """(row, index, count) arrays ordered by row, then index: one number holds both, so they are counted and ordered at once."""
    width = kmer_offset(max(ks) + 1, ks, letters)
    keys = [who * width + (value + kmer_offset(k, ks, letters)) for k, who, value in _windows(codes, owner, ks, letters)]
    key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
    if rows * width <= 4 * len(key) + (1 << 16):
        dense = np.bincount(key, minlength=rows * width)
        key = np.flatnonzero(dense)
        n = dense[key]
    else:
        key, n = np.unique(key, return_counts=True)
    row = key // width
    return row, key - row * width, n


def _count_long_row(codes: np.ndarray, ks, letters: int):
    """One row longer than a slice: overlapping pieces, added up in one vector of the vocabulary."""
    total = np.zeros(kmer_offset(max(ks) + 1, ks, letters), dtype=np.int64)
    for k in ks:
        width, at = letters**k, kmer_offset(k, ks, letters)
        for start in range(0, len(codes) - k + 1, SLICE):
            piece = codes[start : start + SLICE + k - 1]
            for _, _, value in _windows(piece, np.zeros(len(piece), np.int8), (k,), letters):
                total[at : at + width] += np.bincount(value, minlength=width)
    idx = np.flatnonzero(total)
    return np.zeros(len(idx), dtype=np.int64), idx, total[idx]


def _slices(lengths: np.ndarray, bases: int, rows: int) -> Iterator[tuple[int, int]]:
    """Runs of at most `rows` rows with about `bases` bases together; a longer row is a run of its own."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > bases or i - start == rows):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each row begins and the last ends) of an Arrow column of sequences; null is empty."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), ends


def _batch_counts(column: pa.Array, ks, alphabet: str):
    """Counts of one Arrow column of sequences, as (first row, rows, row, index, count) runs."""
    raw, ends = _text(column)
    lengths = np.diff(ends)
    table, letters = _letter_codes(alphabet), len(alphabet)
    for a, b in _slices(lengths, SLICE, ROWS):
        codes = table[raw[ends[a] : ends[b]]]
        if b - a == 1 and lengths[a] > SLICE:
            yield a, b - a, *_count_long_row(codes, ks, letters)
        else:
            owner = np.repeat(np.arange(b - a), lengths[a:b])
            yield a, b - a, *_count(codes, owner, b - a, ks, letters)


def _tables(codes: np.ndarray, ends: np.ndarray, ks, letters: int) -> list[np.ndarray]:
    """For each k all counts, rows x k-mers; a row begins at each of `ends` and stops at the next.

    All windows are counted, with the row in which they begin, and those that leave it or have a letter outside the alphabet are taken off again.
    """
    rows, bad = len(ends) - 1, codes == letters
    codes = np.where(bad, 0, codes)
    begins = np.zeros(len(codes) + 1, dtype=bool)
    begins[ends[1:]] = True
    key = np.repeat(np.arange(rows), np.diff(ends))
    lost = np.zeros(len(codes), dtype=bool)
    tables = []
    for k in range(1, max(ks) + 1):
        n = max(len(codes) - k + 1, 0)
        key = key[:n] * letters
        key += codes[k - 1 :]
        lost = lost[:n] | bad[k - 1 :]
        if k > 1:
            lost |= begins[k - 1 : k - 1 + n]
        if k in ks:
            table = np.bincount(key, minlength=rows * letters**k)
            np.subtract.at(table, key[lost], 1)
            tables.append(table.reshape(rows, -1))
    return tables


def count_tables(column: pa.Array, ks, alphabet: str = "ACGT") -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, rows x k-mers for each k) of one Arrow column of sequences, some rows at a time: all counts, zeros included."""
    raw, ends = _text(column)
    lengths = np.diff(ends)
    codes, letters = _letter_codes(alphabet), len(alphabet)
    width = kmer_offset(max(ks) + 1, ks, letters)
    for a, b in _slices(lengths, min(SLICE, TABLE_BASES), max(1, TABLE // width)):
        some = codes[raw[ends[a] : ends[b]]]
        if lengths[a] > SLICE:
            _, idx, n = _count_long_row(some, ks, letters)
            total = np.zeros((1, width), dtype=np.int64)
            total[0, idx] = n
            yield a, np.split(total, [kmer_offset(k, ks, letters) for k in ks[1:]], axis=1)
        else:
            yield a, _tables(some, ends[a : b + 1] - ends[a], ks, letters)


def _batch_codes(column: pa.Array, alphabet: str, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, owner row) of one Arrow column of sequences, a slice at a time; slices share `overlap` bases."""
    raw, ends = _text(column)
    table = _letter_codes(alphabet)
    for start in range(int(ends[0]), int(ends[-1]), SLICE):
        stop = min(start + SLICE + overlap, int(ends[-1]))
        first, last = np.searchsorted(ends, [start, stop - 1], side="right") - 1
        bounds = np.clip(ends[first : last + 2], start, stop)
        yield table[raw[start:stop]], np.repeat(np.arange(last - first + 1), np.diff(bounds))


def kmer_counts(
    df: DataFrame,
    ks=(3, 4, 5, 6, 7),
    alphabet: str = "ACGT",
    row_id: str = "row_id",
    sequence: str = "sequence",
) -> DataFrame:
    """Sparse counts `(row_id, idx, n)`: k-mers with a letter outside `alphabet` are dropped."""
    ks = tuple(sorted(set(ks)))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, _, row, idx, n in _batch_counts(batch.column(1), ks, alphabet):
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + first)), pa.array(idx.astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=[row_id, "idx", "n"],
                )

    return df.select(row_id, sequence).mapInArrow(run, f"{row_id} bigint, idx int, n bigint")


def kmer_vocab(df: DataFrame, ks=(3, 4, 5, 6, 7), alphabet: str = "ACGT", sequence: str = "sequence") -> DataFrame:
    """`kmer, idx` of every k-mer over `alphabet` that occurs. A task marks what it meets and sends a vocabulary, not its k-mers."""
    ks = tuple(sorted(set(ks)))

    def run(batches):
        met = np.zeros(kmer_offset(max(ks) + 1, ks, len(alphabet)), dtype=bool)
        for batch in batches:
            for codes, owner in _batch_codes(batch.column(0), alphabet, max(ks)):
                for k, _, value in _windows(codes, owner, ks, len(alphabet)):
                    met[value + kmer_offset(k, ks, len(alphabet))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(met))], names=["idx"])

    seen = df.select(sequence).mapInArrow(run, "idx bigint").distinct()
    return seen.select(kmer_name(F.col("idx"), ks, alphabet).alias("kmer"), "idx")


def kmer_vectors(
    df: DataFrame,
    ks=(3, 4, 5, 6, 7),
    alphabet: str = "ACGT",
    row_id: str = "row_id",
    sequence: str = "sequence",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The same counts as one row per sequence: `idx array<int>`, `val array<double>`, plus `keep`."""
    ks = tuple(sorted(set(ks)))
    source = df.select(row_id, sequence, *keep)
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])

    def run(batches):
        for batch in batches:
            for first, rows, row, idx, n in _batch_counts(batch.column(1), ks, alphabet):
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
                part = batch.slice(first, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)]
                    + [part.column(i) for i in range(2, part.num_columns)]
                    + [
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(idx.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(n.astype(np.float64))),
                    ],
                    names=[row_id, *keep, "idx", "val"],
                )

    return source.mapInArrow(run, f"{row_id} bigint{kept}, idx array<int>, val array<double>")


def kmer_bytes(df: DataFrame, k: int, alphabet: str, row_id: str = "row_id", sequence: str = "sequence") -> DataFrame:
    """`row_id, vec binary`: all counts of a small vocabulary, zeros included, as single-precision numbers."""
    width = len(alphabet) ** k

    def run(batches):
        for batch in batches:
            for first, rows, row, idx, n in _batch_counts(batch.column(1), (k,), alphabet):
                dense = np.zeros((rows, width), np.float32)
                dense[row, idx] = n
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array([v.tobytes() for v in dense], pa.binary())], names=[row_id, "vec"]
                )

    return df.select(row_id, sequence).mapInArrow(run, f"{row_id} bigint, vec binary")


def kmer_counts_fit(df: DataFrame, k: int = 3, alphabet: str = "acgtn", row_id: str = "row_id", sequence: str = "sequence") -> DataFrame:
    """Counts over all observed k-mers of the lower-cased sequence: `(row_id, kmer, n)`.

    Rows over `alphabet` are counted as numbers; the rare rows with other letters as strings, as any letter may occur.
    """
    lowered = df.select(row_id, F.lower(F.col(sequence)).alias(sequence))
    other = F.col(sequence).rlike(f"[^{alphabet}]")
    plain = kmer_counts(lowered.where(~other), (k,), alphabet, row_id, sequence)
    plain = plain.select(row_id, kmer_name(F.col("idx"), (k,), alphabet).alias("kmer"), "n")
    letters = F.split(sequence, "")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(letters) - k + 1, F.lit(1))), lambda i: i + (k - 1) <= F.size(letters))
    kmers = F.transform(starts, lambda i: F.array_join(F.slice(letters, i, F.lit(k)), ""))
    odd = lowered.where(other).select(row_id, F.explode(kmers).alias("kmer"))
    return plain.unionByName(odd.groupBy(row_id, "kmer").agg(F.count(F.lit(1)).alias("n")))
