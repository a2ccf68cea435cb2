"""Words, windows and hashes of whole texts as numpy passes over Arrow buffers.

Every pass works on a chunk: neighbouring rows of a batch with at most `CHUNK` bytes of text together, or one
longer row alone, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # bytes of text in one numpy pass
U64 = np.uint64

# Bytes that belong to words: letters, digits and everything beyond ASCII, or all but ASCII white space.
ALNUM = np.array([not (b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F) for b in range(256)])
NON_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
# Lower case of A-Z alone.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_BYTE_KEYS = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(U64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker and extended by doubling."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        kept = np.ones(1, dtype=U64) if kept is None else kept
        while len(kept) < n:
            step = U64(int(kept[-1]) * base % (1 << 64))
            kept = np.concatenate([kept, kept * step])
        _powers[base] = kept
    return kept[:n]


def release() -> None:
    """Give memory back when a task is over: workers live on, and an executor has several."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(step):
    """`step` over a task's batches, and `release` after it."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            release()

    return run


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of `h` over all 64."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        # Null rows may own bytes of the buffer; lay the others side by side.
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
        yield from chunks(column, size)
        return
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        base = offsets[row]
        yield row, end, text[base : offsets[end]], offsets[row : end + 1] - base
        row = end


def words(text: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `member` bytes within rows, and each row's first word."""
    inside = member[text]
    n = len(text)
    before = np.zeros(n, dtype=bool)
    after = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(text: np.ndarray) -> np.ndarray:
    """Running polynomial sums: any substring's hash is a difference of two of them."""
    sums = np.zeros(len(text) + 1, dtype=U64)
    np.cumsum(_BYTE_KEYS[text] * powers(_BASE, len(text)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever the bytes stand."""
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(sums))[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of `k` neighbours; rows are not told apart."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.full(n, U64(seed + 0x1234567))
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[j : j + n]
        out ^= out >> U64(32)
    return mix(out)


def owners(row_starts: np.ndarray) -> np.ndarray:
    """The row of every word."""
    return np.repeat(np.arange(len(row_starts) - 1), np.diff(row_starts))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, .. for every (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total, dtype=np.int64) + shift
