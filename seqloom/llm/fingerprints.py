"""Fingerprints of documents by one-permutation MinHash (operator 12).

Method: each word shingle is hashed once; the high bits of the hash name one of `BINS` bins, and a bin keeps the smallest hash
that falls into it. Empty bins are filled by optimal densification: bin i asks bins in a pseudo-random order of its own, the
same for all texts, and copies the first that is not empty. Of each bin the lowest `BITS` bits are stored, packed into a hexadecimal
string. Two fingerprints agree by chance in 2**-BITS of their bins, for which the likeness is corrected.

Neighbours by doc_id meet by a range exchange: each text crosses the network once, and only the first and last text of each
range are written down to be joined.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm import spans as S
from seqloom.llm.homes import parts, text_bytes
from seqloom.session import cut_lineage

SHINGLE = 5
BINS = 256
BITS = 4  # a hexadecimal digit
PART_BYTES = 24 << 20  # bytes of text in one range of doc_ids
ASKED = 32  # bins that are asked one by one before the order of all is looked up
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

_orders: dict = {}

INNER, FIRST, LAST = 0, 1, 2
_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited binary, near_edited double, near_next double"


# -- fingerprints of texts


def asked_bins() -> tuple[np.ndarray, np.ndarray]:
    """(bin asked by each bin at each of the first attempts, attempt at which each bin first asks each other one)."""
    if not _orders:
        attempts = 32 * BINS
        at = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(attempts) + np.arange(attempts, dtype=np.uint64)
        asked = (S.mix(at + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(40)).astype(np.int64) % BINS
        first = np.full((BINS, BINS), attempts, np.int64) + np.arange(BINS)  # never asked: after all others, in order
        for i in range(BINS):
            bins, when = np.unique(asked[i], return_index=True)
            first[i, bins] = when
        _orders["asked"], _orders["first"] = asked[:, :ASKED].copy(), first
    return _orders["asked"], _orders["first"]


def smallest(column: pa.Array) -> np.ndarray:
    """texts x BINS: the smallest shingle hash per bin, `EMPTY` where none falls.

    Shingles are `SHINGLE` consecutive runs of anything but ASCII white space, A-Z in lower case; a text of fewer words is one shingle.
    """
    out = np.full((len(column), BINS), EMPTY)
    flat = out.reshape(-1)
    for first, _, text, offsets in S.chunks(column):
        text = S.LOWER[text]
        starts, ends, bounds = S.words(text, offsets, S.NON_SPACE)
        hashes = S.span_hashes(S.prefix_sums(text), starts, ends)
        sizes, row = np.diff(bounds), S.owners(bounds)
        for k in range(1, SHINGLE + 1):
            key = S.windows(hashes, k)
            keep = (row[: len(key)] == row[k - 1 :]) if len(key) else np.zeros(0, bool)
            if k < SHINGLE:
                if not (sizes == k).any():
                    continue
                keep &= (sizes == k)[row[: len(key)]]
            key = np.minimum(key[keep], EMPTY - np.uint64(1))
            at = (first + row[: len(keep)][keep]) * BINS + ((key >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
            np.minimum.at(flat, at, key)
    return out


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill the empty bins of every row that has a filled one."""
    asked, order = asked_bins()
    empty = bins == EMPTY
    row, at = np.nonzero(empty & ~empty.all(axis=1)[:, None])
    out = bins.copy()
    for attempt in range(ASKED):
        if not len(row):
            return out
        found = bins[row, asked[at, attempt]]
        hit = found != EMPTY
        out[row[hit], at[hit]] = found[hit]
        row, at = row[~hit], at[~hit]
    # few filled bins are left in these rows: which of them would be asked first?
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1, [len(row)]])
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            filled = np.flatnonzero(~empty[row[a]])
            nearest = order[at[a:b][:, None], filled].argmin(axis=1)
            out[row[a:b], at[a:b]] = bins[row[a], filled[nearest]]
    return out


def pack(bins: np.ndarray) -> list[bytes]:
    """The lowest bits of every bin; nothing for a text without words."""
    low = (bins & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    packed = (low[:, 0::2] << 4) | low[:, 1::2]
    return [b"" if none else row.tobytes() for row, none in zip(packed, (bins == EMPTY).all(axis=1))]


def fingerprints(texts: list[str]) -> list[bytes]:
    return pack(densify(smallest(pa.array(texts, pa.large_string())))) if texts else []


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Estimated Jaccard similarities, corrected for bits that agree by chance: (agreeing - 2**-BITS) / (1 - 2**-BITS), from 0 to 1.

    Texts without words are like one another (1) and like no other (0).
    """
    whole = np.array([len(x) > 0 and len(y) > 0 for x, y in zip(a, b)], bool)
    out = np.array([float(not x and not y) for x, y in zip(a, b)])
    if whole.any():
        left, right = (np.frombuffer(b"".join(x for x, w in zip(of, whole) if w), np.uint8).reshape(-1, BINS // 2) for of in (a, b))
        apart = left ^ right
        agree = ((apart & 0xF0) == 0).sum(axis=1) + ((apart & 0x0F) == 0).sum(axis=1)
        chance = 2.0**-BITS
        out[whole] = np.clip((agree / BINS - chance) / (1 - chance), 0.0, 1.0)
    return out


def as_text(fingerprint: str) -> Column:
    return F.lower(F.hex(fingerprint))


def with_fingerprint(df: DataFrame, text: str = "text", output: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of a text column, as hexadecimal digits; null and wordless texts have ''.

    Rows are independent: repeated rows and equal texts have equal fingerprints, an empty table stays empty. A column of
    the output's name is replaced.
    """

    @F.pandas_udf("binary")
    def of(column):
        out = [f for rows in _slices(pa.array(column, pa.large_string(), from_pandas=True)) for f in fingerprints(rows)]
        return column.__class__(out)

    return df.withColumn(output, F.lower(F.hex(of(F.coalesce(F.col(text), F.lit(""))))))


def _slices(column: pa.Array):
    """Neighbouring texts of at most a chunk together, or one longer text."""
    for first, last, _, _ in S.chunks(column):
        yield ["" if t is None else t for t in column.slice(first, last - first).to_pylist()]


# -- documents beside their edited text and their neighbour


def edit(text: str, following: str) -> str:
    """`text`, its last half (rounded down) replaced by as many characters from the start of `following`, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(docs: list, texts: list[str], own: list[bytes], following: list[str], other: list[bytes]) -> list[pa.Array]:
    changed = [edit(t, f) for t, f in zip(texts, following)]
    edited = fingerprints(changed)
    return [
        pa.array(docs, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()), pa.array(own, pa.binary()), pa.array(edited, pa.binary()),
        pa.array(likeness(own, edited), pa.float64()), pa.array(likeness(own, other), pa.float64()),
    ]


_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def compare_with_edits(documents: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document's fingerprint, that of its edited text (`edit`), and how like both and the next document's are.

    The next document is the one with the next larger doc_id; after the last comes the first, so a single document is its own
    next. `documents` needs `doc_id` and `text`; other columns are ignored. Rows without doc_id stand last; rows that repeat a doc_id stand in the
    order of their texts' hashes, and each is a document of its own. A null text counts as empty. Texts without words
    have the fingerprint '', which is like itself (1) and unlike any other (0). An empty table gives no rows.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    order = [F.asc_nulls_last("doc_id"), F.asc("hash"), F.asc("place")]
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = texts.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    n = parts(text_bytes(texts), part_bytes)
    ranges = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def within(batches):
        """Rows next to one another in a range; the first and the last row come out as they are."""
        held = None  # doc_id, text, fingerprint of the row before
        for batch in batches:
            ids, part = batch.column(0).to_pylist(), batch.column(2)[0].as_py() if len(batch) else 0
            at = 0
            for rows in _slices(batch.column(1)):
                docs, own = ids[at : at + len(rows)], fingerprints(rows)
                at += len(rows)
                if held is None:
                    yield edge(FIRST, part, None, rows[0], own[0])
                else:
                    docs, rows, own = [held[0], *docs], [held[1], *rows], [held[2], *own]
                held = docs[-1], rows[-1], own[-1]
                columns = _compared(docs[:-1], rows[:-1], own[:-1], rows[1:], own[1:])
                k = len(docs) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([INNER] * k, pa.int32()), pa.array([part] * k, pa.int32()), *columns, pa.nulls(k, pa.string())], names=["kind", "part", *_NAMES, "text"]
                )
        if held is not None:
            yield edge(LAST, part, *held)

    def edge(kind, part, doc, text, own):
        blank = [pa.array([doc], pa.int64()), *(pa.nulls(1, t) for t in (pa.int64(), pa.string())), pa.array([own], pa.binary()),
                 *(pa.nulls(1, t) for t in (pa.binary(), pa.float64(), pa.float64()))]
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), *blank, pa.array([text])], names=["kind", "part", *_NAMES, "text"])

    found = cut_lineage(ranges.mapInArrow(S.tidy(within), f"kind int, part int, {_ROW}, text string"))
    firsts = found.where(F.col("kind") == FIRST).select(F.col("part").alias("after"), F.col("text").alias("following"), F.col("fingerprint").alias("other"))
    lasts = found.where(F.col("kind") == LAST).select("part", "doc_id", "text", "fingerprint")
    filled = sorted(r["after"] for r in firsts.select("after").collect())  # a number per range of documents
    follow = documents.sparkSession.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "part int, after int")

    def across(batches):
        for batch in batches:
            for i in range(len(batch)):
                doc, text, own, following, other = (batch.column(c)[i].as_py() for c in range(5))
                yield pa.RecordBatch.from_arrays(_compared([doc], [text], [own], [following], [other]), names=_NAMES)

    meeting = lasts.join(follow, "part").join(firsts, "after").select("doc_id", "text", "fingerprint", "following", "other")
    rows = found.where(F.col("kind") == INNER).select(*_NAMES).unionByName(meeting.mapInArrow(S.tidy(across), _ROW))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("fingerprint").alias("fingerprint"), as_text("edited").alias("edited_fingerprint"), "near_edited", "near_next"
    )
