"""Column functions over sequences (strings of A, C, G, T, N) and their tracks (arrays).

One-hot rows and digits of tracks are made by Arrow functions, a few array operations per batch; the rest are built-in Spark
expressions. Positions are walked with `split` or one regular expression pass, never with a `substring` per position: `substring`
counts characters from the start each time, which makes long sequences quadratic.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from seqloom.constants import CODON_REGEX, KOZAK_STRONG, KOZAK_WEAK

TRACK = "array<tinyint>"


def bases(seq: Column) -> Column:
    """One array element per base; an empty sequence gives an empty array."""
    return F.filter(F.split(seq, ""), lambda b: b != "")


def steps(n: Column, step: int = 1) -> Column:
    """0, step, 2*step, ... below n; empty for n <= 0 (plain `sequence` would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0).cast("tinyint"), F.greatest(n, F.lit(0)).cast("int"))


# ---- one-hot -----------------------------------------------------------------------------


def rows_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(elements of all rows, where each row begins and the last ends) of a list column; null is empty."""
    return column.flatten(), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy())).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, where each row begins and the last ends) of a text column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def texts_of(raw: np.ndarray, ends: np.ndarray, like: pa.Array) -> pa.Array:
    """Text rows of the bytes between `ends`, null where `like` is."""
    valid = None if not like.null_count else pa.array(np.packbits(np.asarray(like.is_valid()), bitorder="little")).buffers()[1]
    return pa.StringArray.from_buffers(len(like), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)), valid)


def lists_of(values: pa.Array, ends: np.ndarray, like: pa.Array) -> pa.Array:
    """List rows of the values between `ends`, null where `like` is."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=like.is_null() if like.null_count else None)


def matrix_of(column: pa.Array, width: int | None = None) -> tuple[np.ndarray | None, np.ndarray]:
    """(rows of all matrices below each other, where each matrix begins and the last ends).

    The first is None where a row is null, holds a null, or lengths differ. With `width`, matrices are lists of their elements, row by row.
    """
    values, ends = rows_of(column)
    if pa.types.is_list(values.type):
        return _plain(values), ends
    if width is None or values.null_count or (ends % width).any():
        raise ValueError("not a matrix")
    return values.to_numpy().reshape(-1, width), ends // width


def _plain(values: pa.Array) -> np.ndarray | None:
    lengths = values.value_lengths()
    if values.null_count or not len(values) or lengths[0].as_py() < 4 or lengths.to_numpy().min() != lengths.to_numpy().max():
        return None
    flat = values.flatten()
    return None if flat.null_count else flat.to_numpy().reshape(len(values), -1)


_LETTER = np.frombuffer(b"ACGT", np.uint8)
_HOT = np.zeros((256, 4), np.int8)
_HOT[_LETTER] = np.eye(4, dtype=np.int8)


def _hot(raw: np.ndarray) -> np.ndarray:
    known = np.isin(np.arange(256), np.append(_LETTER, ord("N")))
    bad = ~known[raw]
    if bad.any():
        raise ValueError(f"not a base: {bytes(raw[bad][:4]).decode(errors='replace')[0]}")
    return _HOT[raw]


def _letter(row: list | None) -> str:
    four = None if row is None else row[:4]
    if not four or None in four:
        return "N" if four == [] else ""
    return "N" if sum(four) == 0 else "ACGT"[four.index(max(four))]


def _ohe_to_str(ohe: pa.Array, width: int | None = None) -> pa.Array:
    x, ends = matrix_of(ohe, width)
    if x is None:
        return pa.array([None if row is None else "".join(map(_letter, row)).rstrip("N") for row in ohe.to_pylist()], pa.string())
    four = x[:, :4]
    letters = np.where(four.sum(axis=1, dtype=np.int64) == 0, np.uint8(ord("N")), _LETTER[four.argmax(axis=1)])
    last = np.append(0, np.maximum.accumulate(np.where(letters != ord("N"), np.arange(1, len(letters) + 1), 0)))
    stop = np.maximum(last[ends[1:]], ends[:-1])
    size = stop - ends[:-1]
    kept = np.arange(len(letters)) < np.repeat(stop, np.diff(ends))
    return texts_of(letters[kept], np.append(0, np.cumsum(size)), ohe)


def ohe_to_str(ohe: Column, width: int | None = None) -> Column:
    """One-hot rows to letters: an all-zero row is N, trailing N is padding and is dropped. A list of elements is cut into rows of `width`."""

    def run(ohe: pa.Array) -> pa.Array:
        return _ohe_to_str(ohe, width)

    return F.arrow_udf(run, "string")(ohe)


def _str_to_ohe(seq: pa.Array) -> pa.Array:
    raw, ends = bytes_of(seq)
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * 4), pa.array(_hot(raw).ravel()))
    return lists_of(rows, ends, seq)


def str_to_ohe(seq: Column) -> Column:
    """Letters to one-hot rows; N is all zeros and any other letter is an error."""
    return F.arrow_udf(_str_to_ohe, "array<array<tinyint>>")(seq)


def six_tracks(seq: pa.Array, cds: pa.Array, splice: pa.Array, pad: int = 0) -> pa.Array:
    """The rows of `six_track` of an Arrow batch, `pad` zero rows after each. Where tracks and sequence differ in length, what is missing is null."""
    raw, ends = bytes_of(seq)
    (c, c_ends), (p, p_ends) = rows_of(cds), rows_of(splice)
    if seq.null_count or c.null_count or p.null_count or not (np.array_equal(ends, c_ends) and np.array_equal(ends, p_ends)):
        return _uneven_tracks(_hot(raw), ends, seq, cds, splice, pad)
    x, ends = flat_tracks(raw, ends, c.to_numpy(), p.to_numpy(), pad)
    rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 6, dtype=np.int32)), pa.array(x.ravel()))
    return lists_of(rows, ends, seq)


def flat_tracks(raw: np.ndarray, ends: np.ndarray, cds: np.ndarray, splice: np.ndarray, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rows of six tracks of all sequences, where each sequence begins and the last ends)."""
    x = np.zeros((len(raw) + pad * (len(ends) - 1), 6), np.int8)
    at = np.arange(len(raw)) + pad * np.repeat(np.arange(len(ends) - 1), np.diff(ends)) if pad else None
    for a in range(0, len(raw), 1 << 20):
        some = slice(a, a + (1 << 20))
        to = some if at is None else at[some]
        x[to, :4], x[to, 4], x[to, 5] = _hot(raw[some]), cds[some], splice[some]
    return x, ends + pad * np.arange(len(ends))


def _uneven_tracks(hot, ends, seq, cds, splice, pad):
    out = []
    for i, (c, p) in enumerate(zip(cds.to_pylist(), splice.to_pylist())):
        if c is None or p is None or not seq[i].is_valid:
            out.append(None)
            continue
        bases = hot[ends[i] : ends[i + 1]].tolist()
        n = max(len(bases), len(c), len(p))
        c, p = c + [None] * (n - len(c)), p + [None] * (n - len(p))
        out.append([[*bases[j], c[j], p[j]] if j < len(bases) else None for j in range(n)] + [[0] * 6] * pad)
    return pa.array(out, pa.list_(pa.list_(pa.int8())))


def _six_track(seq: pa.Array, cds: pa.Array, splice: pa.Array) -> pa.Array:
    return six_tracks(seq, cds, splice)


def six_track(seq: Column, cds: Column, splice: Column) -> Column:
    """One-hot columns followed by the coding and splice tracks, one row per base."""
    return F.arrow_udf(_six_track, "array<array<tinyint>>")(seq, cds.cast(TRACK), splice.cast(TRACK))


def track_of(x: Column, at: int, width: int | None = None) -> Column:
    """One column of tensors as a track, counted from 1; null where a row of the tensor is."""

    def run(x: pa.Array) -> pa.Array:
        plain, ends = matrix_of(x, width)
        if plain is None:
            return pa.array([None if rows is None else [None if r is None else r[at - 1] for r in rows] for rows in x.to_pylist()], pa.list_(pa.int8()))
        return lists_of(pa.array(np.ascontiguousarray(plain[:, at - 1]).astype(np.int8)), ends, x)

    return F.arrow_udf(run, TRACK)(x)


def _digits(track: pa.Array) -> pa.Array:
    values, ends = rows_of(track)
    if pa.types.is_list(values.type):
        if values.null_count:
            nested = [None if row is None or None in row else [v for part in row for v in part] for row in track.to_pylist()]
            track = pa.array(nested, pa.list_(pa.int64()))
            values, ends = rows_of(track)
        else:
            inner = values.offsets.to_numpy()
            ends = (inner[ends] - inner[0]).astype(np.int64)
            values = values.flatten()
    small = np.zeros(0, np.int8) if values.null_count else values.to_numpy()
    if values.null_count or (len(small) and (small.min() < 0 or small.max() > 9)):
        words = values.to_pylist()
        joined = ["".join(str(v) for v in words[a:b] if v is not None) for a, b in zip(ends, ends[1:])]
        return pa.array([t if ok else None for t, ok in zip(joined, track.is_valid().to_pylist())], pa.string())
    return texts_of(small.astype(np.uint8) + np.uint8(ord("0")), ends, track)


def digits(track: Column) -> Column:
    """The numbers of a track, or of a list of tracks one after another, as one text."""
    return F.arrow_udf(_digits, "string")(track)


# ---- tracks ------------------------------------------------------------------------------


def trim_track(track: Column, seq: Column) -> Column:
    return F.slice(track, 1, F.length(seq))


def cds_track(utr5: Column, cds: Column, utr3: Column, exons: Column) -> Column:
    """1 at every third base of the coding part; zeros over the exons of a non-coding transcript."""
    codons = F.flatten(
        F.array_repeat(
            F.array(*[F.lit(x).cast("tinyint") for x in (1, 0, 0)]), F.ceil(cds / 3).cast("int")
        )
    )
    coding = F.concat(zeros(utr5), F.slice(codons, 1, cds.cast("int")), zeros(utr3))
    return F.when(cds > 0, coding).otherwise(zeros(exons))


def splice_track(exon_lengths: Column, length: Column) -> Column:
    """1 at the last base of each exon. `exon_lengths` is in transcript order."""
    one = F.array(F.lit(1).cast("tinyint"))
    marks = F.flatten(
        F.transform(
            F.filter(exon_lengths, lambda n: n > 0),
            lambda n: F.concat(zeros(n - 1), one),
        )
    )
    return F.slice(F.concat(marks, zeros(length - F.size(marks))), 1, length.cast("int"))


def fixed_cds_track(utr: Column, primer: str, n_codons: int, downstream: int) -> Column:
    """Track of a reporter construct: primer and insert, then a fixed run of codons, then the tail."""
    codons = F.flatten(
        F.array_repeat(F.array(*[F.lit(x).cast("tinyint") for x in (1, 0, 0)]), n_codons)
    )
    return F.concat(zeros(F.length(utr) + len(primer)), codons, zeros(F.lit(downstream)))


def first_codon(cds: Column) -> Column:
    """0-based index of the first codon start, null without one."""
    at = F.array_position(cds, F.lit(1).cast("tinyint"))
    return F.when(at > 0, (at - 1).cast("int"))


def last_codon(cds: Column) -> Column:
    """0-based index of the last codon start, null without one."""
    back = F.array_position(F.reverse(cds), F.lit(1).cast("tinyint"))
    return F.when(back > 0, (F.size(cds) - back).cast("int"))


def cds_length(cds: Column) -> Column:
    return F.coalesce(last_codon(cds) + 3 - first_codon(cds), F.lit(0))


def exon_count(splice: Column) -> Column:
    marks = F.array_remove(splice, F.lit(0).cast("tinyint"))  # few are left to add up
    return F.aggregate(marks, F.lit(0), lambda a, x: a + x.cast("int"))


# ---- regions -----------------------------------------------------------------------------


def _whole_codons(seq: Column) -> Column:
    return F.left(seq, F.length(seq) - F.length(seq) % 3)


def get_cds(seq: Column, cds: Column) -> Column:
    """First to last codon, cut to whole codons; the whole sequence, so cut, without a codon."""
    first, last = first_codon(cds), last_codon(cds)
    return _whole_codons(F.when(first.isNull(), seq).otherwise(F.substr(seq, first + 1, last + 3 - first)))


def utr5(seq: Column, cds: Column) -> Column:
    first = first_codon(cds)
    return F.when(first > 0, F.left(seq, first)).otherwise(seq)


def utr3(seq: Column, cds: Column, k: int) -> Column:
    """After the last codon; the whole sequence without a codon or when less than k bases remain."""
    end = last_codon(cds) + 3
    return F.when(F.length(seq) - end >= k, F.substr(seq, end + 1)).otherwise(seq)


def mark_codons(seq: Column, cds: Column) -> Column:
    return F.array_join(
        F.zip_with(bases(seq), cds, lambda b, c: F.when(c == 1, F.concat(F.lit("E"), b)).otherwise(b)), ""
    )


def space_bases(seq: Column) -> Column:
    return F.array_join(bases(seq), " ")


def space_regions(seq: Column, cds: Column) -> Column:
    """Single spaced bases outside the coding part, spaced triplets inside it."""
    start = first_codon(cds)
    end = F.least(last_codon(cds) + 3, F.length(seq))
    coding = F.substr(seq, start + 1, end - start)
    parts = F.array(
        space_bases(F.left(seq, start)),
        F.array_join(chunk_sequence(coding, 3), " "),
        space_bases(F.substr(seq, end + 1)),
    )
    return F.when(start.isNull(), space_bases(seq)).otherwise(
        F.array_join(F.filter(parts, lambda p: p != ""), " ")
    )


# ---- composition -------------------------------------------------------------------------


def count_letter(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def gc_content(seq: Column) -> Column:
    """Share of G and C among A, C, G and T; null when there is none of them."""
    at = count_letter(seq, "A") + count_letter(seq, "T")
    gc = count_letter(seq, "G") + count_letter(seq, "C")
    return F.when(at + gc > 0, gc / (at + gc))


def to_rna(seq: Column) -> Column:
    return F.translate(seq, "T", "U")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def strip_chr(chrom: Column) -> Column:
    return F.regexp_replace(chrom, "^chr", "")


def versionless(ident: Column) -> Column:
    """Identifier without its `.version` suffix."""
    return F.split_part(ident, F.lit("."), F.lit(1))


# ---- untranslated regions of reporter constructs -------------------------------------------


def flank(utr: Column, primer: str, reporter: str) -> Column:
    return F.concat(F.lit(primer), utr, F.lit(reporter))


def extract_utr(seq: Column, primer: str, reporter: str) -> Column:
    return F.substr(
        seq, F.lit(len(primer) + 1), F.greatest(F.length(seq) - (len(primer) + len(reporter)), F.lit(0))
    )


def upstream_start(utr: Column) -> Column:
    """Any start codon upstream (0/1)."""
    return F.contains(F.upper(utr), F.lit("ATG")).cast("int")


def upstream_oof_start(utr: Column) -> Column:
    """Any start codon that is out of frame with the end of the region (0/1).

    Counts start codons twice, in any frame and in the frame of the region's end, and compares:
    occurrences of ATG cannot overlap, so both counts are exact and the work stays linear.
    """
    up = F.upper(utr)
    anywhere = (F.length(up) - F.length(F.replace(up, F.lit("ATG"), F.lit("")))) / 3
    framed = F.regexp_extract_all(F.substr(up, F.length(up) % 3 + 1), F.lit(CODON_REGEX), 0)
    in_frame = F.size(F.filter(framed, lambda c: c == "ATG"))
    return (anywhere > in_frame).cast("int")


def _kozak_match(tail: Column, rule) -> Column:
    ok = F.lit(True)
    for i, allowed in enumerate(rule):
        ok = ok & ((F.length(tail) <= i) | F.substring(tail, i + 1, 1).isin(list(allowed)))
    return ok


def kozak_quality(utr: Column) -> Column:
    """strong, weak or mixed, from the last three bases (fewer are compared as far as they go)."""
    tail = F.right(utr, F.lit(3))
    strong, weak = _kozak_match(tail, KOZAK_STRONG), _kozak_match(tail, KOZAK_WEAK)
    return F.when(strong == weak, "mixed").when(strong, "strong").otherwise("weak")


def feature_combo(u_start: Column, kozak: Column) -> Column:
    return F.concat_ws(
        " ", F.when(u_start == 1, "uAUG: True,").otherwise("uAUG: False,"), kozak, F.lit("Kozak")
    )


# ---- chunks ------------------------------------------------------------------------------


def chunk_sequence(seq: Column, n: int) -> Column:
    """Non-overlapping windows of n bases, the last one shorter; one linear pass."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{n}}}"), 0)


def chunk_tokens(tokens: Column, n: int) -> Column:
    return F.transform(steps(F.size(tokens), n), lambda i: F.slice(tokens, i + 1, n))


def chunk_backfill(seq: Column, n: int) -> Column:
    """As `chunk_sequence`, with a short last window extended backwards to n bases."""
    chunks = chunk_sequence(seq, n)
    whole = F.slice(chunks, 1, F.size(chunks) - 1)
    return F.when(
        (F.size(chunks) > 1) & (F.length(seq) % n != 0), F.concat(whole, F.array(F.right(seq, F.lit(n))))
    ).otherwise(chunks)


def edge_tokens(tokens: Column, pos: Column, n_chunks: Column) -> Column:
    """Drop the end token of the first chunk, the start token of the last, both in between."""
    size = F.size(tokens)
    return (
        F.when(pos == 0, F.slice(tokens, F.lit(1), size - 1))
        .when(pos == n_chunks - 1, F.slice(tokens, F.lit(2), size - 1))
        .otherwise(F.slice(tokens, F.lit(2), size - 2))
    )


def wrap_tokens(tokens: Column, start: int = 1, end: int = 2) -> Column:
    return F.concat(F.array(F.lit(start)), tokens, F.array(F.lit(end)))


def center_pad(seq: Column, length: int) -> Column:
    left = pad_left(seq, length)
    return F.concat(
        F.repeat(F.lit("N"), left),
        seq,
        F.repeat(F.lit("N"), F.greatest(length - F.length(seq) - left, F.lit(0))),
    )


def pad_left(seq: Column, length: int) -> Column:
    return F.floor(F.greatest(length - F.length(seq), F.lit(0)) / 2).cast("int")


def valid_bins(seq: Column, length: int, bin_size: int) -> Column:
    """Half-open range of output bins that hold real, unpadded sequence."""
    left = pad_left(seq, length)
    return F.struct(
        F.floor(left / bin_size).cast("int").alias("start_bin"),
        F.ceil((left + F.length(seq)) / bin_size).cast("int").alias("end_bin"),
    )


# ---- k-mer numbering -----------------------------------------------------------------------


def kmer_offset(k: int, ks=(3, 4, 5, 6, 7), letters: int = 4) -> int:
    """Position of the first k-mer of length k in the vocabulary ordered by length, then letters."""
    return sum(letters**j for j in sorted(ks) if j < k)


def kmer_index(kmer: Column, ks=(3, 4, 5, 6, 7), alphabet: str = "ACGT") -> Column:
    """Vocabulary position of a k-mer, by arithmetic instead of a lookup table."""
    table = F.array(*[F.lit(a) for a in alphabet])
    value = F.aggregate(
        bases(kmer),
        F.lit(0).cast("bigint"),
        lambda acc, b: acc * len(alphabet) + F.array_position(table, b) - 1,
    )
    start = None
    for k in sorted(ks):
        at = F.lit(kmer_offset(k, ks, len(alphabet)))
        start = F.when(F.length(kmer) == k, at) if start is None else start.when(F.length(kmer) == k, at)
    return value + start


def kmer_name(index: Column, ks=(3, 4, 5, 6, 7), alphabet: str = "ACGT") -> Column:
    """Inverse of `kmer_index`."""
    n = len(alphabet)
    table = F.array(*[F.lit(a) for a in alphabet])
    out = None
    for k in sorted(ks):
        rest = index - kmer_offset(k, ks, n)
        letters = [
            F.element_at(table, (F.floor(rest / n ** (k - 1 - j)) % n + 1).cast("int")) for j in range(k)
        ]
        inside = index < kmer_offset(k, ks, n) + n**k
        out = F.when(inside, F.concat(*letters)) if out is None else out.when(inside, F.concat(*letters))
    return out
