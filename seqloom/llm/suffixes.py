"""Removal of long byte strings that occur more than once (operator 6).

Method: suffixes are sorted bucket by bucket, with ties settled by a difference cover. Positions of a perfect
difference set modulo `PERIOD` are the sample: whatever two positions p and q are, some shift below the period takes both
into the sample. Equal `LENGTH`-byte prefixes therefore show as equal sample windows at one shift, and a suffix
none of whose sample windows repeats is unique and never sorted. The suffixes left go into buckets by the leading bits of
their key, one bucket is sorted at a time, and equal neighbours are the repeated prefixes.

Keys are 64-bit hashes of the first `LENGTH` bytes, not the bytes: only equality to that depth is asked for, and
a lexicographic order would move every suffix's text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm import homes as H
from seqloom.llm import spans as S

LENGTH = 200
# Fixed value: a perfect difference set, every residue modulo 133 is a difference of two members.
PERIOD = 133
COVER = (0, 2, 6, 24, 29, 40, 43, 55, 68, 75, 76, 85)


def _shift_table(period: int, cover: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(period, dtype=bool)
    table[list(cover)] = True
    return table


def _samples(offsets: np.ndarray, n: int, window: int, in_cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the sample in every row, where a window fits, and their rows."""
    lengths = np.diff(offsets)
    local = np.arange(n, dtype=np.int64) - np.repeat(offsets[:-1], lengths)
    at = np.flatnonzero(in_cover[local % len(in_cover)])
    row = np.searchsorted(offsets, at, side="right") - 1
    fits = at + window <= offsets[row + 1]
    return at[fits], row[fits]


def _candidates(text, offsets, sums, repeated, length, window, in_cover) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes with a repeated sample window among their first `period` shifts, and their keys."""
    n, period = len(text), len(in_cover)
    at, row = _samples(offsets, n, window, in_cover)
    hit = H.member(S.span_hashes(sums, at, at + window) & H.SHORT, repeated)
    at, row = at[hit], row[hit]
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, np.maximum(at - period + 1, offsets[row]), 1)
    np.add.at(steps, at + 1, -1)
    found = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    end = offsets[np.searchsorted(offsets, found, side="right")] if len(found) else found
    found = found[found + length <= end]
    return found, S.span_hashes(sums, found, found + length)


def remove_repeated_bytes(documents: DataFrame, length: int = LENGTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts anywhere else.

    `documents` needs `doc_id` and `text`; other columns are ignored, whatever their names. Strings are those of
    the UTF-8 bytes of one text and never cross rows. Rows that repeat, with equal ids or not, are other places for each other: all are
    emptied if they are long enough. Null text is empty; texts shorter than `length` are kept whole; a null doc_id stays null in
    its row. An empty table gives no rows.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.
    """
    if not 0 < period < length:
        raise ValueError("the period must be shorter than the strings")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), H.text_key().alias("key"))
    size = H.text_bytes(documents)
    homes, slots = H.parts(size, H.HOME_BYTES), H.parts(0.8 * size, H.SLOT_BYTES)
    window, in_cover = length - period + 1, _shift_table(period, cover)

    def anchors(column):
        for first, _, text, offsets in S.chunks(column):
            at, row = _samples(offsets, len(text), window, in_cover)
            yield first, row, S.span_hashes(S.prefix_sums(text), at, at + window)

    def suffixes(home):
        """(first row, offsets, position and key of the candidates) of each chunk of the home's texts."""
        repeated = home.answered(2)
        for first, _, text, offsets in S.chunks(home.texts):
            yield first, text, offsets, *_candidates(text, offsets, S.prefix_sums(text), repeated, length, window, in_cover)

    def send(home, number):
        keys = [key for *_, key in suffixes(home)] if home else []
        keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        times = np.diff(np.concatenate([new, [len(keys)]]))
        rows = []
        for several in (False, True):
            some = keys[new][(times > 1) == several]
            # kind 3: at one place of this home, kind 4: at several
            rows += [(slot, 3 + several, number.to_bytes(8, "little") + H.pack_sorted(some[a:b])) for slot, a, b in H.by_slot(some, slots)]
        return pa.Table.from_batches([H.message(rows)])

    def bucket(kinds, bodies):
        """Sort one bucket of suffixes; equal neighbours from two homes, or one that a home has twice, are repeated.

        Answers (kind 3) name the suffixes of a home that are unique after all."""
        lists = [H.unpack_sorted(memoryview(b.as_py())[8:])[0] for b in bodies]
        ordered = np.sort(np.concatenate(lists + [x for x, k in zip(lists, kinds) if k == 4]))
        repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        out = []
        for keys, kind, body in zip(lists, kinds, bodies):
            found = keys[~H.member(keys, repeated)]
            if kind == 3 and len(found):  # most candidates are repeated, so homes hear of the others
                out.append((int.from_bytes(body.as_py()[:8], "little"), 3, H.pack_sorted(found)))
        return out

    def cut(home, number):
        rows = []
        for first, text, offsets, at, key in suffixes(home) if home else ():
            at = at[~H.member(key, home.answered(3))]
            steps = np.zeros(len(text) + 1, dtype=np.int64)
            np.add.at(steps, at, 1)
            np.add.at(steps, at + length, -1)
            gone = np.cumsum(steps[:-1]) > 0
            for i in range(len(offsets) - 1):
                part, marks = text[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
                if home.copies[first + i] > 1 and len(part) >= length:
                    marks = np.ones(len(part), dtype=bool)
                n = int(marks.sum())
                runs = int(marks[:1].sum() + (marks[1:] & ~marks[:-1]).sum()) if n else 0
                rows.append((home.keys[first + i], len(part), n, runs, hashlib.sha256((part[~marks] if n else part).tobytes()).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 5
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    sample = H.repeated_anchors(H.send_anchors(texts, slots, anchors), homes, slots)
    packs = H.to_homes(texts, homes)
    ranked = H.at_slots(H.at_homes(packs, sample, homes, send, H.MESSAGE), slots, bucket)
    result = H.at_homes(packs, sample.unionByName(ranked), homes, cut, "key string, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return texts.select("doc_id", "key").join(result, "key").drop("key")
