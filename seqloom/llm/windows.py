"""Removal of later copies of word passages (operator 9).

Method: difference-cover anchors. Shorter windows are hashed only where a word's number modulo `PERIOD` is in a perfect
difference set. Two equal `WIDTH`-word windows share such an anchor at one shift below the period, so windows
without a repeated anchor are unique; those around repeated anchors are hashed whole, and of equal ones the first stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm import homes as H
from seqloom.llm import spans as S

WIDTH = 20
# Fixed value: a perfect difference set, every residue modulo 13 is a difference of two members.
PERIOD = 13
COVER = (0, 1, 3, 9)


def _word_hashes(text, offsets):
    starts, ends, first = S.words(text, offsets, S.NON_SPACE)
    return starts, ends, first, S.span_hashes(S.prefix_sums(text), starts, ends)


def _anchors(hashes, first, window, in_cover):
    """Word number, row and hash of the anchors of a chunk."""
    owner = S.owners(first)
    number = np.arange(len(hashes)) - first[owner]
    key = S.windows(hashes, window)
    at = np.flatnonzero(in_cover[number[: len(key)] % len(in_cover)])
    at = at[at + window <= first[owner[at] + 1]]
    return at, owner[at], key[at]


def _candidates(hashes, first, repeated, width, window, in_cover):
    """Windows with a repeated anchor in one of their first `period` places: word number, row, hash."""
    period = len(in_cover)
    at, row, key = _anchors(hashes, first, window, in_cover)
    hit = H.member(key & H.SHORT, repeated)
    at, row = at[hit], row[hit]
    steps = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(steps, np.maximum(at - period + 1, first[row]), 1)
    np.add.at(steps, at + 1, -1)
    found = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
    owner = np.searchsorted(first, found, side="right") - 1
    fits = found + width <= first[owner + 1]
    found, owner = found[fits], owner[fits]
    return found, owner, S.windows(hashes, width, seed=1)[found]


def remove_repeated_windows(documents: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """Remove every word covered by a window of `width` words that also starts earlier.

    `documents` needs `doc_id` and `text`; other columns are ignored, whatever their names. Earlier is a smaller doc_id, or the same row
    and an earlier word; a null doc_id comes last, and of different texts under one doc_id, or none, the one of smaller md5 is earlier. Rows that repeat a doc_id and its text are one document and get the same result.
    Null text has no words; texts of fewer than `width` words are kept. An empty table gives no rows.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).
    """
    if not 0 < period < width:
        raise ValueError("the period must be shorter than the windows")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), H.text_key().alias("key"))
    size = H.text_bytes(documents)
    homes, slots = H.parts(size, H.HOME_BYTES), H.parts(0.4 * size, H.SLOT_BYTES)
    window = width - period + 1
    in_cover = np.zeros(period, dtype=bool)
    in_cover[list(cover)] = True

    def anchors(column):
        for begin, _, text, offsets in S.chunks(column):
            _, _, first, hashes = _word_hashes(text, offsets)
            _, row, key = _anchors(hashes, first, window, in_cover)
            yield begin, row, key

    def passages(home):
        for begin, _, text, offsets in S.chunks(home.texts):
            starts, ends, first, hashes = _word_hashes(text, offsets)
            yield begin, text, starts, ends, first, *_candidates(hashes, first, home.answered(2), width, window, in_cover)

    def firsts(home):
        """The distinct windows of a home, ascending, with the id and the number of the text that has each first."""
        keys, texts = [], []
        for begin, _, _, _, _, _, owner, key in passages(home):
            keys.append(key)
            texts.append(begin + owner)
        key, text = np.concatenate(keys), np.concatenate(texts)
        order = np.lexsort((text, key))
        key, text = key[order], text[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        # numbers order texts of one id as their keys do, in which a home has them
        number = np.array([int(k[:16], 16) - (1 << 63) for k in home.keys], dtype=np.int64)
        return key[new], home.first[text[new]], number[text[new]]

    def send(home, number):
        key, first, text = firsts(home) if home else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        rows = [(slot, 3, number.to_bytes(8, "little") + H.pack_sorted(key[a:b], first[a:b], text[a:b])) for slot, a, b in H.by_slot(key, slots)]
        return pa.Table.from_batches([H.message(rows)])

    def elect(kinds, bodies):
        """Answer (kind 3) a home with its windows that another home has earlier."""
        lists = [H.unpack_sorted(memoryview(b.as_py())[8:], 2) for b in bodies]
        key, first, text = (np.concatenate([x[i] for x in lists]) for i in (0, 1, 2))
        order = np.lexsort((text, first, key))
        key, first, text = key[order], first[order], text[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        key, first, text = key[new], first[new], text[new]
        out = []
        for (mine, at, by), body in zip(lists, bodies):
            best = np.searchsorted(key, mine)
            later = mine[(first[best] < at) | ((first[best] == at) & (text[best] < by))]
            if len(later):
                out.append((int.from_bytes(body.as_py()[:8], "little"), 3, H.pack_sorted(later)))
        return out

    def cut(home, number):
        rows = []
        if home:
            elsewhere, seen, empty = home.answered(3), np.zeros(0, np.uint64), hashlib.sha256(b"").hexdigest()
            for begin, text, starts, ends, first, at, owner, key in passages(home):
                # texts come by ascending id, so a window met before in this home stands earlier
                order = np.argsort(key, kind="stable")
                again = np.ones(len(key), dtype=bool)
                if len(key):  # a chunk can have no window with a repeated anchor
                    again[order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]] = False
                again |= H.member(key, seen) | H.member(key, elsewhere)
                seen = np.union1d(seen, key)
                steps = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(steps, at[again], 1)
                np.add.at(steps, at[again] + width, -1)
                gone = np.cumsum(steps[:-1]) > 0
                raw = text.tobytes()
                for i in range(len(first) - 1):
                    a, b = first[i], first[i + 1]
                    kept = np.flatnonzero(~gone[a:b]) + a
                    joined = b" ".join(raw[s:e] for s, e in zip(starts[kept].tolist(), ends[kept].tolist()))
                    sha = hashlib.sha256(joined).hexdigest()
                    whole = b - a >= width
                    rows.append((home.keys[begin + i], int(home.first[begin + i]), int(b - a), int(b - a - len(kept)), sha, int(b - a) if whole else 0, empty if whole else sha))
        columns = list(zip(*rows)) if rows else [()] * 7
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "first", "n_words", "removed_first", "sha_first", "removed_later", "sha_later"])

    sample = H.repeated_anchors(H.send_anchors(texts, slots, anchors), homes, slots)
    packs = H.to_homes(texts, homes)
    later = H.at_slots(H.at_homes(packs, sample, homes, send, H.MESSAGE), slots, elect)
    schema = "key string, first long, n_words long, removed_first long, sha_first string, removed_later long, sha_later string"
    result = H.at_homes(packs, sample.unionByName(later), homes, cut, schema)
    original = F.coalesce("doc_id", F.lit(H.NEVER)) == F.col("first")
    return texts.select("doc_id", "key").join(result, "key").select(
        "doc_id", "n_words", F.when(original, F.col("removed_first")).otherwise(F.col("removed_later")).alias("n_removed"),
        F.when(original, F.col("sha_first")).otherwise(F.col("sha_later")).alias("kept_sha256"),
    )
