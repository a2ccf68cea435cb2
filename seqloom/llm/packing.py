"""Documents packed into sequences of tokens (operator 2).

Method: pattern packing by non-negative least squares. Only the histogram of piece lengths, one number per length up to
the sequence length, reaches the driver. Patterns of two and three lengths that fill a sequence exactly are enumerated, repeat counts
are fitted to the histogram, rounded, and what is left is packed best-fit, longest first. Pieces then take their
places by their rank among pieces of the same length.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W

from seqloom.llm import spans as S
from seqloom.session import cut_lineage

SIZE = 1024
END = 2
SHARES = (1.0, 0.9, 0.75, 0.5, 0.25)  # of the fitted repeats that are tried
RANK_GROUP = 512  # pieces of one length that one task numbers together
CACHE = 1_500_000  # atoms of text whose ids a task keeps, the first it meets
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

CHUNK = 1 << 20  # bytes of text that are cut into atoms together; the arrays of a pass take some 50 times as many
JOINED = 512  # atoms that the tokenizer gets in one string, a line each

# A blank before something else than white space always starts a new word of the tokenizer, whatever stands before the
# blank; texts where a blank precedes more white space or the end, or with a special token, are encoded whole.
_IRREGULAR = r" (?:[\s\v\x{1c}-\x{1f}\x{85}\pZ]|$)"
_PLAIN = re.compile(r" ?[^\s\x1c-\x1f\x85]+(?:\n[^\s\x1c-\x1f\x85]+)*").fullmatch

# Visible ASCII bytes: letters 1, digits 2, the others 3. Everything else, 0, may be of any kind and is not parted from its neighbours.
_KINDS = np.array([0 if not 0x21 <= b <= 0x7E else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], dtype=np.uint8)


def _atom_starts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where atoms begin: at their text or a blank, where the kind of visible ASCII changes, and around a line feed between two of it.

    The tokenizer has a word begin at each of these places. Only what follows an apostrophe may belong to it, as in 's.
    """
    kinds = _KINDS[text]
    begins = text == 0x20
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    left, right = kinds[:-1], kinds[1:]
    begins[1:] |= (left != right) & (left > 0) & (right > 0) & ((text[:-1] != 0x27) | (right != 1))
    feeds = np.flatnonzero(text[1:] == 0x0A) + 1
    feeds = feeds[kinds[feeds - 1] > 0]
    begins[feeds] = True
    after = feeds[feeds + 1 < len(text)] + 1
    begins[after[kinds[after] > 0]] = True
    return np.flatnonzero(begins)


class _Encoder:
    """Ids of whole texts; atoms between blanks are encoded once and then found by their 64-bit hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.irregular = "|".join([_IRREGULAR, *(re.sub(r"([^A-Za-z0-9])", r"\\\1", t) for t in special)])
        self.line = self._encode(["\n"])[0][0]
        self.keys = np.zeros(0, dtype=np.uint64)  # ascending
        self.slots = np.zeros(0, dtype=np.int64)  # of the keys, in the arrays below
        self.lengths = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 16):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 16], add_special_tokens=False)]
        return out

    def _encode_atoms(self, atoms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In which order, how many ids each, and the ids.

        Atoms with no white space inside but line feeds between words are lines of one string, as a line feed
        between words is a word of its own.
        """
        fits = np.array([_PLAIN(a) is not None for a in atoms], dtype=bool)
        lengths, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        plain = [a for a, fit in zip(atoms, fits) if fit]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, encoded in zip(groups, self._encode(["\n".join(g) for g in groups])):
            encoded = np.array(encoded, dtype=np.uint32)
            ends = np.append(np.flatnonzero(encoded == self.line), len(encoded))
            ends = ends[np.cumsum([a.count("\n") + 1 for a in group]) - 1]
            lengths.append(np.diff(ends, prepend=-1) - 1)
            ids.append(np.delete(encoded, ends[:-1]))
        for encoded in self._encode([a for a, fit in zip(atoms, fits) if not fit]):
            lengths.append(np.array([len(encoded)]))
            ids.append(np.array(encoded, dtype=np.uint32))
        return np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)]), np.concatenate(lengths), np.concatenate(ids)

    def _look_up(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Slots of distinct atoms, and the arrays to find them in; atoms met for the first time are encoded."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        slots = np.zeros(len(keys), dtype=np.int64)
        slots[known] = self.slots[at[known]]
        new = np.flatnonzero(~known)
        if not len(new):
            return slots, self.lengths, self.ids
        raw = text.tobytes()
        order, lengths, ids = self._encode_atoms([raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        slots[new[order]] = len(self.lengths) + np.arange(len(new))
        lengths, ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        if len(lengths) <= CACHE:  # beyond, what is new is encoded where it stands and not kept
            self.keys, self.slots = np.insert(self.keys, at[new], keys[new]), np.insert(self.slots, at[new], slots[new])
            self.lengths, self.ids = lengths, ids
        return slots, lengths, ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        irregular = np.asarray(pc.match_substring_regex(texts, self.irregular)).astype(bool)
        whole = iter(self._encode(texts.filter(pa.array(irregular)).to_pylist()))
        found: list[np.ndarray] = []
        for _, _, text, offsets in S.chunks(texts.filter(pa.array(~irregular)), CHUNK):
            starts = _atom_starts(text, offsets)
            ends = np.append(starts[1:], len(text))[: len(starts)]
            keys, at, code = np.unique(S.span_hashes(S.prefix_sums(text), starts, ends), return_index=True, return_inverse=True)
            slots, lengths, ids = self._look_up(keys, text, starts[at], ends[at])
            slot = slots[code]
            begins = np.cumsum(lengths) - lengths
            flat = ids[S.ranges(begins[slot], lengths[slot])]
            bounds = np.concatenate([[0], np.cumsum(lengths[slot])])[np.searchsorted(starts, offsets)].tolist()
            found += [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        regular = iter(found)
        return [np.array(next(whole), dtype=np.uint32) if odd else next(regular) for odd in irregular.tolist()]


def token_pieces(documents: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Documents as pieces of at most `size` tokens; only the first piece of a longer document may be shorter."""

    def cut(batches):
        encoder = _Encoder(tokenizer)
        for batch in batches:
            docs, texts = batch.column(0), batch.column(1).fill_null("")
            for first, last, _, _ in S.chunks(texts, CHUNK):
                rows = []
                for doc, ids in zip(docs.slice(first, last - first).to_pylist(), encoder.encode(texts.slice(first, last - first))):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    begin, stop, piece = 0, len(ids) % size or size, 0
                    while begin < len(ids):
                        rows.append((doc, piece, begin, stop - begin, zlib.crc32(ids[begin:stop].tobytes())))
                        begin, stop, piece = stop, stop + size, piece + 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select("doc_id", "text").mapInArrow(S.tidy(cut), PIECES)


# -- the plan: numbers per length, never per document


def _patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """Twos and threes of the lengths with sum `size`, as indices; -1 fills up the twos."""
    where = np.full(size + 1, -1)
    where[lengths] = np.arange(len(lengths))
    i, j = np.triu_indices(len(lengths))
    rest = size - lengths[i] - lengths[j]
    twos = np.stack([i, j, np.full(len(i), -1)], axis=1)[rest == 0]
    ok = rest >= lengths[j]
    i, j, k = i[ok], j[ok], where[rest[ok]]
    threes = np.stack([i, j, k], axis=1)[k >= 0]
    return np.concatenate([twos, threes])


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Non-negative x with A x near `counts` in least squares, A having a column per pattern.

    Block coordinate descent: every round takes patterns with the largest gain that share no length, whose columns are
    orthogonal, and moves each to its best value. The result is sparse, so that few repeats are lost to rounding.
    """
    n = len(counts)
    x = np.zeros(len(patterns))
    padded = np.where(patterns < 0, n, patterns)
    norm = np.zeros(len(patterns))
    for slot in range(3):
        norm += (padded == padded[:, [slot]]).sum(axis=1) * (padded[:, slot] < n)
    left = np.append(counts, 0.0)
    for _ in range(rounds):
        step = np.maximum(left[padded].sum(axis=1) / norm, -x)
        gain = step * step * norm
        used = np.zeros(n + 1, dtype=bool)
        moved = []
        best = np.argpartition(-gain, min(len(gain) - 1, 4 * n))[: 4 * n + 1]
        for p in best[np.argsort(-gain[best], kind="stable")].tolist():
            members = padded[p][padded[p] < n]
            if gain[p] < 1e-3:
                break
            if not used[members].any():
                used[members] = True
                moved.append(p)
        if not moved:
            break
        x[moved] += step[moved]
        for slot in range(3):
            np.subtract.at(left, padded[moved, slot], step[moved])
        left[n] = 0.0
    return x


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns for all of `left` (uses it up): longest first, each time the longest that still fits."""
    plan = []
    while left.any():
        room, members, here = size, [], left.copy()
        while True:
            fits = np.flatnonzero(here[: room + 1])
            if not len(fits):
                break
            longest = int(fits[-1])
            here[longest] -= 1
            room -= longest
            members.append(longest)
        repeats = min(int(left[m]) // members.count(m) for m in set(members))
        for m in members:
            left[m] -= repeats
        plan.append((tuple(members), repeats))
    return plan


def plan_sequences(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using every piece of the histogram once.

    Fitted repeats are rounded down, whole and by the `SHARES`: residuals that keep the histogram's shape pack better
    than what an all but perfect fit leaves. The plan with the fewest sequences is taken.
    """
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    whole = [((size,), int(counts[size]))] if counts[size] else []
    counts[size] = 0
    lengths = np.flatnonzero(counts)
    patterns = _patterns(lengths, size) if len(lengths) else np.zeros((0, 3), dtype=int)
    x = fit_repeats(patterns, counts[lengths].astype(float)) if len(patterns) else np.zeros(0)
    used = [(p, tuple(int(lengths[i]) for i in patterns[p] if i >= 0)) for p in np.argsort(-x, kind="stable").tolist() if x[p] * max(SHARES) >= 1]
    plans = []
    for share in SHARES:
        left, plan = counts.copy(), []
        for p, members in used:
            repeats = min(int(x[p] * share), *(int(left[m]) // members.count(m) for m in members))
            if repeats > 0:
                for m in members:
                    left[m] -= repeats
                plan.append((members, repeats))
        plans.append(plan + _best_fit(left, size))
    return whole + min(plans, key=lambda plan: sum(n for _, n in plan))


def _places(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: from which rank on a pattern serves, its first sequence, and its offsets for that length."""
    places: dict[int, list] = {}
    served: dict[int, int] = {}
    sequence = 0
    for members, repeats in plan:
        offsets: dict[int, list[int]] = {}
        at = 0
        for m in members:
            offsets.setdefault(m, []).append(at)
            at += m
        for m, of in offsets.items():
            places.setdefault(m, []).append((served.get(m, 0), sequence, of))
            served[m] = served.get(m, 0) + repeats * len(of)
        sequence += repeats
    return places


def pack(documents: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """All documents in few sequences of at most `size` tokens.

    `documents` needs `doc_id` and `text`; other columns are ignored. A document is its ids and `end`; null text is empty, so
    every row gives one piece at least. Rows that repeat are packed each. An empty table gives no rows.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = cut_lineage(token_pieces(documents, tokenizer, size, end))
    histogram = dict(pieces.groupBy("length").count().collect())  # at most `size` rows
    places = _places(plan_sequences(histogram, size))
    # A length that many pieces share is numbered in groups, each starting where those before it end.
    groups = F.array(*[F.lit(max(1, -(-histogram.get(n, 0) // RANK_GROUP))) for n in range(1, size + 1)])
    every = ("doc_id", "piece", "start", "ids_crc32")
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64(*every), F.element_at(groups, F.col("length").cast("int"))))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "part").orderBy(*every)) - 1
    ranked = pieces.withColumn("within", within).join(starts, ["length", "part"])
    ranked = ranked.select(*every, "length", (F.col("before") + F.col("within")).alias("rank"))

    def assign(batches):
        tables = {n: (np.array([p[0] for p in of]), of) for n, of in places.items()}
        for batch in batches:
            sequences, offsets = [], []
            for n, rank in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                begins, of = tables[n]
                begin, sequence, at = of[int(np.searchsorted(begins, rank, side="right")) - 1]
                copy, which = divmod(rank - begin, len(at))
                sequences.append(sequence + copy)
                offsets.append(at[which])
            kept = [batch.column(i) for i in (0, 1, 2, 4, 3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(assign, PIECES + ", sequence_id long, offset long")
