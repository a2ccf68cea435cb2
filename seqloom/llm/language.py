"""Language of documents by error-correcting output codes (operator 4).

Method: every language has a codeword of -1 and +1. For each bit a binary classifier over byte n-grams of words separates the languages
with +1 from those with -1. A text's margins are compared with every codeword by a loss, weighted by how well each
bit's classifier does on each language; the nearest codeword wins, and a close second flags the text as ambiguous.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm import spans as S
from seqloom.llm.samples import fold, labelled_sample

#: Labelled rows per language to learn from.
PER_LANGUAGE = 10_000
BUCKETS = 1 << 16  # hashed n-grams
GRAMS = (1, 2, 3, 4)
SHARPNESS = 8.0  # of the loss, per nat of margin and n-gram
AMBIGUOUS = 0.6  # a score below flags the text
SCORED = "held_out boolean, lang_pred string, score double, ambiguous boolean"

_LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0x80 for b in range(256)])


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and +1: every split of the languages for up to 6, else the best of seeded random codes."""
    if n < 2:
        return np.ones((n, 0), dtype=np.int8)
    if n <= 6:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(splits, dtype=np.int8).reshape(-1, n).T
    bits, random, best = int(np.ceil(10 * np.log2(n))), np.random.RandomState(7), None
    for _ in range(200):
        code = random.choice(np.array([-1, 1], dtype=np.int8), (n, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2
        nearest = apart[~np.eye(n, dtype=bool)].min()
        if (np.abs(code.sum(axis=0)) < n).all() and (best is None or nearest > best[0]):
            best = (nearest, code)
    return best[1]


def _word_grams(text, starts, ends):
    """n-gram buckets of words with a blank on either side: word number and bucket."""
    lengths = ends - starts + 2
    at = np.concatenate([[0], np.cumsum(lengths)])
    padded = np.full(at[-1], 0x20, dtype=np.uint8)
    inner = S.ranges(at[:-1] + 1, lengths - 2)
    padded[inner] = text[S.ranges(starts, lengths - 2)]
    owner = np.repeat(np.arange(len(starts)), lengths)
    value = np.zeros(len(padded), dtype=np.uint64)
    words, buckets = [], []
    for n in range(1, max(GRAMS) + 1):
        size = len(padded) - n + 1
        if size <= 0:
            break
        value = value[:size] * np.uint64(257) + padded[n - 1 :].astype(np.uint64) + np.uint64(1)
        if n in GRAMS:
            same = owner[:size] == owner[n - 1 :]
            words.append(owner[:size][same])
            buckets.append((S.mix(value[same] + np.uint64(n << 40)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(words), np.concatenate(buckets)


def _distinct_words(column):
    """Per chunk: first row, offsets of rows in words, text, a place of every distinct word, and which word stands where."""
    for first, _, text, offsets in S.chunks(column):
        text = S.LOWER[text]
        starts, ends, rows = S.words(text, offsets, _LETTERS)
        _, at, code = np.unique(S.span_hashes(S.prefix_sums(text), starts, ends), return_index=True, return_inverse=True)
        yield first, rows, text, starts[at], ends[at], code


def _count_grams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) of texts with a `lang`, summed per task before the shuffle."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for first, bounds, text, starts, ends, code in _distinct_words(batch.column(1)):
                if not len(starts):
                    continue
                word, bucket = _word_grams(text, starts, ends)
                of = langs[first : first + len(bounds) - 1]
                for lang in set(of):
                    chosen = np.repeat(of == lang, np.diff(bounds))
                    times = np.bincount(code[chosen], minlength=len(starts))
                    seen = np.bincount(bucket, times[word], BUCKETS)
                    total[lang] = total.get(lang, 0) + seen
        for lang, seen in total.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(seen[at].astype(np.int64))], names=["lang", "bucket", "n"])

    return rows.select("lang", "text").mapInArrow(S.tidy(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages, their codewords, n-gram weights per bit, and the weight of each bit for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages))
        shares = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)  # languages weigh alike, however many rows each has
        self.weights = np.stack([np.log(shares[bit > 0].mean(axis=0) / shares[bit < 0].mean(axis=0)) for bit in self.code.T], axis=1) if self.code.size else np.zeros((BUCKETS, 0))
        self.trust = np.ones(self.code.shape)

    def margins(self, column: pa.Array) -> np.ndarray:
        """Mean weight of a text's n-grams, per bit."""
        out = np.zeros((len(column), self.code.shape[1]))
        for first, bounds, text, starts, ends, code in _distinct_words(column):
            if not len(starts):
                continue
            word, bucket = _word_grams(text, starts, ends)
            grams = np.bincount(word, minlength=len(starts)).astype(float)
            row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            n = np.bincount(row, grams[code], len(bounds) - 1)
            for bit in range(out.shape[1]):
                per_word = np.bincount(word, self.weights[bucket, bit], len(starts))
                out[first : first + len(n), bit] = np.bincount(row, per_word[code], len(n)) / np.maximum(n, 1)
        return out

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest codeword and how sure it is, by loss-weighted decoding."""
        weight = self.trust / np.maximum(self.trust.sum(axis=1, keepdims=True), 1e-9)
        loss = np.stack([(np.logaddexp(0, -SHARPNESS * margins * c) * w).sum(axis=1) for c, w in zip(self.code, weight)], axis=1)
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return loss.argmin(axis=1), near.max(axis=1) / near.sum(axis=1)


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from `text` and `lang` of documents outside the held-out fold, `per_language` of each language at most about."""
    rows = documents.where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = labelled_sample(rows, "lang", per_language)
    counted = _count_grams(sample).toArrow()  # languages times `BUCKETS` rows at most
    names = counted.column("lang").to_pylist()
    languages = sorted(set(names))
    counts = np.zeros((len(languages), BUCKETS))
    where = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, ([where[x] for x in names], np.asarray(counted.column("bucket"))), np.asarray(counted.column("n")))
    model = Model(languages, counts)
    if len(languages) > 1:
        shared = documents.sparkSession.sparkContext.broadcast(model)
        bits = model.code.shape[1]

        def right(batches):
            for batch in batches:
                of = np.array([where[x] for x in batch.column(0).to_pylist()], dtype=int)
                hit = (shared.value.margins(batch.column(1)) * shared.value.code[of]) > 0
                n = np.bincount(of, minlength=len(languages))
                for i in np.flatnonzero(n):
                    yield pa.RecordBatch.from_arrays([pa.array([i] * bits, pa.int32()), pa.array(range(bits), pa.int32()), pa.array(hit[of == i].sum(axis=0), pa.int64()), pa.array([int(n[i])] * bits, pa.int64())], names=["lang", "bit", "hit", "n"])

        rates = sample.select("lang", "text").mapInArrow(S.tidy(right), "lang int, bit int, hit long, n long").groupBy("lang", "bit").agg(F.sum("hit"), F.sum("n"))
        for lang, bit, hit, n in rates.collect():
            model.trust[lang, bit] = hit / n
    return model


def _predicted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents` as a struct `row`, beside `SCORED` but for doc_id."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = documents.select(F.struct("*").alias("row"), (fold() == 0).alias("held_out"), "text", letters.alias("letters"))

    def predict(batches):
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            letters = np.asarray(batch.column(3)).astype(bool) & bool(model.languages)
            best, score = model.decode(model.margins(batch.column(2))) if model.languages else (np.zeros(len(letters), int), np.zeros(len(letters)))
            best, score = np.where(letters, best, len(names) - 1), np.where(letters, score, 0.0)
            columns = [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(score < AMBIGUOUS)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "held_out", "lang_pred", "score", "ambiguous"])

    return rows.mapInArrow(S.tidy(predict), f"row {rows.schema['row'].dataType.simpleString()}, {SCORED}")


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Predict the language of whole texts, from nothing but the text.

    `documents` needs `doc_id` and `text`; other columns are ignored. Null texts and texts without a letter are `und` with score 0, and so are
    all texts if nothing was learned. Equal texts get equal results; every row gives a row; an empty table gives none.

    Returns doc_id, held_out, lang_pred, score (0 to 1), ambiguous.
    """
    return _predicted(documents.select("doc_id", "text"), model).select("row.doc_id", "held_out", "lang_pred", "score", "ambiguous")


def drop_unidentified(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `documents`, all columns, whose text has a language with a score of `least` or more; see `identify`."""
    found = _predicted(documents, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
