"""Toxicity by class-conditional Kneser-Ney models (operator 10).

Method: two interpolated Kneser-Ney models over the bytes of words, one for toxic and one for ordinary texts. The longest n-grams are counted
per class, in a bounded sample of labelled texts; everything shorter is one set of continuation counts over the whole
corpus that both classes back off to, so an expression that either class hardly saw is judged by shared evidence. A text is scored by its length-normalised log-likelihood ratio
and by the words that speak most for toxicity; a logistic curve over these, fitted on a fold that its counts leave out, gives the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm import homes as H
from seqloom.llm import spans as S
from seqloom.llm.homes import member
from seqloom.llm.samples import fold, labelled_sample
from seqloom.session import cut_lineage

ORDER = 6  # bytes; n-grams fit a 64-bit number as they are
DISCOUNT = 0.75
BACKOFF = 5.0  # occurrences' worth of shared evidence in every context of a class
EXCESS = 2.0  # nats from which on a word counts
#: Labelled rows per class to learn from.
PER_LABEL = 50_000
PRIOR = 1e-4  # ridge of the curve
PLACES = (1, 2, 4, 8)  # words of a text that count on their own
FEATURES = 3 + len(PLACES)
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what `spans.ALNUM` leaves out
SCORED = "doc_id long, held_out boolean, score double, predicted int"


def _grams(text, starts, ends):
    """The ORDER-byte n-grams of words, with ORDER-1 marks before and one behind: word number and packed bytes."""
    pad = ORDER - 1
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + pad + 1)])
    padded = np.ones(at[-1], dtype=np.uint64)
    padded[S.ranges(at[:-1] + pad, lengths)] = text[S.ranges(starts, lengths)]
    padded[at[1:] - 1] = 2
    packed = np.zeros(max(0, len(padded) - pad), dtype=np.uint64)
    for i in range(ORDER if len(packed) else 0):
        packed = (packed << np.uint64(8)) | padded[i : i + len(packed)]
    inside = S.ranges(at[:-1], lengths + 1)
    return np.repeat(np.arange(len(starts)), lengths + 1), packed[inside]


def _distinct_words(column):
    for first, _, text, offsets in S.chunks(column):
        text = S.LOWER[text]
        starts, ends, rows = S.words(text, offsets, S.ALNUM)
        _, at, code = np.unique(S.span_hashes(S.prefix_sums(text), starts, ends), return_index=True, return_inverse=True)
        yield first, rows, text, starts[at], ends[at], code


def count_grams(rows: DataFrame) -> DataFrame:
    """gram, and its counts in texts of class 0 and 1, without (a0, a1) and within (b0, b1) fold 4. Summed per task first."""

    def count(batches):
        keys, counts, held = [], [], 0

        def merged():
            key, of = np.unique(np.concatenate(keys), return_inverse=True)
            every = np.concatenate(counts, axis=1)
            return key, np.stack([np.bincount(of, c, len(key)) for c in every])

        def send(key, every):
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *(pa.array(c.astype(np.int64)) for c in every)], names=["gram", "a0", "a1", "b0", "b1"])

        for batch in batches:
            group = np.asarray(batch.column(0)).astype(int)
            for first, bounds, text, starts, ends, code in _distinct_words(batch.column(1)):
                if not len(starts):
                    continue
                word, gram = _grams(text, starts, ends)
                of = np.repeat(group[first : first + len(bounds) - 1], np.diff(bounds))
                key, at = np.unique(gram, return_inverse=True)
                keys.append(key)
                counts.append(np.stack([np.bincount(at, np.bincount(code[of == g], minlength=len(starts))[word], len(key)) for g in range(4)]))
                held += len(key)
                if held > 1 << 22:
                    key, every = merged()
                    keys, counts, held = [key], [every], len(key)
                    if held > 1 << 21:
                        yield send(key, every)
                        keys, counts, held = [], [], 0
        if held:
            yield send(*merged())

    found = rows.select("group", "text").mapInArrow(S.tidy(count), "gram long, a0 long, a1 long, b0 long, b1 long")
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "b0", "b1")])


def corpus_grams(documents: DataFrame) -> DataFrame:
    """The different n-grams of all texts, each once; tasks drop what they have sent."""

    def distinct(batches):
        kept = np.zeros(0, np.uint64)
        for batch in batches:
            for _, _, text, starts, ends, _ in _distinct_words(batch.column(0)):
                if not len(starts):
                    continue
                new = np.unique(_grams(text, starts, ends)[1])
                new = new[~member(new, kept)]
                if len(new):
                    kept = np.union1d(kept, new) if len(kept) < 1 << 22 else new
                    yield pa.RecordBatch.from_arrays([pa.array(new.astype(np.int64))], names=["gram"])

    return documents.select("text").mapInArrow(S.tidy(distinct), "gram long").distinct()


def _last(order: int) -> Column:
    """The last `order` bytes of n-grams."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))


def _contexts(counts: DataFrame, *names: str) -> DataFrame:
    """Per context (all bytes but the last): sums of the counts, and how many n-grams have any."""
    sums = [F.sum(n).alias(f"sum_{n}") for n in names]
    return counts.groupBy(F.shiftright("gram", 8).alias("context")).agg(*sums, *[F.count_if(F.col(n) > 0).alias(f"types_{n}") for n in names])


def shared_tables(grams: DataFrame) -> dict[int, DataFrame]:
    """gram, n0 for all shorter n-grams: continuation counts, how many different bytes stand before each in the corpus."""
    tables = {}
    for order in range(ORDER - 1, 0, -1):
        grams = tables[order] = cut_lineage(grams.groupBy(_last(order).alias("gram")).agg(F.count(F.lit(1)).alias("n0")))
    return tables


class Model:
    """Counts by exact n-gram, in tables that grow with the corpus, and the curve from features to a score."""

    def __init__(self, counts: DataFrame, shared: dict[int, DataFrame]):
        """`counts`: gram, n0, n1 over labelled texts; `shared`: tables of the shorter n-grams."""
        self.counts, self.shared = counts, shared
        self.curve = None
        #: The different n-grams of the documents it was fitted to.
        self.grams: DataFrame | None = None

    def ratio_table(self, grams: DataFrame) -> DataFrame:
        """gram, ratio of each of the different `grams`: log P(last byte | the others, toxic) - log P(.. | ordinary).

        A key has 256 rows at most in any join, as contexts and suffixes lack one byte.
        """
        context = F.shiftright("gram", 8).alias("context")
        lower = None
        for order in range(1, ORDER):
            table = self.shared[order]
            rows = grams.select(_last(order).alias("gram")).distinct().select("gram", context).join(table, "gram", "left").join(_contexts(table, "n0"), "context", "left")
            if lower is None:
                rows = rows.withColumn("below", F.lit(1 / 256))
            else:
                rows = rows.withColumn("suffix", _last(order - 1)).join(lower, "suffix")
            share = F.greatest(F.coalesce("n0", F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("types_n0") * F.col("below")
            share = F.when(F.col("sum_n0") > 0, share / F.col("sum_n0")).otherwise(F.col("below"))
            lower = cut_lineage(rows.select(F.col("gram").alias("suffix"), share.alias("below")))
        rows = grams.select("gram", context, _last(ORDER - 1).alias("suffix")).join(self.counts, "gram", "left")
        rows = rows.join(_contexts(self.counts, "n0", "n1"), "context", "left").join(lower, "suffix")
        logs = []
        for n in ("n0", "n1"):
            of = [F.coalesce(c, F.lit(0)) for c in (n, f"sum_{n}", f"types_{n}")]
            share = F.greatest(of[0] - DISCOUNT, F.lit(0.0)) + (DISCOUNT * of[2] + BACKOFF) * F.col("below")
            logs.append(F.log(F.greatest(share / (of[1] + BACKOFF), F.lit(1e-12))))
        return rows.select("gram", (logs[1] - logs[0]).alias("ratio"))  # one join of tables that are written; not worth writing itself

    def ratios(self, grams: np.ndarray) -> np.ndarray:
        """`ratio_table` of a few n-grams."""
        kinds, of = np.unique(grams, return_inverse=True)
        rows = self.counts.sparkSession.createDataFrame([(int(g),) for g in kinds], "gram long")
        found = dict(self.ratio_table(rows).collect())
        return np.array([found[int(g)] for g in kinds])[of]


def _features(column: pa.Array, known: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Per text: length-normalised ratio, and the ratios of the words that come 1st, 2nd, 4th and 8th
    in speaking for toxicity, and what words have beyond `EXCESS`, by the root of the text's length and by its length.

    `known`: all n-grams of the texts, ascending; `ratio`: of each."""
    out = np.zeros((len(column), FEATURES))
    for first, bounds, text, starts, ends, code in _distinct_words(column):
        if not len(starts):
            continue
        word, gram = _grams(text, starts, ends)
        per_word = np.bincount(word, ratio[np.searchsorted(known, gram)], len(starts))
        n = len(bounds) - 1
        row = np.repeat(np.arange(n), np.diff(bounds))
        value = per_word[code]
        size = np.bincount(row, (ends - starts + 1)[code], n)
        out[first : first + n, 0] = 100 * np.bincount(row, value, n) / np.maximum(size, 1)
        over = np.bincount(row, np.maximum(value - EXCESS, 0), n)
        length = np.maximum(np.diff(bounds), 1)
        out[first : first + n, -2:] = np.stack([over / np.sqrt(length), 100 * over / (length + 20)], axis=1)
        at = np.flatnonzero(value > 0)
        at = at[np.lexsort((-value[at], row[at]))]
        begins = np.searchsorted(row[at], np.arange(n + 1))
        for i, place in enumerate(PLACES):
            has = np.flatnonzero(np.diff(begins) >= place)
            out[first + has, i + 1] = value[at[begins[has] + place - 1]]
    return out


_NAMES = [f"f{i}" for i in range(FEATURES)]


def _feature_rows(rows: DataFrame, model: Model, *kept: str, grams: DataFrame | None = None) -> DataFrame:
    """`kept` and the features of every row. Texts go to homes, which are answered the ratios of their different n-grams.

    `grams`: the different n-grams of the rows, or more. Homes get words with a blank between them, and ratios in single precision."""
    ratios = model.ratio_table(cut_lineage(corpus_grams(rows)) if grams is None else grams).withColumn("ratio", F.col("ratio").cast("float"))
    between = F.regexp_replace(F.coalesce("text", F.lit("")), BETWEEN_WORDS, " ")
    keyed = rows.select(F.lit(0).cast("long").alias("doc_id"), between.alias("text"), H.text_key().alias("key"))
    homes = H.parts(H.text_bytes(rows), H.HOME_BYTES)
    packs = H.to_homes(keyed, homes, level=3).repartition(2 * homes, "slot").groupBy("slot")

    def ask(key, packs):
        grams = np.zeros(0, np.uint64)
        for _, _, text, starts, ends, _ in _distinct_words(H.Home(packs, None).texts):
            if len(starts):
                grams = np.union1d(grams, _grams(text, starts, ends)[1])
        S.release()
        return pa.table({"slot": pa.array([key[0].as_py()] * len(grams), pa.int64()), "gram": pa.array(grams.astype(np.int64))})

    def compute(key, packs, answered):
        home = H.Home(packs, None)
        known, ratio = np.asarray(answered.column("gram")).astype(np.uint64), np.asarray(answered.column("ratio"))
        order = np.argsort(known)
        found = _features(home.texts, known[order], ratio[order])
        out = pa.table([pa.array(home.keys, pa.string()), *(pa.array(f) for f in found.T)], names=["key", *_NAMES])
        S.release()
        return out

    answers = packs.applyInArrow(ask, "slot long, gram long").join(ratios, "gram").select("slot", "gram", "ratio")
    found = packs.cogroup(answers.repartition(2 * homes, "slot").groupBy("slot")).applyInArrow(compute, "key string" + "".join(f", {f} double" for f in _NAMES))
    return rows.select(*kept, H.text_key().alias("key")).join(found, "key").select(*kept, *_NAMES)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton's method with a small ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRIOR * len(x) * np.eye(len(w)), x.T @ (y - p) - PRIOR * len(x) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from documents outside the held-out fold that `labels` marks with toxic 0 or 1, `per_label` of either at most about.

    Repeated marks count once, 1 before 0. The shared counts are those of all documents: they see texts, no labels.
    """
    marks = labels.where(F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = F.broadcast(labelled_sample(marks, "toxic", per_label))  # twice `per_label` rows at most about
    texts = documents.where((fold() != 0) & F.col("text").isNotNull()).select("doc_id", "text", fold().alias("fold"))
    rows = texts.join(chosen, "doc_id").select("text", "toxic", (F.col("toxic") + 2 * (F.col("fold") == 4).cast("int")).alias("group"))
    grams = cut_lineage(corpus_grams(documents))
    shared = shared_tables(grams)
    counts = cut_lineage(count_grams(rows))
    of = lambda *names: counts.select("gram", *[sum((F.col(n) for n in c[1:]), F.col(c[0])).alias(f"n{i}") for i, c in enumerate(names)])
    apart = Model(of(["a0"], ["a1"]), shared)
    later = cut_lineage(rows.where(F.col("group") >= 2).select("text", "toxic"))  # a part of the sample
    found = _feature_rows(later, apart, "toxic").toArrow()
    model = Model(of(["a0", "b0"], ["a1", "b1"]), shared)
    model.grams = grams
    y = np.asarray(found.column("toxic")).astype(float)
    if len(set(y.tolist())) == 2:
        model.curve = _logistic(np.stack([np.asarray(found.column(f)) for f in _NAMES], axis=1), y)
    return model


def score(documents: DataFrame, model: Model, grams: DataFrame | None = None) -> DataFrame:
    """Score whole texts for toxicity, from nothing but the text.

    `grams`: the different n-grams of `documents` or more, where the caller has them, as `model.grams` for the documents of `fit`;
    otherwise they are extracted.

    `documents` needs `doc_id` and `text`; other columns are ignored. Null and wordless texts have ratios of 0 and the score that goes with
    them; if one of the classes had no text to learn from, every score is 0. Equal texts get equal scores; every row gives a row.

    Returns doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).
    """
    rows = documents.select("doc_id", (fold() == 0).alias("held_out"), "text")
    found = _feature_rows(rows, model, "doc_id", "held_out", grams=grams)
    curve = model.curve
    if curve is None:
        value = F.lit(0.0)
    else:
        value = 1 / (1 + F.exp(-sum((F.lit(float(w)) * F.col(f"f{i}") for i, w in enumerate(curve[1:])), F.lit(float(curve[0])))))
    return found.select("doc_id", "held_out", value.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
