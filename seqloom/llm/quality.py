"""Quality rules as a learned decision list (operator 5).

Method: sequential covering. From labelled statistics, a rule for bad texts is grown threshold by threshold on two thirds of
the texts it may still cover, by information gain, then pruned on the other third; texts it covers are set aside and the next
rule is grown. The list is emitted as ordered Spark conditions over the statistics.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm import spans as S
from seqloom.llm.samples import labelled_sample

#: Labelled rows of either quality to learn from.
PER_LABEL = 10_000
SHINGLE = 5
SYMBOLS = b"#*$%&|<>"
CUTS = 64  # thresholds tried per statistic, at quantiles
MOST_RULES, MOST_CONDITIONS = 12, 4
SURE = 0.9  # share of bad texts that a pruned rule must reach
LEAST = 3  # bad texts that a rule must cover
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_chars", "n_letters", "longest_word")


def _row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(hashes: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes every row has, and which of the values occur again in their row."""
    key = S.mix(hashes + S.mix(row.astype(np.uint64)))
    _, at, code, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return np.bincount(row[at], minlength=rows), times[code] > 1


def _statistics(column):
    """The `COUNTS` of every text of a column."""
    out = np.zeros((len(column), len(COUNTS)), dtype=np.int64)
    symbol = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
    letter = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for b in range(256)])  # lead bytes beyond ASCII count once
    for first, last, text, offsets in S.chunks(column):
        n = last - first
        starts, ends, bounds = S.words(text, offsets, S.NON_SPACE)
        sums = S.prefix_sums(text)
        row = S.owners(bounds)
        inside = S.NON_SPACE[text]
        point = (text & 0xC0) != 0x80
        hashes = S.span_hashes(sums, starts, ends)
        # lines end at a line feed or with the text
        breaks = np.union1d(np.flatnonzero(text == 10), offsets[1:] - 1) if len(text) else np.zeros(0, np.int64)
        breaks = breaks[breaks >= 0]
        feed = text[breaks] == 10 if len(breaks) else np.zeros(0, bool)
        from_ = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else breaks
        to = np.where(feed, breaks, breaks + 1)
        filled = np.concatenate([[0], np.cumsum(inside)])
        full = filled[to] > filled[from_]
        from_, to = from_[full], to[full]
        of = np.searchsorted(offsets, from_, side="right") - 1
        lines, _ = _distinct(S.span_hashes(sums, from_, to), of, n)
        n_lines = np.bincount(of, minlength=n)
        # words in windows that occur again
        key = S.windows(hashes, SHINGLE)
        whole = row[: len(key)] == row[SHINGLE - 1 :] if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        _, again = _distinct(key[at], row[at], n)
        steps = np.zeros(len(starts) + 1, dtype=np.int64)
        np.add.at(steps, at[again], 1)
        np.add.at(steps, at[again] + SHINGLE, -1)
        repeated = np.cumsum(steps[:-1]) > 0
        characters = np.diff(np.concatenate([[0], np.cumsum(inside & point)])[np.stack([starts, ends])], axis=0)[0] if len(starts) else np.zeros(0, np.int64)
        longest = np.zeros(n, dtype=np.int64)
        has = np.flatnonzero(np.diff(bounds))
        if len(has):
            longest[has] = np.maximum.reduceat(characters, bounds[:-1][has])
        out[first:last] = np.stack([
            np.diff(bounds), _row_sums(inside & point, offsets), _row_sums(symbol[text], offsets), n_lines - lines,
            np.bincount(row, repeated, n).astype(np.int64), _distinct(hashes, row, n)[0], n_lines,
            _row_sums(point, offsets), _row_sums(letter[text], offsets), longest,
        ], axis=1)
    return out


def statistics(documents: DataFrame, *kept: str) -> DataFrame:
    """`COUNTS` of whole texts, beside the columns `kept`."""
    types = dict(documents.dtypes)

    def count(batches):
        for batch in batches:
            found = _statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(kept))), *(pa.array(c) for c in found.T)], names=[*kept, *COUNTS])

    return documents.select("text", *kept).mapInArrow(S.tidy(count), ", ".join([f"{k} {types[k]}" for k in kept] + [f"{c} long" for c in COUNTS]))


#: Statistics that rules may use: a quotient of two counts, or one count (over 1).
RATIOS = {
    "words": ("n_words", None), "word length": ("word_chars", "n_words"), "symbols per word": ("n_symbols", "n_words"),
    "repeated lines": ("n_dup_lines", "n_lines"), "repeated words": ("n_repeat_words", "n_words"), "different words": ("n_distinct_words", "n_words"),
    "words per line": ("n_words", "n_lines"), "letters": ("n_letters", "n_chars"), "longest word": ("longest_word", None),
}


class Condition(NamedTuple):
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, list(RATIOS).index(self.statistic)]
        return value >= self.threshold if self.at_least else value < self.threshold

    def column(self) -> Column:
        over, under = RATIOS[self.statistic]
        value = F.col(over).cast("double") / (F.greatest(F.col(under), F.lit(1)) if under else F.lit(1))
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)


def _ratios(counts: np.ndarray) -> np.ndarray:
    of = lambda name: counts[:, COUNTS.index(name)].astype(float)
    return np.stack([of(a) / (np.maximum(of(b), 1) if b else 1.0) for a, b in RATIOS.values()], axis=1)


def _holds(rule, x):
    out = np.ones(len(x), dtype=bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Add the threshold with the largest information gain until only bad texts are covered."""
    rule, covered = [], np.ones(len(x), dtype=bool)
    while len(rule) < MOST_CONDITIONS and (~bad[covered]).any():
        p0, n0 = bad[covered].sum(), covered.sum()
        best = (0.0, None)
        for i, name in enumerate(RATIOS):
            values = x[covered, i]
            for threshold in np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1])):
                for at_least in (True, False):
                    some = values >= threshold if at_least else values < threshold
                    p, n = bad[covered][some].sum(), some.sum()
                    if p >= LEAST and n < n0:
                        gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                        if gain > best[0]:
                            best = (gain, Condition(name, at_least, float(threshold)))
        if best[1] is None:
            break
        rule.append(best[1])
        covered &= best[1].holds(x)
    return rule


def learn_rules(counts: np.ndarray, bad: np.ndarray, seed: int = 5) -> list[list[Condition]]:
    """An ordered list of rules; a text that one of them covers is bad, any other is good."""
    x, bad, rules = _ratios(counts), bad.astype(bool), []
    test = np.random.RandomState(seed).rand(len(x)) < 1 / 3
    while len(rules) < MOST_RULES and bad[~test].sum() >= LEAST:
        rule = _grow(x[~test], bad[~test])
        worth = []
        for length in range(1, len(rule) + 1):
            hit = _holds(rule[:length], x[test])
            p = bad[test][hit].sum()
            worth.append((2 * p - hit.sum()) / max(1, hit.sum()))
        rule = rule[: int(np.argmax(worth)) + 1] if rule else []
        hit = _holds(rule, x) if rule else np.zeros(len(x), bool)
        if bad[hit].sum() < LEAST or bad[hit].mean() < SURE:
            break
        rules.append(rule)
        x, bad, test = x[~hit], bad[~hit], test[~hit]
    return rules


def fit(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> list[list[Condition]]:
    """Learn from the texts that `labels` marks with quality 0 or 1; repeated marks count once, 0 before 1."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = F.broadcast(labelled_sample(marks, "quality", per_label))  # twice `per_label` rows at most about
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id")
    found = statistics(rows, "doc_id", "quality").toArrow().sort_by("doc_id")
    counts = np.stack([np.asarray(found.column(c)) for c in COUNTS], axis=1).reshape(-1, len(COUNTS))
    return learn_rules(counts, np.asarray(found.column("quality")) == 0)


def apply_rules(documents: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Statistics of whole texts and the verdict of the base rules and of the list.

    `documents` needs `doc_id` and `text`; other columns are ignored. Null text has no words and fails the base rules, as any text of fewer
    than 10 words; equal texts get equal verdicts; every row gives a row; an empty table gives none. Without rules all
    texts pass that the base rules pass.

    Returns doc_id, `COUNTS`, base_failed, kept, rule (the number of the rule that rejected the text, from 0, else null).
    """
    rule = F.lit(None).cast("int")
    for i, conditions in reversed(list(enumerate(rules))):
        every = conditions[0].column()
        for condition in conditions[1:]:
            every = every & condition.column()
        rule = F.when(every, F.lit(i)).otherwise(rule)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    found = statistics(documents, "doc_id").withColumn("base_failed", failed).withColumn("rule", rule)
    return found.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
