"""Many probes from one scan: several seeds, several labels, over vectors that are read and packed once.

Rows become blocks of bytes, each with the vectors of some rows, their labels and, for every seed, the split that a row is in.
A pass over the blocks adds something up for all models at once: moments, products of columns, left-out errors, or the
losses and gradients of every logistic model at its own next point. How many passes there are does not depend on the
number of seeds or labels.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from seqloom.session import cut_lineage

SPLITS = ("train", "val", "test")
TRAIN = 0
BLOCK_BYTES = 4 << 20  # vectors of a block
HELD_BYTES = 128 << 20  # sums that a task holds, and numbers that are broadcast, in one pass
ROWS_PER_COLUMN = 8  # rows of a task that adds up products of columns, per column: what is shuffled is an eighth of the data

# of the gradient methods
MEMORY = 10
PASSES = 1000
FLAT = 1e-9  # largest partial derivative of the mean loss at which a fit is done


@dataclass
class Blocks:
    """`frame` has x, y and marks as bytes; x is rows x width, y rows x labels, marks rows x seeds."""

    frame: DataFrame
    kind: str
    labels: int
    seeds: int
    width: int
    n: int

    def release(self) -> None:
        self.frame.unpersist()


def pack_blocks(rows: DataFrame, labels: int, seeds: int) -> Blocks:
    """Blocks of `x array<float or double>, y array<double>, marks array<tinyint>`; written once, as passes and retries read it again.

    A missing vector or label, a null within one, and vectors of different widths are an error.
    """
    kind = "<f4" if rows.schema["x"].dataType.simpleString() == "array<float>" else "<f8"

    def pack(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, y, marks = (batch.column(c) for c in range(3))
            if x.null_count or y.null_count or x.flatten().null_count or y.flatten().null_count:
                yield from failed("a split lacks features or labels")
                return
            widths = np.unique(np.diff(np.asarray(x.offsets)))
            if len(widths) != 1:
                yield from failed(f"vectors of different widths: {widths.tolist()[:5]}")
                return
            x = np.ascontiguousarray(x.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1), kind)
            y = np.asarray(y.flatten(), np.float64).reshape(len(batch), labels)
            marks = np.asarray(marks.flatten(), np.int8).reshape(len(batch), seeds)
            step = max(1, BLOCK_BYTES // max(1, x[:1].nbytes))
            for a in range(0, len(x), step):
                cut = [v[a : a + step] for v in (x, y, marks)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v.tobytes()], pa.binary()) for v in cut), pa.array([len(cut[0])], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.nulls(1, pa.string())],
                    names=["x", "y", "marks", "rows", "width", "failure"],
                )

    def failed(why):
        nothing = [pa.nulls(1, t) for t in (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([why])], names=["x", "y", "marks", "rows", "width", "failure"])

    frame = rows.select("x", "y", "marks").mapInArrow(pack, "x binary, y binary, marks binary, rows int, width int, failure string")
    frame = cut_lineage(frame)
    seen = frame.agg(F.min("width").alias("low"), F.max("width").alias("high"), F.sum("rows").alias("n"), F.max("failure").alias("failure")).first()
    if seen["failure"]:
        raise ValueError(seen["failure"])
    if not seen["n"]:
        raise ValueError("no training rows")
    if seen["low"] != seen["high"]:
        raise ValueError(f"vectors of different widths: {seen['low']} and {seen['high']}")
    return Blocks(frame.select("x", "y", "marks").persist(), kind, labels, seeds, seen["high"], seen["n"])


def each_block(batches, blocks: tuple):
    """(x, y, marks) of every block of a task."""
    kind, labels, seeds, width = blocks
    for batch in batches:
        for i in range(len(batch)):
            x, y, marks = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in enumerate((kind, np.float64, np.int8)))
            yield x.reshape(-1, width).astype(np.float64), y.reshape(-1, labels), marks.reshape(-1, seeds)


def _shape(blocks: Blocks) -> tuple:
    return blocks.kind, blocks.labels, blocks.seeds, blocks.width


def _matrix_rows(first: int, sums: np.ndarray):
    """A matrix as rows (key, part), some at a time."""
    step = max(1, (1 << 22) // max(1, sums.shape[1]))
    for a in range(0, len(sums), step):
        part = sums[a : a + step]
        ends = np.arange(len(part) + 1, dtype=np.int32) * sums.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(first + a, first + a + len(part))), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(part).ravel()))], names=["key", "part"]
        )


def add_up(blocks: Blocks, shape: tuple[int, int], add: Callable, shared=None, first: int = 0, tasks: int | None = None) -> DataFrame:
    """Rows (key, part) of the sum over all blocks of what `add(total, x, y, marks, shared)` adds to a matrix of `shape`.

    Tasks hold one matrix each and Spark adds up equal rows.
    """
    known = _shape(blocks)
    sent = blocks.frame.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        total, value = np.zeros(shape), sent.value
        for x, y, marks in each_block(batches, known):
            add(total, x, y, marks, value)
        yield from _matrix_rows(first, total)

    frame = blocks.frame.select("x", "y", "marks")
    parts = (frame.coalesce(tasks) if tasks else frame).mapInArrow(run, "key long, part array<double>")
    return parts.groupBy("key").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))


def _collected(sums: DataFrame, shape: tuple[int, int], first: int = 0) -> np.ndarray:
    out = np.zeros(shape)
    for row in sums.collect():  # as many rows as the matrix of a pass has
        out[row["key"] - first] = row["part"]
    return out


def rows_per_split(blocks: Blocks) -> np.ndarray:
    """seeds x splits."""

    def add(total, x, y, marks, _):
        for i in range(len(SPLITS)):
            total[:, i] += (marks == i).sum(axis=0)

    shape = (blocks.seeds, len(SPLITS))
    return _collected(add_up(blocks, shape, add), shape)


# ---- ridge and least squares -------------------------------------------------------------


@dataclass
class Moments:
    n: np.ndarray  # seeds
    x: np.ndarray  # seeds x width, means
    y: np.ndarray  # seeds, means of the only label


def train_moments(blocks: Blocks) -> Moments:
    """Rows and means of every seed's training rows."""

    def add(total, x, y, marks, _):
        train = (marks == TRAIN).astype(np.float64)
        total[:, 0] += train.sum(axis=0)
        total[:, 1] += train.T @ y[:, 0]
        total[:, 2:] += train.T @ x

    shape = (blocks.seeds, 2 + blocks.width)
    sums = _collected(add_up(blocks, shape, add), shape)
    n = sums[:, 0]
    if not n.all():
        raise ValueError("train is empty")
    return Moments(n, sums[:, 2:] / n[:, None], sums[:, 1] / n)


def strips(width: int, each: int) -> list[tuple[int, int]]:
    """Ranges of columns that together have at most `HELD_BYTES` of sums, each column having `each` numbers."""
    step = max(1, HELD_BYTES // (8 * each))
    return [(a, min(a + step, width)) for a in range(0, width, step)]


def centred_products(blocks: Blocks, moments: Moments) -> np.ndarray:
    """Per seed X'X and X'y of its centred training rows: seeds x width x (width + 1).

    The matrices are added up in strips of rows that a task can hold, each strip of all seeds in one pass.
    """
    width, seeds = blocks.width, blocks.seeds
    out = np.zeros((seeds, width, width + 1))
    tasks = max(1, blocks.n // (ROWS_PER_COLUMN * width))
    for a, b in strips(width, seeds * (width + 1)):
        shape = (seeds * (b - a), width + 1)

        def add(total, x, y, marks, shared, a=a, b=b):
            means, y_means = shared
            for s in range(seeds):
                rows = np.flatnonzero(marks[:, s] == TRAIN)
                centred = x[rows] - means[s]
                into = total[s * (b - a) : (s + 1) * (b - a)]
                into[:, :width] += centred[:, a:b].T @ centred
                into[:, width] += centred[:, a:b].T @ (y[rows, 0] - y_means[s])

        sums = add_up(blocks, shape, add, (moments.x, moments.y), tasks=tasks)
        out[:, a:b] = _collected(sums, shape).reshape(seeds, b - a, width + 1)
    return out


def left_out_errors(blocks: Blocks, moments: Moments, bases: np.ndarray, shrinks: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Sums of squared leave-one-out errors: seeds x penalties.

    `bases`: per seed the eigenvectors; `shrinks`: per seed and penalty 1 / (eigenvalue + penalty); `turned`: the basis' products
    with X'y. A row's fit and leverage are sums over eigenvectors. If the eigenvectors are more than may be broadcast, they
    come in strips, one pass each, and the fits and leverages of a row meet by its number.
    """
    seeds, width = blocks.seeds, blocks.width
    penalties = shrinks.shape[1]
    weights = shrinks * turned[:, None, :]

    def parts(x, s, value):
        basis, shrink, weight, means, _, _ = value
        z = (x - means[s]) @ basis[s]
        return z @ weight[s].T, np.square(z) @ shrink[s].T

    def error(fit, leverage, y, n):
        return (y[:, None] - fit) / np.maximum(1.0 - 1.0 / n - leverage, 1e-12)

    ranges = strips(width, seeds * width)
    if len(ranges) == 1:

        def add(total, x, y, marks, value):
            for s in range(seeds):
                rows = np.flatnonzero(marks[:, s] == TRAIN)
                fit, leverage = parts(x[rows], s, value)
                total[s] += np.square(error(fit, leverage, y[rows, 0] - value[4][s], value[5][s])).sum(axis=0)

        shape = (seeds, penalties)
        return _collected(add_up(blocks, shape, add, (bases, shrinks, weights, moments.x, moments.y, moments.n)), shape)

    numbered = cut_lineage(blocks.frame.select("x", "y", "marks", F.monotonically_increasing_id().alias("block")))
    known, context, found = _shape(blocks), blocks.frame.sparkSession.sparkContext, None
    for a, b in ranges:
        sent = context.broadcast((bases[:, :, a:b], shrinks[:, :, a:b], weights[:, :, a:b], moments.x, None, None))

        def run(batches, sent=sent):
            for batch in batches:
                for i, (x, _, marks) in enumerate(each_block([batch], known)):
                    for s in range(seeds):
                        rows = np.flatnonzero(marks[:, s] == TRAIN)
                        both = np.hstack(parts(x[rows], s, sent.value))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([batch.column(3)[i].as_py()] * len(rows), pa.int64()), pa.array(rows), pa.array([s] * len(rows), pa.int32()), pa.array(list(both), pa.list_(pa.float64()))],
                            names=["block", "row", "seed", "part"],
                        )

        strip = cut_lineage(numbered.mapInArrow(run, "block long, row long, seed int, part array<double>"))
        sent.unpersist()
        found = strip if found is None else found.unionByName(strip)

    def labels(batches):
        for batch in batches:
            for i, (_, y, _) in enumerate(each_block([batch], known)):
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(3)[i].as_py()] * len(y), pa.int64()), pa.array(np.arange(len(y))), pa.array(y[:, 0])], names=["block", "row", "y"])

    whole = found.groupBy("block", "row", "seed").agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("part"))
    placed = whole.join(numbered.mapInArrow(labels, "block long, row long, y double"), ["block", "row"])
    means, n = (F.array(*[F.lit(float(v)) for v in of]) for of in (moments.y, moments.n))
    at = lambda c, i: F.element_at(c, i + 1)
    terms = [
        F.sum(F.pow((F.col("y") - at(means, F.col("seed")) - at(F.col("part"), F.lit(p))) / F.greatest(1 - 1 / at(n, F.col("seed")) - at(F.col("part"), F.lit(penalties + p)), F.lit(1e-12)), F.lit(2))).alias(f"e{p}")
        for p in range(penalties)
    ]
    out = np.zeros((seeds, penalties))
    for row in placed.groupBy("seed").agg(*terms).collect():  # a row per seed
        out[row["seed"]] = [row[f"e{p}"] for p in range(penalties)]
    return out


def ridge_fits(blocks: Blocks, penalties: np.ndarray) -> list[tuple[np.ndarray, float, float]]:
    """(weights, intercept, penalty) per seed, the penalty having the smallest leave-one-out error of all."""
    moments = train_moments(blocks)
    products = centred_products(blocks, moments)
    width = blocks.width
    bases, values = np.zeros((blocks.seeds, width, width)), np.zeros((blocks.seeds, width))
    for s in range(blocks.seeds):
        values[s], bases[s] = np.linalg.eigh(products[s, :, :width])
    turned = np.einsum("sij,si->sj", bases, products[:, :, width])
    del products
    shrinks = 1.0 / (np.maximum(values, 0.0)[:, None, :] + penalties[None, :, None])
    errors = left_out_errors(blocks, moments, bases, shrinks, turned)
    out = []
    for s in range(blocks.seeds):
        best = int(np.argmin(errors[s]))
        coef = bases[s] @ (shrinks[s, best] * turned[s])
        out.append((coef, float(moments.y[s] - coef @ moments.x[s]), float(penalties[best])))
    return out


def linear_fits(blocks: Blocks) -> list[tuple[np.ndarray, float]]:
    """(weights, intercept) of least squares per seed; the shortest weights where there is a choice."""
    moments = train_moments(blocks)
    products = centred_products(blocks, moments)
    out = []
    for s in range(blocks.seeds):
        coef = np.linalg.pinv(products[s, :, : blocks.width], rcond=1e-13, hermitian=True) @ products[s, :, blocks.width]
        out.append((coef, float(moments.y[s] - coef @ moments.x[s])))
    return out


# ---- logistic models ---------------------------------------------------------------------


class _Descent:
    """One model's limited-memory quasi-Newton search: it names a point, is told the loss and gradient there, and goes on."""

    def __init__(self, size: int):
        self.at, self.point = np.zeros(size), np.zeros(size)
        self.loss, self.gradient, self.done = np.inf, None, False
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []

    def told(self, loss: float, gradient: np.ndarray) -> None:
        if self.gradient is not None:
            if not loss <= self.loss + 1e-4 * self.length * self.slope:
                self.length /= 2
                if self.length < 1e-12:  # rounding hides any further descent
                    self.point, self.done = self.at, True
                else:
                    self.point = self.at + self.length * self.way
                return
            step, change = self.point - self.at, gradient - self.gradient
            if step @ change > 1e-14 * (change @ change):
                self.steps = [*self.steps, (step, change)][-MEMORY:]
        self.at, self.loss, self.gradient = self.point, loss, gradient
        if np.abs(gradient).max() <= FLAT:
            self.done = True
            return
        self.way = -self._turned(gradient)
        self.slope = float(gradient @ self.way)
        if self.slope >= 0:
            self.steps, self.way = [], -gradient
            self.slope = float(gradient @ self.way)
        self.length = 1.0 if self.steps else min(1.0, 1.0 / np.abs(gradient).sum())
        self.point = self.at + self.length * self.way

    def _turned(self, q: np.ndarray) -> np.ndarray:
        q, shares = q.copy(), []
        for s, c in reversed(self.steps):
            share = (s @ q) / (s @ c)
            q -= share * c
            shares.append(share)
        if self.steps:
            s, c = self.steps[-1]
            q *= (s @ c) / (c @ c)
        for (s, c), share in zip(self.steps, reversed(shares)):
            q += (share - (c @ q) / (s @ c)) * s
        return q


@dataclass
class Logistic:
    coef: np.ndarray  # seeds x labels x width
    intercept: np.ndarray  # seeds x labels
    skipped: np.ndarray  # seeds x labels: one class only among the training rows
    passes: int


def logistic_fits(blocks: Blocks) -> Logistic:
    """L2-penalised logistic models with unit inverse penalty, one for each seed and label.

    All searches go on at once: a pass gives every unfinished one the loss and gradient at its own point. Columns are scaled
    by their deviation over all rows, which changes the path but not the minimum.
    """
    seeds, labels, width = blocks.seeds, blocks.labels, blocks.width

    def add_moments(total, x, y, marks, _):
        total[0, 0] += len(x)
        total[0, 1:] += x.sum(axis=0)

    def add_squares(total, x, y, marks, mean):
        total[0, 1:] += np.square(x - mean).sum(axis=0)

    def add_classes(total, x, y, marks, _):
        train = (marks == TRAIN).astype(np.float64)
        total[:, 0] += train.sum(axis=0)
        total[:, 1:] += train.T @ y

    shape = (1, 1 + width)
    sums = _collected(add_up(blocks, shape, add_moments), shape)[0]
    mean = sums[1:] / sums[0]
    scale = np.sqrt(_collected(add_up(blocks, shape, add_squares, mean), shape)[0, 1:] / sums[0])
    scale[scale == 0] = 1.0
    shape = (seeds, 1 + labels)
    classes = _collected(add_up(blocks, shape, add_classes), shape)
    n, positive = classes[:, 0], classes[:, 1:]
    if not n.all():
        raise ValueError("train is empty")
    skipped = (positive == 0) | (positive == n[:, None])

    def add(total, x, y, marks, value):
        points, of = value
        x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        seed, label = np.divmod(of, labels)
        train = marks[:, seed] == TRAIN
        z, y = x @ points.T, y[:, label]
        total[:, 0] += np.where(train, np.logaddexp(0.0, z) - y * z, 0.0).sum(axis=0)
        total[:, 1:] += np.where(train, 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - y, 0.0).T @ x

    searches = {s * labels + i: _Descent(width + 1) for s in range(seeds) for i in range(labels) if not skipped[s, i]}
    passes = 0
    while passes < PASSES:
        going = [m for m, search in searches.items() if not search.done]
        if not going:
            break
        passes += 1
        points = np.array([searches[m].point for m in going])
        shape = (len(going), 2 + width)
        sums = _collected(add_up(blocks, shape, add, (points, np.array(going))), shape)
        for row, m, point in zip(sums, going, points):
            rows = n[m // labels]
            weights = point[:width] / scale
            loss = (row[0] + 0.5 * weights @ weights) / rows
            gradient = row[1:] / rows
            gradient[:width] += weights / scale / rows
            searches[m].told(loss, gradient)
    coef, intercept = np.zeros((seeds, labels, width)), np.zeros((seeds, labels))
    for m, search in searches.items():
        s, i = divmod(m, labels)
        coef[s, i] = search.at[:width] / scale
        intercept[s, i] = search.at[width] - coef[s, i] @ mean
    return Logistic(coef, intercept, skipped, passes)


# ---- predictions -------------------------------------------------------------------------


def predictions(blocks: Blocks, coef: np.ndarray, intercept: np.ndarray, logistic: bool, used: np.ndarray, splits: Sequence[str]) -> DataFrame:
    """`seed, split, p, y` for every row, seed and used label; `seed` counts from 0."""
    seeds, labels, width = coef.shape
    known = _shape(blocks)
    wanted = [SPLITS.index(s) for s in splits]
    sent = blocks.frame.sparkSession.sparkContext.broadcast((coef, intercept))

    def run(batches):
        coef, intercept = sent.value
        for x, y, marks in each_block(batches, known):
            for s in range(seeds):
                rows = np.flatnonzero(np.isin(marks[:, s], wanted))
                label = np.flatnonzero(used[s])
                z = x[rows] @ coef[s, label].T + intercept[s, label]
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) if logistic else z
                again = np.repeat(rows, len(label))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s] * len(again), pa.int32()), pa.array(np.asarray(SPLITS)[marks[again, s]].tolist(), pa.string()), pa.array(p.ravel()), pa.array(y[np.ix_(rows, label)].ravel())],
                    names=["seed", "split", "p", "y"],
                )

    return blocks.frame.select("x", "y", "marks").mapInArrow(run, "seed int, split string, p double, y double")


def train_rows(blocks: Blocks, seed: int) -> DataFrame:
    """`embedding, target` of the training rows of a seed, the target being the first label."""
    known = _shape(blocks)

    def run(batches):
        for x, y, marks in each_block(batches, known):
            rows = np.flatnonzero(marks[:, seed] == TRAIN)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(list(x[rows]), pa.list_(pa.float64())), pa.array(y[rows, 0])], names=["embedding", "target"])

    return blocks.frame.mapInArrow(run, "embedding array<double>, target double")
