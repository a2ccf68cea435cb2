"""Whitening of embeddings on their leading principal components (operator 11).

Method: spectrum slicing. The inertia of an LDL' factorisation of the covariance less a shift counts the eigenvalues above
the shift. Bisecting shifts isolate each leading eigenvalue in an interval of its own, Rayleigh quotient iteration
converges there cubically, and two counts around the result certify that it has the number it is given.

Rows are read by tasks that add up integer sums and then the centred products; only sums as large as the
covariance reach the driver, where the eigenvectors are found and broadcast to the tasks that project the rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.spans import tidy
from seqloom.session import cut_lineage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100000
LARGEST = 2.0**50  # entries beyond have no whole number of 64 bits after scaling; they count as not finite
MERGED = 64  # partial matrices that one task adds up in the first of two steps
EPS = np.finfo(float).eps


# -- eigenvectors by counts


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above `shift`: positive pivots of LDL' with symmetric pivoting by blocks of one and two."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        here = abs(a[k, k])
        below = np.abs(a[k + 1 :, k])
        largest = below.max() if len(below) else 0.0
        if max(here, largest) == 0.0:
            k += 1  # a zero eigenvalue of the shifted matrix
            continue
        double = False
        if here < alpha * largest:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0.0
            if here * row.max() < alpha * largest**2:
                double = abs(a[r, r]) < alpha * row.max()
                to = k + 1 if double else k
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if double:
            pivot, c = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            above += int((np.linalg.eigvalsh(pivot) > 0).sum())
            update = c @ np.linalg.solve(pivot, c.T)
            a[k + 2 :, k + 2 :] -= (update + update.T) / 2
            k += 2
        else:
            above += int(a[k, k] > 0)
            column = a[k + 1 :, k].copy()
            a[k + 1 :, k + 1 :] -= np.outer(column, column) / a[k, k]
            k += 1
    return above


def _isolate(matrix, i: int, known: dict[float, int], least: float) -> tuple[float, float]:
    """An interval of the i-th largest eigenvalue alone, or one as narrow as `least`, starting from all the counts known."""
    while True:
        low = max(s for s, n in known.items() if n >= i)
        high = min(s for s, n in known.items() if n < i)
        if known[low] == i and known[high] == i - 1 or high - low <= least:
            return low, high
        middle = (low + high) / 2
        known[middle] = count_above(matrix, middle)


def _quotients(matrix, start: np.ndarray, shift: float, others: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration beside the vectors already found: value, vector, residual."""
    norm = max(np.abs(matrix).sum(axis=1).max(), np.finfo(float).tiny)
    vector, best = start, None
    for step in range(30):
        shifted = matrix - shift * np.eye(len(matrix))
        try:
            vector = np.linalg.solve(shifted, vector)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            vector = np.linalg.solve(shifted + np.eye(len(matrix)) * norm * EPS, vector)
        for _ in range(2):
            vector = vector / np.linalg.norm(vector)
            vector = vector - others.T @ (others @ vector)
        vector = vector / np.linalg.norm(vector)
        value = float(vector @ matrix @ vector)
        residual = float(np.linalg.norm(matrix @ vector - value * vector))
        if best is not None and residual >= best[2] and step > 1:
            break
        best = (value, vector, residual) if best is None or residual < best[2] else best
        shift = value if step else shift  # the first step is inverse iteration at the interval's middle
    return best


def leading_eigenvectors(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` largest eigenvalues, falling, and their unit vectors as rows, of a symmetric matrix.

    Equal eigenvalues have any orthonormal basis of their space. The largest entry of a vector is positive.
    """
    d = len(matrix)
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    bound = float(np.abs(matrix).sum(axis=1).max())
    if bound == 0.0:
        return np.zeros(min(count, d)), np.eye(d)[: min(count, d)]
    least = 4 * d * EPS * bound
    known = {float((np.diag(matrix) - radius).min() - least): d, float((np.diag(matrix) + radius).max() + least): 0}
    random = np.random.RandomState(11)
    values, vectors = [], np.zeros((0, d))
    for i in range(1, min(count, d) + 1):
        low, high = _isolate(matrix, i, known, least)
        while True:
            start = random.standard_normal(d)
            value, vector, residual = _quotients(matrix, start, (low + high) / 2, vectors)
            margin = max(2 * residual, least)
            if low - margin <= value <= high + margin and count_above(matrix, value + margin) < i <= count_above(matrix, value - margin):
                break
            if high - low <= least:
                raise ArithmeticError(f"eigenvalue {i} of {d} cannot be certified")
            middle = (low + high) / 2
            known[middle] = count_above(matrix, middle)
            low, high = (middle, high) if known[middle] >= i else (low, middle)
        values.append(value)
        vectors = np.vstack([vectors, vector * np.sign(vector[np.abs(vector).argmax()])])
    order = np.argsort(-np.array(values), kind="stable")  # equal to rounding: the counts tell no order among them
    return np.array(values)[order], vectors[order]


# -- passes over the rows


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first entry and length of each row, entries as doubles, rows without a null or an entry that is not finite)."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    entries = column.flatten()  # of the rows that are not null
    data = np.asarray(pc.fill_null(entries.cast(pa.float64()), float("nan")))
    starts = np.cumsum(lengths) - lengths
    bad = ~(np.abs(data) <= LARGEST)
    spoilt = np.concatenate([[0], np.cumsum(bad)])
    good = np.asarray(column.is_valid()) & (spoilt[starts + lengths] == spoilt[starts])
    return starts, lengths, data, good


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(usable rows, their entries as scaled whole numbers)."""
    starts, lengths, data, good = _usable(column)
    rows = np.flatnonzero(good & (lengths == width))
    x = np.floor(SCALE * data[starts[rows, None] + np.arange(width)]).astype(np.int64) + SHIFT
    return rows, x


def _sums(vectors: DataFrame, name: str) -> tuple[int, list[int]]:
    """(rows, sum of each dimension) of the commonest width among usable vectors, the larger of two as common."""

    def add(batches):
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            _, lengths, _, good = _usable(batch.column(0))
            for width in np.unique(lengths[good]).tolist():
                rows, x = _numbers(batch.column(0), width)
                safe = x if np.abs(x).max(initial=0) < 2**62 // max(1, len(x)) else x.astype(object)
                n[width] = n.get(width, 0) + len(rows)
                total[width] = total.get(width, np.zeros(width, object)) + safe.sum(axis=0).astype(object)
        rows = [(w, -1, Decimal(n[w])) for w in n] + [(w, j, Decimal(int(s))) for w in n for j, s in enumerate(total[w])]
        width, dim, value = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(width, pa.int32()), pa.array(dim, pa.int32()), pa.array(value, pa.decimal128(38, 0))], names=["width", "dim", "value"])

    partial = vectors.select(name).mapInArrow(tidy(add), "width int, dim int, value decimal(38,0)")
    totals = cut_lineage(partial.groupBy("width", "dim").agg(F.sum("value").cast("decimal(38,0)").alias("value")))
    best = totals.where("dim = -1").orderBy(F.desc("value"), F.desc("width")).first()
    if best is None:
        return 0, []
    rows = totals.where((F.col("width") == best["width"]) & (F.col("dim") >= 0)).orderBy("dim").collect()  # a row per dimension
    return int(best["value"]), [int(r["value"]) for r in rows]


def _added(vectors: DataFrame, name: str, size: int, block) -> np.ndarray:
    """The sum over all rows of `block(column)`'.`block(column)`, size x size, added up in two steps in a fixed order."""

    def partial(batches):
        total = np.zeros((size, size))
        for batch in batches:
            y = block(batch.column(0))
            total += y.T @ y
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array([task] * size, pa.int64()), pa.array(np.arange(size, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["task", "i", "part"]
        )

    def add(table):
        order = np.argsort(np.asarray(table.column("task")), kind="stable")
        rows = np.stack([table.column("part")[int(k)].values.to_numpy() for k in order])
        return pa.table({"task": pa.array([table.column("task")[0].as_py() // MERGED]), "i": pa.array([table.column("i")[0].as_py()], pa.int32()), "part": pa.array([rows.sum(axis=0)], pa.list_(pa.float64()))})

    schema = "task long, i int, part array<double>"
    parts = vectors.select(name).mapInArrow(tidy(partial), schema)
    merged = parts.groupBy((F.col("task") / MERGED).cast("long"), "i").applyInArrow(add, schema).groupBy("i").applyInArrow(add, schema)
    out = np.zeros((size, size))
    for row in merged.collect():  # a row per row of the matrix
        out[row["i"]] = row["part"]
    return out


class Centre:
    """What is known of all usable rows: their number and the sums of their whole numbers."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums, self.width = n, sums, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64) if n else np.zeros(0, np.int64)
        self.rest = np.array([s % n / n for s in sums]) if n else np.zeros(0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Exact sums of (n x - S)^2, null where they do not fit a long."""
        if not len(x):
            return pa.array([], pa.int64())
        reach = float(self.n) * (np.abs(self.centred(x)).max(axis=1) + 1)
        if reach.max() ** 2 * self.width < 2.0**62 and float(self.n) * np.abs(x).max() < 2.0**62 and max(map(abs, self.sums)) < 2**62:
            apart = self.n * x - np.array(self.sums, np.int64)
            return pa.array((apart * apart).sum(axis=1))
        apart = self.n * x.astype(object) - np.array(self.sums, object)
        exact = (apart * apart).sum(axis=1)
        return pa.array([int(e) if e < 2**63 else None for e in exact], pa.int64())


class Whitening:
    """A fitted transform: the components with a positive eigenvalue turn rows into uncorrelated values of unit variance."""

    def __init__(self, centre: Centre, covariance: np.ndarray, components: int):
        self.centre = centre
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = leading_eigenvectors(covariance, components) if centre.width else (np.zeros(0), np.zeros((0, 0)))
        floor = 4 * centre.width * EPS * max(self.trace, 0.0)
        self.positive = self.values > floor
        self.scale = np.where(self.positive, 1 / np.sqrt(np.where(self.positive, self.values, 1.0)), np.nan)
        self.explained = np.where(self.positive, self.values, 0.0) / self.trace if self.trace > 0 else np.full(len(self.values), np.nan)

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows x components; not a number where a component has no variance."""
        return (self.centre.centred(x) @ self.vectors.T) * self.scale


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Fit on every usable row, in two passes: whole-number sums, then centred products."""
    n, sums = _sums(embeddings, vector)
    centre = Centre(n, sums)
    if not n or not centre.width:
        return Whitening(centre, np.zeros((0, 0)), components)
    products = _added(embeddings, vector, centre.width, lambda column: centre.centred(_numbers(column, centre.width)[1]))
    products = (products + products.T) / 2
    return Whitening(centre, products / n, components)


def identity_error(embeddings: DataFrame, fitted: Whitening, vector: str = "embedding") -> float | None:
    """Largest entry of the whitened rows' covariance less the identity, over the components that have variance; measured on all rows."""
    kept = np.flatnonzero(fitted.positive)
    if not len(kept):
        return None
    width = fitted.centre.width

    def block(column):  # a column of ones gives the means
        white = fitted.apply(_numbers(column, width)[1])[:, kept]
        return np.hstack([white, np.ones((len(white), 1))])

    sums = _added(embeddings, vector, len(kept) + 1, block) / fitted.centre.n
    mean = sums[-1, :-1]
    return float(np.abs(sums[:-1, :-1] - np.outer(mean, mean) - np.eye(len(kept))).max())


def whiten(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and leading component: the vector's whitened coordinate, and how good the whitening is.

    An entry c becomes x = floor(1024 c) + 100000. Rows whose vector is null, or holds a null or an entry that is not finite (or beyond
    2^50, which has no whole number), are dropped, and so are those of another width than the commonest one (of two as
    common, the larger), since one covariance has one width. Rows that repeat count each. Where there are fewer dimensions than
    `components`, there are fewer components; empty vectors and empty tables give no rows. A component without variance has
    a null `whitened` and explains 0 (null if nothing varies); a `deviation` beyond 64 bits is null. Other columns are ignored.

    Returns the key, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.
    """
    fitted = fit(embeddings, vector, components)
    error = identity_error(embeddings, fitted, vector)
    id_type = embeddings.schema[key].dataType.simpleString()
    shared = embeddings.sparkSession.sparkContext.broadcast((fitted, error))  # components x width

    def project(batches):
        fitted, error = shared.value
        k, n = len(fitted.values), fitted.centre.n
        for batch in batches:
            rows, x = _numbers(batch.column(1), fitted.centre.width)
            if not k or not len(rows):
                continue
            again = np.repeat(np.arange(len(rows)), k)
            white = fitted.apply(x).ravel()
            explained = np.tile(fitted.explained, len(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[again])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(again), n, np.int64)),
                 fitted.centre.deviations(x).take(pa.array(again)), pa.array(white, mask=np.isnan(white)), pa.array(explained, mask=np.isnan(explained)),
                 pa.array([error] * len(again), pa.float64())],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = f"`{key}` {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return embeddings.select(key, vector).mapInArrow(tidy(project), schema)
