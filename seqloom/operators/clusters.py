"""k-means with very many clusters: a tree of centres.

All rows start in one cell that is owed all the clusters. A cell with more points than one task should work on is split
around a few coarse centres, and its clusters are dealt to the parts by their squared distances; a cell that is owed one
cluster is one. What is left are small cells, and each is clustered by k-means in a task of its own. So a row is compared with a few
centres per level and with those of its own cell, whatever the number of clusters, and no table of all centres exists.

Equal vectors are one point with a weight, so copies of a sequence can never make a cell too large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.session import cut_lineage

CELL_BYTES = 8 << 20  # of vectors that one task clusters
MOST_POINTS = 8192  # in such a cell
FAN = 32  # coarse centres of a cell
SAMPLE = 4096  # points that coarse centres are fitted to; all points are then dealt to them
ROUNDS = 100  # steps of k-means at most
TOLERANCE = 1e-4  # of the mean variance: centres that move less in a step stand still
UNEVEN = 0.9  # a split whose largest part has more of the points has failed
FEW_CELLS = 10_000  # rows of a table of cells that may be broadcast

_POINT = "key string, vec binary, w long, cell long, k int"


# -- k-means within a task


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, squared distance to it) of every row, a block of rows at a time."""
    lengths = np.square(centres).sum(axis=1)
    which, far = np.empty(len(x), np.int64), np.empty(len(x))
    for a in range(0, len(x), 1024):
        block = x[a : a + 1024]
        d = lengths - 2 * block @ centres.T
        which[a : a + 1024] = d.argmin(axis=1)
        far[a : a + 1024] = np.maximum(d.min(axis=1) + np.square(block).sum(axis=1), 0.0)
    return which, far


def _first_centres(x: np.ndarray, w: np.ndarray, k: int, random: np.random.RandomState) -> np.ndarray:
    """Rows drawn by weight and squared distance from those drawn before."""
    chosen = [int(random.choice(len(x), p=w / w.sum()))]
    far = np.square(x - x[chosen[0]]).sum(axis=1)
    for _ in range(1, k):
        far[chosen[-1]] = 0.0
        mass = far * w
        if mass.sum() > 0:
            chosen.append(int(random.choice(len(x), p=mass / mass.sum())))
        else:  # rows that differ by less than rounding
            chosen.append(int(np.setdiff1d(np.arange(len(x)), chosen)[0]))
        far = np.minimum(far, np.square(x - x[chosen[-1]]).sum(axis=1))
    return x[chosen].copy()


def _means(x: np.ndarray, w: np.ndarray, which: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean of every cluster, its weight)."""
    order = np.argsort(which, kind="stable")
    starts = np.searchsorted(which[order], np.arange(k))
    weight = np.bincount(which, w, minlength=k)
    filled = np.flatnonzero(weight > 0)
    sums = np.zeros((k, x.shape[1]))
    sums[filled] = np.add.reduceat(x[order] * w[order, None], starts[filled], axis=0)
    return sums / np.maximum(weight, 1e-300)[:, None], weight


def weighted_kmeans(x: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Cluster of every row of `x`, different rows with weights; none of the min(k, rows) clusters is empty."""
    k = min(k, len(x))
    if k == len(x):
        return np.arange(k)
    if k == 1:
        return np.zeros(len(x), np.int64)
    random = np.random.RandomState(seed % (1 << 32))
    centres = _first_centres(x, w, k, random)
    still = TOLERANCE * np.average(np.square(x - np.average(x, axis=0, weights=w)), axis=0, weights=w).mean()
    for _ in range(ROUNDS):
        which, far = _nearest(x, centres)
        which = _none_empty(which, far, k)
        means, _ = _means(x, w, which, k)
        moved = np.square(means - centres).sum()
        centres = means
        if moved <= still:
            break
    which, far = _nearest(x, centres)
    return _none_empty(which, far, k)


def _none_empty(which: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """An empty cluster takes the row that is farthest from its centre and not alone with it."""
    sizes = np.bincount(which, minlength=k)
    empty = np.flatnonzero(sizes == 0)
    if len(empty):
        which = which.copy()
        farthest = iter(np.argsort(-far, kind="stable"))
        for c in empty:
            row = next(r for r in farthest if sizes[which[r]] > 1)
            sizes[which[row]] -= 1
            which[row], sizes[c] = c, 1
    return which


# -- the tree


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(v, np.float32) for v in column.to_pylist()]).astype(np.float64)


def _by_key(table: pa.Table) -> pa.Table:
    return table.sort_by([("key", "ascending")])


def deal(k: int, spread: np.ndarray, points: np.ndarray) -> np.ndarray:
    """`k` clusters dealt to parts by their squared distances from the centre, which is what clusters are there to lessen.

    A part gets one at least and as many as it has points at most; all are dealt if the points allow.
    """
    out = np.ones(len(points), np.int64)
    left = min(k, int(points.sum())) - len(points)
    spread = spread if spread.sum() > 0 else points.astype(float)
    while left > 0:
        room = points - out
        open_ = np.where(room > 0, spread, 0.0)
        want = np.minimum(np.floor(left * open_ / max(open_.sum(), 1e-300)).astype(np.int64), room)
        if not want.any():
            first = np.argsort(-(open_ / out), kind="stable")
            want[[i for i in first if room[i] > 0][:left]] = 1
        out += want
        left -= int(want.sum())
    return out


def _coarse_centres(sample: DataFrame, fan: int, seed: int) -> DataFrame:
    """`cell, centres`: the centres of each open cell, from its sample."""

    def fit(table):
        table = _by_key(table)
        x, w = _vectors(table.column("vec")), np.asarray(table.column("w")).astype(float)
        k = min(fan, table.column("k")[0].as_py())
        cell = table.column("cell")[0].as_py()
        centres, _ = _means(x, w, weighted_kmeans(x, w, k, seed + cell), min(k, len(x)))
        return pa.table({"cell": pa.array([cell], pa.int64()), "centres": pa.array([centres.astype(np.float32).tobytes()], pa.binary())})

    return sample.groupBy("cell").applyInArrow(fit, "cell long, centres binary")


def _split(points: DataFrame, cell_points: int, fan: int, seed: int, level: int) -> DataFrame:
    """The open cells' points with their part of the cell, `part`.

    A cell is dealt in slices of bounded size, each of which meets the cell's centres.
    """
    slices = F.ceil(F.col("size") / cell_points).cast("int")
    draw = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
    centres = _coarse_centres(points.where(draw < F.lit(float(min(SAMPLE, cell_points))) / F.col("size")), fan, seed + level)
    sliced = points.withColumn("slice", F.pmod(F.xxhash64("key", F.lit(level), F.lit("slice")), slices).cast("int"))
    count = points.groupBy("cell").agg(F.max(slices).alias("slices"))
    meets = centres.join(count, "cell").select("cell", "centres", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def assign(rows, centres):
        if not len(rows):
            return rows.select(names).append_column("part", pa.array([], pa.int32())).append_column("far", pa.array([], pa.float64()))
        rows = _by_key(rows)
        x = _vectors(rows.column("vec"))
        # a cell whose sample came out empty has no centres and is cut by hash below
        part, far = np.zeros(len(rows), np.int64), np.ones(len(rows))
        if len(centres):
            part, far = _nearest(x, np.frombuffer(centres.column("centres")[0].as_py(), np.float32).reshape(-1, x.shape[1]).astype(np.float64))
        far = far * np.asarray(rows.column("w"))
        return rows.select(names).append_column("part", pa.array(part.astype(np.int32))).append_column("far", pa.array(far))

    names = ["key", "vec", "w", "cell", "k"]
    return sliced.groupBy("cell", "slice").cogroup(meets.groupBy("cell", "slice")).applyInArrow(assign, f"{_POINT}, part int, far double")


def _parts_of(split: DataFrame) -> DataFrame:
    """`cell, part, new_cell, new_k, new_size, failed`: a row for every part of a cell, with the clusters it is owed.

    Clusters are numbered: a cell owns `k` numbers from `cell` on, and its parts own runs of them.
    """
    exact = F.sum(F.col("far").cast("decimal(38,3)")).cast("double")  # a sum of doubles would depend on their order
    counted = split.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("points"), exact.alias("spread"), F.max("k").alias("k"))

    def share(table):
        table = table.sort_by([("part", "ascending")])
        points, spread = (np.asarray(table.column(c)) for c in ("points", "spread"))
        k, cell = table.column("k")[0].as_py(), table.column("cell")[0].as_py()
        owed = deal(k, spread, points)
        start = np.cumsum(owed) - owed
        failed = points.max() > UNEVEN * points.sum() and owed[points.argmax()] > 1
        return pa.table({
            "cell": table.column("cell"), "part": table.column("part"), "new_cell": pa.array(cell + start, pa.int64()),
            "new_k": pa.array(owed.astype(np.int32)), "new_size": pa.array(points), "failed": pa.array([bool(failed)] * len(points)),
        })

    return counted.groupBy("cell").applyInArrow(share, "cell long, part int, new_cell long, new_k int, new_size long, failed boolean")


def _moved(split: DataFrame, parts: DataFrame) -> DataFrame:
    """The points in their new cells."""
    few = parts.count() <= FEW_CELLS
    joined = split.join(F.broadcast(parts) if few else parts, ["cell", "part"])
    return joined.select("key", "vec", "w", F.col("new_cell").alias("cell"), F.col("new_k").alias("k"), F.col("new_size").alias("size"))


def tree_clusters(vectors: DataFrame, n_clusters: int, seed: int, cell_points: int | None = None, fan: int = FAN) -> DataFrame:
    """`row_id, cluster` of rows (`row_id`, `vec`: single-precision numbers as bytes, all of one width).

    Clusters are numbered from 0. There are exactly `n_clusters`, or as many as there are different vectors if these are fewer.
    """
    keyed = cut_lineage(vectors.select("row_id", "vec", F.md5("vec").alias("key")))
    points = keyed.groupBy("key").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("w"))
    points = cut_lineage(points.withColumns({"cell": F.lit(0).cast("long"), "k": F.lit(int(n_clusters)).cast("int")}))
    total = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vec")).alias("bytes")).first()
    if not total["n"]:
        return vectors.select("row_id", F.lit(0).alias("cluster"))
    limit = cell_points or max(2 * fan, min(MOST_POINTS, CELL_BYTES // (2 * total["bytes"])))
    current = points.withColumns({"size": F.lit(total["n"]).cast("long"), "k": F.least("k", F.lit(total["n"])).cast("int")})
    small, level = [], 0
    is_open = (F.col("size") > limit) & (F.col("k") > 1)
    while True:
        small.append(current.where(~is_open))
        current = current.where(is_open)
        if not current.limit(1).count():
            break
        level += 1
        split = cut_lineage(_split(current, limit, fan, seed, level))
        parts = cut_lineage(_parts_of(split))
        if parts.where("failed").limit(1).count():  # cells that centres cannot divide are cut by the hash of the vector
            bad = parts.where("failed").select("cell").distinct()
            bad = F.broadcast(bad) if bad.count() <= FEW_CELLS else bad
            by_hash = F.pmod(F.xxhash64("key", F.lit(-level)), F.least(F.lit(fan), F.col("k"))).cast("int")
            cut = split.join(bad.withColumn("cut", F.lit(True)), "cell", "left")
            split = cut_lineage(cut.withColumn("part", F.when(F.col("cut"), by_hash).otherwise(F.col("part"))).drop("cut"))
            parts = cut_lineage(_parts_of(split))
        current = cut_lineage(_moved(split, parts))
    cells = small[0]
    for more in small[1:]:
        cells = cells.unionByName(more)

    def cluster(table):
        table = _by_key(table)
        k, cell = table.column("k")[0].as_py(), table.column("cell")[0].as_py()
        which = weighted_kmeans(_vectors(table.column("vec")), np.asarray(table.column("w")).astype(float), k, seed + cell)
        return pa.table({"key": table.column("key"), "cluster": pa.array((cell + which).astype(np.int32))})

    whole = cells.where("k = 1").select("key", F.col("cell").cast("int").alias("cluster"))
    found = cells.where("k > 1").groupBy("cell").applyInArrow(cluster, "key string, cluster int").unionByName(whole)
    return keyed.select("row_id", "key").join(found, "key").select("row_id", "cluster")
