"""Linear probes: split, fit on train, score every split, over many seeds."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.constants import DEFAULT_RATIOS, RIDGE_ALPHAS, RIDGE_FALLBACK_ALPHA, SEEDS
from seqloom.operators import metrics as M
from seqloom.operators.prefix import fill_cuts, shuffle_order
from seqloom.operators.projections import drop_null, validate_splits
from seqloom.operators.splits import get_splits, split_three_way
from seqloom.plans import batched as B
from seqloom.session import cut_lineage

REGRESSIONS = ("regression", "reg_ridge", "reg_lin")
TASKS = (*REGRESSIONS, "classification", "multilabel")

# Rows of a block of ridge in the form for fewer rows than columns.
ROW_BLOCK = 1024

# Training rows per task of a gradient fit.
PART_BYTES = 32 << 20

# Gradient fits stop once a step improves the loss by less than this share.
TOLERANCE = 1e-6


@dataclass(frozen=True)
class FittedProbe:
    """Weights per label. A label that could not be fitted is listed in `skipped`."""

    task: str
    coef: np.ndarray  # labels x width
    intercept: np.ndarray  # labels
    penalty: float | None = None
    skipped: tuple[int, ...] = ()

    def predict(self, df: DataFrame, features: str = "embedding", output: str = "p") -> DataFrame:
        """Adds the prediction: a value, a probability, or an array of probabilities per label."""
        coef, intercept, logistic = self.coef, self.intercept, self.task not in REGRESSIONS
        many = self.task == "multilabel"

        @F.pandas_udf("array<double>" if many else "double")
        def score(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object if many else float)
            z = np.stack(x.to_numpy()).astype(np.float64) @ coef.T + intercept
            out = 1.0 / (1.0 + np.exp(-z)) if logistic else z
            return pd.Series(list(out)) if many else pd.Series(out[:, 0])

        return df.withColumn(output, score(features))

    def save(self, spark: SparkSession, path: str, seed: int) -> None:
        rows = [
            (i, self.coef[i].tolist(), float(self.intercept[i]), self.task, self.penalty, i in self.skipped)
            for i in range(len(self.intercept))
        ]
        schema = "label int, coef array<double>, intercept double, task string, penalty double, skipped boolean"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/seed={seed}")


def fitted_model(spark: SparkSession, path: str, seed: int) -> FittedProbe:
    """The probe saved for one seed."""
    rows = spark.read.parquet(f"{path}/seed={seed}").orderBy("label").collect()  # a row per label
    return FittedProbe(
        rows[0]["task"],
        np.array([r["coef"] for r in rows]),
        np.array([r["intercept"] for r in rows]),
        rows[0]["penalty"],
        tuple(r["label"] for r in rows if r["skipped"]),
    )


def _vectors(train: DataFrame, features: str, y: str) -> DataFrame:
    return train.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(y).cast("double").alias("y"))


# ---- regression --------------------------------------------------------------------------


def _moments(vectors: DataFrame):
    row = vectors.agg(
        vector_to_array(Summarizer.mean(F.col("x"))).alias("mean"),
        F.avg("y").alias("y"),
        F.stddev_samp("y").alias("sd"),
        F.count(F.lit(1)).alias("n"),
    ).first()
    if not row["n"]:
        raise ValueError("no training rows")
    return np.array(row["mean"]), row["y"], row["sd"], row["n"]


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _numbered(train: DataFrame, features: str, y: str) -> DataFrame:
    """`id, x, y`, written once: a row keeps its number in every pass and on every retry."""
    table = train.select(F.monotonically_increasing_id().alias("id"), F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    return cut_lineage(table)


def centred_products(table: DataFrame, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, y, X X') of the centred rows, where rows are fewer than columns.

    Rows are cut into blocks by id; every pair of blocks is multiplied in a task of its own.
    """
    ids, y = (np.asarray(c) for c in table.select("id", "y").orderBy("id").toArrow().columns)  # fewer rows than a row has numbers
    blocks = -(-len(ids) // ROW_BLOCK)
    edges = ids[::ROW_BLOCK]
    block = sum((F.when(F.col("id") >= int(e), 1).otherwise(0) for e in edges[1:]), F.lit(0))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b")))
    spread_out = table.withColumn("block", block).select("id", "block", "x", F.explode(pairs).alias("pair")).select("id", "block", "x", "pair.a", "pair.b")

    def multiply(key, rows):
        a, b = key[0].as_py(), key[1].as_py()
        of, at = np.asarray(rows.column("block")), np.asarray(rows.column("id"))
        x = _stack(rows.column("x").combine_chunks()) - mean
        left, right = np.flatnonzero(of == a), np.flatnonzero(of == b)
        product = x[left] @ x[right].T
        ends = np.arange(len(left) + 1, dtype=np.int32) * len(right)
        return pa.table({
            "id": pa.array(at[left]), "other": pa.array([at[right].tolist()] * len(left), pa.list_(pa.int64())),
            "product": pa.ListArray.from_arrays(pa.array(ends), pa.array(product.ravel())),
        })

    out = np.zeros((len(ids), len(ids)))
    for row in spread_out.groupBy("a", "b").applyInArrow(multiply, "id long, other array<long>, product array<double>").toLocalIterator():
        i, j = np.searchsorted(ids, row["id"]), np.searchsorted(ids, row["other"])
        out[i, j] = out[j, i] = row["product"]
    return ids, y, out


def probe_ridge_cv(
    train: DataFrame, features: str = "embedding", y: str = "target", alphas: Sequence[float] = RIDGE_ALPHAS
) -> FittedProbe:
    """Ridge with the penalty of the smallest leave-one-out error, exact for every penalty at once and at any width.

    The smaller of rows and columns decides the form; the driver holds its square. With fewer columns, the products of columns are
    summed over the rows, and a second pass gets every row's left-out error from the eigenvectors; tasks hold strips of
    bounded size of both (`batched`). With fewer rows, the products of rows have all that is needed, and a second pass turns their
    weights into coefficients.
    """
    grid = np.array(alphas, dtype=np.float64)
    size = train.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("width")).first()
    if not size["n"]:
        raise ValueError("no training rows")
    if size["width"] <= size["n"]:
        blocks = B.pack_blocks(_one_seed(train, features, F.array(F.col(y).cast("double"))), 1, 1)
        try:
            ((coef, intercept, best),) = B.ridge_fits(blocks, grid)
        finally:
            blocks.release()
        return FittedProbe("reg_ridge", coef[None, :], np.array([intercept]), best)
    table = _numbered(train, features, y)
    mean, y_mean, _, n = _moments(_vectors(table, "x", "y"))
    coef, best = _ridge_by_rows(table, mean, y_mean, n, grid)
    return FittedProbe("reg_ridge", coef[None, :], np.array([y_mean - coef @ mean]), float(grid[best]))


def _one_seed(train: DataFrame, features: str, labels) -> DataFrame:
    """Training rows as `batched` takes them."""
    return train.select(_numbers(train, features).alias("x"), labels.alias("y"), F.array(F.lit(B.TRAIN).cast("tinyint")).alias("marks"))


def _numbers(df: DataFrame, features: str):
    single = df.schema[features].dataType.simpleString() == "array<float>"
    return F.col(features) if single else F.col(features).cast("array<double>")


def _ridge_by_rows(table: DataFrame, mean: np.ndarray, y_mean: float, n: int, grid: np.ndarray) -> tuple[np.ndarray, int]:
    ids, y, products = centred_products(table, mean)
    values, basis = np.linalg.eigh(products)
    values = np.maximum(values, 0.0)
    turned = basis.T @ (y - y_mean)
    errors, weights = [], []
    for alpha in grid:
        weight = basis @ (turned / (values + alpha))
        # residual over 1 - leverage, the intercept taking 1/n of every row
        residual = (y - y_mean) - products @ weight
        leverage = (np.square(basis) * (values / (values + alpha))).sum(axis=1) + 1.0 / n
        # rows that the fit reaches whole have no left-out error but in the limit
        errors.append(np.square(residual / np.maximum(1.0 - leverage, 1e-12)).sum())
        weights.append(weight)
    best = int(np.argmin(errors))
    shared = table.sparkSession.sparkContext.broadcast((ids, weights[best]))

    def weighted(batches):
        ids, weight = shared.value
        total = np.zeros(len(mean))
        for batch in batches:
            if len(batch):
                total += weight[np.searchsorted(ids, np.asarray(batch.column(0)))] @ (_stack(batch.column(1)) - mean)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = table.mapInArrow(weighted, "part array<double>")
    coef = np.array(parts.agg(vector_to_array(Summarizer.sum(array_to_vector("part"))).alias("coef")).first()["coef"])
    return coef, best


def _from_spark(model, task: str, penalty: float | None = None) -> FittedProbe:
    return FittedProbe(task, np.array([model.coefficients.toArray()]), np.array([model.intercept]), penalty)


def probe_ridge_fallback(
    train: DataFrame, features: str = "embedding", y: str = "target", alpha: float = RIDGE_FALLBACK_ALPHA
) -> FittedProbe:
    """Ridge with one fixed penalty by gradient steps, for data whose eigenvalues do not converge.

    The optimiser works on labels divided by their sample deviation, hence the factor.
    """
    vectors = _vectors(train, features, y)
    _, _, sd, n = _moments(vectors)
    model = LinearRegression(
        featuresCol="x", labelCol="y", regParam=alpha * (sd or 0.0) / n, standardization=False,
        solver="l-bfgs", maxIter=1000, tol=1e-10,
    ).fit(vectors)
    return _from_spark(model, "reg_ridge", alpha)


def probe_linear(train: DataFrame, features: str = "embedding", y: str = "target") -> FittedProbe:
    """Ordinary least squares."""
    model = LinearRegression(featuresCol="x", labelCol="y", regParam=0.0, tol=1e-10, maxIter=1000).fit(
        _vectors(train, features, y)
    )
    return _from_spark(model, "reg_lin")


# ---- classification ----------------------------------------------------------------------


def _packed(vectors: DataFrame, rows: int, width: int) -> DataFrame:
    """Fewer, fuller partitions where there is little data: every step of a fit is a job over all of them."""
    return vectors.coalesce(max(1, -(-rows * width * 8 // PART_BYTES)))


def _logistic(vectors: DataFrame, rows: int):
    """L2 logistic regression with unit inverse penalty, that is 1/rows on the mean loss."""
    return LogisticRegression(
        featuresCol="x", labelCol="y", regParam=1.0 / rows, standardization=False, maxIter=5000, tol=TOLERANCE
    ).fit(vectors)


def probe_logistic(train: DataFrame, features: str = "embedding", y: str = "target") -> FittedProbe:
    row = train.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("pos"), F.max(F.size(features)).alias("width")
    ).first()
    n = row["n"]
    if not n or row["pos"] in (0.0, float(n)):
        raise ValueError("classification needs both classes in the training rows")
    vectors = _packed(_vectors(train, features, y), n, row["width"]).persist()
    try:
        return _from_spark(_logistic(vectors, n), "classification")
    finally:
        vectors.unpersist()


def probe_multilabel(train: DataFrame, features: str = "embedding", y: str = "target") -> FittedProbe:
    """One logistic regression per label, all of them fitted by the same passes; labels with one class are skipped."""
    labels = train.agg(F.max(F.size(y)).alias("labels")).first()["labels"]
    if labels is None:
        raise ValueError("no training rows")
    blocks = B.pack_blocks(_one_seed(train, features, F.col(y).cast("array<double>")), labels, 1)
    try:
        fit = B.logistic_fits(blocks)
    finally:
        blocks.release()
    if fit.skipped.all():
        raise ValueError("no label has both classes in the training rows")
    return FittedProbe("multilabel", fit.coef[0], fit.intercept[0], skipped=tuple(np.flatnonzero(fit.skipped[0]).tolist()))


def fit_probe(train: DataFrame, task: str, features: str = "embedding", y: str = "target") -> FittedProbe:
    if task in ("regression", "reg_ridge"):
        try:
            return probe_ridge_cv(train, features, y)
        except np.linalg.LinAlgError as e:  # the eigenvalues did not converge; the result's penalty tells
            warnings.warn(f"ridge with a single penalty instead: {e}")
            return probe_ridge_fallback(train, features, y)
    if task == "reg_lin":
        return probe_linear(train, features, y)
    if task == "classification":
        return probe_logistic(train, features, y)
    if task == "multilabel":
        return probe_multilabel(train, features, y)
    raise ValueError(f"invalid task: {task}")


# ---- scoring and runs --------------------------------------------------------------------


def evaluate_probe(predicted: DataFrame, task: str, y: str = "target", skipped: Sequence[int] = ()) -> DataFrame:
    """`split, metric, value` rows of predictions `p` against labels `y`."""
    by = ["split"]
    if task not in TASKS:
        raise ValueError(f"invalid task: {task}")
    if task in REGRESSIONS:
        wide = M.eval_regression(predicted.select("split", "p", F.col(y).cast("double").alias("y")), "p", "y", by)
    elif task == "classification":
        wide = M.eval_classification(predicted.select("split", "p", F.col(y).cast("int").alias("y")), "p", "y", by)
    else:
        def fitted(column):
            kept = F.filter(F.col(column), lambda _, i: ~i.isin(*skipped)) if skipped else F.col(column)
            return kept.alias("y" if column == y else column)

        wide = M.metric_micro(predicted.select("split", fitted("p"), fitted(y)), "p", "y", by)
    return M.long_metrics(wide, by)


# What a splitter reads beside `row_id`.
KEYS = {"default": (), "homology": ("gene",), "chromosome": ("chromosome",), "kmer": ("sequence",), "hard-kmer": ("sequence",)}


def split_keys(data: DataFrame, split_type: str, splitter: Callable | None, but: Sequence[str]) -> DataFrame:
    """The columns that a splitter declares; all columns but `but` for one that was passed in."""
    if splitter is None and split_type in KEYS:
        return data.select("row_id", *KEYS[split_type])
    return data.drop(*but)


def run_probe(
    data: DataFrame,
    task: str,
    target: str = "target",
    features: str = "embedding",
    split_type: str = "default",
    ratios: Sequence[float] = DEFAULT_RATIOS,
    seed: int = SEEDS[0],
    eval_all_splits: bool = True,
    dropna: bool = True,
    splitter: Callable[..., DataFrame] | None = None,
    save_to: str | None = None,
    **split_options,
) -> tuple[FittedProbe, DataFrame]:
    """Drop rows without a target, split, fit, score. Returns the probe and its metric rows.

    `split_type` names a catalogue entry; `splitter` passes a function instead. Metrics are
    `seed, split, metric, value`, for all splits or for validation alone.
    """
    if task not in TASKS:
        raise ValueError(f"invalid task: {task}")
    if target not in data.columns:
        raise ValueError(f"target column not found: {target}")
    kept = drop_null(data, target) if dropna else data
    # the splitters pass over these few columns several times, the vectors are read once
    keys = split_keys(kept, split_type, splitter, (features, target)).persist()
    if splitter is None:
        placed = get_splits(keys, split_type, ratios, seed, **split_options)
    else:
        placed = split_three_way(splitter, keys, ratios, seed, **split_options)
    frame = (
        kept.select("row_id", F.col(features).alias("embedding"), F.col(target).alias("target"))
        .join(placed.select("row_id", "split"), "row_id")
        .persist()
    )
    try:
        validate_splits(frame, "target", "embedding", ("train",) if eval_all_splits else ("train", "val"))
        probe = fit_probe(frame.filter("split = 'train'"), task)
        scored = frame if eval_all_splits else frame.filter("split = 'val'")
        rows = evaluate_probe(probe.predict(scored), task, skipped=probe.skipped).collect()  # splits x metrics
    finally:
        frame.unpersist()
        keys.unpersist()
    spark = data.sparkSession
    if save_to:
        probe.save(spark, save_to, seed)
    records = [(seed, r["split"], r["metric"], r["value"]) for r in rows]
    return probe, spark.createDataFrame(records, "seed int, split string, metric string, value double")


def run_multi_seed(
    data: DataFrame,
    task: str,
    seeds: Sequence[int] = SEEDS,
    target: str = "target",
    features: str = "embedding",
    split_type: str = "default",
    ratios: Sequence[float] = DEFAULT_RATIOS,
    eval_all_splits: bool = True,
    dropna: bool = True,
    splitter: Callable[..., DataFrame] | None = None,
    save_to: str | None = None,
    **split_options,
) -> DataFrame:
    """Metric rows of one probe per seed, as `run_probe` gives them, from vectors that are read once.

    Each row gets its split under every seed beside its vector. The passes of a fit serve all seeds; where ridge has fewer
    training rows than columns, its products of rows are made seed by seed from the rows kept.
    """
    if task not in TASKS:
        raise ValueError(f"invalid task: {task}")
    if target not in data.columns:
        raise ValueError(f"target column not found: {target}")
    seeds = list(seeds)
    kept = drop_null(data, target) if dropna else data
    keys = split_keys(kept, split_type, splitter, (features, target)).persist()
    try:
        marks = seed_marks(keys, seeds, split_type, ratios, splitter, **split_options)
        labels = kept.agg(F.max(F.size(target))).first()[0] if task == "multilabel" else 1
        if labels is None:
            raise ValueError("no splits provided")
        y = F.col(target).cast("array<double>") if task == "multilabel" else F.array(F.col(target).cast("double"))
        rows = kept.select("row_id", _numbers(kept, features).alias("x"), y.alias("y")).join(marks, "row_id")
        blocks = B.pack_blocks(rows, labels, len(seeds))
    finally:
        keys.unpersist()
    try:
        counts = B.rows_per_split(blocks)
        for name in ("train",) if eval_all_splits else ("train", "val"):
            if not counts[:, B.SPLITS.index(name)].all():
                raise ValueError(f"split {name} is empty")
        probes = _fit_seeds(blocks, task, int(counts[:, B.TRAIN].min()))
        used = np.array([[i not in p.skipped for i in range(labels)] for p in probes])
        coef, intercept = np.array([p.coef for p in probes]), np.array([p.intercept for p in probes])
        splits = B.SPLITS if eval_all_splits else ("val",)
        scored = cut_lineage(B.predictions(blocks, coef, intercept, task not in REGRESSIONS, used, splits))  # read once per metric
    finally:
        blocks.release()
    by = ["seed", "split"]
    if task in REGRESSIONS:
        wide = M.eval_regression(scored, "p", "y", by)
    else:
        wide = M.eval_classification(scored.withColumn("y", F.col("y").cast("int")), "p", "y", by)
    found = M.long_metrics(wide, by).collect()  # seeds x splits x metrics
    spark = data.sparkSession
    if save_to:
        for seed, probe in zip(seeds, probes):
            probe.save(spark, save_to, seed)
    records = [(seeds[r["seed"]], r["split"], r["metric"], r["value"]) for r in found]
    return spark.createDataFrame(records, "seed int, split string, metric string, value double")


def seed_marks(keys: DataFrame, seeds: Sequence[int], split_type: str, ratios, splitter, **options) -> DataFrame:
    """`row_id, marks`: for every seed the number of the split that a row is in, -1 for none."""
    if splitter is None and split_type == "default" and not options:
        return keys.select("row_id", random_marks(keys, seeds, ratios).alias("marks"))
    every = None
    for i, seed in enumerate(seeds):
        if splitter is None:
            placed = get_splits(keys, split_type, ratios, seed, **options)
        else:
            placed = split_three_way(splitter, keys, ratios, seed, **options)
        number = F.array_position(F.array(*[F.lit(s) for s in B.SPLITS]), F.col("split")) - 1
        one = placed.select("row_id", F.lit(i).alias("i"), number.cast("tinyint").alias("mark"))
        every = one if every is None else every.unionByName(one)
    mark = lambda i: F.coalesce(F.max(F.when(F.col("i") == i, F.col("mark"))), F.lit(-1).cast("tinyint"))
    return every.groupBy("row_id").agg(F.array(*[mark(i) for i in range(len(seeds))]).alias("marks"))


def random_marks(keys: DataFrame, seeds: Sequence[int], ratios):
    """The marks of `split_three_way(split_random, ..)` under every seed, as a column.

    Both splits of a seed cut one order of the rows, so a row's marks follow from two cuts per seed, and these are found for all seeds at once.
    """
    train, val, test = ratios = tuple(ratios or DEFAULT_RATIOS)
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    held = val + test
    each = keys.select(F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"), "row_id")
    ordered = each.select("seed", shuffle_order("row_id", F.col("seed")).alias("order"), F.lit(1).alias("one"))

    def cuts(rows: DataFrame, share: float) -> dict[int, str]:
        found = fill_cuts(rows, "order", "one", lambda n: F.ceil(n * share), ["seed"])
        return {r["seed"]: r["cut"] for r in found.collect()}  # a row per seed

    first = cuts(ordered, held) if train and held else {}
    second = {}
    if val and test:
        below = ordered if not train else ordered.where(_at_most(F.col("order"), F.col("seed"), first))
        second = cuts(below, test / held)

    def mark(seed: int):
        order = shuffle_order("row_id", seed)
        rest = F.lit(1 if test == 0 else 2)
        if val and test:
            rest = F.when(order <= second[seed], 2).otherwise(1) if seed in second else F.lit(1)
        if train == 0:
            return rest
        return F.when(order <= first[seed], rest).otherwise(B.TRAIN) if seed in first else F.lit(B.TRAIN)

    return F.array(*[mark(s).cast("tinyint") for s in seeds])


def _at_most(order, seed, cuts: dict[int, str]):
    inside = F.lit(False)
    for s, cut in cuts.items():
        inside = inside | ((seed == s) & (order <= cut))
    return inside


def _fit_seeds(blocks: B.Blocks, task: str, least_rows: int) -> list[FittedProbe]:
    if task == "reg_lin":
        return [FittedProbe(task, coef[None, :], np.array([b])) for coef, b in B.linear_fits(blocks)]
    if task in REGRESSIONS and blocks.width <= least_rows:
        try:
            return [FittedProbe("reg_ridge", coef[None, :], np.array([b]), a) for coef, b, a in B.ridge_fits(blocks, np.array(RIDGE_ALPHAS, dtype=np.float64))]
        except np.linalg.LinAlgError as e:
            warnings.warn(f"ridge seed by seed instead: {e}")
    if task in REGRESSIONS:
        return [fit_probe(B.train_rows(blocks, s), task) for s in range(blocks.seeds)]
    fit = B.logistic_fits(blocks)
    if task == "classification":
        if fit.skipped.any():
            raise ValueError("classification needs both classes in the training rows")
        return [FittedProbe(task, fit.coef[s], fit.intercept[s]) for s in range(blocks.seeds)]
    if fit.skipped.all(axis=1).any():
        raise ValueError("no label has both classes in the training rows")
    return [FittedProbe(task, fit.coef[s], fit.intercept[s], skipped=tuple(np.flatnonzero(fit.skipped[s]).tolist())) for s in range(blocks.seeds)]
