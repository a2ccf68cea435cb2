import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.plans import batched as B, probe as P


def frame(spark, x, y, kind="double"):
    to = (lambda v: [int(e) for e in v]) if kind.startswith("array") else (int if kind == "int" else float)
    rows = [(i, a.tolist(), to(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"row_id long, embedding array<float>, target {kind}").repartition(4)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(80, 5)) + 3).astype(np.float32).astype(float)
    return x, x @ [1.0, -2, 0, 0.5, 3] + rng.normal(size=80) * 4


def ridge(x, y, a):
    xc, yc = x - x.mean(axis=0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + a * np.eye(x.shape[1]), xc.T @ yc)
    return w, y.mean() - w @ x.mean(axis=0)


def test_ridge_is_leave_one_out(spark, data):
    x, y = data
    alphas = (1e-3, 0.1, 1.0, 10.0, 40.0)
    errors = []
    for a in alphas:
        left = []
        for i in range(len(y)):
            w, b = ridge(np.delete(x, i, 0), np.delete(y, i), a)
            left.append((y[i] - x[i] @ w - b) ** 2)
        errors.append(np.mean(left))
    best = alphas[int(np.argmin(errors))]
    probe = P.probe_ridge_cv(frame(spark, x, y), alphas=alphas)
    w, b = ridge(x, y, best)
    assert probe.penalty == best
    np.testing.assert_allclose(probe.coef[0], w, rtol=1e-9)
    assert probe.intercept[0] == pytest.approx(b)


def test_ridge_fallback_and_ols(spark, data):
    x, y = data
    np.testing.assert_allclose(P.probe_ridge_fallback(frame(spark, x, y), alpha=5.0).coef[0], ridge(x, y, 5.0)[0], rtol=1e-5)
    np.testing.assert_allclose(P.probe_linear(frame(spark, x, y)).coef[0], ridge(x, y, 0.0)[0], rtol=1e-7)


def left_out(x, y, alphas):
    """Leave-one-out errors of ridge with an intercept, through the products of rows: any width."""
    errors = []
    for a in alphas:
        total = 0.0
        for i in range(len(y)):
            xt, yt = np.delete(x, i, 0), np.delete(y, i)
            xc = xt - xt.mean(axis=0)
            w = xc.T @ np.linalg.solve(xc @ xc.T + a * np.eye(len(yt)), yt - yt.mean())
            total += (y[i] - yt.mean() - (x[i] - xt.mean(axis=0)) @ w) ** 2
        errors.append(total)
    return errors


@pytest.mark.parametrize("width,block", [(60, 1024), (60, 7), (9000, 16)])
def test_ridge_with_more_columns_than_rows(spark, monkeypatch, width, block):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, width)).astype(np.float32).astype(float)
    y = x[:, :5].sum(axis=1) + rng.normal(size=40)
    alphas = (0.1, 10.0, 1000.0, 20000.0)
    monkeypatch.setattr(P, "ROW_BLOCK", block)
    probe = P.probe_ridge_cv(frame(spark, x, y), alphas=alphas)
    best = alphas[int(np.argmin(left_out(x, y, alphas)))]
    assert probe.penalty == best
    xc = x - x.mean(axis=0)
    w = xc.T @ np.linalg.solve(xc @ xc.T + best * np.eye(40), y - y.mean())
    np.testing.assert_allclose(probe.coef[0], w, rtol=1e-6, atol=1e-10)
    assert probe.intercept[0] == pytest.approx(y.mean() - w @ x.mean(axis=0))


def newton(x, y):
    z = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(z.shape[1]), np.eye(z.shape[1])
    pen[0, 0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (p - y) + pen @ w)
    return w


def test_logistic(spark, data):
    x, y = data
    flag = (y > np.median(y)).astype(int)
    probe = P.probe_logistic(frame(spark, x, flag, "int"))
    w = newton(x, flag)
    np.testing.assert_allclose([probe.intercept[0], *probe.coef[0]], w, atol=2e-4)
    with pytest.raises(ValueError, match="both classes"):
        P.probe_logistic(frame(spark, x, np.ones(80), "int"))


def test_multilabel_skips_constant_labels(spark, data):
    x, y = data
    labels = np.column_stack([y > np.median(y), np.zeros(80), x[:, 0] > 3]).astype(int)
    df = frame(spark, x, labels, "array<int>")
    probe = P.probe_multilabel(df)
    assert probe.skipped == (1,)
    for i in (0, 2):
        np.testing.assert_allclose(probe.coef[i], newton(x, labels[:, i])[1:], atol=5e-4)
    scored = probe.predict(df).withColumn("split", F.lit("test"))
    got = {r.metric: r.value for r in P.evaluate_probe(scored, "multilabel", skipped=probe.skipped).collect()}
    assert set(got) == {"auroc", "auprc"} and 0.5 < got["auroc"] <= 1


def keyed(df):
    return df.withColumns({"gene": F.concat(F.lit("g"), (F.col("row_id") % 20).cast("string")), "chromosome": (F.col("row_id") % 8).cast("string")})


@pytest.mark.parametrize("split", ["default", "chromosome"])
def test_run_probe(spark, data, split, tmp_path):
    x, y = data
    df = keyed(frame(spark, x, y)).withColumn("target", F.when(F.col("row_id") % 10 == 0, float("nan")).otherwise(F.col("target")))
    probe, rows = P.run_probe(df, "reg_ridge", split_type=split, seed=413, save_to=str(tmp_path / "m"))
    got = {(r.split, r.metric): r.value for r in rows.collect()}
    assert set(got) == {(s, m) for s in ("train", "val", "test") for m in ("mse", "r", "p")}
    assert got["train", "r"] > 0.4
    again = P.fitted_model(spark, str(tmp_path / "m"), 413)
    np.testing.assert_array_equal(again.coef, probe.coef)
    assert again.task == "reg_ridge" and again.penalty == probe.penalty


def test_homology_probe_and_val_only(spark, data):
    x, y = data
    df = keyed(frame(spark, x, (y > 0).astype(int), "int"))
    homology = spark.createDataFrame([(f"g{i}", i // 2, i) for i in range(20)], "gene_name string, gene_group long, ordinal long")
    _, rows = P.run_probe(df, "classification", split_type="homology", homology=homology, eval_all_splits=False)
    assert {r.split for r in rows.collect()} == {"val"}
    with pytest.raises(ValueError, match="val is empty"):
        P.run_probe(df, "classification", ratios=(0.8, 0, 0.2), eval_all_splits=False)
    with pytest.raises(ValueError, match="invalid task"):
        P.run_probe(df, "clustering")
    with pytest.raises(ValueError, match="target column"):
        P.run_probe(df, "reg_lin", target="nope")


def with_marks(df, seeds):
    return df.select(F.col("embedding").alias("x"), F.array(F.col("target").cast("double")).alias("y"), F.array(*[((F.col("row_id") * (7 + s)) % 3 % 2).cast("tinyint") for s in range(seeds)]).alias("marks"))


@pytest.mark.parametrize("held", [B.HELD_BYTES, 700])
def test_ridge_in_strips(spark, monkeypatch, held):
    """Several seeds at once, whole or in strips of a few columns, beside single fits on their rows."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(120, 11)) + 2).astype(np.float32).astype(float)
    y = x @ rng.normal(size=11) + rng.normal(size=120) * 3
    monkeypatch.setattr(B, "HELD_BYTES", held)
    blocks = B.pack_blocks(with_marks(frame(spark, x, y), 3), 1, 3)
    assert len(B.strips(11, 3 * 12)) == (1 if held > 700 else 6)
    alphas = np.array([0.01, 1.0, 30.0, 300.0])
    fits = B.ridge_fits(blocks, alphas)
    linear = B.linear_fits(blocks)
    blocks.release()
    for s in range(3):
        train = np.flatnonzero((np.arange(120) * (7 + s)) % 3 % 2 == 0)
        errors = left_out(x[train], y[train], alphas)
        w, b = ridge(x[train], y[train], alphas[int(np.argmin(errors))])
        np.testing.assert_allclose(fits[s][0], w, rtol=1e-8)
        assert fits[s][1:] == (pytest.approx(b), alphas[int(np.argmin(errors))])
        np.testing.assert_allclose(linear[s][0], ridge(x[train], y[train], 0.0)[0], rtol=1e-7)


def test_logistic_models_share_their_passes(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 4)) * [1, 10, 0.1, 3] + [0, 50, 0, 0]
    labels = (x[:, [i % 4 for i in range(9)]] + rng.normal(size=(200, 9)) > np.median(x, axis=0)[[i % 4 for i in range(9)]]).astype(int)
    labels[:, 4] = 1
    x = x.astype(np.float32).astype(float)
    fits = {}
    for n in (2, 9):
        df = frame(spark, x, labels[:, :n], "array<int>").select(
            F.col("embedding").alias("x"), F.col("target").cast("array<double>").alias("y"), F.array(F.lit(0).cast("tinyint"), (F.col("row_id") % 2).cast("tinyint")).alias("marks"))
        blocks = B.pack_blocks(df, n, 2)
        fits[n] = B.logistic_fits(blocks)
        blocks.release()
    assert fits[9].passes < 1.5 * fits[2].passes
    assert fits[9].skipped.tolist() == [[i == 4 for i in range(9)]] * 2
    for s, rows in ((0, slice(None)), (1, slice(0, None, 2))):
        for i in set(range(9)) - {4}:
            want = newton(x[rows], labels[rows, i])
            np.testing.assert_allclose([fits[9].intercept[s, i], *fits[9].coef[s, i]], want, atol=1e-5)


@pytest.mark.parametrize("task", ["reg_ridge", "reg_lin", "classification", "multilabel"])
def test_seeds_together_and_one_by_one(spark, data, task):
    x, y = data
    labels, kind = {"classification": ((y > np.median(y)).astype(int), "int"),
                    "multilabel": (np.column_stack([y > np.median(y), np.zeros(80), x[:, 0] > 3]).astype(int), "array<int>")}.get(task, (y, "double"))
    read = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<float>")
    def counted(v: pd.Series) -> pd.Series:
        read.add(len(v))
        return v

    df = frame(spark, x, labels, kind)
    seen = df.withColumn("embedding", counted("embedding"))
    got = {(r.seed, r.split, r.metric): r.value for r in P.run_multi_seed(seen, task, (2541, 413, 5), ratios=(0.6, 0.2, 0.2)).collect()}
    assert read.value == 80
    one = {}
    for seed in (2541, 413, 5):
        one |= {(r.seed, r.split, r.metric): r.value for r in P.run_probe(df, task, seed=seed, ratios=(0.6, 0.2, 0.2))[1].collect()}
    assert got == pytest.approx(one, abs=1e-4 if task == "classification" else 1e-7) and len(got) == 3 * 3 * (3 if task.startswith("reg") else 2)


def test_seeds_with_fewer_rows_than_columns_and_bad_rows(spark):
    rng = np.random.default_rng(12)
    x, y = rng.normal(size=(30, 50)), rng.normal(size=30)
    df = frame(spark, x, y)
    got = {(r.seed, r.split, r.metric): r.value for r in P.run_multi_seed(df, "reg_ridge", (1, 2)).collect()}
    one = {(r.seed, r.split, r.metric): r.value for s in (1, 2) for r in P.run_probe(df, "reg_ridge", seed=s)[1].collect()}
    assert got == pytest.approx(one)
    with pytest.raises(ValueError, match="lacks features"):
        P.run_multi_seed(df.withColumn("embedding", F.when(F.col("row_id") > 2, F.col("embedding"))), "reg_lin", (1,))
    with pytest.raises(ValueError, match="different widths"):
        P.run_multi_seed(df.withColumn("embedding", F.when(F.col("row_id") > 2, F.col("embedding")).otherwise(F.slice("embedding", 1, 3))), "reg_lin", (1,))
    with pytest.raises(ValueError, match="val is empty"):
        P.run_multi_seed(df, "reg_lin", (1,), ratios=(0.8, 0, 0.2), eval_all_splits=False)


def test_a_split_reads_what_its_splitter_declares(spark, data):
    df = keyed(frame(spark, *data)).withColumn("sequence", F.lit("ACGT"))
    assert P.split_keys(df, "homology", None, ()).columns == ["row_id", "gene"]
    assert P.split_keys(df, "kmer", None, ()).columns == ["row_id", "sequence"]
    assert P.split_keys(df, "default", lambda *a: None, ("embedding", "target")).columns == ["row_id", "gene", "chromosome", "sequence"]


@pytest.mark.parametrize("ratios", [(0.7, 0.15, 0.15), (0.8, 0, 0.2), (0.8, 0.2, 0), (0, 0.5, 0.5), (1, 0, 0), (0.99, 0.005, 0.005)])
def test_marks_of_all_seeds_are_the_splits_of_each(spark, ratios):
    from seqloom.operators import splits as X

    keys = spark.range(97).withColumnRenamed("id", "row_id")
    seeds = (2541, 3, 411)
    got = {r.row_id: r.marks for r in P.seed_marks(keys, seeds, "default", ratios, None).collect()}
    for i, seed in enumerate(seeds):
        want = {r.row_id: B.SPLITS.index(r.split) for r in X.split_three_way(X.split_random, keys, ratios, seed).collect()}
        assert {k: v[i] for k, v in got.items()} == want
