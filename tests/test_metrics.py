import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import joins as J, metrics as M, windows as W
from seqloom.operators.prefix import running_totals


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def auroc(p, y):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def auprc(p, y):
    out, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        at = p >= t
        recall = y[at].sum() / y.sum()
        out, last = out + (recall - last) * y[at].mean(), recall
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 400), ("b", 60)):  # a third of group a shares one score
        p = np.where(rng.random(n) < 0.33, 0.5, np.round(rng.random(n), 2))
        y = (rng.random(n) < p).astype(int)
        t = p * 3 + rng.integers(0, 4, n)
        rows += [(g, float(a), int(b), float(c)) for a, b, c in zip(p, y, t)]
    return spark.createDataFrame(rows, "g string, p double, y int, t double").repartition(6).cache()


def numpy_of(scored, g):
    rows = scored.filter(F.col("g") == g).collect()
    return tuple(np.array([r[c] for r in rows]) for c in "pyt")


def test_classification(scored):
    got = {r.g: r for r in M.eval_classification(scored, "p", "y", ["g"]).collect()}
    for g in "ab":
        p, y, _ = numpy_of(scored, g)
        assert got[g].auroc == pytest.approx(auroc(p, y), abs=1e-12)
        assert got[g].auprc == pytest.approx(auprc(p, y), abs=1e-12)


def test_regression(scored):
    got = {r.g: r for r in M.eval_regression(scored, "p", "t", ["g"]).collect()}
    for g in "ab":
        p, _, t = numpy_of(scored, g)
        assert got[g].mse == pytest.approx(np.mean((p - t) ** 2))
        assert got[g].r == pytest.approx(np.corrcoef(p, t)[0, 1])
        assert got[g].p == pytest.approx(np.corrcoef(ranks(p), ranks(t))[0, 1])


def test_without_groups(scored):
    rows = scored.filter("g = 'a'").drop("g")
    p, y, t = numpy_of(scored, "a")
    got = M.eval_classification(rows, "p", "y").first()
    assert (got.auroc, got.auprc) == pytest.approx((auroc(p, y), auprc(p, y)))
    assert M.eval_regression(rows, "p", "t").first().p == pytest.approx(np.corrcoef(ranks(p), ranks(t))[0, 1])


def test_running_totals_in_many_parts(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v), int(rng.integers(1, 9))) for k in "xy" for v in rng.permutation(500)]
    df = spark.createDataFrame(rows, "k string, v double, n long")
    for parts in (1, 7, 64):
        out = {(r.k, r.v): r for r in running_totals(df, "v", ["n"], ["k"], parts).collect()}
        for k in "xy":
            total = 0
            for _, v, n in sorted(r for r in rows if r[0] == k):
                assert out[k, v].n_before == total
                total += n
            assert out[k, 0.0].n_total == total
    assert len(out) == 1000


def test_ranks(scored):
    got = W.average_rank(scored, "t", ["g"]).filter("g = 'b'").collect()
    assert sorted(r["rank"] for r in got) == pytest.approx(sorted(ranks([r.t for r in got])))


def test_micro(spark):
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random((50, 4)), 1), rng.integers(0, 2, (50, 4))
    df = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(p, y)], "p array<double>, y array<int>")
    got = M.metric_micro(df, "p", "y").first()
    assert (got.auroc, got.auprc) == pytest.approx((auroc(p.ravel(), y.ravel()), auprc(p.ravel(), y.ravel())))


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.7, 0)], "p double, y int")
    assert M.metric_auroc(df, "p", "y").first().auroc is None


@pytest.mark.parametrize(
    "t, df, p",
    [
        (12.706204736, 1, 0.05), (2.228138852, 10, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0), (2.0, 2, 0.183503419),
        (1.959963985, 1e7, 0.05), (3.290526731, 1e9, 0.001), (31.59905458, 2, 0.001),
    ],
)
def test_student(one, t, df, p):
    assert one("t double, df double", (float(t), float(df)), M.student_two_sided(F.col("t"), F.col("df")))[0] == pytest.approx(p, rel=2e-6)


def test_student_in_closed_form(spark):
    rows = [(float(t), float(df)) for t in (1e-9, 1e-3, 0.1, 0.7, 1.0, 2.5, 8.0, 1e3, 1e9) for df in (1, 2, 4)] + [(-2.5, 4.0)]
    known = {
        1: lambda t: 2 / math.pi * math.atan2(1, t), 2: lambda t: 2 / (math.sqrt(2 + t * t) * (math.sqrt(2 + t * t) + t)),
        4: lambda t: 1 - (s := t / math.sqrt(4 + t * t)) * (1.5 - 0.5 * s * s),
    }
    got = spark.createDataFrame(rows, "t double, df double").withColumn("p", M.student_two_sided(F.col("t"), F.col("df"))).collect()
    for r in got:
        assert r.p == pytest.approx(known[int(r.df)](abs(r.t)), rel=1e-11, abs=1e-15)
    odd = [(float("nan"), 3.0), (None, 3.0), (2.0, None), (2.0, float("inf")), (2.0, 0.5), (1e200, 3.0)]
    got = spark.createDataFrame(odd, "t double, df double").select(M.student_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in got] == [None] * 5 + [0.0]


def test_welch_and_adjustment(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(rng.normal(m, s))) for g, m, s, n in (("a", 0, 1, 40), ("b", 0.2, 2, 30), ("c", 3, 1, 20)) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, v double")
    pairs = J.group_pairs(M.group_moments(df, "g", "v"), "g", ["n", "mean", "var"])
    tests = M.welch_t(pairs)
    out = {(r.g_a, r.g_b): r for r in W.bh_adjust(tests, "p_value").collect()}
    assert set(out) == {("a", "b"), ("a", "c"), ("b", "c")}
    a, b = (np.array([v for g, v in rows if g == k]) for k in "ab")
    va, vb = a.var(ddof=1) / len(a), b.var(ddof=1) / len(b)
    assert out["a", "b"].t == pytest.approx((a.mean() - b.mean()) / np.sqrt(va + vb))
    assert out["a", "b"].df == pytest.approx((va + vb) ** 2 / (va**2 / 39 + vb**2 / 29))
    p = sorted(r.p_value for r in out.values())
    want = [min(min(p[j] * 3 / (j + 1) for j in range(i, 3)), 1) for i in range(3)]
    assert sorted(r.adj_p for r in out.values()) == pytest.approx(want)
    significant = W.bh_adjust(tests, "p_value", alpha=0.05).collect()
    assert [(r.g_a, r.g_b) for r in significant] and all(r.adj_p <= 0.05 for r in significant)


def test_constant_and_single_rows_give_null(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 1.0, 3.0), ("one", 4.0, 5.0), ("ok", 1.0, 2.0), ("ok", 2.0, 4.0), ("ok", 3.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, p double, y double")
    got = {r.g: r for r in M.eval_regression(df, "p", "y", ["g"]).collect()}
    assert got["flat"].r is None and got["flat"].p is None and got["flat"].mse == 2.5
    assert got["one"].r is None and got["one"].p is None
    assert got["ok"].p == pytest.approx(1.0) and got["ok"].r == pytest.approx(0.9819805)


def test_welch_of_constant_groups_is_null(spark):
    pairs = spark.createDataFrame([(1.0, 0.0, 5, 2.0, 0.0, 5)], "mean_a double, var_a double, n_a long, mean_b double, var_b double, n_b long")
    row = M.welch_t(pairs).first()
    assert row.t is None and row.df is None and (row.p_value is None or row.p_value != row.p_value)


def adjusted(p):
    p = np.asarray(p, float)
    order = np.argsort(p, kind="stable")
    q = p[order] * len(p) / np.arange(1, len(p) + 1)
    out = np.empty(len(p))
    out[order] = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    return out


@pytest.mark.parametrize("rows_in_part", [1, 7, 1 << 18])
def test_adjusting_families_over_many_parts(spark, monkeypatch, rows_in_part):
    from seqloom.operators import prefix

    monkeypatch.setattr(prefix, "PART_ROWS", rows_in_part)
    rng = np.random.default_rng(4)
    sizes = {"a": 90, "b": 1, None: 25, "c": 4}
    rows = [(f, i, float(v)) for f, n in sizes.items() for i, v in enumerate(np.round(rng.random(n) ** 3, 2))]
    rows += [("a", 1000 + i, 1.0) for i in range(40)] + [("a", 2000, None)]
    got = W.bh_adjust(spark.createDataFrame(rows, "family string, id int, p double"), "p", ["family"]).collect()
    assert len(got) == len(rows) and [r.adj_p for r in got if r.p is None] == [None]
    for f in sizes:
        mine = [(i, p) for g, i, p in rows if g == f and p is not None]
        want = dict(zip((i for i, _ in mine), adjusted([p for _, p in mine])))
        assert {r.id: r.adj_p for r in got if r.family == f and r.p is not None} == pytest.approx(want)


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_totals_of_nulls_and_doubles(spark, parts):
    rows = [(g, h, float(v), v + 0.5, v) for g in (None, "x", "y") for h in (1, None) for v in range(7)] + [("z", 1, None, 2.0, 3)]
    df = spark.createDataFrame(rows, "g string, h int, v double, a double, n int")
    got = running_totals(df, "v", ["a", "n"], ["g", "h"], parts).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[:2] == (r.g, r.h)]
        earlier = [x for x in mine if r.v is not None and x[2] < r.v]
        assert (r.a_before, r.n_before) == (sum(x[3] for x in earlier), sum(x[4] for x in earlier))
        assert (r.a_total, r.n_total) == (sum(x[3] for x in mine), sum(x[4] for x in mine))
    assert running_totals(df.limit(0), "v", ["n"], ["g"]).collect() == []


def test_one_group_is_spread_evenly(spark):
    from seqloom.operators import prefix

    laid, parts = prefix.lay_out(spark.range(1_000_000).select(F.rand(3).alias("v"), F.lit(1).alias("n")), "v")
    sizes = [r["count"] for r in laid.groupBy("_part").count().collect()]
    assert len(sizes) == parts == 4 and max(sizes) < 2 * min(sizes)
    plan = running_totals(spark.range(100).withColumn("n", F.lit(1)), "id", ["n"])._jdf.queryExecution().toString()
    assert "Window" not in plan and "Exchange" not in plan
