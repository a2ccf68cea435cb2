"""Exact regression and classification metrics, one row per group.

Rank metrics work on distinct scores with their counts: equal scores meet before the shuffle, and
the running sums are split over tasks, so neither a tied score nor a single group is a hot spot.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.operators.windows import score_steps, value_ranks


def metric_mse(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("mse"))


def _correlation(p: str, y: str) -> Column:
    """Pearson's r; null, not an error, where a side is constant or there is one row."""
    used = F.col(p).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(used, F.col(p).cast("double")), F.when(used, F.col(y).cast("double"))
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    spread = F.when(varies, F.stddev_pop(a) * F.stddev_pop(b))
    return F.try_divide(F.covar_pop(a, b), spread)


def metric_pearson(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(_correlation(p, y).alias("r"))


def metric_spearman(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Spearman's rho under the name `p`: Pearson's r of the average ranks."""
    by = list(by)
    pairs = df.groupBy(*by, p, y).agg(F.count(F.lit(1)).alias("w"))

    def centred(value: str, name: str) -> DataFrame:
        ranks = value_ranks(df, value, by)
        return ranks.select(*by, value, (F.col("rank") - (F.col("n_total") + 1) / 2).alias(name))

    both = pairs.join(centred(p, "a"), [*by, p]).join(centred(y, "b"), [*by, y])
    rho = F.try_divide(F.sum(F.expr("w * a * b")), F.sqrt(F.sum(F.expr("w * a * a")) * F.sum(F.expr("w * b * b"))))
    return both.groupBy(*by).agg(rho.alias("p"))


def eval_regression(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    plain = df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("mse"), _correlation(p, y).alias("r"))
    rho = metric_spearman(df, p, y, by)
    if by:
        return plain.join(rho, by)
    return plain.withColumn("p", rho.scalar())


def _auroc():
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    neg_before = F.col("n_before") - F.col("pos_before")
    won = F.sum((pos * (neg_before + neg / 2)).cast("double"))
    return F.try_divide(won, (F.max("pos_total") * (F.max("n_total") - F.max("pos_total"))).cast("double")).alias("auroc")


def _auprc():
    tp, at = F.col("pos_total") - F.col("pos_before"), F.col("n_total") - F.col("n_before")
    return F.try_divide(F.sum(F.col("pos") * tp / at), F.max("pos_total").cast("double")).alias("auprc")


def metric_auroc(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half."""
    return score_steps(df, p, y, by).groupBy(*by).agg(_auroc())


def metric_auprc(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Average precision: the step sum of precision over recall, not the trapezoid."""
    return score_steps(df, p, y, by).groupBy(*by).agg(_auprc())


def eval_classification(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return score_steps(df, p, y, by).groupBy(*by).agg(_auroc(), _auprc())


def metric_micro(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Both classification metrics over all (row, label) pairs; `p` and `y` are arrays."""
    flat = df.select(*by, F.explode(F.arrays_zip(F.col(p).alias("p"), F.col(y).alias("y"))).alias("e"))
    return eval_classification(flat.select(*by, "e.p", "e.y"), "p", "y", by)


def long_metrics(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metric columns to (`by`..., metric, value) rows."""
    names = [c for c in wide.columns if c not in by]
    return wide.unpivot(list(by), names, "metric", "value")


# ---- group comparison --------------------------------------------------------------------


def group_moments(df: DataFrame, group: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )


def welch_t(pairs: DataFrame) -> DataFrame:
    """Unequal-variance t, degrees of freedom and two-sided p for pairs of `group_moments` rows.

    All three are null for two constant groups.
    """
    a, b = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    t = F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(a + b))
    within = F.try_divide(F.pow(a, F.lit(2)), F.col("n_a") - 1) + F.try_divide(F.pow(b, F.lit(2)), F.col("n_b") - 1)
    df = F.try_divide(F.pow(a + b, F.lit(2)), within)
    out = pairs.withColumns({"t": t, "df": df})
    return out.withColumn("p_value", student_two_sided(F.col("t"), F.col("df")))


NODES = 96  # points of a Gauss-Legendre rule: the integrands below are smooth


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|): the regularised incomplete beta function of df / (df + t^2) at (df/2, 1/2).

    Substituting x = sin^2(u) leaves smooth integrands: the tail is the integral of sin(u)^(df - 1) up to the angle with tangent
    sqrt(df) / |t|, over that up to pi/2. Each is taken from where it is e^-45 of its peak, and both peaks are left out of the sums, so that no tail is
    too small. Null where either input is null or not finite, or df is below one, which Welch's never is.
    """
    at, weight = np.polynomial.legendre.leggauss(NODES)
    points = F.array(*[F.lit(float(x)) for x in (at + 1) / 2])
    weights = F.array(*[F.lit(float(w)) for w in weight / 2])
    power = df - 1
    pairs = F.zip_with(points, weights, lambda x, w: F.struct(x.alias("x"), w.alias("w")))

    def log_integral(top: Column) -> Column:
        peak = power * F.ln(F.sin(top))
        low = F.when(power > 0, F.asin(F.sin(top) * F.exp(-45.0 / power))).otherwise(0.0)
        step = lambda acc, e: acc + e["w"] * F.exp(power * F.ln(F.sin(low + (top - low) * e["x"])) - peak)
        return peak + F.ln(F.aggregate(pairs, F.lit(0.0), step) * (top - low))

    finite = ~F.isnan(t) & ~F.isnan(df) & (F.abs(t) < float("inf")) & (df < float("inf")) & (df >= 1)
    top = F.atan2(F.sqrt(df), F.abs(t))
    share = F.exp(log_integral(top) - log_integral(F.lit(float(np.pi / 2))))
    return F.when(finite & (t == 0), 1.0).when(finite & (top == 0), 0.0).when(finite, F.least(share, F.lit(1.0)))
