"""Metrics, group comparison, probes over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import joins as J, metrics as M
from seqloom.plans import probe as P
from seqloom.plans.report import report
from seqloom.plans.work import run_pending
from seqloom.registry import query
from seqloom.session import scratch
from seqloom.sources import readers as R, standins as D
from seqloom.sources.standins import ctes

BY = ["run"]


@query("metric_mse", ctes("scores") + "SELECT run, round(avg((p - t) ** 2), 6) AS mse FROM scores GROUP BY run")
def metric_mse(spark, sf):
    return M.metric_mse(D.scores(spark, sf), "p", "t", BY).select("run", F.round("mse", 6).alias("mse"))


@query("metric_pearson", ctes("scores") + "SELECT run, round(corr(p, t), 9) AS r FROM scores GROUP BY run")
def metric_pearson(spark, sf):
    return M.metric_pearson(D.scores(spark, sf), "p", "t", BY).select("run", F.round("r", 9).alias("r"))


@query(
    "metric_spearman",
    ctes("scores")
    + """
    SELECT run, round(corr(a, b), 9) AS p FROM (
      SELECT run, rank() OVER (PARTITION BY run ORDER BY p) + (count(*) OVER (PARTITION BY run, p) - 1) / 2 AS a,
        rank() OVER (PARTITION BY run ORDER BY t) + (count(*) OVER (PARTITION BY run, t) - 1) / 2 AS b FROM scores) GROUP BY run
    """,
)
def metric_spearman(spark, sf):
    return M.metric_spearman(D.scores(spark, sf), "p", "t", BY).select("run", F.round("p", 9).alias("p"))


def rank_sql(table: str, by: str) -> str:
    return f"""
    rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2 AS rank FROM {table}),
    roc AS (SELECT {by}, (sum(rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auroc FROM rk GROUP BY {by}),
    st AS (SELECT {by}, p, sum(y) AS pos, count(*) AS n FROM {table} GROUP BY {by}, p),
    cu AS (SELECT {by}, pos, sum(pos) OVER w / sum(n) OVER w AS prec, sum(pos) OVER (PARTITION BY {by}) AS total FROM st WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)),
    prc AS (SELECT {by}, sum(pos * prec / total) AS auprc FROM cu GROUP BY {by})"""


@query("metric_auroc", ctes("scores") + "," + rank_sql("scores", "run") + "SELECT run, round(auroc, 9) AS auroc FROM roc")
def metric_auroc(spark, sf):
    return M.metric_auroc(D.scores(spark, sf), "p", "y", BY).select("run", F.round("auroc", 9).alias("auroc"))


@query("metric_auprc", ctes("scores") + "," + rank_sql("scores", "run") + "SELECT run, round(auprc, 9) AS auprc FROM prc")
def metric_auprc(spark, sf):
    return M.metric_auprc(D.scores(spark, sf), "p", "y", BY).select("run", F.round("auprc", 9).alias("auprc"))


@query(
    "metric_micro",
    f"""
    WITH flat AS (SELECT vec_id % 3 AS run, unnest([round(x::DOUBLE, 2) FOR x IN embedding]) AS p, unnest([(label = i)::INT FOR i IN range(len(embedding))]) AS y FROM embeddings),
    {rank_sql("flat", "run")}
    SELECT run, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc FROM roc JOIN prc USING (run)
    """,
)
def metric_micro(spark, sf):
    """Every coordinate as the score of the label of its number."""
    rows = D.table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 3).alias("run"),
        F.transform("embedding", lambda x: F.round(x.cast("double"), 2)).alias("p"),
        F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: (F.col("label") == i).cast("int")).alias("y"),
    )
    out = M.metric_micro(rows, "p", "y", BY)
    return out.select("run", F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"))


@query(
    "welch_t",
    """
    WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents GROUP BY lang)
    SELECT a.lang AS lang_a, b.lang AS lang_b, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 8) AS t,
      round((a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)), 6) AS df
    FROM g a JOIN g b ON a.lang < b.lang
    """,
)
def welch_t(spark, sf):
    groups = M.group_moments(D.table(spark, sf, "documents"), "lang", "n_chars")
    tests = M.welch_t(J.group_pairs(groups, "lang", ["n", "mean", "var"]))
    return tests.filter("p_value BETWEEN 0 AND 1").select("lang_a", "lang_b", F.round("t", 8).alias("t"), F.round("df", 6).alias("df"))


SIMPSON = "list_sum([CASE WHEN k IN (0, 4096) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(c * ln(sin({low} + ({top} - {low}) * k / 4096) / sin({top}))) FOR k IN range(4097)]) * ({top} - {low})"


@query(
    "welch_p",
    f"""
    WITH g AS (SELECT lang, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM documents GROUP BY lang),
    t AS (SELECT a.lang AS lang_a, b.lang AS lang_b, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t,
      (a.v / a.n + b.v / b.n) ** 2 / ((a.v / a.n) ** 2 / (a.n - 1) + (b.v / b.n) ** 2 / (b.n - 1)) AS df FROM g a JOIN g b ON a.lang < b.lang),
    u AS (SELECT *, df - 1 AS c, asin(sqrt(df / (df + t * t))) AS top FROM t),
    w AS (SELECT *, asin(sin(top) * exp(-45 / c)) AS low, asin(exp(-45 / c)) AS least FROM u)
    SELECT lang_a, lang_b, round(exp(c * ln(sin(top))) * {SIMPSON.format(low="low", top="top")} / ({SIMPSON.format(low="least", top="(pi() / 2)")}), 9) AS p_value FROM w
    """,
)
def welch_p(spark, sf):
    """Do documents of two languages differ in length? The probability itself, beside Simpson's rule."""
    groups = M.group_moments(D.table(spark, sf, "documents"), "lang", "n_chars")
    tests = M.welch_t(J.group_pairs(groups, "lang", ["n", "mean", "var"]))
    return tests.select("lang_a", "lang_b", F.round("p_value", 9).alias("p_value"))


# ---- probes ------------------------------------------------------------------------------


def weights(probe, spark):
    rows = [(i, j, float(w)) for i, c in enumerate(probe.coef) for j, w in enumerate([probe.intercept[i], *c])]
    return spark.createDataFrame(rows, "label int, term int, weight double")


@query(
    "probe_linear",
    "SELECT 0 AS label, t.term::INT AS term, round(CASE t.term WHEN 0 THEN regr_intercept(l_extendedprice, l_quantity) ELSE regr_slope(l_extendedprice, l_quantity) END, 4) AS weight FROM lineitem, range(2) t(term) GROUP BY t.term",
)
def probe_linear(spark, sf):
    """Price on quantity over all line items."""
    rows = D.table(spark, sf, "lineitem").select(F.array("l_quantity").alias("embedding"), F.col("l_extendedprice").alias("target"))
    return weights(P.probe_linear(rows), spark).withColumn("weight", F.round("weight", 4))


RIDGE = """
    WITH d AS (SELECT l_discount - (SELECT avg(l_discount) FROM lineitem) AS x, l_tax - (SELECT avg(l_tax) FROM lineitem) AS y FROM lineitem),
    s AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, count(*) AS n FROM d),
    loo AS (SELECT a, xy / (xx + a) AS w, (SELECT sum(((y - x * xy / (xx + a)) / (1 - 1 / n - x * x / (xx + a))) ** 2) FROM d) AS err
      FROM s, (VALUES (0.001::DOUBLE), (0.01), (0.1), (1.0), (10.0)) t(a))
    SELECT round(w, 9) AS weight, a AS penalty FROM loo ORDER BY err, a LIMIT 1
    """


@query("probe_ridge_cv", RIDGE)
def probe_ridge_cv(spark, sf):
    """Tax on discount over all line items: the best of five penalties and its weight."""
    rows = D.table(spark, sf, "lineitem").select(F.array("l_discount").alias("embedding"), F.col("l_tax").alias("target"))
    probe = P.probe_ridge_cv(rows)
    return spark.createDataFrame([(round(float(probe.coef[0, 0]), 9), probe.penalty)], "weight double, penalty double")


# Gauss-Jordan elimination of [X'X + a, 1] for every penalty at once, a column a step.
WIDE_RIDGE = """
    WITH RECURSIVE l AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS j, unnest(embedding)::DOUBLE AS x FROM embeddings),
    c AS (SELECT vec_id, j, x - avg(x) OVER (PARTITION BY j) AS x FROM l),
    t AS (SELECT vec_id, label - avg(label) OVER () AS y, count(*) OVER () AS n FROM embeddings),
    g AS (SELECT a.j AS i, b.j AS j, sum(a.x * b.x) AS v FROM c a JOIN c b USING (vec_id) GROUP BY a.j, b.j),
    xy AS (SELECT j, sum(x * y) AS v FROM c JOIN t USING (vec_id) GROUP BY j),
    penalties(a) AS (VALUES (0.001::DOUBLE), (0.01), (0.1), (1.0), (10.0)),
    m(a, k, i, j, v) AS (
      SELECT a, 0, i, j, CASE WHEN i = j THEN v + a ELSE v END FROM g, penalties
      UNION ALL SELECT a, 0, x.i, 1000 + y.i, (x.i = y.i)::INT::DOUBLE FROM (SELECT DISTINCT i FROM g) x, (SELECT DISTINCT i FROM g) y, penalties
    ),
    e(a, k, i, j, v) AS (
      SELECT * FROM m
      UNION ALL
      SELECT a, k + 1, i, j, CASE WHEN i = k + 1 THEN v / d ELSE v - f * r / d END
      FROM (SELECT *, max(v) FILTER (WHERE i = k + 1) OVER (PARTITION BY a, j) AS r, max(v) FILTER (WHERE j = k + 1) OVER (PARTITION BY a, i) AS f,
                   max(v) FILTER (WHERE i = k + 1 AND j = k + 1) OVER (PARTITION BY a) AS d FROM e) WHERE k < (SELECT max(i) FROM g)
    ),
    inv AS (SELECT a, i, j - 1000 AS j, v FROM e WHERE k = (SELECT max(i) FROM g) AND j > 1000),
    w AS (SELECT a, i AS j, sum(inv.v * xy.v) AS w FROM inv JOIN xy USING (j) GROUP BY a, i),
    z AS (SELECT a, vec_id, i AS j, sum(v * x) AS z FROM inv JOIN c USING (j) GROUP BY a, vec_id, i),
    fit AS (SELECT a, vec_id, sum(x * w) AS p, sum(x * z) AS h FROM c JOIN z USING (vec_id, j) JOIN w USING (a, j) GROUP BY a, vec_id),
    loo AS (SELECT a, sum(((y - p) / (1 - 1 / n - h)) ** 2) AS err FROM fit JOIN t USING (vec_id) GROUP BY a),
    best AS (SELECT a FROM loo ORDER BY err, a LIMIT 1)
    SELECT j::INT AS term, round(w, 7) AS weight, a AS penalty FROM w JOIN best USING (a)
    """


@query("probe_ridge_wide", WIDE_RIDGE)
def probe_ridge_wide(spark, sf):
    """The label of an embedding from all its coordinates: the best of five penalties and every weight."""
    rows = D.table(spark, sf, "embeddings").select("embedding", F.col("label").alias("target"))
    probe = P.probe_ridge_cv(rows)
    found = [(j + 1, round(float(w), 7), probe.penalty) for j, w in enumerate(probe.coef[0])]
    return spark.createDataFrame(found, "term int, weight double, penalty double")


@query(
    "probe_ridge_fallback",
    """
    WITH d AS (SELECT l_discount - (SELECT avg(l_discount) FROM lineitem) AS x, l_tax - (SELECT avg(l_tax) FROM lineitem) AS y FROM lineitem)
    SELECT 1 AS term, round(sum(x * y) / (sum(x * x) + 0.001), 7) AS weight FROM d
    """,
)
def probe_ridge_fallback(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(F.array("l_discount").alias("embedding"), F.col("l_tax").alias("target"))
    out = weights(P.probe_ridge_fallback(rows), spark).filter("term = 1")
    return out.select("term", F.round("weight", 7).alias("weight"))


NEWTON = """
    it(label, k, a, b) AS (
      SELECT label, 0, 0::DOUBLE, 0::DOUBLE FROM ls
      UNION ALL
      SELECT label, k + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
      FROM (SELECT label, k, a, b,
          list_sum([r.pos - r.n * r.q FOR r IN rs]) AS g0, list_sum([r.x * (r.pos - r.n * r.q) FOR r IN rs]) - b AS g1,
          list_sum([r.n * r.q * (1 - r.q) FOR r IN rs]) AS h00, list_sum([r.x * r.n * r.q * (1 - r.q) FOR r IN rs]) AS h01,
          list_sum([r.x * r.x * r.n * r.q * (1 - r.q) FOR r IN rs]) + 1 AS h11
        FROM (SELECT it.label, k, a, b, [{'x': d.x, 'n': d.n, 'pos': d.pos, 'q': 1 / (1 + exp(-(a + b * d.x)))} FOR d IN ls.data] AS rs
          FROM it JOIN ls USING (label) WHERE k < 25)))"""


@query(
    "probe_logistic",
    f"""
    WITH RECURSIVE g AS (SELECT 0 AS label, l_discount * 10 AS x, count(*) AS n, count(*) FILTER (WHERE l_tax < 0.04 OR l_discount > 0.07) AS pos FROM lineitem GROUP BY l_discount),
    ls AS (SELECT label, list({{'x': x, 'n': n, 'pos': pos}}) AS data FROM g GROUP BY label), {NEWTON}
    SELECT label, t.term::INT AS term, round(CASE t.term WHEN 0 THEN a ELSE b END, 3) AS weight FROM it, range(2) t(term) WHERE k = 25
    """,
)
def probe_logistic(spark, sf):
    """A flag on discount over all line items, beside Newton's method on the same penalised loss."""
    flag = ((F.col("l_tax") < 0.04) | (F.col("l_discount") > 0.07)).cast("int")
    rows = D.table(spark, sf, "lineitem").select(F.array(F.col("l_discount") * 10).alias("embedding"), flag.alias("target"))
    return weights(P.probe_logistic(rows), spark).withColumn("weight", F.round("weight", 3))


@query(
    "probe_multilabel",
    f"""
    WITH RECURSIVE g AS (SELECT i AS label, l_discount * 10 AS x, count(*) AS n, count(*) FILTER (WHERE CASE i WHEN 0 THEN l_returnflag = 'A' OR l_discount > 0.08 WHEN 1 THEN l_tax > 0.05 ELSE l_quantity > 10 AND l_discount > 0.01 END) AS pos
      FROM lineitem, (VALUES (0), (1), (2)) t(i) GROUP BY l_discount, i),
    ls AS (SELECT label, list({{'x': x, 'n': n, 'pos': pos}}) AS data FROM g GROUP BY label), {NEWTON}
    SELECT label, t.term::INT AS term, round(CASE t.term WHEN 0 THEN a ELSE b END, 3) AS weight FROM it, range(2) t(term) WHERE k = 25
    """,
)
def probe_multilabel(spark, sf):
    """Three flags at once, each beside its own Newton solution."""
    d = F.col("l_discount")
    flags = [(F.col("l_returnflag") == "A") | (d > 0.08), F.col("l_tax") > 0.05, (F.col("l_quantity") > 10) & (d > 0.01)]
    rows = D.table(spark, sf, "lineitem").select(
        F.array(d * 10).alias("embedding"), F.array(*[f.cast("int") for f in flags]).alias("target")
    )
    return weights(P.probe_multilabel(rows), spark).withColumn("weight", F.round("weight", 3))


def runs_sql(seeds: str, x: str = "p_size::DOUBLE") -> str:
    return f"""
    WITH d AS (SELECT p_partkey AS row_id, {x} AS x, p_retailprice + p_size * 10 AS y, seed, md5(p_partkey || ':' || seed) AS h FROM part, (VALUES {seeds}) t(seed)),
    a AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY h, row_id) <= ceil(count(*) OVER (PARTITION BY seed) * 0.3::DOUBLE) AS held FROM d),
    b AS (SELECT row_id, seed, row_number() OVER (PARTITION BY seed ORDER BY h, row_id) <= ceil(count(*) OVER (PARTITION BY seed) * 0.5::DOUBLE) AS test FROM a WHERE held),
    s AS (SELECT row_id, seed, x, y, CASE WHEN NOT held THEN 'train' WHEN test THEN 'test' ELSE 'val' END AS split FROM a LEFT JOIN b USING (row_id, seed)),
    w AS (SELECT seed, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s WHERE split = 'train' GROUP BY seed),
    q AS (SELECT seed, split, y, a + b * x AS p, rank() OVER (PARTITION BY seed, split ORDER BY x) + (count(*) OVER (PARTITION BY seed, split, x) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY seed, split ORDER BY y) + (count(*) OVER (PARTITION BY seed, split, y) - 1) / 2 AS ry, b FROM s JOIN w USING (seed)),
    m AS (SELECT seed, split, avg((p - y) ** 2) AS mse, corr(p, y) AS r, corr(rx, ry) * sign(max(b)) AS p FROM q GROUP BY seed, split)"""


LONG = "SELECT seed, split, 'mse' AS metric, round(mse, 4) AS value FROM m UNION ALL SELECT seed, split, 'r', round(r, 6) FROM m UNION ALL SELECT seed, split, 'p', round(p, 6) FROM m"


def priced(spark, sf):
    size = F.col("p_size").cast("double")
    return D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"), F.array(size).alias("embedding"), (F.col("p_retailprice") + F.col("p_size") * 10).alias("target")
    )


def rounded(rows):
    digits = F.when(F.col("metric") == "mse", F.round("value", 4)).otherwise(F.round("value", 6))
    return rows.withColumn("value", digits)


@query("run_probe", runs_sql("(2541)") + LONG)
def run_probe(spark, sf):
    """Price of a part from its size: random split, least squares, three metrics on three splits."""
    _, rows = P.run_probe(priced(spark, sf), "reg_lin")
    return rounded(rows)


@query("run_multi_seed", runs_sql("(2541), (413), (411)") + LONG)
def run_multi_seed(spark, sf):
    return rounded(P.run_multi_seed(priced(spark, sf), "reg_lin", (2541, 413, 411)))


@query("fitted_model", runs_sql("(413)") + "SELECT 0 AS label, t.term::INT AS term, round(CASE t.term WHEN 0 THEN a ELSE b END, 5) AS weight FROM w, range(2) t(term)")
def fitted_model(spark, sf):
    """A saved probe, read back for its seed."""
    path = scratch(spark, "probe")
    for seed in (411, 413):
        P.run_probe(priced(spark, sf), "reg_lin", seed=seed, save_to=path)
    return weights(P.fitted_model(spark, path, 413), spark).withColumn("weight", F.round("weight", 5))


MODELS = {"size": "p_size::DOUBLE", "batch": "(p_partkey % 97)::DOUBLE"}


@query(
    "probe_to_report",
    " UNION ALL ".join(
        f"""SELECT * FROM ({runs_sql("(2541), (413)", x)}
    SELECT 'part' AS dataset, 'target' AS target, '{name}' AS model, round(avg(r), 6) AS mean, round(1.96 * stddev_pop(r) / sqrt(count(*)), 6) AS ci, '{name[0]}' AS model_class
    FROM m WHERE split = 'test')"""
        for name, x in MODELS.items()
    ),
)
def probe_to_report(spark, sf):
    """Two feature sets probed under two seeds, stopped after the first, taken up from what is stored, and reported."""
    parts = D.table(spark, sf, "part")
    features = {"size": F.col("p_size"), "batch": F.col("p_partkey") % 97}

    def load(cell):
        return parts.select(
            F.col("p_partkey").alias("row_id"), F.array(features[cell["model"]].cast("double")).alias("embedding"), (F.col("p_retailprice") + F.col("p_size") * 10).alias("target")
        )

    catalogue = spark.createDataFrame([("part", "reg_lin", "target", "default")], "dataset string, task string, target string, split_type string")
    work = J.work_grid(catalogue, list(MODELS), (2541, 413), canonical=True)
    path = scratch(spark, "probed")
    run_pending(work, load, path, most=1)
    run_pending(work, load, path)
    left = J.resume_pending(work, R.scan_results(spark, path))
    classes = spark.createDataFrame([(m, m[0]) for m in MODELS], "model string, model_class string")
    out = report(R.scan_results(spark, path).join(left, list(J.CELL), "left_anti"), classes)
    return out.select("dataset", "target", "model", F.round("mean", 6).alias("mean"), F.round("ci", 6).alias("ci"), "model_class")
