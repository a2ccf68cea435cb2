"""Ranking and running sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import windows as W
from seqloom.registry import query
from seqloom.sources import standins as D
from seqloom.sources.standins import ctes


@query(
    "top_n_transcripts",
    ctes("tx")
    + """
    SELECT gene_id, tx_id, rn::INT AS priority FROM (SELECT gene_id, tx_id, row_number() OVER (PARTITION BY gene_id ORDER BY
      CASE WHEN is_mane THEN 0 WHEN appris IS NOT NULL THEN 1 ELSE 2 END, CASE WHEN is_mane THEN 0 ELSE coalesce(appris, 0) END, tx_id) AS rn FROM tx) WHERE rn <= 3
    """,
)
def top_n_transcripts(spark, sf):
    return W.top_n_transcripts(D.transcripts(spark, sf), 3).select("gene_id", "tx_id", "priority")


@query(
    "principal_transcript",
    ctes("tx", "exons")
    + """
    , lens AS (SELECT tx_id, sum(len) AS len FROM exons GROUP BY 1)
    SELECT gene_id, tx_id FROM (SELECT gene_id, tx_id, row_number() OVER (PARTITION BY gene_id ORDER BY appris IS NULL, appris, len DESC, tx_id) AS rn FROM
      (SELECT gene_id, tx_id, appris, CASE WHEN appris IS NULL THEN len ELSE 0 END AS len FROM tx JOIN lens USING (tx_id) WHERE gene_id % 2 = 0 OR appris IS NULL)) WHERE rn = 1
    """,
)
def principal_transcript(spark, sf):
    """Genes with an odd number keep only transcripts without a level, so that length decides."""
    lens = D.exons(spark, sf).groupBy("tx_id").agg(F.sum("len").alias("len"))
    tx = D.transcripts(spark, sf).filter("gene_id % 2 = 0 OR appris IS NULL").join(lens, "tx_id")
    return W.principal_transcript(tx)


@query(
    "exon_ends",
    ctes("exons") + "SELECT tx_id, ordinal::INT AS ordinal, sum(len) OVER (PARTITION BY tx_id ORDER BY ordinal)::BIGINT AS exon_end FROM exons",
)
def exon_ends(spark, sf):
    return W.exon_ends(D.exons(spark, sf)).select("tx_id", "ordinal", "exon_end")


@query(
    "average_rank",
    ctes("scores")
    + "SELECT row_id, run, rank() OVER (PARTITION BY run ORDER BY p) + (count(*) OVER (PARTITION BY run, p) - 1) / 2 AS rank FROM scores",
)
def average_rank(spark, sf):
    return W.average_rank(D.scores(spark, sf), "p", ["run"]).select("row_id", "run", "rank")


@query(
    "cumulative_pr",
    ctes("scores")
    + """
    , s AS (SELECT run, p, sum(y) AS pos, count(*) AS n FROM scores GROUP BY ALL),
    c AS (SELECT run, p, sum(pos) OVER w AS tp, sum(n) OVER w AS predicted, sum(pos) OVER (PARTITION BY run) AS total FROM s WINDOW w AS (PARTITION BY run ORDER BY p DESC))
    SELECT run, p, tp::BIGINT AS tp, predicted::BIGINT AS predicted, round(tp / predicted, 9) AS precision, round(tp / total, 9) AS recall FROM c
    """,
)
def cumulative_pr(spark, sf):
    steps = W.cumulative_pr(D.scores(spark, sf), "p", "y", ["run"])
    return steps.select("run", "p", "tp", "predicted", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    "bh_adjust",
    """
    WITH t AS (SELECT l_suppkey AS test, l_returnflag AS family, (sum(l_partkey) % 9973 + 1) / 9974 AS p FROM lineitem GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS k, count(*) OVER (PARTITION BY family) AS m FROM t),
    a AS (SELECT *, least(min(p * m / k) OVER (PARTITION BY family ORDER BY k DESC), 1.0::DOUBLE) AS adj FROM r)
    SELECT test, family, round(p, 9) AS p, round(adj, 9) AS adj_p FROM a WHERE adj <= 0.9
    """,
)
def bh_adjust(spark, sf):
    """One p-value per supplier and return flag, made from sums of part numbers."""
    tests = D.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("test"), F.col("l_returnflag").alias("family")).agg(
        ((F.sum("l_partkey") % 9973 + 1) / 9974).alias("p")
    )
    out = W.bh_adjust(tests, "p", ["family"], alpha=0.9)
    return out.select("test", "family", F.round("p", 9).alias("p"), F.round("adj_p", 9).alias("adj_p"))
