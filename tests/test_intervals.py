import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import joins as J


def rows(seed):
    r = random.Random(seed)
    lengths = [0, 1, 7, 8, 9, 63, 64, 65, 1000, 10**5, 10**8]
    intervals = [(i, r.choice("ab"), s := r.randrange(0, 2000), s + r.choice(lengths)) for i in range(150)]
    intervals += [(200, "a", 0, 3 * 10**8), (201, "b", 511, 513), (202, None, 0, 100), (203, "a", 64, 128)]
    points = [(i, r.choice(["a", "b", "c"]), r.choice([r.randrange(0, 2200), 64, 63, 128, 512, 10**8 + 5, 3 * 10**8])) for i in range(200)] + [(300, None, 5)]
    return points, intervals


@pytest.mark.parametrize("width", [1, 8, 1024])
def test_points_in_intervals_of_any_length(spark, width):
    points, intervals = rows(width)
    p = spark.createDataFrame(points, "p int, chrom string, at long")
    i = spark.createDataFrame(intervals, "i int, chrom string, start long, end long")
    got = [(r.p, r.i) for r in J.interval_join(p, i, width=width).collect()]
    want = [(a, b) for a, c, at in points for b, d, s, e in intervals if c == d and c is not None and s <= at < e]
    assert sorted(got) == sorted(want)
    assert J.interval_join(p, i.limit(0), width=width).collect() == []


def test_long_intervals_are_not_multiplied(spark):
    i = spark.range(50).select(F.lit("a").alias("chrom"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 100_000_000).alias("end"))
    p = spark.createDataFrame([("a", 10**8 - 1)], "chrom string, at long")
    joined = J.interval_join(p, i, width=1024)
    assert joined.count() == 50
    wide = next(1024 * J.FINER**k for k in range(J.LEVELS) if 1024 * J.FINER**k >= 100_000_000)
    assert all((s * 1000 + 100_000_000 - 1) // wide - s * 1000 // wide <= 1 for s in range(50))


def test_heavy_bins_in_pieces(spark, monkeypatch):
    """Bins with more pairs than a task should compare are dealt in pieces; no pair is lost or comes out twice, repeated points included."""
    p = spark.createDataFrame([(i // 2, "1", 100 + i % 40) for i in range(400)] + [(999, "2", 7), (998, "1", 5_000_000)], "p long, chrom string, at long")
    i = spark.createDataFrame([(j, "1", 90 + j % 30, 90 + j % 30 + 1 + j % 9) for j in range(300)] + [(999, "2", 0, 4000)], "i long, chrom string, start long, end long")
    want = sorted((a.p, b.i) for a in p.collect() for b in i.collect() if a.chrom == b.chrom and b.start <= a.at < b.end)
    monkeypatch.setattr(J, "TASK_PAIRS", 500)
    joined = J.interval_join(p, i, width=1024)
    assert sorted((r.p, r.i) for r in joined.select("p", "i").collect()) == want
    assert "_piece" in joined._jdf.queryExecution().toString() and joined.rdd.getNumPartitions() > 8


def test_best_transcript_without_sorting_candidates(spark):
    v = spark.createDataFrame([(1, "1", 10, "utr5"), (2, "1", 10, "utr3"), (3, "1", 10, None)], "variant_id long, chrom string, pos long, region string")
    s = spark.createDataFrame(
        [(7, "utr5", 1, "1", "-", 1, 0, 20), (9, "utr5", 1, "1", "+", 1, 0, 20), (8, "utr5", 2, "1", "+", 1, 0, 20), (5, "utr5", 1, "1", "+", None, 0, 20)],
        "tx_id long, kind string, ordinal int, chrom string, strand string, appris int, start long, end long",
    )
    out = J.variant_utr_match(v, s)
    assert {r.variant_id: r.tx_id for r in out.collect()} == {1: 8, 2: None, 3: None}
    assert "partial_min(tx_id" in out._jdf.queryExecution().executedPlan().toString()
