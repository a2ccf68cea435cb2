import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import clusters as K, splits as X
from seqloom.operators.prefix import fill_cuts, shuffle_order, up_to_cut
from seqloom.operators.sets import expected_chunks, merge_chunks, row_chunk, with_row_id


def chromosomes(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "row_id long, chromosome string")


def sides(df, column="chromosome"):
    rows = df.collect()
    return {s: sorted(r[column] for r in rows if r["side"] == s) for s in ("train", "test")}


@pytest.mark.parametrize("size", [0.4, 0.3, 0.2, 0.1])
def test_chromosome_basic(spark, size):
    df = chromosomes(spark, ["8"] * 5 + ["9"] * 3)
    assert sides(X.split_chromosome(df, size, 38)) == {"train": ["8"] * 5, "test": ["9"] * 3}


def test_chromosome_exact(spark):
    df = chromosomes(spark, ["8"] * 5 + ["9"] * 3 + ["X"] * 2)
    assert sides(X.split_chromosome(df, 0.2, 38)) == {"train": ["8"] * 5 + ["9"] * 3, "test": ["X"] * 2}


def test_chromosome_tiny(spark):
    out = sides(X.split_chromosome(chromosomes(spark, ["1"] * 5 + ["2"] * 5), 0.01, 38))
    assert len(out["train"]) == len(out["test"]) == 5 and len(set(out["test"])) == 1


@pytest.mark.parametrize("names", [["8"] * 10, []])
def test_chromosome_needs_two(spark, names):
    with pytest.raises(Exception, match="cannot split"):
        X.split_chromosome(chromosomes(spark, names), 0.3, 38).collect()


def test_random_is_exact_and_seeded(spark):
    df = spark.range(997).withColumnRenamed("id", "row_id")
    for size in (0.3, 0.15, 0.001, 1.0):
        import math

        assert X.split_random(df, size, 1).filter("side = 'test'").count() == math.ceil(997 * size)
    a = {r.row_id for r in X.split_random(df, 0.3, 1).filter("side = 'test'").collect()}
    b = {r.row_id for r in X.split_random(df.repartition(7), 0.3, 1).filter("side = 'test'").collect()}
    c = {r.row_id for r in X.split_random(df, 0.3, 2).filter("side = 'test'").collect()}
    assert a == b != c


def constant_splitter(df, test_size, seed):
    return df.withColumn("side", F.when(F.col("row_id") % 2 == 0, "train").otherwise("test"))


@pytest.mark.parametrize(
    "ratios, parts",
    [
        ((0.8, 0.1, 0.1), {"train", "val", "test"}), ((0.7, 0.2, 0.1), {"train", "val", "test"}),
        ((0.8, 0, 0.2), {"train", "test"}), ((0.8, 0.2, 0), {"train", "val"}),
        ((1, 0, 0), {"train"}), ((0, 0.5, 0.5), {"val", "test"}),
    ],
)
def test_three_way_parts(spark, ratios, parts):
    df = spark.range(40).withColumnRenamed("id", "row_id")
    out = X.split_three_way(X.split_random, df, ratios).collect()
    assert {r.split for r in out} == parts and len(out) == 40 == len({r.row_id for r in out})


def test_three_way_checks(spark):
    df = spark.range(4).withColumnRenamed("id", "row_id")
    with pytest.raises(ValueError, match="sum to 1"):
        X.split_three_way(constant_splitter, df, (0, 0.5, 0.1))
    with pytest.raises(TypeError, match="n_cluster"):
        X.split_three_way(X.split_random, df, n_cluster=3)
    with pytest.raises(ValueError, match="unknown split type"):
        X.get_splits(df, "nope")
    with pytest.raises(ValueError, match="homology map"):
        X.get_splits(df, "homology")
    # the second call sees the odd rows only and puts them all in test
    assert {r.split for r in X.split_three_way(constant_splitter, df, (0.8, 0.1, 0.1)).collect()} == {"train", "test"}


def homology_rows(spark, n=600, hot=200):
    """One gene holds a third of all rows; every tenth gene is unmapped."""
    rows = [(i, "hot" if i < hot else f"g{i % 90}") for i in range(n)]
    groups = [("hot", 1000, 0)] + [(f"g{j}", j // 3, j) for j in range(90) if j % 10] + [("g1", 77, 500)]
    return (
        spark.createDataFrame(rows, "row_id long, gene string"),
        spark.createDataFrame(groups, "gene_name string, gene_group long, ordinal long"),
        dict((g, k) for g, k, _ in groups),
    )


@pytest.mark.parametrize("seed", [2541, 413, 7])
def test_homology_groups_stay_whole(spark, seed):
    df, homology, last = homology_rows(spark)
    out = X.split_homology(df, 0.3, seed, homology).collect()
    assert len(out) == 600
    where, size = {}, {}
    for r in out:
        if r.gene in last:
            where.setdefault(last[r.gene], set()).add(r.side)
            size[last[r.gene]] = size.get(last[r.gene], 0) + 1
    assert all(len(s) == 1 for s in where.values())
    train = sum(r.side == "train" for r in out)
    assert 420 <= train < 420 + max(size.values())


def test_homology_unmapped_option(spark):
    df, homology, _ = homology_rows(spark)
    out = X.split_homology(df, 0.3, 5, homology, group_unmapped=True).filter("gene IN ('g0', 'g10', 'g20')")
    assert all(r.n == 1 for r in out.groupBy("gene").agg(F.countDistinct("side").alias("n")).collect())


def test_fill_matches_a_walk(spark):
    rows = [(i, 1 + (i * 7919) % 40 if i % 50 else 900) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, n long").withColumn("k", shuffle_order("id", 3))
    for limit in (0, 1, 1234, 9999, 10**9):
        out = {r.id: r.filled for r in up_to_cut(df, "k", fill_cuts(df, "k", "n", lambda _: F.lit(limit))).collect()}
        taken = 0
        for r in sorted(df.collect(), key=lambda r: r.k):
            assert out[r.id] == (taken < limit)
            taken += r.n if taken < limit else 0


def test_fill_by_group(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id"), F.lit(1).alias("n"))
    df = df.withColumn("k", shuffle_order("id", F.col("g")))
    out = up_to_cut(df, "k", fill_cuts(df, "k", "n", lambda t: F.floor(t * 0.25), ["g"]), ["g"])
    assert {r.g: r.s for r in out.groupBy("g").agg(F.sum(F.col("filled").cast("int")).alias("s")).collect()} == {0: 25, 1: 25, 2: 25}


def test_kmer_split(spark):
    seqs = ["ACGT" * 10 + "A" * (i % 5) for i in range(30)] + ["GGTT" * 10 + "T" * (i % 5) for i in range(70)]
    df = spark.createDataFrame(list(enumerate(seqs)), "row_id long, sequence string")
    out = X.split_kmer(df, 0.2, 3)
    assert out.columns == ["row_id", "sequence", "side"] and out.count() == 100
    clusters = {r.row_id: r.cluster for r in X.kmeans_clusters(df, 3, 2, 3).collect()}
    assert len({clusters[i] for i in range(30)}) == 1 and len({clusters[i] for i in range(30, 100)}) == 1
    rows = out.collect()
    for start, stop in ((0, 30), (30, 100)):
        assert len({r.side for r in rows if start <= r.row_id < stop}) == 1


def test_row_ids_and_chunks(spark):
    df = spark.createDataFrame([(f"k{(i * 37) % 101:03d}",) for i in range(101)], "key string").repartition(5)
    rows = with_row_id(df, "key")
    assert [r.row_id for r in rows.orderBy("key").collect()] == list(range(101))
    chunked = row_chunk(rows, 4)
    assert [r["count"] for r in chunked.groupBy("chunk").count().orderBy("chunk").collect()] == [26, 26, 26, 23]
    expected = expected_chunks(rows, 60)
    assert expected.count() == 51  # of 60 chunks of two rows, nine hold none
    parts = row_chunk(rows, 4)
    assert merge_chunks(parts, expected_chunks(rows, 4)).count() == 101
    assert merge_chunks(parts.filter("chunk <> 2"), expected_chunks(rows, 4)).count() == 0


def clustered_points(n=3000, hot=900):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 12)) * 5
    x = (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 12))).astype(np.float32)
    x[:hot] = x[0]
    return x


def scatter(x, clusters):
    return sum(np.square(x[clusters == c] - x[clusters == c].mean(axis=0)).sum() for c in np.unique(clusters))


def clusters_of(spark, x, *args, **options):
    df = spark.createDataFrame([(i, v.tobytes()) for i, v in enumerate(x)], "row_id long, vec binary").repartition(6)
    rows = K.tree_clusters(df, *args, **options).collect()
    assert sorted(r.row_id for r in rows) == list(range(len(x)))
    return np.array([r.cluster for r in sorted(rows)])


@pytest.mark.parametrize("wanted,cell_points,fan", [(60, 150, 8), (300, 64, 4), (40, None, 32), (2, 100, 32)])
def test_tree_of_centres(spark, wanted, cell_points, fan):
    x = clustered_points()
    got = clusters_of(spark, x, wanted, 5, cell_points=cell_points, fan=fan)
    assert sorted(set(got)) == list(range(wanted)) and len(set(got[:900])) == 1
    different, at, weight = np.unique(x.astype(float), axis=0, return_inverse=True, return_counts=True)
    flat = K.weighted_kmeans(different, weight.astype(float), wanted, 5)[at.ravel()]
    assert scatter(x, got) < min(1.5 * scatter(x, flat), scatter(x, np.zeros(len(x))))
    again = clusters_of(spark, x, wanted, 5, cell_points=cell_points, fan=fan)
    assert (got == again).all()


def test_cells_that_centres_cannot_divide(spark):
    x = np.zeros((600, 3), np.float32)
    x[:, 0] = 1 + np.arange(600) * 1e-6  # different numbers, all but equal
    x[0] = 1e6
    assert len(set(clusters_of(spark, x, 50, 1, cell_points=40, fan=2))) == min(50, len(np.unique(x, axis=0)))


def test_fewer_vectors_than_clusters(spark):
    x = np.repeat(np.eye(4, dtype=np.float32), 5, axis=0)
    assert sorted(set(clusters_of(spark, x, 9, 1))) == [0, 1, 2, 3]
    assert K.tree_clusters(spark.createDataFrame([], "row_id long, vec binary"), 3, 1).collect() == []


@pytest.mark.parametrize("k,spread,points", [(10, [5.0, 1.0, 0.0], [100, 2, 9]), (100, [1.0, 1.0], [3, 5]), (3, [9.0, 0.0, 0.0], [50, 1, 1]), (7, [0.0, 0.0], [5, 9])])
def test_dealing_clusters(k, spread, points):
    out = K.deal(k, np.array(spread), np.array(points))
    assert out.sum() == min(k, sum(points)) and (out >= 1).all() and (out <= points).all()


def test_kmer_rule(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "".join(rng.choice(list("ACGTN"), 60))) for i in range(450)], "row_id long, sequence string")
    out = X.split_kmer(df, 0.2, 3, keep_cluster=True).collect()
    assert len(out) == 450 and {r.cluster for r in out} == {0, 1, 2, 3}
    assert {r.cluster for r in X.split_hard_kmer(df, 0.2, 3, keep_cluster=True).collect()} == {0, 1}


def fold(sizes, limit):
    used, taken = 0, []
    for n in sizes:
        fits = used + n <= limit
        taken.append(fits)
        used += n * fits
    return taken


@pytest.mark.parametrize("fold_rows,rows_in_part", [(1 << 16, 1 << 18), (0, 40), (25, 7)])
@pytest.mark.parametrize("limit", [0, 3, 700, 5000, 10**9])
def test_first_fit_is_the_fold(spark, monkeypatch, fold_rows, rows_in_part, limit):
    from seqloom.operators import prefix

    monkeypatch.setattr(prefix, "PART_ROWS", rows_in_part)
    rng = np.random.default_rng(limit)
    sizes = [int(v) for v in np.where(rng.random(300) < 0.1, rng.integers(200, 900, 300), rng.integers(1, 40, 300))]
    df = spark.createDataFrame([(f"{i:05d}", n) for i, n in enumerate(sizes)], "o string, n long").repartition(5)
    got = X.first_fit(df, "o", "n", limit, fold_rows).orderBy("o").collect()
    assert [r.taken for r in got] == fold(sizes, limit)


def test_a_million_scaffolds(spark):
    df = spark.range(1_000_000).select(F.format_string("%07d", "id").alias("o"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).alias("n"))
    for share in (0.3, 0.9999):
        limit = int(500_500_000 * share)
        out = X.first_fit(df, "o", "n", limit).select("o", "n", "taken").toPandas().sort_values("o")
        assert out.taken.tolist() == fold(out.n.tolist(), limit)


def test_null_and_hot_chromosomes(spark):
    df = chromosomes(spark, [None] * 2 + ["1"] * 30 + ["2"] * 3 + ["3"] * 5)
    out = X.split_chromosome(df, 0.3, 5).collect()
    assert len(out) == 40 and all(len({r.side for r in out if r.chromosome == c}) == 1 for c in (None, "1", "2", "3"))
    assert 0 < sum(r.side == "test" for r in out) <= 12
