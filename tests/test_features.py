from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import kmers as K, sequence as S
from seqloom.operators import aggregates as A
from seqloom.plans import embed as E


def brute(seq, ks, alphabet="ACGT"):
    out = Counter()
    for k in ks:
        for i in range(len(seq) - k + 1):
            w = seq[i : i + k]
            if set(w) <= set(alphabet):
                n = 0
                for b in w:
                    n = n * len(alphabet) + alphabet.index(b)
                out[S.kmer_offset(k, ks, len(alphabet)) + n] += 1
    return out


@pytest.fixture(scope="module")
def seqs(spark):
    rng = np.random.default_rng(0)
    texts = ["", "AC", "NNNN", "ACGT", "A" * 50] + ["".join(rng.choice(list("ACGTN"), n, p=[0.24] * 4 + [0.04])) for n in (7, 30, 700, 3000)]
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, sequence string").cache()


def test_counts_match_brute_force(seqs):
    ks = (3, 4, 5, 6, 7)
    got = {}
    for r in K.kmer_counts(seqs, ks).collect():
        got.setdefault(r.row_id, {})[r.idx] = r.n
    for r in seqs.collect():
        assert got.get(r.row_id, {}) == dict(brute(r.sequence, ks))


def test_long_rows_in_pieces():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ACGTN"), n)) for n in (5, 300, 20, 1000, 3)]
    old, K.SLICE = K.SLICE, 128
    try:
        got = {}
        for first, _, row, idx, n in K._batch_counts(pa.array([*texts, None]), (3, 5), "ACGT"):
            for a, b, c in zip(row, idx, n):
                got.setdefault(first + a, {})[int(b)] = int(c)
    finally:
        K.SLICE = old
    for i, t in enumerate(texts):
        assert got.get(i, {}) == dict(brute(t, (3, 5)))


def test_fit_counts_observed_lower_cased(spark):
    df = spark.createDataFrame([(1, "AAnAA"), (2, "acg")], "row_id long, sequence string")
    got = {(r.row_id, r.kmer): r.n for r in K.kmer_counts_fit(df, 2).collect()}
    assert got == {(1, "aa"): 2, (1, "an"): 1, (1, "na"): 1, (2, "ac"): 1, (2, "cg"): 1}


def test_baseline_widths_and_tail(spark):
    assert (E.BASELINE_WIDTH, E.SIXTRACK_WIDTH) == (21825, 21827)
    df = spark.createDataFrame(
        [(1, "GCGCGC", [0] * 6, [1, 0, 0, 1, 0, 0]), (2, "ATGATG", [0, 0, 0, 1, 0, 0], [0] * 6)],
        "row_id long, sequence string, cds array<tinyint>, splice array<tinyint>",
    )
    rows = {r.row_id: dict(zip(r.idx, r.val)) for r in E.baseline_features(df, sixtrack=True).collect()}
    assert [rows[1][i] for i in (21824, 21825, 21826)] == [1.0, 0.0, 2.0]
    assert rows[2][21825] == 3.0 and 0 < rows[2][21824] < 1
    assert max(rows[1]) == 21826 and max(dict(zip(*E.baseline_features(df).filter("row_id = 1").select("idx", "val").first()))) == 21824


def test_scaled_embedding_matches_dense(seqs):
    rows = seqs.filter(F.length("sequence") >= 7)
    features = E.baseline_features(rows)
    dense = np.zeros((rows.count(), E.BASELINE_WIDTH))
    order = sorted(r.row_id for r in rows.collect())
    for r in features.collect():
        dense[order.index(r.row_id), r.idx] = r.val
    keep = (dense != 0).any(axis=0)
    dense = dense[:, keep]
    sd = dense.std(axis=0)
    want = (dense - dense.mean(axis=0)) / np.where(sd > 1e-12, sd, 1)
    got = {r.row_id: r.embedding for r in E.embed_kmer_dataset(rows).collect()}
    np.testing.assert_allclose(np.array([got[i] for i in order]), want, atol=1e-5)


def test_standard_scale(spark):
    x = np.random.default_rng(2).normal(size=(30, 4))
    x[:, 2] = 7.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row_id long, v array<double>")
    got = {r.row_id: r.v for r in A.standard_scale(df, "v").collect()}
    sd = x.std(axis=0)
    np.testing.assert_allclose([got[i] for i in range(30)], (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1), atol=1e-9)


def test_plug_in_model(spark):
    class Positions:
        """Token vectors are their positions."""

        def embed_sequence(self, sequence, pool):
            return pool(np.arange(len(sequence), dtype=float)[:, None] * np.ones(3))

        def embed_sequence_sixtrack(self, sequence, cds, splice, pool):
            assert cds.dtype == np.int32
            return [float(cds.sum()), float(splice.sum())]

    df = spark.createDataFrame([(1, "ACGTA", [1, 0], [0, 1]), (2, "A", [1, 1], [1, 1])], "row_id long, sequence string, cds array<tinyint>, splice array<tinyint>")
    for pool, want in (("mean", 2.0), ("max", 4.0), ("cls", 0.0), (lambda t: t.sum(axis=0), 10.0)):
        got = {r.row_id: r.embedding for r in E.embed_dataset(df, Positions, pool).collect()}
        assert got[1] == [want] * 3 and got[2] == [0.0] * 3
    six = {r.row_id: r.embedding for r in E.embed_dataset(df, Positions, sixtrack=True).collect()}
    assert six == {1: [1.0, 1.0], 2: [2.0, 2.0]}


def test_pooling(spark):
    df = spark.createDataFrame(
        [(1, 0, "b", [1.0, 5.0]), (1, 1, "a", [3.0, 1.0]), (2, 0, "a", [7.0, 7.0])], "row_id long, pos int, layer string, v array<float>"
    )
    rows = lambda d: {r.row_id: list(r.v) for r in d.collect()}
    assert rows(A.mean_pool(df, ["row_id"], "v")) == {1: [2.0, 3.0], 2: [7.0, 7.0]}
    assert rows(A.pool(df, ["row_id"], "v", "max")) == {1: [3.0, 5.0], 2: [7.0, 7.0]}
    assert rows(A.cls_pool(df, ["row_id"], "v")) == {1: [1.0, 5.0], 2: [7.0, 7.0]}
    assert rows(A.layer_concat(df, ["row_id"], "layer", "v")) == {1: [3.0, 1.0, 1.0, 5.0], 2: [7.0, 7.0]}
    two = spark.createDataFrame([(1, "x", [1.0] * 3), (1, "y", [3.0] * 3)], "row_id long, model string, v array<float>")
    assert rows(A.replicate_average(two, ["row_id"], "v")) == {1: [2.0] * 3}
    with pytest.raises(ValueError):
        A.pool(df, ["row_id"], "v", "median")


def test_codon_aware_chunks(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        n = int(rng.integers(0, 40))
        cds = (rng.random(n) < (0.0 if i % 6 == 0 else 0.4)).astype(int)
        rows.append((i, "".join(rng.choice(list("ACGT"), n)), cds.tolist()))
    df = spark.createDataFrame(rows, "row_id long, sequence string, cds array<tinyint>")
    got = {}
    for r in E.chunk_cds_aware(df, 7).orderBy("row_id", "chunk").collect():
        got.setdefault(r.row_id, []).append((r.piece, list(r.cds)))
    for i, seq, cds in rows:
        want, start = [], 0
        while start < len(seq):
            end = min(start + 7, len(seq))
            if any(cds):
                while end > start and (cds[end - 1] or (end > 1 and cds[end - 2])):
                    end -= 1
                end = min(start + 7, len(seq)) if end == start else end
            want.append((seq[start:end], cds[start:end]))
            start = end
        assert got.get(i, []) == want


def test_observed_kmers_of_other_letters(spark):
    df = spark.createDataFrame([(1, "ACGRYACG"), (2, "acgacg"), (3, "AR"), (4, ""), (5, None)], "row_id long, sequence string")
    got = {(r.row_id, r.kmer): r.n for r in K.kmer_counts_fit(df, 3).collect()}
    assert got == {(1, "acg"): 2, (1, "cgr"): 1, (1, "gry"): 1, (1, "rya"): 1, (1, "yac"): 1, (2, "acg"): 2, (2, "cga"): 1, (2, "gac"): 1}


def test_vocabulary_across_slices(spark):
    """k-mers over the cut between two slices are met, k-mers over two rows are not; one row for a task and k-mer is sent at most."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ACGTN"), n, p=[0.24, 0.24, 0.24, 0.24, 0.04])) for n in (5, 0, 300, 2, 1000, 127, 3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "row_id long, sequence string").coalesce(1)
    want = {idx for t in texts for idx in brute(t, (3, 5))}
    old, K.SLICE = K.SLICE, 64
    try:
        got = K.kmer_vocab(df, (3, 5)).collect()
        codes = list(K._batch_codes(__import__("pyarrow").array(texts), "ACGT", 5))
    finally:
        K.SLICE = old
    assert {r.idx for r in got} == want and len(got) == len(want) and len(codes) > 20
    met = {K.kmer_offset(k, (3, 5)) + int(v) for c, o in codes for k, _, values in K._windows(c, o, (3, 5), 4) for v in values}
    assert met == want


def test_entries_of_scaled_vectors(spark):
    df = spark.createDataFrame([(1, "ACGTAC"), (2, "GGGG"), (3, "ATATAT")], "row_id long, sequence string")
    stats = {r.idx: i for i, r in enumerate(E.baseline_stats(E.baseline_features(df)).orderBy("idx").collect())}
    stored = {r.row_id: {stats[i] for i, v in zip(r.idx, r.val) if v} for r in E.baseline_features(df).collect()}
    got = E.embed_kmer_dataset(df, entries=True).collect()
    assert {r.row_id: set(r.dims) for r in got} == stored and all(len(r.embedding) == len(stats) for r in got)


def test_vector_sums(spark):
    from seqloom.queries.embedding import vector_sums

    df = spark.createDataFrame([(i, [float(i), -1.0, 2.0]) for i in range(150)], "row_id long, embedding array<float>").coalesce(1)
    got = {(r.kind, r.id): (r.n, r.weighted, r.squares) for r in vector_sums(df).collect()}
    assert got["row", 5] == (3, 5 - 2 + 6, 30.0) and len(got) == 153
    assert got["dim", 1] == (150, -float(sum(i % 7 + 1 for i in range(150))), 150.0)


def test_letters_to_bases():
    """Letters of any case become bases, everything else drops out, bytes of other scripts too; null stays null."""
    import pyarrow as pa

    from seqloom.sources.standins import _letters_to_bases

    texts = ["", "A-b 1", None, "\u00e9", "zZ", "", "n\u65e5x", " "]
    want = [None if t is None else "".join("ACGT"[(ord(c.lower()) - 97) % 4] for c in t if c.isascii() and c.isalpha()) for t in texts]
    assert _letters_to_bases(pa.array(texts)).to_pylist() == want == ["", "AC", None, "", "CC", "", "CT", ""]
    assert _letters_to_bases(pa.array(texts)[1:5]).to_pylist() == want[1:5]


def test_tables_of_all_counts():
    """Windows over two rows or other letters are not counted; rows longer than a slice are counted in pieces."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("ACGTN"), n, p=[0.23, 0.23, 0.23, 0.23, 0.08])) for n in (5, 0, 300, 2, 1, 90, 1000, 0, 3)] + ["", "NNNN", "ACGTACGT", ""]
    sizes = K.SLICE, K.TABLE_BASES
    for ks in ((3, 5), (1, 2, 4)):
        for K.SLICE, K.TABLE_BASES in (sizes, (128, 64), (1 << 10, 256)):
            try:
                got = {}
                for first, tables in K.count_tables(pa.array([*texts, None])[1:], ks):
                    assert [t.shape[1] for t in tables] == [4**k for k in ks]
                    got |= {first + i + 1: row for i, row in enumerate(np.concatenate(tables, axis=1))}
            finally:
                K.SLICE, K.TABLE_BASES = sizes
            assert sorted(got) == list(range(1, len(texts) + 1))
            for i, t in enumerate([*texts, ""]):
                assert i == 0 or {j: n for j, n in enumerate(got[i].tolist()) if n} == dict(brute(t, ks))


def test_moments_of_tables(spark, seqs):
    rows = seqs.filter(F.length("sequence") >= 7).withColumns({"extra": F.array(F.lit(2.0), F.col("row_id").cast("double"))})
    features = E.baseline_features(rows).select(
        "row_id", F.concat("idx", F.array(F.lit(21825), F.lit(21826))).alias("idx"), F.concat("val", F.array(F.lit(2.0), F.col("row_id").cast("double"))).alias("val")
    )
    want = {r.idx: (r.mean, r.sd) for r in E.baseline_stats(features).collect()}
    got = {r.idx: (r.mean, r.sd) for r in E.table_stats(rows.select("row_id", "sequence", "extra").repartition(2), E.BASELINE_KMERS).collect()}
    assert sorted(got) == sorted(want) and got[21825] == (2.0, 1.0)
    np.testing.assert_allclose([got[i] for i in sorted(got)], [want[i] for i in sorted(want)], rtol=1e-9, atol=1e-12)


def test_vectors_are_taken_where_they_are_made(spark):
    """With `first` and `then` sequences and vectors do not leave the task; the result is that of those sent."""
    from seqloom.queries.embedding import SUMS, embed_kmer_dataset_whole, sums_of, vector_sums
    from seqloom.sources.standins import bases_of, letters_to_bases

    texts = ["A, b c", "", "GGGG", None, "atatat", "TTTACG GG-CATTAGCA", "1 2 3"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, sequence string")
    made = df.select("row_id", letters_to_bases(F.col("sequence")).alias("sequence")).filter("sequence <> ''")
    sent = vector_sums(E.embed_kmer_dataset(made)).groupBy("kind", "id")
    taken = E.embed_kmer_dataset(df, first=bases_of, then=(sums_of, SUMS)).groupBy("kind", "id")
    want, got = [{(r.kind, r.id): r[2:] for r in g.sum("n", "weighted", "squares").collect()} for g in (sent, taken)]
    assert sorted(got) == sorted(want) and [i for kind, i in sorted(got) if kind == "row"] == [0, 2, 4, 5]
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)], atol=1e-6)
    plan = embed_kmer_dataset_whole(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 0


def test_windows_of_uneven_tracks(spark):
    df = spark.createDataFrame([(1, "ACGTACGT", [1, 0, 0]), (2, "ACG", [0] * 9), (3, "", [])], "row_id long, sequence string, cds array<tinyint>")
    got = [(r.row_id, r.chunk, r.piece, r.cds) for r in E.chunk_cds_aware(df, 4).orderBy("row_id", "chunk").collect()]
    assert got == [(1, 0, "ACGT", [1, 0, 0]), (1, 1, "ACGT", []), (2, 0, "ACG", [0, 0, 0])]
