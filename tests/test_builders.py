import pytest
from pyspark.sql import functions as F

from seqloom.constants import EGFP, MCHERRY, PRIMER
from seqloom.operators import aggregates as A, joins as J, projections as P, windows as W
from seqloom.plans import builders as B
from seqloom.plans.report import report
from seqloom.sources import catalogue as C, readers as R


@pytest.fixture(scope="module")
def annotation(spark):
    """Gene g1 with two coding transcripts (one per strand) and g2 with a non-coding one."""
    genes = spark.createDataFrame([("G1.4", "ALPHA", "chr1", 0), ("G2.1", "BETA", "chrX", 1)], "gene_id string, gene string, chromosome string, ordinal int")
    tx = spark.createDataFrame(
        [("T1.2", "G1.4", "+", False, 2, 0), ("T2.1", "G1.4", "-", True, None, 1), ("T3.1", "G2.1", "+", False, None, 2)],
        "tx_id string, gene_id string, strand string, is_mane boolean, appris int, ordinal int",
    )
    rows = []

    def add(tx, chrom, strand, appris, kind, ordinal, start, end, seq=None, before=None):
        rows.append((tx, chrom, strand, appris, kind, ordinal, start, end, seq, before))

    # T1: exons [100,106) and [110,116): utr5 100-102, cds 102-106 + 110-112, utr3 112-116
    add("T1.2", "1", "+", 2, "exon", 1, 100, 106, "AACATG", 0)
    add("T1.2", "1", "+", 2, "exon", 2, 110, 116, "CCTTTT", 6)
    add("T1.2", "1", "+", 2, "utr5", 1, 100, 102)
    add("T1.2", "1", "+", 2, "cds", 1, 102, 106)
    add("T1.2", "1", "+", 2, "cds", 2, 110, 112)
    add("T1.2", "1", "+", 2, "utr3", 1, 112, 116)
    # T2 on the - strand: exon [200,208); utr5 206-208, cds 203-206, utr3 200-203
    add("T2.1", "1", "-", None, "exon", 1, 200, 208, "GGATGCCC", 0)
    add("T2.1", "1", "-", None, "utr5", 1, 206, 208)
    add("T2.1", "1", "-", None, "cds", 1, 203, 206)
    add("T2.1", "1", "-", None, "utr3", 1, 200, 203)
    add("T3.1", "X", "+", None, "exon", 1, 10, 14, "acgt", 0)
    segs = spark.createDataFrame(
        rows, "tx_id string, chrom string, strand string, appris int, kind string, ordinal int, start long, end long, seq string, before long"
    )
    return genes, tx, segs


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_transcript_tracks(annotation):
    got = by(B.transcript_tracks(annotation[2]), "tx_id")
    assert got["T1.2"].sequence == "AACATGCCTTTT"
    assert got["T1.2"].cds == [0, 0, 1, 0, 0, 1, 0, 0, 0, 0, 0, 0]
    assert got["T1.2"].splice == [0] * 5 + [1] + [0] * 5 + [1]
    assert got["T3.1"].cds == [0, 0, 0, 0] and got["T3.1"].splice == [0, 0, 0, 1]


def test_priority(annotation):
    top = W.top_n_transcripts(annotation[1], 1)
    assert {(r.gene_id, r.tx_id) for r in top.collect()} == {("G1.4", "T2.1"), ("G2.1", "T3.1")}
    lens = annotation[1].withColumn("len", F.lit(5))
    assert {r.tx_id for r in W.principal_transcript(lens).collect()} == {"T1.2", "T3.1"}


def test_translation_efficiency(spark, annotation):
    genes, tx, segs = annotation
    measured = spark.createDataFrame(
        [("T1.9", 0.5, 0), ("T2.3", 0.7, 1), ("T2.4", 0.7, 2), ("T3.1", None, 3), ("T9.1", 1.0, 4), (None, 2.0, 5)], "tx_id string, mean_te double, row_id long"
    )
    rows = B.translation_efficiency(measured, tx, genes, segs).collect()
    assert [(r.transcript_id, r.gene, r.chromosome, r.sequence) for r in rows] == [("T2.1", "ALPHA", "1", "GGATGCCC")]
    assert rows[0].target == pytest.approx(0.7)


def test_mirna_targets(spark, annotation):
    genes, tx, segs = annotation
    rows = [
        ("G1", "ALPHA", "T1.5", "m1,m2", 0), ("G1", "ALPHA", "T2.5", "m2", 1), ("G2", "BETA", "T3.2", "m10", 2),
        ("G2", "None", "T3.2", "m1", 3), ("G3", "GAMMA", "T1.5", "m1", 4), ("G2", "BETA", "T3.2", None, 5), ("G1", "ALPHA", "T3.1", "m1", 6),
    ]
    inter = spark.createDataFrame(rows, "gene_id string, gene_name string, mrna string, mirnas string, row_id long")
    got = B.mirna_targets(inter, tx, genes, segs, ["m1", "m2"])
    assert [(r.transcript_id, r.gene, r.target_m1, r.target_m2) for r in got.collect()] == [("T1.2", "ALPHA", 1, 1)]
    assert dict(got.dtypes)["target_m1"] == "tinyint"


def test_ribosome_load(spark):
    a, b = "A" * 50, "C" * 50
    rows = [(a + "GG", 1.0, "egfp_unmod_1"), (a, 3.0, "egfp_unmod_2"), (a + "T", 5.0, "egfp_unmod_2"), (b, 9.0, "egfp_unmod_1"), (a, 7.0, "egfp_pseudo_1")]
    reps = spark.createDataFrame(rows, "utr string, rl double, experiment string")
    out = B.ribosome_load(reps)
    assert out.columns == ["sequence", "cds", "splice", "target_mrl_egfp_pseudo", "target_mrl_egfp_unmod"]
    got = sorted((r.sequence, r.target_mrl_egfp_unmod, r.target_mrl_egfp_pseudo) for r in out.collect())
    assert got == [(PRIMER + a + EGFP, 2.0, 7.0), (PRIMER + a + EGFP, 3.0, 7.0)]
    row = B.ribosome_load_features(out).first()
    assert (row.u_start, row.u_oof_start, row.kozak_quality) == (0, 0, "strong") and len(row.cds) == len(row.splice) == len(row.sequence)
    cherry = B.ribosome_load(reps.withColumn("experiment", F.replace("experiment", F.lit("egfp"), F.lit("mcherry"))), "mcherry").first()
    assert cherry.sequence.endswith(MCHERRY) and sum(cherry.cds) == 246


def test_localisation(spark, annotation):
    genes, tx, segs = annotation
    measured = spark.createDataFrame([("G1", "ALPHA", 0.0, -4.0, 0.0), ("G2", "BETA", 0.0, 0.0, 5.0)], ["gene_id", "name", "ER log2FC", "NLS log2FC", "OMM log2FC"])
    got = by(B.localisation(measured, tx, genes, segs), "transcript_id")
    assert got["T1.2"].target == [1, 0, 1] and got["T3.1"].target == [0, 0, 1] and got["T3.1"].sequence == "ACGT"


def test_from_tensor(spark):
    x = [[1, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 0], [0, 0, 1, 0, 0, 1], [0] * 6]
    df = spark.createDataFrame([("ALPHA", x, 1.5), ("", x, 2.0), ("NOPE", x, 2.0)], "gene string, X array<array<tinyint>>, target double")
    genes = spark.createDataFrame([("ALPHA", "chr7", 5), ("ALPHA", "chr8", 9)], "gene string, chromosome string, ordinal int")
    rows = B.from_tensor(df, genes).collect()
    assert [(r.gene, r.chromosome, r.sequence, r.cds, r.splice) for r in rows] == [("ALPHA", "7", "ANG", [1, 0, 0], [0, 0, 1])]


def test_variant_effects(spark, annotation):
    genes, tx, segs = annotation
    rows = [
        (1, "1", 101, "A", "G", 1, "5_prime_x"),  # first base of T1
        (2, "1", 113, "T", "C", 0, "3_prime_x"),  # first base of T1's utr3
        (3, "1", 207, "CC", "AG", 1, "5_prime_x"),  # both utr5 bases of T2, - strand
        (4, "1", 104, "A", "T", 1, "5_prime_x"),  # coding: no match
        (5, "1", 101, "A", "G", 1, "intron_x"),
    ]
    variants = spark.createDataFrame(rows, "variant_id long, chrom string, pos long, ref string, alt string, label int, match_group string")
    got = B.variant_effects(variants, tx, genes, segs).collect()
    by_text = {r.description: r for r in got}
    assert len(got) == 5  # two reference rows: T1 appears once although two variants share it
    assert by_text["chr1:101 A:G"].sequence == "GACATGCCTTTT" and by_text["chr1:101 A:G"].target == 1
    assert by_text["chr1:113 T:C"].sequence == "AACATGCCCTTT"
    assert by_text["chr1:207 CC:AG"].sequence == "CTATGCCC"
    assert sum(r.description == "wild-type" and r.target == 0 for r in got) == 2


def test_interval_edges(spark):
    points = spark.createDataFrame([(i, "c", i) for i in range(0, 40)], "id long, chrom string, at long")
    spans = spark.createDataFrame([("a", "c", 0, 1), ("b", "c", 3, 33), ("e", "c", 5, 5), ("d", "d", 0, 40)], "name string, chrom string, start long, end long")
    for width in (1, 4, 1000):
        got = sorted((r.name, r.at) for r in J.interval_join(points, spans, width=width).collect())
        assert got == [("a", 0)] + [("b", i) for i in range(3, 33)]


def test_blocks_of_many_exons(spark):
    rows = [("hot", i + 1, 1 + i % 3) for i in range(500)] + [("t", 1, 4), ("t", 2, 5)]
    df = spark.createDataFrame(rows, "tx_id string, ordinal int, len int")
    got = {(r.tx_id, r.ordinal): r.exon_end for r in W.exon_ends(df, block=16).collect()}
    total = 0
    for t, o, n in rows[:500]:
        total += n
        assert got[t, o] == total
    assert got["t", 2] == 9


def test_first_values_and_duplicates(spark):
    df = spark.createDataFrame([("g", 0, None, "x"), ("g", 1, 5, "y"), ("h", 2, None, None)], "gene string, row_id long, a int, b string")
    assert {r.gene: (r.a, r.b) for r in A.first_per_gene(df, "gene", "row_id").collect()} == {"g": (5, "x"), "h": (None, None)}
    maps = spark.createDataFrame([("a", "x", 3, 0), ("a", "y", 5, 1), ("b", "x", 1, 2), ("c", "z", 2, 3)], "species string, gene_name string, gene_group long, ordinal long")
    assert sorted((r.species, r.gene_group) for r in A.species_map_merge(maps).collect()) == [("a", 3), ("a", 5), ("b", 6), ("c", 8)]
    with pytest.raises(ValueError, match="one to one"):
        J.attach_embeddings(spark.range(3).withColumnRenamed("id", "row_id"), spark.range(4).withColumnRenamed("id", "row_id"))


def test_catalogue(spark):
    tasks = C.task_catalog(C.datasets(spark))
    assert C.datasets(spark).count() == 23
    assert tasks.count() == 40 + 20 + 3 + 2 + 18
    assert tasks.filter("dataset = 'mirna-target' AND target = 'target_hsa-miR-8485' AND task = 'classification'").count() == 1
    grid = J.work_grid(tasks, ["base"], [1, 2])
    splits = {r.dataset: r.n for r in grid.groupBy("dataset").agg(F.countDistinct("split_type").alias("n")).collect()}
    assert splits["mrl-hl-lbkwk"] == 1 and splits["mrl-sample-egfp"] == 3 and splits["go-mf"] == 5
    assert not {"vep-traitgym-complex", "utr-variants-bohn-utr5"} & set(splits)
    assert J.work_grid(tasks, ["base"], [1], canonical=True).filter("split_type <> 'homology'").select("dataset").distinct().count() == 5
    done = grid.filter("NOT (dataset = 'go-mf' AND seed = 2 AND split_type = 'kmer')")
    assert [(r.dataset, r.split_type) for r in J.resume_pending(grid, done).collect()] == [("go-mf", "kmer")]
    with pytest.raises(KeyError):
        C.load(spark, "/nowhere", "nope")


def test_files(spark, tmp_path):
    (tmp_path / "GSM1_egfp_unmod_1.csv").write_text("utr,x,rl\nACG,9,1.5\n")
    (tmp_path / "GSM2_egfp_unmod_2.csv").write_text("rl,utr\n2.5,ACG\n")
    one = R.scan_csv_multi(spark, str(tmp_path / "GSM1_*.csv")).first()
    assert (one.utr, one.rl, one.experiment) == ("ACG", 1.5, "egfp_unmod_1")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "t")
    for force in (False, False, True):
        assert R.read_or_build(spark, path, build, force).count() == 3
    assert len(calls) == 2
    with pytest.raises(ValueError, match="splice"):
        R.from_dataframe(spark.createDataFrame([("A", [1])], "sequence string, cds array<int>"))
    assert R.scan_csv_columns(spark, str(tmp_path / "GSM1_*.csv"), ("rl", "double")).first().rl == 1.5


def test_results_and_report(spark, tmp_path):
    rows = [
        ("d", m, "classification", "t", "default", s, "test", metric, v)
        for m, base in (("zeta", 0.5), ("alpha", 0.7), ("alpha-utronly", 0.9))
        for s, step in ((1, 0.0), (2, 0.2))
        for metric, v in (("auprc", base + step), ("auroc", 0.1))
    ]
    path = str(tmp_path / "results")
    R.sink_results(spark.createDataFrame(rows, R.RESULTS), path)
    again = [r[:8] + (0.0,) for r in rows if r[1] == "zeta" and r[5] == 1]
    R.sink_results(spark.createDataFrame(again, R.RESULTS), path)
    table = R.scan_results(spark, path)
    assert table.count() == 12 and R.scan_results(spark, path, [1], model="zeta").agg(F.sum("value")).first()[0] == 0.0
    classes = spark.createDataFrame([("zeta", "A"), ("alpha", "B")], "model string, model_class string")
    out = report(table, classes).collect()
    assert [r.model for r in out] == ["zeta", "alpha"]
    assert out[1]["mean"] == pytest.approx(0.8) and out[1].ci == pytest.approx(1.96 * 0.1 / 2**0.5)


def test_null_and_empty_targets(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), "b"), (3, None, "c"), (4, 2.0, None)], "row_id long, t double, k string")
    assert [r.row_id for r in P.drop_null(df, "t").collect()] == [1, 4] and P.drop_null(df, "t", "k").count() == 1
    with pytest.raises(ValueError, match="no splits"):
        P.validate_splits(df.withColumn("split", F.lit("train")).limit(0), "t", "k")
    with pytest.raises(ValueError, match="lacks"):
        P.validate_splits(df.withColumn("split", F.lit("train")), "t", "k")
    with pytest.raises(ValueError, match="val is empty"):
        P.validate_splits(df.filter("row_id = 1").withColumn("split", F.lit("train")), "t", "k", ("train", "val"))


def test_variant_at_exon_edges(spark):
    exons = spark.createDataFrame(
        [("p", 1, 100, 104, 0, "AAAA", "+"), ("p", 2, 200, 204, 4, "CCCC", "+"), ("m", 1, 200, 204, 0, "AAAA", "-"), ("m", 2, 100, 104, 4, "CCCC", "-")],
        "tx_id string, ordinal int, start long, end long, before long, seq string, strand string")
    variants = spark.createDataFrame(
        [(1, "p", 104, "AA", "GG"),  # last base of exon 1 and the intron
         (2, "p", 204, "CC", "GG"),  # past the transcript's end
         (3, "m", 104, "GG", "TA"),  # leaves the second exon on its 5' side
         (4, "m", 204, "TT", "GG"),  # past the transcript's start
         (5, "p", 101, "A", "GTG"), (6, "m", 101, "GG", "T")],
        "variant_id int, tx_id string, pos long, ref string, alt string")
    got = {r.variant_id: r.var_sequence for r in B.apply_variant(exons, variants).collect()}
    assert got == {1: "AAAGCCCC", 2: "AAAACCCG", 3: "AAAAACCC", 4: "CAAACCCC", 5: "GTGAAACCCC", 6: "AAAACCA"}
