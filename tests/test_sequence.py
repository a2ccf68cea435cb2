import pytest
from pyspark.sql import functions as F

from seqloom.constants import EGFP, MCHERRY, PRIMER
from seqloom.functions import sequence as S

# The sequences and tracks of the examples below, and what must come of them.

SC = "s string, c array<tinyint>"


def regions(one, seq, cds, k=3):
    s, c = F.col("s"), F.col("c")
    return one(SC, (seq, cds), S.get_cds(s, c), S.utr5(s, c), S.utr3(s, c, k), S.mark_codons(s, c), S.space_regions(s, c), S.cds_length(c))


def test_one_hot_both_ways(one):
    (ohe,) = one("s string", ("ACGTN",), S.str_to_ohe(F.col("s")))
    assert ohe == [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0]]
    back = S.ohe_to_str(F.col("x"))
    assert one("x array<array<tinyint>>", ([[1, 0, 0, 0], [0, 0, 0, 0], [0, 0, 1, 0]],), back) == ("ANG",)
    assert one("x array<array<tinyint>>", ([[1, 0, 0, 0], [0, 1, 0, 0], [0] * 4, [0] * 4],), back) == ("AC",)
    assert one("x array<array<tinyint>>", ([],), back) == ("",)
    with pytest.raises(Exception, match="not a base"):
        one("s string", ("AXC",), S.str_to_ohe(F.col("s")))


def test_tracks(one):
    i = "a int, b int, c int, n int"
    track = S.cds_track(F.col("a"), F.col("b"), F.col("c"), F.col("n"))
    assert one(i, (2, 7, 3, 12), track) == ([0, 0, 1, 0, 0, 1, 0, 0, 1, 0, 0, 0],)
    assert one(i, (0, 0, 0, 4), track) == ([0, 0, 0, 0],)
    splice = S.splice_track(F.col("l"), F.col("n"))
    assert one("l array<int>, n int", ([2, 3, 1], 6), splice) == ([0, 1, 0, 0, 1, 1],)
    assert one("l array<int>, n int", ([2, 0, 1], 5), splice) == ([0, 1, 1, 0, 0],)


def test_six_track(one):
    six = S.six_track(F.col("s"), F.col("c"), F.col("p"))
    got = one(SC + ", p array<tinyint>", ("AN", [1, 0], [0, 1]), six)
    assert got == ([[1, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 1]],)


def test_coding_region(one):
    assert regions(one, "CCGATGCCG", [0, 0, 0, 1, 0, 0, 0, 0, 0])[0] == "ATG"
    assert regions(one, "CCGATGCCG", [0] * 9)[0] == "CCGATGCCG"
    assert regions(one, "CCGATGCC", [0] * 8)[0] == "CCGATG"
    assert regions(one, "CCGATGCCG", [0, 0, 0, 0, 1, 0, 0, 1, 0])[0] == "TGC"
    assert regions(one, "CCGATGCCG", [0, 0, 0, 0, 0, 1, 0, 0, 1])[0] == "GCC"


def test_untranslated_regions(one):
    assert regions(one, "AAAGGG", [0, 0, 0, 1, 1, 1])[1] == "AAA"
    assert regions(one, "AAAGGG", [0] * 6)[1] == "AAAGGG"
    assert regions(one, "AAAGGG", [1, 0, 0, 0, 0, 0])[1] == "AAAGGG"
    assert regions(one, "ATGATGATG", [0, 1, 0, 0, 0, 0, 0, 0, 0])[2] == "TGATG"
    assert regions(one, "ATGATGATG", [0] * 9)[2] == "ATGATGATG"
    assert regions(one, "ATGATGATG", [0, 0, 0, 0, 0, 1, 0, 0, 0])[2] == "ATGATGATG"
    assert regions(one, "ATGATG", [1, 0, 0, 0, 0, 0])[2] == "ATG"


def test_codon_marks_and_spacing(one):
    assert regions(one, "AUGUAG", [0, 0, 0, 1, 0, 0])[3] == "AUGEUAG"
    assert regions(one, "AUGUAG", [0, 0, 0, 1, 0, 1])[3] == "AUGEUAEG"
    assert regions(one, "AUGUAG", [0] * 6)[3] == "AUGUAG"
    assert regions(one, "AACTGCGTG", [0, 0, 1, 0, 0, 0, 0, 0, 0])[4] == "A A CTG C G T G"
    assert regions(one, "ACG", [0, 0, 0])[4] == "A C G"
    assert regions(one, "ACGTA", [0, 1, 0, 0, 1])[4] == "A CGT A"


def test_lengths(one):
    assert regions(one, "ATGATGATG", [0, 0, 0, 1, 0, 0, 0, 0, 0])[5] == 3
    assert regions(one, "ATGATG", [0] * 6)[5] == 0
    assert one("c array<tinyint>", ([1, 0, 0, 1],), S.exon_count(F.col("c"))) == (2,)
    s = F.col("s")
    for text, gc in (("GCGCGC", 1.0), ("ATATAT", 0.0), ("ANGN", 0.5), ("NNN", None), ("", None)):
        assert one("s string", (text,), S.gc_content(s)) == (gc,)


def test_chunks(one):
    s = F.col("s")
    assert one("s string", ("ACGTA",), S.chunk_sequence(s, 2), S.chunk_backfill(s, 2), S.chunk_backfill(s, 9)) == (
        ["AC", "GT", "A"], ["AC", "GT", "TA"], ["ACGTA"],
    )
    assert one("s string", ("",), S.chunk_sequence(s, 2), S.chunk_backfill(s, 2)) == ([], [])
    assert one("t array<int>", ([5, 6, 7],), S.chunk_tokens(F.col("t"), 2)) == ([[5, 6], [7]],)
    assert one("t array<int>", ([],), S.chunk_tokens(F.col("t"), 2)) == ([],)
    t = F.col("t")
    edge = lambda p, n: S.edge_tokens(t, F.lit(p), F.lit(n))
    assert one("t array<int>", ([0, 5, 6, 9],), edge(0, 1), edge(0, 3), edge(1, 3), edge(2, 3), S.wrap_tokens(t)) == (
        [0, 5, 6], [0, 5, 6], [5, 6], [5, 6, 9], [1, 0, 5, 6, 9, 2],
    )


def test_padding(one):
    s = F.col("s")
    pad, bins = one("s string", ("ACG",), S.center_pad(s, 8), S.valid_bins(s, 8, 2))
    assert pad == "NNACGNNN" and tuple(bins) == (1, 3)
    assert one("s string", ("ACGT",), S.center_pad(s, 4))[0] == "ACGT"


def test_reporter_construct(one):
    s = F.col("s")
    built, track = one("s string", ("ACGT",), S.flank(s, PRIMER, EGFP), S.fixed_cds_track(s, PRIMER, 244, len(EGFP) - 732))
    assert built == PRIMER + "ACGT" + EGFP and len(track) == len(built)
    assert sum(track) == 244 and track.index(1) == 29
    assert one("s string", (built,), S.extract_utr(s, PRIMER, EGFP)) == ("ACGT",)
    assert len(EGFP) == len(MCHERRY) == 780


@pytest.mark.parametrize(
    "utr, found, out",
    [("", 0, 0), ("AT", 0, 0), ("ATG", 1, 0), ("ATGC", 1, 1), ("CCATGAAA", 1, 0), ("atgATGa", 1, 1), ("AATGATGG", 1, 1)],
)
def test_upstream_start(one, utr, found, out):
    at = [i for i in range(len(utr) - 2) if utr[i : i + 3].upper() == "ATG"]
    assert (found, out) == (int(bool(at)), int(any((len(utr) - i) % 3 for i in at)))
    assert one("s string", (utr,), S.upstream_start(F.col("s")), S.upstream_oof_start(F.col("s"))) == (found, out)


@pytest.mark.parametrize(
    "utr, quality",
    [("CCACC", "strong"), ("GCC", "strong"), ("TGT", "weak"), ("TGC", "weak"), ("TCC", "mixed"), ("acc", "mixed"), ("", "mixed"), ("A", "strong"), ("TG", "weak"), ("C", "mixed")],
)
def test_kozak(one, utr, quality):
    assert one("s string", (utr,), S.kozak_quality(F.col("s"))) == (quality,)


def test_names(one):
    s = F.col("s")
    assert one("s string", ("chrXchr",), S.strip_chr(s)) == ("Xchr",)
    assert one("s string", ("ENST1.12",), S.versionless(s)) == ("ENST1",)
    assert one("s string", ("AACG",), S.reverse_complement(s), S.to_rna(s), S.space_bases(s)) == ("CGTT", "AACG", "A A C G")


def test_kmer_numbers(spark):
    names = ["AAA", "AAC", "ACA", "ACC", "CAA", "CAC", "CCA", "CCC"]
    got = spark.range(8).select(S.kmer_name(F.col("id"), (3,), "AC").alias("k")).collect()
    assert [r.k for r in got] == names
    ids = spark.range(21824).select("id", S.kmer_index(S.kmer_name(F.col("id"))).alias("back"))
    assert ids.filter("id <> back").count() == 0


def test_tensors_and_tracks_by_batch(one, spark, tmp_path):
    """Tracks that differ in length, nulls, numbers of several digits; tensors come back from files in small row groups."""
    import pyarrow.parquet as pq

    from seqloom.sources import readers as R

    six = S.six_track(F.col("s"), F.col("c"), F.col("p"))
    assert one(SC + ", p array<tinyint>", ("AN", [1], [0, 1]), six) == ([[1, 0, 0, 0, 1, 0], [0, 0, 0, 0, None, 1]],)
    assert one(SC + ", p array<tinyint>", ("A", [1, 1], [0]), six) == ([[1, 0, 0, 0, 1, 0], None],)
    assert one(SC + ", p array<tinyint>", (None, [1], [0]), six) == (None,)
    assert one("x array<array<tinyint>>", ([[0, 1, 0, 0], None, [1, 0, 0, 0], [0, 0, 0, 0]],), S.ohe_to_str(F.col("x"))) == ("CA",)
    assert one("c array<tinyint>", ([1, 0, None, 12, -1],), S.digits(F.col("c"))) == ("1012-1",)
    assert one("x array<array<tinyint>>", ([[1, 0], [], [7]],), S.digits(F.col("x"))) == ("107",)
    rows = [(i, "ACGTN"[i % 3 :] * i + "A", [1] * (i * (5 - i % 3) + 1), [0] * (i * (5 - i % 3) + 1)) for i in range(200)]
    table = spark.createDataFrame(rows, "row_id long, sequence string, cds array<tinyint>, splice array<tinyint>").coalesce(1)
    path = str(tmp_path / "tensors")
    R.sink_tensors(table, path, pad=3)
    files = [pq.ParquetFile(f) for f in (tmp_path / "tensors").glob("*.parquet")]
    assert max(f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)) <= R.TENSOR_ROWS
    got = {r.row_id: (r.sequence, r.cds, r.splice) for r in R.tensor_rows(spark.read.parquet(path)).collect()}
    assert got == {i: (s, c, p) for i, s, c, p in rows}
