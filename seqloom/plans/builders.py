"""Dataset tables from raw measurements and gene annotation.

Annotation comes as three tables: `genes(gene_id, gene, chromosome, ordinal)`,
`transcripts(tx_id, gene_id, strand, is_mane, appris, ordinal)` and
`segments(tx_id, kind, ordinal, start, end, seq)` with kinds exon, cds, utr5 and utr3.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.constants import (
    EGFP, EGFP_CODONS, LOCALISED_SHARE, MCHERRY, MCHERRY_CODONS, PRIMER,
)
from seqloom.functions import sequence as S
from seqloom.operators import aggregates as A, joins as J, projections as P, sets as U, windows as W
from seqloom.sources.readers import tensor_rows


def assemble_sequence(exons: DataFrame, seq: str = "seq") -> DataFrame:
    """`tx_id, sequence`: exon texts joined in transcript order. A transcript is one row of the result."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", seq)))
    return exons.groupBy("tx_id").agg(F.array_join(F.transform(ordered, lambda x: x[seq]), "").alias("sequence"))


def transcript_tracks(segments: DataFrame, seq: str = "seq") -> DataFrame:
    """`tx_id, sequence, cds, splice` in one aggregation over a transcript's segments."""
    size = F.col("end") - F.col("start")

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, size)), F.lit(0)).cast("int")

    exon = F.when(F.col("kind") == "exon", F.struct(F.col("ordinal"), size.cast("int").alias("len"), F.col(seq)))
    parts = segments.groupBy("tx_id").agg(
        F.array_sort(F.collect_list(exon)).alias("exons"),
        *[total(k).alias(k) for k in ("utr5", "cds", "utr3", "exon")],
    )
    length = F.when(F.col("cds") > 0, F.col("utr5") + F.col("cds") + F.col("utr3")).otherwise(F.col("exon"))
    return parts.select(
        "tx_id",
        F.array_join(F.transform("exons", lambda e: e[seq]), "").alias("sequence"),
        S.cds_track(F.col("utr5"), F.col("cds"), F.col("utr3"), F.col("exon")).alias("cds"),
        S.splice_track(F.transform("exons", lambda e: e["len"]), length).alias("splice"),
    )


def apply_variant(exons: DataFrame, variants: DataFrame) -> DataFrame:
    """`variant_id, tx_id, var_sequence`: the transcript with REF replaced by ALT.

    `variants` names the matched transcript. `exons` has genome coordinates, strand, `before` (bases of
    the transcript ahead of the exon) and the exon text. On the - strand the transcript runs
    backwards, so the allele's last genomic base comes first and ALT is complemented.
    A variant belongs to the exon that holds its first genomic base. Where REF runs on past that exon, the bases of REF
    within it are replaced by as many of ALT's; other exons stay as they are.
    """
    first = F.col("pos") - 1
    last = F.least(first + F.length("ref"), F.col("end"))  # one past the last base within the exon
    hit = exons.join(variants, "tx_id").filter((F.col("start") <= first) & (first < F.col("end")))
    forward = F.col("strand") == "+"
    offset = F.col("before") + F.when(forward, first - F.col("start")).otherwise(F.col("end") - last)
    within = F.when(first + F.length("ref") <= F.col("end"), F.col("alt")).otherwise(F.left("alt", (F.col("end") - first).cast("int")))
    alt = F.when(forward, within).otherwise(S.reverse_complement(within))
    placed = hit.select("variant_id", "tx_id", offset.alias("_at"), alt.alias("_alt"), (last - first).cast("int").alias("_len"))
    whole = assemble_sequence(exons.join(variants.select("tx_id").distinct(), "tx_id", "left_semi"))
    return placed.join(whole, "tx_id").select(
        "variant_id",
        "tx_id",
        F.overlay(F.col("sequence"), F.col("_alt"), F.col("_at").cast("int") + 1, F.col("_len")).alias("var_sequence"),
    )


def _annotated(rows: DataFrame, transcripts: DataFrame, genes: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds gene, chromosome, sequence and tracks to rows with a `tx_id`."""
    names = genes.select("gene_id", "gene", S.strip_chr(F.col("chromosome")).alias("chromosome"))
    wanted = segments.join(rows.select("tx_id").distinct(), "tx_id", "left_semi")
    rows = rows.drop("gene_id", "gene", "chromosome")
    return (
        rows.join(transcripts.select("tx_id", "gene_id"), "tx_id")
        .join(names, "gene_id")
        .join(transcript_tracks(wanted), "tx_id")
        .withColumnRenamed("tx_id", "transcript_id")
    )


HEAD = ("transcript_id", "gene", "chromosome", "sequence", "cds", "splice")


def translation_efficiency(measured: DataFrame, transcripts: DataFrame, genes: DataFrame, segments: DataFrame) -> DataFrame:
    """`measured(tx_id, mean_te, row_id)`: the transcript with the highest value of each gene."""
    known = P.drop_null(measured, "tx_id", "mean_te").withColumnRenamed("tx_id", "measured_id")
    matched = J.versionless_join(known, "measured_id", transcripts, "tx_id", "ordinal")
    best = A.max_te_per_gene(matched.select("gene_id", "tx_id", "mean_te", "row_id"), "gene_id", "mean_te", "row_id")
    table = P.skip_empty_seq(_annotated(best, transcripts, genes, segments))
    return table.select(*HEAD, F.col("mean_te").cast("float").alias("target"))


def mirna_targets(
    interactions: DataFrame, transcripts: DataFrame, genes: DataFrame, segments: DataFrame, names: Sequence[str]
) -> DataFrame:
    """`interactions(gene_id, gene_name, mrna, mirnas, row_id)`: 0/1 targets, one transcript per gene.

    Gene and transcript ids are compared without versions.
    """
    plain = transcripts.withColumn("_gene", S.versionless(F.col("gene_id")))
    top = W.top_n_transcripts(plain.withColumn("gene_id", F.col("_gene")), 5)
    known = interactions.join(top.select("gene_id").distinct(), "gene_id", "left_semi")
    lookup = J.last_wins(
        top.withColumn("_pair", F.concat_ws("|", "gene_id", S.versionless(F.col("tx_id")))), "_pair", "priority", ["tx_id"]
    )
    kept = known.withColumn("_key", F.concat_ws("|", "gene_id", S.versionless(F.col("mrna")))).join(lookup, "_key")
    kept = P.drop_bad_gene(kept, "gene_name")
    labelled = kept.select("gene_id", "row_id", "tx_id", *A.multi_hot(F.col("mirnas"), names))
    targets = [f"target_{n}" for n in names]
    first = A.first_per_gene(P.any_label_filter(labelled, targets), "gene_id", "row_id")
    return _annotated(first, transcripts, genes, segments).select(*HEAD, *targets)


def ribosome_load(replicates: DataFrame, reporter: str = "egfp", trim: int | None = 50, codons: int | None = None) -> DataFrame:
    """`replicates(utr, rl, experiment)`: mean load per experiment family of inserts every replicate has.

    Equal inserts within a replicate (trimming can make some) pair up many-to-many. `codons`
    overrides the reading frame's length.
    """
    utr = F.left("utr", F.lit(trim)) if trim else F.col("utr")
    rows = replicates.select(utr.alias("utr"), "rl", "experiment")
    names = sorted(r["experiment"] for r in rows.select("experiment").distinct().collect())  # one per file
    frames = [
        rows.filter(F.col("experiment") == n).select("utr", F.col("rl").alias(n)) for n in names
    ]
    joined = J.replicate_join(frames, "utr")
    means = A.replicate_mean(joined, "utr", names)
    tail, frame = (MCHERRY, MCHERRY_CODONS) if reporter == "mcherry" else (EGFP, EGFP_CODONS)
    n = frame if codons is None else codons
    built = means.withColumns(
        {
            "sequence": S.flank(F.col("utr"), PRIMER, tail),
            "cds": S.fixed_cds_track(F.col("utr"), PRIMER, n, len(tail) - 3 * n),
        }
    )
    built = built.withColumn("splice", S.zeros(F.size("cds"))).drop("utr")
    return P.prefix_targets(built, "target_mrl_")


def ribosome_load_features(df: DataFrame) -> DataFrame:
    """Adds upstream start codons and the start context, read back from the construct."""
    utr = S.extract_utr(F.col("sequence"), PRIMER, EGFP)
    return df.withColumns(
        {
            "u_start": S.upstream_start(utr),
            "u_oof_start": S.upstream_oof_start(utr),
            "kozak_quality": S.kozak_quality(utr),
        }
    )


def localisation(measured: DataFrame, transcripts: DataFrame, genes: DataFrame, segments: DataFrame) -> DataFrame:
    """`measured(gene_id, <*log2FC*>)`: compartments holding at least an eighth, on the principal transcript."""
    columns = [c for c in measured.columns if "log2FC" in c]
    _, flags = A.row_normalise([F.col(f"`{c}`") for c in columns], LOCALISED_SHARE)
    labels = measured.select(S.versionless(F.col("gene_id")).alias("_gene"), flags.alias("target"))
    lengths = segments.filter("kind = 'exon'").groupBy("tx_id").agg(F.sum(F.col("end") - F.col("start")).alias("len"))
    principal = W.principal_transcript(transcripts.join(lengths, "tx_id"))
    chosen = principal.withColumn("_gene", S.versionless(F.col("gene_id"))).join(labels, "_gene")
    table = _annotated(chosen.drop("_gene"), transcripts, genes, segments)
    return P.skip_empty_seq(table).select(*HEAD, "target")


def from_tensor(tensors: DataFrame, genes: DataFrame) -> DataFrame:
    """`tensors(gene, X, target)`: six-track tensors as text and tracks, with the gene's chromosome."""
    named = J.chromosome_lookup(tensor_rows(P.drop_bad_gene(tensors)), genes)
    return named.withColumn("chromosome", S.strip_chr(F.col("chromosome")))


def variant_effects(variants: DataFrame, transcripts: DataFrame, genes: DataFrame, segments: DataFrame) -> DataFrame:
    """Reference and variant rows of variants in untranslated regions.

    `segments` also carry chrom, strand, appris, and exons `before`.
    """
    wanted = P.filter_regex(variants, "match_group", "5_prime|3_prime")
    region = F.when(F.col("match_group").startswith("5_prime"), "utr5").otherwise("utr3")
    matched = J.variant_utr_match(wanted.withColumn("region", region), segments).dropna(subset=["tx_id"])
    changed = apply_variant(segments.filter("kind = 'exon'"), matched)
    tracks = _annotated(matched.drop("chrom"), transcripts, genes, segments)
    both = (
        tracks.join(changed.select("variant_id", "var_sequence"), "variant_id")
        .withColumnsRenamed({c: f"ref_{c}" for c in ("sequence", "cds", "splice")})
        .withColumns({"var_cds": F.col("ref_cds"), "var_splice": F.col("ref_splice")})
        .withColumnRenamed("chromosome", "chrom")
    )
    rows = U.union_ref_var(both)
    return A.dedupe_subset(rows, ["transcript_id", "sequence", "target", "description"], "row_id")
