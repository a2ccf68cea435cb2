"""Leakage-aware train, validation and test splits.

A splitter is a function `(df, test_size, seed, **options) -> df + side` with `side` either train
or test. It reads only key columns, so project to them first and join the result by row id.
Randomness is a seeded hash order: the rules are those of a shuffle, and the outcome is the same
on any cluster.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.constants import DEFAULT_RATIOS
from seqloom.functions.kmers import kmer_bytes
from seqloom.functions.sequence import bytes_of
from seqloom.operators.clusters import tree_clusters
from seqloom.operators.joins import homology_lookup
from seqloom.operators.prefix import fill_cuts, lay_out, shuffle_order, up_to_cut
from seqloom.session import cut_lineage, spread

Splitter = Callable[..., DataFrame]

FOLD_ROWS = 1 << 16  # items that one task walks one by one, and names that are broadcast


def _sides(df: DataFrame, if_filled: str, otherwise: str) -> DataFrame:
    return df.withColumn("side", F.when(F.col("filled"), if_filled).otherwise(otherwise)).drop("filled")


def split_random(df: DataFrame, test_size: float, seed: int) -> DataFrame:
    """Exactly ceil(test_size * rows) test rows. Only sums per hash prefix are shuffled."""
    keyed = df.select(shuffle_order("row_id", seed).alias("_order"), F.lit(1).alias("_one"))
    cuts = fill_cuts(keyed, "_order", "_one", lambda n: F.ceil(n * test_size))
    return _sides(up_to_cut(df, shuffle_order("row_id", seed), cuts), "test", "train")


def split_homology(
    df: DataFrame, test_size: float, seed: int, homology: DataFrame, group_unmapped: bool = False
) -> DataFrame:
    """Genes of one homology group stay together; an unmapped gene's rows are groups of their own.

    A group enters the order at its first row. Train takes whole groups while it holds fewer than
    floor(rows * (1 - test_size)) rows. With `group_unmapped`, rows of one unmapped gene stay together.
    """
    group = F.concat(F.lit("group:"), F.col("gene_group").cast("string"))
    if group_unmapped:
        group = F.coalesce(group, F.concat(F.lit("gene:"), F.col("gene")))
    rows = homology_lookup(df, homology).select(
        *df.columns, group.alias("_group"), shuffle_order("row_id", seed).alias("_order")
    )
    # rows without a group are placed by their own order: they meet no join and no null key
    alone, grouped = rows.filter("_group IS NULL"), rows.filter("_group IS NOT NULL")
    groups = grouped.groupBy("_group").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n"))
    items = groups.select("_first", "_n").unionByName(
        alone.select(F.col("_order").alias("_first"), F.lit(1).cast("bigint").alias("_n"))
    )
    cuts = fill_cuts(items, "_first", "_n", lambda n: F.floor(n * (1 - test_size)))
    placed = grouped.join(groups.select("_group", "_first"), "_group").select(*df.columns, "_first")
    ordered = placed.unionByName(alone.select(*df.columns, F.col("_order").alias("_first")))
    return _sides(up_to_cut(ordered, "_first", cuts), "train", "test").drop("_first")


def first_fit(counts: DataFrame, order: str, size: str, limit: int, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """`counts` with `taken`: in `order`, an item is taken if it still fits into `limit` beside those taken before.

    Done in rounds over ranges of the order. What is larger than the room left can never fit and is out; of the rest, all up to the
    first that overflows are taken, which leaves less room for the next round after that one. A round adds up sizes per range and
    walks the one range with the overflow. Once no more than `fold_rows` items are left, one task walks them.
    """
    rounds: list[tuple] = []  # after this item, before that one, at most this size
    room, after, walked = int(limit), None, None
    few = counts.limit(fold_rows + 1).count() <= fold_rows
    laid = counts if few else lay_out(counts, order)[0]
    if few:
        walked = counts.select(order, size).coalesce(1).sortWithinPartitions(order).mapInArrow(_walk(room), _field(counts, order))
    while room > 0 and not few:
        left = laid.where(F.col(size) <= room)
        left = left if after is None else left.where(F.col(order) > F.lit(after))
        parts = sorted((r["_part"], r["s"], r["n"]) for r in left.groupBy("_part").agg(F.sum(size).alias("s"), F.count(F.lit(1)).alias("n")).collect())
        if sum(n for _, _, n in parts) <= fold_rows:
            walked = left.select(order, size).coalesce(1).sortWithinPartitions(order).mapInArrow(_walk(room), _field(laid, order))
            break
        used, over = 0, None
        for part, s, _ in parts:
            if used + s > room:
                over = part
                break
            used += s
        if over is None:
            rounds.append((after, None, room))
            break
        inside = left.where(F.col("_part") == over).select(order, size).coalesce(1).sortWithinPartitions(order)
        found = inside.mapInArrow(_overflow(room - used), f"{_field(laid, order)}, used long").first()
        rounds.append((after, found[0], room))
        room, after = room - used - found[1], found[0]
    taken = F.lit(False)
    for low, high, most in rounds:
        here = F.col(size) <= most
        here = here if low is None else here & (F.col(order) > F.lit(low))
        here = here if high is None else here & (F.col(order) < F.lit(high))
        taken = taken | here
    out = laid.drop("_part").withColumn("taken", taken)
    if walked is None:
        return out
    late = walked.withColumn("_late", F.lit(True))
    return out.join(late, order, "left").withColumn("taken", F.col("taken") | F.coalesce("_late", F.lit(False))).drop("_late")


def _field(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def _walk(room: int):
    """The items that a first fit into `room` takes."""

    def walk(batches):
        left = room
        for batch in batches:
            kept = []
            for i, n in enumerate(batch.column(1).to_pylist()):
                if n <= left:
                    left -= n
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64()))], names=batch.schema.names[:1])

    return walk


def _overflow(room: int):
    """The first item beyond `room`, and the sum before it."""

    def find(batches):
        used = 0
        for batch in batches:
            sizes = np.asarray(batch.column(1)).astype(np.int64)
            up_to = used + np.cumsum(sizes)
            at = int(np.searchsorted(up_to, room, side="right"))
            if at < len(sizes):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([int(up_to[at] - sizes[at])], pa.int64())], names=[batch.schema.names[0], "used"])
                return
            used = int(up_to[-1]) if len(sizes) else used

    return find


def split_chromosome(df: DataFrame, test_size: float, seed: int) -> DataFrame:
    """Whole chromosomes go to test while they fit in floor(test_size * rows) rows; if none does, the smallest goes."""
    counts = df.groupBy(F.col("chromosome").cast("string").alias("_name")).agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts.withColumn("_order", F.coalesce(shuffle_order("_name", seed), F.lit(""))))
    whole = counts.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("names")).first()
    if not whole["names"]:
        raise ValueError("cannot split an empty table")
    if whole["names"] == 1:
        raise ValueError("cannot split by chromosome with only one chromosome")
    fitted = first_fit(counts, "_order", "_n", math.floor(whole["rows"] * test_size)).where("taken")
    if not fitted.limit(1).count():
        fitted = counts.orderBy("_n", "_order", "_name").limit(1)
    fitted = cut_lineage(fitted.select("_name", F.lit(True).alias("_test")))
    few = fitted.count() <= FOLD_ROWS
    joined = df.join(F.broadcast(fitted) if few else fitted, F.col("chromosome").cast("string").eqNullSafe(F.col("_name")), "left")
    return joined.withColumn("side", F.when(F.col("_test"), "test").otherwise("train")).drop("_name", "_test")


def _letters(batches):
    """The different letters of a task's sequences."""
    seen: set[str] = set()
    met = np.zeros(256, bool)
    for batch in batches:
        raw, ends = bytes_of(batch.column(0))
        high = raw >= 128
        met[raw[~high]] = True
        if high.any():  # letters of several bytes, in the rows that have them
            for i in np.unique(np.searchsorted(ends, np.flatnonzero(high), side="right") - 1):
                seen.update(bytes(raw[ends[i] : ends[i + 1]]).decode())
    seen.update(map(chr, np.flatnonzero(met[:128])))
    yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["letter"])


def kmeans_clusters(df: DataFrame, k: int, n_clusters: int, seed: int) -> DataFrame:
    """`row_id, cluster` from k-means over the counts of all observed k-mers of the lower-cased sequence.

    Clusters are the leaves of a tree of centres (`tree_clusters`): none is empty, and the work of a row grows with the
    depth of the tree and not with `n_clusters`. Counts are dense vectors over the small vocabulary; columns no sequence has
    are zero everywhere and change no distance.
    """
    low = spread(df.select("row_id", "sequence"), "row_id").withColumn("sequence", F.lower("sequence"))
    seen = low.select("sequence").mapInArrow(_letters, "letter string").distinct()
    letters = "".join(sorted({r[0] for r in seen.collect()} | set("acgtn")))  # the letters of an alphabet
    if len(letters) > 90:
        raise ValueError(f"sequences of {len(letters)} different letters")
    code = "".join(chr(33 + i) for i in range(len(letters)))  # a byte each
    vectors = kmer_bytes(low.withColumn("sequence", F.translate("sequence", letters, code)), k, code)
    return tree_clusters(vectors, n_clusters, seed)


def split_clusters(df: DataFrame, clusters: DataFrame, test_size: float, seed: int) -> DataFrame:
    """Whole clusters go to test, in shuffled order, until test reaches floor(test_size * rows). Keeps `cluster`."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_order", shuffle_order("cluster", seed))
    cuts = fill_cuts(sizes, "_order", "_n", lambda n: F.floor(n * test_size))
    joined = df.join(clusters, "row_id")
    return _sides(up_to_cut(joined, shuffle_order("cluster", seed), cuts), "test", "train")


def split_kmer(
    df: DataFrame, test_size: float, seed: int, k: int = 3, n_clusters: int | None = None, rows_per_cluster: int = 100,
    keep_cluster: bool = False,
) -> DataFrame:
    """Clusters of similar k-mer counts stay together, one cluster per `rows_per_cluster` rows, two at least."""
    n_clusters = n_clusters or max(2, df.count() // rows_per_cluster)
    clusters = cut_lineage(kmeans_clusters(df, k, n_clusters, seed))  # they are counted, cut and joined
    out = split_clusters(df, clusters, test_size, seed)
    return out if keep_cluster else out.drop("cluster")


def split_hard_kmer(
    df: DataFrame, test_size: float, seed: int, k: int = 3, n_clusters: int | None = None, keep_cluster: bool = False
) -> DataFrame:
    """As `split_kmer` with a tenth of the clusters."""
    return split_kmer(df, test_size, seed, k, n_clusters, 1000, keep_cluster)


CATALOGUE: dict[str, Splitter] = {
    "default": split_random,
    "homology": split_homology,
    "kmer": split_kmer,
    "chromosome": split_chromosome,
    "hard-kmer": split_hard_kmer,
}


def split_three_way(
    splitter: Splitter, df: DataFrame, ratios: Sequence[float] | None = None, seed: int = 2541, **options
) -> DataFrame:
    """`df` with `split` in train, val, test: the rest of a first split is split again.

    A zero ratio leaves that part empty. Any function with a splitter's signature can be passed.
    Pass key columns only: the first split is written once before the second reads it.
    """
    train, val, test = ratios = tuple(ratios or DEFAULT_RATIOS)
    if abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("split ratios must sum to 1")
    known = inspect.signature(splitter).parameters
    if not any(p.kind is p.VAR_KEYWORD for p in known.values()):
        unknown = set(options) - set(known)
        if unknown:
            raise TypeError(f"unknown split options: {sorted(unknown)}")

    held = val + test
    if held == 0:
        return df.withColumn("split", F.lit("train"))
    if train == 0:
        kept, rest = None, df
    else:
        first = splitter(df, held, seed, **options)
        if val and test:
            first = cut_lineage(first)  # a second split passes over the held-out keys several times
        kept = first.filter("side = 'train'").drop("side").withColumn("split", F.lit("train"))
        rest = first.filter("side = 'test'").drop("side")
    if val == 0 or test == 0:
        rest = rest.withColumn("split", F.lit("test" if val == 0 else "val"))
    else:
        second = splitter(rest, test / held, seed, **options)
        rest = second.withColumn("split", F.when(F.col("side") == "train", "val").otherwise("test")).drop("side")
    return rest if kept is None else kept.unionByName(rest)


def get_splits(
    df: DataFrame,
    split_type: str = "homology",
    ratios: Sequence[float] | None = None,
    seed: int = 2541,
    species: str | None = None,
    homology: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Split by catalogue name. Homology uses the rows of its map for the dataset's species."""
    if split_type not in CATALOGUE:
        raise ValueError(f"unknown split type: {split_type}")
    if split_type == "homology":
        if homology is None:
            raise ValueError("the homology split needs a homology map")
        if species is not None and "species" in homology.columns:
            homology = homology.filter(F.col("species") == species)
        options["homology"] = homology
    return split_three_way(CATALOGUE[split_type], df, ratios, seed, **options)
