"""Connected components of links, in Spark for any number of them and in numpy for those of one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.session import cut_lineage

SPREAD = 32  # tasks over which a node's links are spread


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of links a-b."""
    nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = of[: len(a)], of[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _minima(both: DataFrame) -> DataFrame:
    """a, least (its smallest neighbour, or itself), place: a copy for each place where larger neighbours of `a` are."""
    place = F.when(F.col("b") > F.col("a"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(b), {SPREAD}) as int))"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"), F.coalesce(F.bit_or(place), F.lit(0)).alias("places"))
    taken = F.filter(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.getbit("places", i) == 1)
    return least.select("a", "least", F.explode(taken).alias("place"))


def _place() -> Column:
    return F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of links a-b, root being the smallest node of the component.

    Alternates two kinds of steps until nothing changes: larger neighbours are linked to a node's smallest neighbour, then
    smaller ones. Minima are aggregated before they are joined, and a node with very many links is spread over tasks.
    Every round is written to the checkpoint folder.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut_lineage(links)
    known = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the centre of a star has very many larger neighbours: they meet copies of its minimum in `SPREAD` places
        larger = both.where("b > a").withColumn("place", _place())
        large = larger.join(_minima(both), ["a", "place"]).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(low, "a")
        small = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(low.select("a", F.col("least").alias("b")))
        links = cut_lineage(small.where("a <> b").distinct())
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        known = state
