"""Documents linked by the Jaccard similarity of their word shingles (operator 8).

Method: an R-tree over count vectors. A text's shingles are hashed into groups, and the counts per group are a point; two texts share at
most the sum of the smaller counts, and two boxes of points at most the sum of their smaller upper corners. Pairs of leaves and then of
points that this bound leaves are verified on the sets themselves.

Points of unrelated texts of one size lie close, so the tree holds only texts that can have a partner. Of every second shingle it is
found out whether another text has it; a text with more shingles of its own than a link may leave out has no partner.
The root splits by connected candidates: texts that share a shingle among those that a text must share with any partner
(all but the last `PERCENT` of its shingles in one global order, which begins with those that few texts have, so that
what is common to many unrelated texts connects none). Below it, leaves hold texts of like size. A pair whose
texts are already connected by verified links of its leaves needs no check of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from seqloom.llm import homes as H
from seqloom.llm import spans as S
from seqloom.llm.links import components, connected
from seqloom.session import cut_lineage

SHINGLE = 5
PERCENT = 75
GROUPS = 128  # coordinates of a point
CORNERS = 16  # coordinates of the boxes of leaves, each the sum of neighbouring groups
LEAF = 1024  # texts in a leaf at most about
LEAF_SHINGLES = 1 << 20  # shingles of the texts of a leaf at most about
CHUNK = 1 << 19  # bytes of text in one numpy pass, whose arrays take some 50 times as many
SLOT_BYTES = H.SLOT_BYTES // 2  # a slot sorts its hashes beside their texts, in some 12 times as many bytes
UNKNOWN = 1 << 16  # rank of a shingle that was not asked about: behind all that were
_ID, _FIRST, _EMPTY, _AGAIN = (f"seqloom {x}" for x in ("id", "first", "empty", "again"))  # names that no input has


def _sets(column, shingle: int):
    """Per chunk: first row, rows, the row of every distinct shingle and its hash, ascending within rows."""
    for first, last, text, offsets in S.chunks(column, CHUNK):
        text = S.LOWER[text]
        starts, ends, bounds = S.words(text, offsets, S.NON_SPACE)
        hashes = S.span_hashes(S.prefix_sums(text), starts, ends)
        row = S.owners(bounds)
        key = S.windows(hashes, shingle)
        whole = np.flatnonzero(row[: len(key)] == row[shingle - 1 :]) if len(key) else np.zeros(0, np.int64)
        key, of = key[whole], row[whole]
        sizes = np.diff(bounds)
        for i in np.flatnonzero((sizes > 0) & (sizes < shingle)):
            key = np.append(key, S.windows(hashes[bounds[i] : bounds[i + 1]], int(sizes[i]), seed=int(sizes[i]))[0])
            of = np.append(of, i)
        order = np.lexsort((key, of))
        key, of = key[order], of[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (of[1:] != of[:-1])]) if len(key) else np.zeros(0, bool)
        yield first, last - first, of[new], key[new]


def _must_share(sizes: np.ndarray, percent: int) -> np.ndarray:
    """How many of a text's shingles, in a global order, hold one that it shares with any partner."""
    return sizes - -(-percent * sizes // 100) + (sizes > 0)


def _rarest(keys: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """Of the shingles that a text must share with any partner, by rank and then by hash, those another text may have; rank -1: none has."""
    order = np.lexsort((keys, ranks))[: int(_must_share(np.array([len(keys)]), percent)[0])]
    return keys[order[ranks[order] >= 0]]


def _vectors(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles per group of hash values, one row for each ascending set."""
    out = np.zeros((len(sets), GROUPS), dtype=np.int32)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=GROUPS)
    return out


def _links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what links within a leaf (all of `side` 0) or between two leaves (0 and 1)."""
    sizes = np.array([len(s) for s in sets])
    points = _vectors(sets)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in left:
        # shared shingles are at least percent / (100 + percent) of both sizes together
        bound = np.minimum(points[right], points[i]).sum(axis=1)
        ok = (bound * (100 + percent) >= percent * (sizes[right] + sizes[i])) & (right > i if right is left else True)
        for j in right[ok]:
            a, b = find(i), find(j)
            if a == b:
                continue
            small, large = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            shared = int(H.member(small, large).sum())
            if 100 * shared >= percent * (sizes[i] + sizes[j] - shared):
                parent[max(a, b)] = min(a, b)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _classes(documents: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """`documents` as doc_id, text, key, id, and id, n_shingles, first (smallest doc_id of the text), root (names the class), component_id of every text."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), H.text_key().alias("key"), F.xxhash64(H.text_key()).alias("id"))
    size = H.text_bytes(documents)
    homes, slots = H.parts(size, H.HOME_BYTES), H.parts(0.6 * size, SLOT_BYTES)

    def every_second(column):
        for begin, _, of, key in _sets(column, shingle):
            chosen = (key & np.uint64(1)) == 0
            yield begin, of[chosen], key[chosen]

    def measure(key, packs, answered):
        """Size of every text of a home; the set and the corners of the point of those that may have a partner."""
        if not len(packs):
            return facts_schema.empty_table()
        home = H.Home(packs, answered)
        ranked = home.answered(2)
        ranked = ranked[np.argsort(ranked & H.SHORT)]
        answers, times = ranked & H.SHORT, (ranked >> np.uint64(48)).astype(np.uint16)
        home.answers.clear()
        del ranked
        rows = []
        for begin, n, of, keys in _sets(home.texts, shingle):
            bounds = np.searchsorted(of, np.arange(n + 1))
            asked, known = (keys & np.uint64(1)) == 0, H.member(keys & H.SHORT, answers)
            own = asked & ~known
            ranks = np.where(own, -1, UNKNOWN)
            ranks[asked & known] = times[np.searchsorted(answers, keys[asked & known] & H.SHORT)]
            owned = np.concatenate([[0], np.cumsum(own)])
            for i in range(n):
                mine = keys[bounds[i] : bounds[i + 1]]
                size = len(mine)
                chosen = size > 0 and 100 * (size - (owned[bounds[i + 1]] - owned[bounds[i]])) >= percent * size
                corners = _vectors([mine]).reshape(CORNERS, -1).sum(axis=1).tolist() if chosen else None
                rarest = _rarest(mine, ranks[bounds[i] : bounds[i + 1]], percent).tobytes() if chosen else None
                rows.append((home.ids[begin + i], int(home.first[begin + i]), size, corners, mine.tobytes() if chosen else None, rarest))
        del home, answers, times
        found = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), facts_schema)], schema=facts_schema)
        del rows
        S.release()
        return found

    facts_schema = pa.schema([("id", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("corners", pa.list_(pa.int32())), ("shingles", pa.binary()), ("rarest", pa.binary())])
    shared = H.repeated_anchors(H.send_anchors(texts, slots, every_second), homes, slots, ranked=True)
    dealt = H.to_homes(texts, homes).repartition(2 * homes, "slot").groupBy("slot")
    facts = dealt.cogroup(shared.repartition(2 * homes, "slot").groupBy("slot")).applyInArrow(measure, "id long, first long, n long, corners array<int>, shingles binary, rarest binary")
    facts = cut_lineage(facts)
    points = facts.where("shingles is not null")

    def first_shingles(batches):
        writer = H.AnchorWriter(slots)
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                mine = np.frombuffer(raw.as_buffer(), dtype=np.uint64)
                yield from writer.add(np.full(len(mine), number, dtype=np.int64), mine)
        yield from writer.send()

    def meet(table):
        key, owner = H.read_anchors(table.column("body"))
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        star = owner[np.flatnonzero(new)[np.cumsum(new) - 1]]
        linked = star != owner
        node, root = components(owner[linked], star[linked])
        return pa.table({"a": pa.array(node[node != root]), "b": pa.array(root[node != root])})

    sent = points.select("id", "rarest").mapInArrow(S.tidy(first_shingles), H.MESSAGE)
    candidates = connected(sent.repartition(2 * slots, "slot").groupBy("slot").applyInArrow(meet, "a long, b long"))
    points = points.join(candidates, F.col("id") == F.col("node")).select("id", "n", "root", "corners", "shingles")
    links = _verified(points, percent)
    classes = facts.select("id", "first", "n").join(connected(links), F.col("id") == F.col("node"), "left")
    classes = classes.select("id", "first", "n", F.coalesce("root", "id").alias("root"))
    firsts = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return texts, classes.join(firsts, "root").select("id", "first", F.col("n").alias("n_shingles"), "root", "component_id")


def link_documents(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Classes of documents connected by links: `percent` % or more of all their different shingles are shared.

    `documents` needs `doc_id` and `text`; other columns are ignored, whatever their names. A-Z are lower-cased. A text of fewer than `shingle`
    words has one shingle, all of them; null or wordless text has none and links with nothing. Equal texts are one
    class; rows that repeat a doc_id give a row each. A class whose ids are all null has a null id. An empty table gives no rows.

    Returns doc_id, n_shingles, component_id (smallest doc_id of the class).
    """
    texts, classes = _classes(documents, shingle, percent)
    smallest = F.when(F.col("component_id") != H.NEVER, F.col("component_id"))
    # wordless texts link with nothing, not even with each other
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(smallest)
    return texts.select("doc_id", "id").join(classes, "id").select("doc_id", "n_shingles", own.alias("component_id"))


def drop_linked(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row, all columns, of each class that `link_documents` finds: the one of smallest doc_id, ties by the hash of the text.

    Wordless texts all stay, as they link with nothing.
    """
    _, classes = _classes(documents, shingle, percent)
    # by root: classes that do not link can have one smallest doc_id, as all those without ids do
    best = classes.groupBy("root").agg(F.min(F.struct("first", "id")).alias("best"))
    chosen = classes.join(best, "root").where((F.col("n_shingles") == 0) | (F.struct("first", "id") == F.col("best")))
    chosen = chosen.select(F.col("id").alias(_ID), F.col("first").alias(_FIRST), (F.col("n_shingles") == 0).alias(_EMPTY))
    rows = documents.withColumn(_ID, F.xxhash64(H.text_key())).join(chosen, _ID)
    rows = rows.where(F.col(_EMPTY) | (F.coalesce("doc_id", F.lit(H.NEVER)) == F.col(_FIRST)))
    # rows that repeat both id and text: one of them, whichever, as they are the same
    again = F.row_number().over(W.partitionBy(_ID).orderBy(_FIRST))
    return rows.withColumn(_AGAIN, F.when(F.col(_EMPTY), F.lit(1)).otherwise(again)).where(F.col(_AGAIN) == 1).select(*documents.columns)


def _verified(points: DataFrame, percent: int) -> DataFrame:
    """Links a-b of candidates: bound pairs of leaves, then pairs of points, then the sets."""
    band = F.floor(4 * F.log2(F.greatest("n", F.lit(1)))).cast("int")
    sized = points.withColumn("band", band)
    filled = sized.groupBy("root", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / LEAF, F.sum("n") / LEAF_SHINGLES)).alias("leaves"))
    # texts of like size share leaves; where there are more than a leaf takes, their hashes deal them out
    leaf = F.struct("root", "band", F.pmod(F.xxhash64("id"), F.col("leaves")).alias("part"))
    placed = sized.join(filled, ["root", "band"]).select(F.xxhash64(leaf).alias("leaf"), "root", "id", "n", "corners", "shingles")
    corners = [f for i in range(CORNERS) for f in (F.max(F.col("corners")[i]).alias(f"high{i}"),)]
    boxes = cut_lineage(placed.groupBy("root", "leaf").agg(F.min("n").alias("low"), F.max("n").alias("high"), *corners))
    x, y = boxes.alias("x"), boxes.alias("y")
    shared = sum((F.least(F.col(f"x.high{i}"), F.col(f"y.high{i}")) for i in range(CORNERS)), F.lit(0))
    may_link = (
        (F.col("x.leaf") <= F.col("y.leaf")) & (100 * F.col("x.high") >= percent * F.col("y.low")) & (100 * F.col("y.high") >= percent * F.col("x.low"))
        & (shared * (100 + percent) >= percent * (F.col("x.low") + F.col("y.low")))
    )
    pairs = x.join(y, (F.col("x.root") == F.col("y.root")) & may_link).select(F.col("x.leaf").alias("left"), F.col("y.leaf").alias("right"))
    sides = pairs.select(F.col("left").alias("leaf"), F.lit(0).alias("side"), "left", "right").unionByName(
        pairs.where("left <> right").select(F.col("right").alias("leaf"), F.lit(1).alias("side"), "left", "right"))
    met = placed.select("leaf", "id", "shingles").join(sides, "leaf")

    def verify(batches):
        """Pairs of leaves come one after another; one pair is held at a time."""
        pair, rows = None, []

        def done():
            sets = [np.frombuffer(r[2], dtype=np.uint64) for r in rows]
            found = _links(np.array([r[0] for r in rows]), sets, np.array([r[1] for r in rows]), percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

        for batch in batches:
            for left, right, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if pair != (left, right):
                    if len(rows) > 1:
                        yield from done()
                    pair, rows = (left, right), []
                rows.append(row)
        if len(rows) > 1:
            yield from done()

    ordered = met.select("left", "right", "id", "side", "shingles").repartition("left", "right").sortWithinPartitions("left", "right", "side", "id")
    return ordered.mapInArrow(S.tidy(verify), "a long, b long")
