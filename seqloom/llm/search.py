"""Ranked lexical search of given items in all documents (operator 13).

Method: reversed search. An inverted index over the items' terms is broadcast, and every document's term counts stream through
it once. A task keeps a bounded heap of best documents per item; the heaps are merged in two steps. Items are taken in blocks
whose index has a bounded size, one after another.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seqloom.llm import spans as S

TOP = 20
#: Bytes of item texts in one block; a longer item is a block alone. An index takes up to a hundred times as much memory.
BLOCK_BYTES = 1 << 20
#: Items in one block: a task holds `TOP` documents of each.
BLOCK_ITEMS = 1 << 14
#: Scores, and matches of terms and items, that one numpy pass works on; a single document may exceed it by its own.
CELLS = 1 << 20
#: Groups in which the heaps of an item are merged before the last merge.
GROUPS = 256
#: Documents named together in the statistics of terms: the number of documents and of all their terms.
DOCUMENTS, TERMS = -1, -2

_TABLE = bytes(int(S.LOWER[b]) if S.ALNUM[b] else 0x20 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of letters, digits and characters beyond ASCII, with A-Z in lower case."""
    return (text or "").encode().translate(_TABLE).split()


class Index:
    """Items of one block: numbers of their terms, and per term the items that have it, with repeats counted."""

    def __init__(self, items: list[tuple]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        rows, columns = [], []
        for row, (_, text) in enumerate(items):
            for term in terms(text):
                columns.append(self.number.setdefault(term, len(self.number)))
                rows.append(row)
        key, times = np.unique(np.array(columns, np.int64) * max(1, len(items)) + np.array(rows, np.int64), return_counts=True)
        term, self.item = np.divmod(key, max(1, len(items)))
        self.times = times.astype(np.int64)
        self.start = np.searchsorted(term, np.arange(len(self.number) + 1))
        self.fan = np.diff(self.start)

    def counts(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text its number of terms; and of the index's terms in it: text, term, times, ordered by text."""
        n = np.zeros(len(texts), np.int64)
        found = []
        for i, text in enumerate(texts):
            words = terms(text)
            n[i] = len(words)
            of = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
            found.append(of[of >= 0] + i * len(self.number))
        key, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        text, term = np.divmod(key, max(1, len(self.number)))
        return n, text, term, times.astype(np.int64)


def item_blocks(items: DataFrame, block_bytes: int, block_items: int) -> list:
    """Filters on `items` (columns item_id, text) that cut them into blocks by hash: more of them until all fit."""
    size, rows = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    blocks = max(1, -(-size // block_bytes), -(-rows // block_items))
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        sizes = items.groupBy(block.alias("block")).agg(
            F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.count(F.lit(1)).alias("n"), F.countDistinct("item_id", "text").alias("kinds")
        )
        # rows that repeat an item cannot be told apart by a hash; neither can a single item be cut
        over = (F.col("kinds") > 1) & ((F.col("bytes") > block_bytes) | (F.col("n") > block_items))
        if not sizes.where(over).limit(1).count():
            return [block == b for b in range(blocks)]
        blocks *= 2


def statistics(documents: DataFrame, shared) -> dict[int, int]:
    """Documents that have each term of the index; under `DOCUMENTS` those with any term, under `TERMS` all terms with repeats."""

    def count(batches):
        index = shared.value
        df, n, total = np.zeros(len(index.number), np.int64), 0, 0
        for batch in batches:
            sizes, _, term, _ = index.counts(batch.column(0).to_pylist())
            df += np.bincount(term, minlength=len(df))
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        seen = np.flatnonzero(df)
        keys, values = np.concatenate([seen, [DOCUMENTS, TERMS]]), np.concatenate([df[seen], [n, total]])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["term", "n"])

    parts = documents.select("text").mapInArrow(S.tidy(count), "term long, n long")
    return {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per term of the block


class Heaps:
    """The `top` best documents of each item: highest score first, then smallest doc_id, documents without one last."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.zeros(items, np.int64)  # a score must reach the least of a full heap
        self.item, self.doc, self.missing, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, scores: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        """`scores`: documents x items."""
        at, item = np.nonzero((scores >= self.least) & (scores > 0))
        if not len(at):
            return
        item, doc = np.concatenate([self.item, item]), np.concatenate([self.doc, docs[at]])
        missing, score = np.concatenate([self.missing, missing[at]]), np.concatenate([self.score, scores[at, item[len(self.item):]]])
        order = np.lexsort((doc, missing, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(len(self.least) + 1))
        rank = np.arange(len(item)) - first[item]
        kept = order[rank < self.top]
        self.item, self.doc, self.missing, self.score = item[rank < self.top], doc[kept], missing[kept], score[kept]
        full = np.flatnonzero(np.bincount(self.item, minlength=len(self.least)) == self.top)
        last = np.searchsorted(self.item, full, side="right") - 1
        self.least[full] = self.score[last]


def _best_of_block(documents: DataFrame, items: list[tuple], item_type, top: int) -> DataFrame:
    """Rows (item, item_id, doc_id, score): of each task, the best documents of each item."""
    spark = documents.sparkSession
    index = Index(items)
    shared = spark.sparkContext.broadcast(index)
    known = statistics(documents, shared)
    n_docs, n_terms = known.get(DOCUMENTS, 0), known.get(TERMS, 0)
    df = np.zeros(len(index.number), np.int64)
    for term, n in known.items():
        if term >= 0:
            df[term] = n
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def stream(batches):
        index = shared.value
        heaps = Heaps(len(index.ids), top)
        for batch in batches:
            docs = batch.column(0)
            missing = np.asarray(docs.is_null())
            docs = np.asarray(docs.fill_null(0))
            n, text, term, times = index.counts(batch.column(1).to_pylist())
            first = np.searchsorted(text, np.arange(len(n) + 1))
            pairs = np.concatenate([[0], np.cumsum(index.fan[term])])[first]  # matches of terms and items before each text
            a = 0
            while a < len(n):
                b = int(np.searchsorted(pairs, pairs[a] + CELLS, side="right")) - 1
                b = min(max(b, a + 1), len(n), a + max(1, CELLS // len(index.ids)))
                of, what, tf = (c[first[a] : first[b]] for c in (text, term, times))
                m = 100 - 25 + (25 * n[of] * n_docs) // max(1, n_terms)
                points = weight[what] * ((1000000000 * tf) // (1000 * tf + 12 * m))
                fan = index.fan[what]
                at = S.ranges(index.start[what], fan)
                scores = np.zeros((b - a) * len(index.ids), np.int64)
                np.add.at(scores, np.repeat(of - a, fan) * len(index.ids) + index.item[at], np.repeat(points, fan) * index.times[at])
                heaps.add(scores.reshape(b - a, -1), docs[a:b], missing[a:b])
                a = b
        yield pa.RecordBatch.from_arrays(
            [pa.array(heaps.item), pa.array([index.ids[i] for i in heaps.item], id_type), pa.array(heaps.doc, mask=heaps.missing), pa.array(heaps.score)],
            names=["item", "item_id", "doc_id", "score"],
        )

    id_type = pa.int64() if item_type == "bigint" else pa.string()
    return documents.mapInArrow(S.tidy(stream), f"item long, item_id {item_type}, doc_id long, score long")


def search(documents: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The `top` documents with the highest score above 0 for each item: item_id, rank (from 1), doc_id, score.

    `documents` needs `doc_id` and `text`, `items` needs `item_id` and `text`; other columns are ignored. A term's weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))); a document of n terms has m = 75 + (25 n N) div L; the score adds up weight times
    (10^9 tf) div (1000 tf + 12 m) over the item's terms, repeats included. N counts the documents with a term, L their terms.

    Null or wordless texts have no terms: such documents are not counted and not found, such items find nothing. Equal scores
    stand by ascending doc_id, documents without one last. Every row is a document, or an item, of its own: rows that
    repeat an id or a text are ranked each, and an item row that repeats gives its ranks again. An empty table gives no rows. An
    item_id is returned as a long if it is a whole number, else as a string.
    """
    kind = items.schema["item_id"].dataType.simpleString()
    kind = "bigint" if kind in ("bigint", "int", "smallint", "tinyint") else "string"
    wanted = items.select(F.col("item_id").cast(kind).alias("item_id"), "text")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for number, chosen in enumerate(item_blocks(wanted, block_bytes, block_items)):
        rows = [(r["item_id"], r["text"]) for r in wanted.where(chosen).collect() if terms(r["text"])]  # at most a block
        if rows:
            found.append(_best_of_block(docs, rows, kind, top).withColumn("block", F.lit(number)))
    if not found:
        return documents.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    best = reduce(DataFrame.unionByName, found).withColumn("group", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for by in (["block", "item", "group"], ["block", "item"]):
        best = best.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")
