"""Test questions and answers found in documents (operator 1).

Method: one Aho-Corasick automaton over the windows of all normalised items; a text is normalised and scanned once, and
what it finds is mapped back to words and characters of the original.
"""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqloom.llm import spans as S

WIDTH = 10
#: Bytes of items in one automaton, which takes some 400 times as much memory. More items are scanned for in blocks, one pass each.
BLOCK_BYTES = 1 << 19

FOUND = "n_words long, hit array<int>, items array<string>, spans array<struct<start:int,end:int>>"
_TABLE = bytes(int(S.LOWER[b]) if S.ALNUM[b] else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def _item_windows(items, width: int) -> dict[bytes, list[str]]:
    windows: dict[bytes, list[str]] = {}
    for item, text in items:
        words = normal_words(text or "")
        if item is None or not words:
            continue
        for i in range(max(1, len(words) - width + 1)):
            windows.setdefault(b" ".join(words[i : i + width]), []).append(item)
    return {w: sorted(set(ids)) for w, ids in windows.items()}


def _scan(texts: DataFrame, items, width: int) -> DataFrame:
    """One pass over `texts` (row, key, text) with one automaton, built once per task."""
    windows = texts.sparkSession.sparkContext.broadcast(_item_windows(items, width))

    def automaton():
        found = ahocorasick.Automaton()
        for window, ids in windows.value.items():
            # bytes as characters, so places in the string are places in the bytes
            found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, ids))
        if len(found):
            found.make_automaton()
        return found

    def search(batches):
        items = automaton()
        for batch in batches:
            rows = []
            for text in batch.column(2).to_pylist():
                words = normal_words(text or "")
                hit, ids, spans = [], [], []
                if words and len(items):
                    joined = b" ".join(words).decode("latin-1")
                    matches = list(items.iter(f" {joined} "))
                    if matches:
                        ends = np.cumsum([len(w) + 1 for w in words])  # of the blank behind every word
                        steps = np.zeros(len(words) + 1, dtype=np.int64)
                        found = set()
                        for end, (n, of) in matches:
                            last = int(np.searchsorted(ends, end))
                            steps[last - n + 1] += 1
                            steps[last + 1] -= 1
                            found.update(of)
                        hit, ids = np.flatnonzero(np.cumsum(steps[:-1]) > 0), sorted(found)
                        places = [m.span() for m in _WORD.finditer(text)]
                        runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
                        spans = [{"start": places[r[0]][0], "end": places[r[-1]][1]} for r in runs]
                        hit = hit.tolist()
                rows.append((len(words), hit, ids, spans))
            columns = zip(*rows) if rows else [()] * 4
            types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            found = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["row", "key", "n_words", "hit", "items", "spans"])

    return texts.mapInArrow(S.tidy(search), f"row {texts.schema['row'].dataType.simpleString()}, key string, {FOUND}")


def _found(documents: DataFrame, benchmark: DataFrame, width: int, block_bytes: int) -> DataFrame:
    """The rows of `documents` as a struct `row`, and what `find_items` says of them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = documents.select(F.struct("*").alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("key"), "text")
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    bare = texts.withColumn("row", F.struct(F.lit(True).alias("bare")))
    scans = [_scan(texts if b == 0 else bare, items.where(block == b).collect(), width) for b in range(blocks)]
    if blocks == 1:
        return scans[0].drop("key")
    every = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_set(name)))).alias(name)
    hits = reduce(DataFrame.unionByName, [s.where(F.size("hit") > 0).drop("row", "n_words") for s in scans])
    merged = hits.groupBy("key").agg(every("hit"), every("items"), every("spans"))
    found = scans[0].select("row", "key", "n_words").join(merged, "key", "left")
    empty = lambda name: F.coalesce(F.col(name), F.array().cast(found.schema[name].dataType)).alias(name)
    return found.select("row", "n_words", empty("hit"), empty("items"), empty("spans"))


def find_items(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Benchmark items in documents, by windows of `width` consecutive words of an item (all of a shorter item).

    `documents` needs `doc_id` and `text`, `benchmark` needs `item_id` and `text`; other columns are ignored. Case of A-Z and all
    that is not a letter or digit is ignored. Null or wordless texts have no words; null, wordless or id-less items have
    no windows; items that repeat an id are one item with the windows of all its rows. Every document row gives a row, also rows
    that repeat; empty documents give no rows, an empty benchmark no hits.

    Returns doc_id, n_words, hit (numbers of the words inside occurrences), items (ids with occurrences, sorted as
    strings), spans (of the original text's characters, a run of hit words each; runs that two blocks found may overlap).
    """
    found = _found(documents.select("doc_id", "text"), benchmark, width, block_bytes)
    return found.select("row.doc_id", "n_words", "hit", "items", "spans")


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `documents`, all columns, in which no benchmark item occurs; see `find_items`."""
    return _found(documents, benchmark, width, block_bytes).where(F.size("hit") == 0).select("row.*")
