"""Find what repeats across a corpus without moving a row per position.

Distinct texts live in `homes`, groups of about `HOME_BYTES` chosen by the hash of the text, so that exact copies
meet there and are worked on once. A home sends the sorted hashes of what it holds to `slots`, ranges of
hash values; a slot sees every holder of a hash and answers the homes concerned. What a task sends is already distinct, so a
hash that fills a third of the corpus reaches its slot once per task. Homes and slots grow in number with
the corpus and never in size.

All messages share one shape, `(slot, kind, body)`; a body is a block of numbers, split into byte planes that
Spark's shuffle compression takes well, or an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.spans import release, tidy

MESSAGE = "slot long, kind int, body binary"
ARROW = pa.schema([("slot", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
HOME_BYTES = 16 << 20  # bytes of text per home
SLOT_BYTES = 16 << 20  # bytes of hashes per slot
PACK_BYTES = 4 << 20  # bytes of text in one message
FLUSH = 1 << 20  # hashes that a task holds before it sends them
SHORT = np.uint64((1 << 48) - 1)  # bits of anchors, which only propose, and of the identity of texts beside them
NEVER = np.iinfo(np.int64).max  # order of a row without doc_id


def text_key(text: str = "text") -> Column:
    """Identity of a whole text; null counts as empty."""
    return F.md5(F.coalesce(F.col(text), F.lit("")))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts(size: float, each: int) -> int:
    return max(1, int(-(-size // each)))


# -- bodies


def planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), 8).T.tobytes()


def from_planes(data, n: int, dtype=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, n).T).view(dtype).reshape(n)


def pack_sorted(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences, with 64-bit columns beside them."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return planes(steps) + b"".join(planes(c) for c in columns)


def unpack_sorted(body: bytes, columns: int = 0) -> tuple[np.ndarray, ...]:
    n = len(body) // (8 * (1 + columns))
    view = memoryview(body)
    keys = np.cumsum(from_planes(view[: 8 * n], n), dtype=np.uint64)
    return keys, *(from_planes(view[8 * n * (i + 1) : 8 * n * (i + 2)], n, np.int64) for i in range(columns))


def ipc(batch: pa.RecordBatch, level: int = 1) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def message(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    slots, kinds, bodies = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(kinds, pa.int32()), pa.array(bodies, pa.binary())], schema=ARROW)


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    """Ranges of the hash values, so that sorted keys have sorted slots."""
    return (((keys >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)).astype(np.int64)


def by_slot(keys: np.ndarray, slots: int) -> Iterator[tuple[int, int, int]]:
    """(slot, from, to) of ascending keys."""
    of = slot_of(keys, slots)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])):
        if b > a:
            yield int(of[a]), int(a), int(b)


# -- texts and their homes


def to_homes(texts: DataFrame, homes: int, level: int = 1) -> DataFrame:
    """`texts` has `doc_id`, `text`, `key`; kind 0: the distinct texts of a task, with their smallest ids. `level`: of the compression of texts."""
    rows = texts.select("doc_id", "text", "key", F.pmod(F.xxhash64("key").bitwiseAND(F.lit(int(SHORT))), F.lit(homes)).alias("home"), F.xxhash64("key").alias("id"))

    def pack(batches):
        waiting: dict[int, list] = {}
        held: dict[int, int] = {}
        seen: dict[str, list] = {}  # by key: home, smallest doc_id, copies, id

        def send(home):
            keys, texts = zip(*waiting.pop(home))
            held.pop(home)
            batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(texts, pa.string())], ["key", "text"])
            return message([(home, 0, ipc(batch, level))])

        for batch in batches:
            for doc, text, key, home, number in zip(*(batch.column(i).to_pylist() for i in range(5))):
                doc = NEVER if doc is None else doc
                if key in seen:
                    entry = seen[key]
                    entry[1] = min(entry[1], doc)
                    entry[2] += 1
                    continue
                seen[key] = [home, doc, 1, number]
                waiting.setdefault(home, []).append((key, text))
                held[home] = held.get(home, 0) + len(text)
                if held[home] >= PACK_BYTES:
                    yield send(home)
        for home in list(waiting):
            yield send(home)
        facts: dict[int, list] = {}
        for key, (home, first, copies, number) in seen.items():
            facts.setdefault(home, []).append((key, number, first, copies))
        for home, entries in facts.items():
            keys, *numbers = zip(*entries)
            batch = pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(n, pa.int64()) for n in numbers)], ["key", "id", "first", "copies"])
            yield message([(home, 1, ipc(batch))])

    return rows.mapInArrow(tidy(pack), MESSAGE)


class Home:
    """The distinct texts of one home, ordered by their smallest id, and the hashes it was answered."""

    def __init__(self, texts: pa.Table, answered: pa.Table | None):
        def of(kind, table=texts):
            kinds, bodies = np.asarray(table.column("kind")), table.column("body")
            return [bodies[int(i)].as_py() for i in np.flatnonzero(kinds == kind)]

        facts = pa.concat_tables([from_ipc(b) for b in of(1)]).group_by("key").aggregate([("id", "min"), ("first", "min"), ("copies", "sum")])
        order = facts.sort_by([("first_min", "ascending"), ("key", "ascending")])
        self.keys = order.column("key").to_pylist()
        self.ids = order.column("id_min").to_pylist()
        self.first = np.asarray(order.column("first_min"))
        self.copies = np.asarray(order.column("copies_sum"))
        packs = pa.concat_tables([from_ipc(b) for b in of(0)])
        where = {k: i for i, k in enumerate(packs.column("key").to_pylist())}
        self.texts = packs.column("text").combine_chunks().take(pa.array([where[k] for k in self.keys], pa.int64()))
        self.answers = {
            k: np.unique(np.concatenate([unpack_sorted(b)[0] for b in of(k, answered)]))
            for k in (set(answered.column("kind").to_pylist()) if answered is not None else ())
        }

    def answered(self, kind: int) -> np.ndarray:
        return self.answers.get(kind, np.zeros(0, np.uint64))


def at_homes(packs: DataFrame, answers: DataFrame, homes: int, work: Callable, schema: str) -> DataFrame:
    """Run `work(home, number)` on every home with what its slots answered; it returns Arrow columns.

    The texts are dealt to homes once: later calls over the same `packs` reuse that exchange.
    """

    def step(key, texts, answered):
        out = work(Home(texts, answered) if len(texts) else None, key[0].as_py())
        release()
        return out

    grouped = packs.repartition(2 * homes, "slot").groupBy("slot")
    return grouped.cogroup(answers.repartition(2 * homes, "slot").groupBy("slot")).applyInArrow(step, schema)


def at_slots(messages: DataFrame, slots: int, work: Callable) -> DataFrame:
    """Run `work(kinds, bodies)` on all the messages of every slot; it returns messages for homes."""

    def step(table):
        kinds = np.asarray(table.column("kind"))
        out = pa.Table.from_batches([message(work(kinds, table.column("body")))])
        release()
        return out

    return messages.repartition(2 * slots, "slot").groupBy("slot").applyInArrow(step, MESSAGE)


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys occur in the ascending array `among`."""
    if not len(among) or not len(keys):
        return np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return among[at] == keys


# -- anchors: hashes at the positions of a difference cover


def send_anchors(texts: DataFrame, slots: int, anchors: Callable) -> DataFrame:
    """`anchors(column)` yields (first row, row of each anchor, hash of each anchor) per chunk of texts."""
    rows = texts.select("text", F.xxhash64("key").alias("id"), "key")

    def emit(batches):
        seen: set[str] = set()
        writer = AnchorWriter(slots)
        for batch in batches:
            keys = batch.column(2).to_pylist()
            fresh = []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    fresh.append(i)
            batch = batch.take(pa.array(fresh, pa.int64()))
            number = (np.asarray(batch.column(1)).astype(np.int64).view(np.uint64) & SHORT).view(np.int64)
            for first, row, key in anchors(batch.column(0)):
                yield from writer.add(number[first + row], key)
        yield from writer.send()

    return rows.mapInArrow(tidy(emit), MESSAGE)


class AnchorWriter:
    """Collects anchors and their texts and sends them to slots. A body: its texts, how many anchors each has, the anchors."""

    def __init__(self, slots: int):
        self.slots, self.ids, self.hashes, self.held = slots, [], [], 0

    def add(self, ids: np.ndarray, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        """`ids` have runs of equal values, one for each text."""
        if len(keys):
            self.ids.append(ids)
            self.hashes.append(keys & SHORT)
            self.held += len(keys)
        if self.held >= FLUSH:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        key, owner = np.concatenate(self.hashes), np.concatenate(self.ids)
        self.ids, self.hashes, self.held = [], [], 0
        of = slot_of(key << np.uint64(16), self.slots)
        order = np.argsort(of, kind="stable")
        key, owner, of = key[order], owner[order], of[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            runs = np.concatenate([[0], np.flatnonzero(np.diff(owner[a:b])) + 1])
            counts = np.diff(np.concatenate([runs, [b - a]]))
            head = np.array([len(runs)], dtype=np.int64).tobytes()
            yield message([(int(of[a]), 2, head + planes(owner[a:b][runs]) + planes(counts) + planes(key[a:b]))])


def read_anchors(bodies) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text identity) of every anchor sent to a slot."""
    keys, owners = [], []
    for body in bodies:
        body = memoryview(body.as_py())
        n = int(np.frombuffer(body[:8], np.int64)[0])
        ids = from_planes(body[8 : 8 + 8 * n], n, np.int64)
        counts = from_planes(body[8 + 8 * n : 8 + 16 * n], n, np.int64)
        rest = body[8 + 16 * n :]
        keys.append(from_planes(rest, len(rest) // 8))
        owners.append(np.repeat(ids, counts))
    return np.concatenate(keys), np.concatenate(owners)


def repeated_anchors(messages: DataFrame, homes: int, slots: int, ranked: bool = False) -> DataFrame:
    """Answer (kind 2) every home with its anchors that stand in two texts, or twice in one.

    A text that several tasks sent counts once: of each anchor, the largest count any task saw in the text.
    If `ranked`, the 16 bits above an anchor say in how many texts it stands, 65,535 for more.
    """

    def work(kinds, bodies):
        keys, owners, times = [], [], []
        for body in bodies:
            key, owner = read_anchors([body])
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]))
            keys.append(key[at])
            owners.append(owner[at])
            times.append(np.diff(np.concatenate([at, [len(key)]])) > 1)
        key, owner, twice = np.concatenate(keys), np.concatenate(owners), np.concatenate(times)
        del keys, owners, times  # as long as the slot's hashes, all of them
        order = np.lexsort((owner, key))
        key, owner, twice = key[order], owner[order], twice[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(new) - 1
        texts = np.concatenate([[True], new[1:] | (owner[1:] != owner[:-1])])
        among = np.bincount(group, texts)
        hit = (among > 1) | (np.bincount(group, twice) > 0)
        keep = hit[group] & texts
        if ranked:
            key = key | np.minimum(among, 65535).astype(np.uint64)[group] << np.uint64(48)
        key, home = key[keep], owner[keep] % homes
        out = []
        order = np.lexsort((key, home))
        key, home = key[order], home[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(home)) + 1, [len(home)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b > a:
                out.append((int(home[a]), 2, pack_sorted(np.unique(key[a:b]))))
        return out

    return at_slots(messages, slots, work)
