import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from seqloom.llm import packing as K
from tests.llm import cases as C

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_gives_the_tokenizers_ids():
    odd = ["", "a  b", "a \n b", "\n\n x", " lead", "trail ", "x\xa0y  z", "it's I'll we've don't", "<|endoftext|> a<|endoftext|>b", "naïve 12,000.50 €5!! …?",
           "\t tab\tx", "日本語 テキスト 한국어", "a\u0085 b", "\x1c a \x1db", " ", "  ", "\n", "x \n", "a.\nB c\nd", "a\n\nb", "new\nline here\n"]
    texts = odd + [t or "" for _, t, _ in C.documents()] + odd
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    encoder = K._Encoder(PATH)
    for _ in range(2):  # the second time from what was kept
        assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [w.ids for w in want]


@pytest.mark.parametrize("seed", range(4))
def test_encoder_on_mixed_kinds(seed):
    r = np.random.RandomState(seed)
    parts = ["a", "B", "cde", "'", "'s", "'ll", "'Re", "12", "7", "\u00b2", "\u00e9", "_", "...", "\u2026", "\n", " ", " x", "\xa0", "\t", "\x1c", "\x85", "\x7f", "\u65e5", "!", "\u2028", "\r", "\x00", "e\u0301"]
    plain = parts[:9] + ["_", "...", "\n", " x", "!"]
    texts = ["".join(r.choice(plain if i % 2 else parts, r.randint(1, 12))) for i in range(3000)]
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in K._Encoder(PATH).encode(pa.array(texts))] == [w.ids for w in want]


def test_a_word_is_encoded_once_whatever_stands_beside_it():
    words, marks = ["alpha", "beta", "gamma", "delta"], [",", ".", ";", ")", "\n", "42", "'s"]
    texts = [f" {a}{m}{b}" for a in words for m in marks for b in words]
    encoder = K._Encoder(PATH)
    encoder.encode(pa.array(texts))
    # words with and without a blank, marks, and what may belong to an apostrophe
    assert len(encoder.keys) <= 2 * len(words) + len(marks) + len(words)


@pytest.mark.parametrize("kept", [K.CACHE, 3])
def test_pack(spark, monkeypatch, kept):
    monkeypatch.setattr(K, "CACHE", kept)
    monkeypatch.setattr(K, "RANK_GROUP", 3)
    rows = [r for r in C.documents() if r[0] is not None][:-1]
    rows = list(dict.fromkeys(rows))
    tokenizer = Tokenizer.from_file(PATH)
    got = K.pack(C.frame(spark, rows), PATH).collect()
    by, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, K.END], dtype="<u4")
        total += len(ids)
        at = 0
        for i, r in enumerate(sorted(by[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == K.SIZE or i == 0
            at += r.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= K.SIZE
    assert len(sequences) <= total / K.SIZE + 3


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "same", "a")] * 5 + [(None, None, None)] * 2
    got = K.pack(C.frame(spark, rows), PATH).collect()
    assert len(got) == 7 and len({(r.sequence_id, r.offset) for r in got}) == 7
    assert K.pack(C.frame(spark, rows).limit(0), PATH).collect() == []


@pytest.mark.parametrize("seed,low,high", [(0, 1, 1023), (1, 300, 700), (2, 513, 1023), (3, 1, 40)])
def test_plan_uses_every_piece_once(seed, low, high):
    r = np.random.RandomState(seed)
    counts = Counter(r.randint(low, high + 1, 20_000).tolist())
    counts[K.SIZE] = 17
    plan = K.plan_sequences(dict(counts))
    used = Counter()
    for members, n in plan:
        assert sum(members) <= K.SIZE and n > 0
        for m in members:
            used[m] += n
    assert used == counts
    total, sequences = sum(k * v for k, v in counts.items()), sum(n for _, n in plan)
    alone = sum(v for k, v in counts.items() if 2 * k > K.SIZE)
    assert sequences <= 1.01 * max(total / K.SIZE, alone) + 2


def test_fit_is_least_squares():
    lengths = np.array([100, 200, 412, 512, 612, 924])
    patterns = K._patterns(lengths, 1024)
    truth = np.arange(1.0, len(patterns) + 1)
    a = np.zeros((len(lengths), len(patterns)))
    for j, p in enumerate(patterns):
        for i in p[p >= 0]:
            a[i, j] += 1
    x = K.fit_repeats(patterns, a @ truth, 2000)
    assert (x >= 0).all()
    np.testing.assert_allclose(a @ x, a @ truth, atol=0.1)
