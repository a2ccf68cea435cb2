import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import fingerprints as P
from seqloom.llm import spans as S
from tests.llm import cases as C


def by_hand(text):
    """The fingerprint of one text, one shingle and one bin at a time, from the hashes of its words."""
    words = C.spaced(C.lowered(text))
    if not words:
        return ""
    hashes = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        hashes.append(S.span_hashes(S.prefix_sums(b), np.array([0]), np.array([len(b)]))[0])
    k = min(len(words), 5)
    bins = {}
    for i in range(len(words) - k + 1):
        h = int(S.windows(np.array(hashes[i : i + k], np.uint64), k)[0])
        at = (h >> 32) * 256 >> 32
        bins[at] = min(h, bins.get(at, h))
    digits = []
    for i in range(256):
        attempt, at = 0, i
        while at not in bins:
            h = S.mix(np.array([i * 8192 + attempt + 0x5851F42D4C957F2D], np.uint64))[0]
            at, attempt = int(h >> np.uint64(40)) % 256, attempt + 1
        digits.append(f"{bins[at] & 15:x}")
    return "".join(digits)


def like(a, b):
    if not a or not b:
        return float(a == b)
    share = sum(x == y for x, y in zip(a, b)) / 256
    return min(1.0, max(0.0, (share - 1 / 16) / (1 - 1 / 16)))


def compared(rows):
    """By brute force, in the order of doc_id; equal ids stand in any order here, so give them equal texts."""
    docs = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for i, (doc, text, _) in enumerate(docs):
        text, following = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, other = by_hand(text), by_hand(edited), by_hand(following)
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, round(like(own, changed), 9), round(like(own, other), 9)))
    return out


def rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("near_edited", "near_next")}).collect()


@pytest.fixture(scope="module")
def rows():
    return [r if r[1] is None or len(r[1]) < 9000 else (r[0], r[1][:9000], r[2]) for r in C.documents() if r[0] is not None or r[1] is None]


@pytest.mark.parametrize("part_bytes", [P.PART_BYTES, 3000])
def test_documents_beside_edits(spark, rows, part_bytes):
    got = P.compare_with_edits(C.frame(spark, rows), part_bytes)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert C.ordered(rounded(got)) == C.ordered(compared(rows))


def test_long_text_and_few_rows(spark):
    rows = [(5, C.prose(3, 60000, 5000), "a"), (2, "x", "b")]
    assert C.ordered(rounded(P.compare_with_edits(C.frame(spark, rows)))) == C.ordered(compared(rows))
    one = P.compare_with_edits(C.frame(spark, rows[:1])).first()
    assert one.near_next == 1.0 and one.n_chars == len(rows[0][1])
    assert P.compare_with_edits(C.frame(spark, rows).limit(0)).collect() == []
    repeated = P.compare_with_edits(C.frame(spark, [(1, "a b c d e f", "a")] * 3 + [(None, None, None)] * 2)).collect()
    assert len(repeated) == 5 and len({(r.doc_id, r.fingerprint) for r in repeated}) == 2


def test_fingerprint_column(spark, rows):
    got = P.with_fingerprint(C.frame(spark, rows)).select("doc_id", "fingerprint", "text").collect()
    assert all(r.fingerprint == by_hand(r.text) for r in got)


def test_likeness_is_unbiased():
    """Estimates of sets with known similarity are right on average, with full and with mostly empty bins."""
    words = [f"w{i}" for i in range(200000)]
    for size, least in ((30, 0.06), (2000, 0.02)):
        for shared in (0.25, 0.5, 0.9):
            errors = []
            for trial in range(60):
                base = words[trial * 3000 : trial * 3000 + size]
                cut = int(size * shared)
                a, b = base[:], base[:cut] + [f"{trial}x{i}" for i in range(size - cut)]
                x, y = C.shingles(" ".join(a)), C.shingles(" ".join(b))
                fa, fb = P.fingerprints([" ".join(a), " ".join(b)])
                errors.append(P.likeness([fa], [fb])[0] - len(x & y) / len(x | y))
            assert abs(np.mean(errors)) < least
