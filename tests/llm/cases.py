"""Awkward documents, and what operators must say of them by brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

# Extra columns have the names that operators use within.
SCHEMA = "key string, doc_id long, text string, lang string, source string, n_chars long, row string, score double, home int, id long, n long, root long"
NEVER = (1 << 63) - 1


def prose(seed, n, words=300):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeilmnorstué") for _ in range(r.randint(1, 8))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def documents():
    """(doc_id, text, source) with nulls, empties, a very long text, copies, near copies, repeated rows, shared passages."""
    base, passage = prose(1, 300), prose(2, 60)
    near = base.split()
    near[150] = "changed"
    rows = [
        (0, base, "a"), (1, base, "b"), (2, " ".join(near), "c"), (3, None, "a"), (4, "", "a"), (5, " \n\t ", None),
        (6, "one two three", "b"), (7, "One  two\tthree", "b"), (None, prose(3, 40), "a"), (None, None, None),
        (8, prose(4, 120) + "\n" + passage + "\n" + prose(5, 80), "a"), (9, passage, "d"), (10, prose(6, 50) + " " + passage, "e"),
        (11, "x" * 450, "a"), (12, "ab" * 400, "f"), (13, " ".join(["again and again"] * 60), "g"),
        (14, prose(7, 30000, 3000), "h"), (14, prose(7, 30000, 3000), "h"), (15, base.upper(), "i"), (16, base + " tail", "j"),
        (17, "été ✓ " * 90, "k"), (18, "日本語 テキスト " * 30, "k"), (19, "MIT License\nApache  License, GNU General-Public License. CC-BY cc by", "a"),
    ]
    line = "Subscribe to our letter today"
    rows += [(20 + i, f"{prose(50 + i, 30)}\n{line}\n{prose(80 + i, 20)}\n{line if i % 3 == 0 else 'own'}", f"s{i % 9}") for i in range(18)]
    return rows


def frame(spark, rows):
    full = [("clash", d, t, "xx", s, len(t or ""), "clash", 0.5, 1, 2, 3, 4) for d, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def ordered(rows):
    """Result rows as a sortable multiset."""
    return sorted(tuple(str(v) for v in r) for r in rows)


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def repeated_bytes(rows, length=200):
    count = Counter()
    for _, text, _ in rows:
        b = (text or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for doc, text, _ in rows:
        b = (text or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(v for v, m in zip(b, mark) if not m)
        out.append((doc, len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), sha(kept)))
    return out


def repeated_windows(rows, width=20):
    first, out = {}, []
    places = sorted({(NEVER if d is None else d, t or "") for d, t, _ in rows})
    for place in places:
        words = spaced(place[1])
        for i in range(len(words) - width + 1):
            first.setdefault(tuple(words[i : i + width]), (place, i))
    for doc, text, _ in rows:
        place, words = (NEVER if doc is None else doc, text or ""), spaced(text)
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] != (place, i):
                gone[i : i + width] = [True] * width
        out.append((doc, len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g))))
    return out


def shingles(text, k=5):
    words = spaced(lowered(text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def classes(rows, percent=75):
    sets = {t or "": shingles(t) for _, t, _ in rows}
    parent = {t: t for t in sets}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    texts = list(sets)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    smallest = defaultdict(lambda: NEVER)
    for doc, text, _ in rows:
        root = find(text or "")
        smallest[root] = min(smallest[root], NEVER if doc is None else doc)
    out = []
    for doc, text, _ in rows:
        low = smallest[find(text or "")]
        out.append((doc, len(sets[text or ""]), doc if not sets[text or ""] else (None if low == NEVER else low)))
    return out


def spread(rows, sites=8):
    """(kept text per (doc_id, text), numbers of the lines removed)."""
    where, first = defaultdict(set), {}
    key = lambda d, t: (NEVER if d is None else d, hashlib.md5(t.encode()).hexdigest())
    for doc, text, source in rows:
        for i, line in enumerate(text.split("\n") if text is not None else ()):
            if spaced(line):
                if source is not None:
                    where[line].add(source)
                first[line] = min(first.get(line, (NEVER + 1, "", 0)), (*key(doc, text), i))
    out = []
    for doc, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        gone = [i for i, x in enumerate(lines) if spaced(x) and len(where[x]) >= sites and first[x] != (*key(doc, text), i)]
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((doc, len(lines), gone, kept))
    return out


def items_found(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        words = alnum(text)
        if item is not None and words:
            for i in range(max(1, len(words) - width + 1)):
                windows[tuple(words[i : i + width])].add(str(item))
    out = []
    for doc, text, _ in rows:
        words, found, hit = alnum(text), set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    found |= windows[tuple(words[i : i + n])]
                    hit |= set(range(i, i + n))
        out.append((doc, len(words), sorted(hit), sorted(found)))
    return out
