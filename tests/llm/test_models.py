import random
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import language, quality, toxicity
from seqloom.llm.samples import labelled_sample
from tests.llm import cases as C

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return C.frame(spark, C.documents()).persist()


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 == 0


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20])
def test_codewords(n):
    code = language.codewords(n)
    apart = (code[:, None] != code[None]).sum(axis=2)[~np.eye(n, dtype=bool)].min()
    assert apart >= (2 ** (n - 2) if n <= 6 else 5)
    assert (np.abs(code.sum(axis=0)) < n).all()  # every bit tells some languages from others


def test_language(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(table)
    truth = {r.doc_id: r.lang for r in table.collect()}
    got = language.identify(table, model).collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == held_out(r.doc_id) for r in got) and len(got) == len(truth)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in out]) >= 0.95
    odd = language.identify(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    letterless = {3, 4, 5, None}
    assert all((r.lang_pred == "und") == (r.score == 0) for r in odd)
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == letterless
    kept = language.drop_unidentified(docs, model)
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.collect()} & {3, 4, 5}
    assert language.identify(docs.limit(0), model).collect() == []


def test_no_language_to_learn(spark, docs):
    model = language.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in language.identify(docs, model).collect()} == {("und", 0.0)}
    one = language.fit(docs)  # a single language
    assert {r.lang_pred for r in language.identify(docs, one).collect()} == {"xx", "und"}


def statistics(text):
    words, seen, again = C.spaced(text), set(), 0
    for line in (text or "").split("\n"):
        if C.spaced(line):
            again += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    mark = [False] * len(words)
    for i in range(len(words) - 4):
        if count[tuple(words[i : i + 5])] > 1:
            mark[i : i + 5] = [True] * 5
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, sum(mark)


def test_statistics(spark):
    rows = C.documents() + [(70, "a\n\na\r\n a\na\n#|", "a"), (71, "|<>&%$*#", "a")]
    got = quality.apply_rules(C.frame(spark, rows), []).collect()
    want = [(d, *statistics(t)) for d, t, _ in rows]
    assert C.ordered((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == C.ordered(want)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) == (not r.kept) for r in got)
    assert quality.apply_rules(C.frame(spark, rows).limit(0), []).collect() == []


def test_rules_find_planted_thresholds():
    r = np.random.RandomState(0)
    counts = np.ones((3000, len(quality.COUNTS)), dtype=np.int64) * 100
    counts[:, quality.COUNTS.index("n_symbols")] = r.randint(0, 100, 3000)
    counts[:, quality.COUNTS.index("n_dup_lines")] = r.randint(0, 100, 3000)
    bad = (counts[:, 2] >= 70) & (counts[:, 3] >= 50) | (counts[:, 3] < 10)
    rules = quality.learn_rules(counts, bad)
    x, hit = quality._ratios(counts), np.zeros(3000, dtype=bool)
    for rule in rules:
        hit |= quality._holds(rule, x)
    assert (hit == bad).mean() > 0.97 and all(len(rule) <= 4 for rule in rules)
    assert quality.learn_rules(counts, np.zeros(3000, bool)) == []


def test_rules_say_the_same_in_spark(spark):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality.fit(table, labels) or [[quality.Condition("symbols per word", True, 0.3)]]
    got = quality.apply_rules(table, rules).collect()
    x = quality._ratios(np.array([[r[c] for c in quality.COUNTS] for r in got]))
    hit = np.zeros(len(got), dtype=bool)
    for rule in rules:
        hit |= quality._holds(rule, x)
    assert [r.kept for r in got] == [not (h or r.base_failed) for h, r in zip(hit, got)]


def labelled(n=500):
    r, rows, marks = random.Random(4), [], []
    for i in range(n):
        words = C.prose(1000 + i % 7, 40, 400).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(2):
                words[r.randrange(40)] = "gromp" + r.choice("abcdefghij") + r.choice("klmnop")
        rows.append((i, " ".join(words), "a"))
        marks.append((i, int(bad), 1))
    return rows, marks


def test_toxicity(spark, docs):
    rows, marks = labelled()
    table, labels = C.frame(spark, rows), spark.createDataFrame(marks + marks[:5] + [(None, 1, 1), (999, None, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(table, labels)
    got = toxicity.score(table, model).collect()
    bad = {d for d, t, _ in marks if t}
    out = [r for r in got if r.held_out]
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([(r.doc_id in bad) == bool(r.predicted) for r in out]) > 0.97
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and len({r.score for r in odd if r.doc_id in (3, 4, 5)}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_toxicity_takes_the_ngrams_of_fit(spark, monkeypatch):
    """Documents of `fit` are not searched for n-grams again, and marks between words do not matter."""
    rows, marks = labelled()
    rows += [(10_000, "?gromp-ak,\x7fthe.\n", "a"), (10_001, "Gromp AK the", "a")]
    table, labels = C.frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    model = toxicity.fit(table, labels)
    alone = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    monkeypatch.setattr(toxicity, "corpus_grams", None)
    got = {r.doc_id: r.score for r in toxicity.score(table, model, model.grams).collect()}
    assert got == alone and got[10_000] == got[10_001]


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def test_ratios_are_kneser_ney(spark):
    """The two models by hand, on few words, where no count tables collide."""
    rows = [(i, t, "a") for i, t in enumerate(["aba abb", "abc", "aba", "cab cab", "bca"])]
    table = C.frame(spark, rows)
    grams = toxicity.corpus_grams(table)
    shared = toxicity.shared_tables(grams)
    counts = toxicity.count_grams(spark.createDataFrame([("aba abb abb", 0), ("cab abc", 1)], "text string, group int"))
    model = toxicity.Model(counts.selectExpr("gram", "a0 as n0", "a1 as n1"), shared)

    def seen(words):
        return [(b"\1" * 5 + w.encode() + b"\2")[i : i + 6] for w in words for i in range(len(w) + 1)]

    kinds = {6: set(seen("aba abb abc cab bca".split()))}
    cont = {}
    for order in range(5, 0, -1):
        cont[order] = Counter(g[1:] for g in kinds[order + 1])
        kinds[order] = set(cont[order])

    def low(g):
        p = 1 / 256
        for order in range(1, 6):
            h = g[-order:]
            total = sum(v for k, v in cont[order].items() if k[:-1] == h[:-1])
            types = sum(k[:-1] == h[:-1] for k in cont[order])
            if total:
                p = (max(cont[order][h] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * types * p) / total
        return p

    def high(g, words):
        count = Counter(seen(words))
        total, types = sum(v for k, v in count.items() if k[:-1] == g[:-1]), sum(k[:-1] == g[:-1] for k in count)
        share = max(count[g] - toxicity.DISCOUNT, 0) + (toxicity.DISCOUNT * types + toxicity.BACKOFF) * low(g)
        return share / (total + toxicity.BACKOFF)

    some = sorted(kinds[6])
    packed = np.array([int.from_bytes(g, "big") for g in some], dtype=np.uint64)
    want = [np.log(high(g, ["cab", "abc"])) - np.log(high(g, ["aba", "abb", "abb"])) for g in some]
    np.testing.assert_allclose(model.ratios(packed), want, rtol=1e-5)


def test_shared_counts_see_all_documents(spark):
    out = next(d for d in range(100) if held_out(d))
    rows = [(out, "only here: quiz", "a"), *((d, "some text", "a") for d in range(out + 1, out + 9)), (None, None, "a")]
    model = toxicity.fit(C.frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {chr(r.gram) for r in model.shared[1].collect()} == set("onlyherequizsometext") | {"\2"}


def test_counts_are_exact_for_many_ngrams(spark):
    """Statistics of 200,000 different n-grams, beside counts in dictionaries."""
    r = np.random.RandomState(5)
    letters = r.randint(97, 123, (200_000, 6)).astype(np.uint64)
    kinds = np.unique((letters << np.arange(40, -8, -8).astype(np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)
    table = spark.createDataFrame([(int(g), int(g % 3), int(g % 5)) for g in kinds[::20]], "gram long, n0 long, n1 long")
    model = toxicity.Model(table, toxicity.shared_tables(spark.createDataFrame(kinds.reshape(-1, 1).tolist(), "gram long")))
    cont, last = {}, kinds
    for order in range(5, 0, -1):
        cont[order] = Counter((last & ((1 << 8 * order) - 1)).tolist())
        last = np.array(list(cont[order]))
    sums = {order: Counter() for order in cont}
    types = {order: Counter(g >> 8 for g in cont[order]) for order in cont}
    for order, of in cont.items():
        for g, n in of.items():
            sums[order][g >> 8] += n
    some = np.concatenate([kinds[::500], r.randint(0, 1 << 48, 50)])  # the last ones are not in the corpus

    def ratio(gram):
        p = 1 / 256
        for order in range(1, 6):
            g = gram & ((1 << 8 * order) - 1)
            if total := sums[order][g >> 8]:
                p = (max(cont[order][g] - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * types[order][g >> 8] * p) / total
        logs = []
        for modulo in (3, 5):
            near = [int(g % modulo) for g in kinds[::20] if g >> 8 == gram >> 8]
            own = sum(int(g % modulo) for g in kinds[::20] if g == gram)
            share = max(own - toxicity.DISCOUNT, 0) + (toxicity.DISCOUNT * sum(n > 0 for n in near) + toxicity.BACKOFF) * p
            logs.append(np.log(max(share / (sum(near) + toxicity.BACKOFF), 1e-12)))
        return logs[1] - logs[0]

    np.testing.assert_allclose(model.ratios(some.astype(np.uint64)), [ratio(int(g)) for g in some], rtol=1e-5, atol=1e-6)


def test_sample_is_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS label")
    n = labelled_sample(rows, "label", 500).groupBy("label").count().collect()
    assert all(400 < r["count"] < 600 for r in n)
    assert labelled_sample(rows, "label", 5000).count() == 5000
