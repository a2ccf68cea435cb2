import numpy as np
import pytest

from seqloom.llm import whitening as V

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, 6, "clash") for i, v in rows], SCHEMA).repartition(4)


def usable(rows):
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    widths = [len(v) for _, v in good]
    width = max(set(widths), key=lambda w: (widths.count(w), w))
    return [(i, v) for i, v in good if len(v) == width]


def by_hand(rows):
    good = usable(rows)
    x = np.floor(1024 * np.array([v for _, v in good])).astype(np.int64) + 100000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in good], x, n, sums, centred, values[::-1], vectors[:, ::-1]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 12)) * np.linspace(3, 0.2, 12) @ np.linalg.qr(r.normal(size=(12, 12)))[0]
    out = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (None, x[9].tolist())]
    return out + [(400, None), (401, []), (402, [None] * 12), (403, [float("nan")] + [0.0] * 11), (404, [0.0] * 11 + [float("inf")]), (405, [1.0] * 5)]


def test_whitened_rows(spark, rows):
    got = V.whiten(frame(spark, rows))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ids, x, n, sums, centred, values, vectors = by_hand(rows)
    found = got.collect()
    assert n == 302 and len(found) == 8 * n and {r.n for r in found} == {n}
    deviations = {i: int(d) for i, d in zip(ids, ((n * x - sums) ** 2).sum(axis=1))}
    assert all(r.deviation == deviations[r.vec_id] for r in found)
    (error,) = {r.identity_error for r in found}
    assert error < 1e-9
    for k in range(8):
        mine = {r.vec_id: r for r in found if r.component == k + 1}
        want = centred @ vectors[:, k] / np.sqrt(values[k])
        here = np.array([mine[i].whitened for i in ids])
        np.testing.assert_allclose(here * np.sign(here @ want), want, atol=1e-9)
        assert mine[ids[0]].explained == pytest.approx(values[k] / values.sum(), rel=1e-9)


def test_constant_dimensions_and_few_of_them(spark):
    flat = V.whiten(frame(spark, [(i, [float(i % 5), 2.0, float(i % 5)]) for i in range(40)])).collect()
    assert len(flat) == 120
    assert all((r.whitened is None) == (r.component > 1) and r.explained == pytest.approx(float(r.component == 1)) for r in flat)
    assert {r.identity_error for r in flat} == {flat[0].identity_error} and flat[0].identity_error < 1e-9
    same = V.whiten(frame(spark, [(1, [0.5, 0.5])] * 3)).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in same)


def test_no_rows(spark, rows):
    assert V.whiten(frame(spark, rows).limit(0)).collect() == []
    assert V.whiten(frame(spark, [(1, None), (2, [None]), (3, [])])).collect() == []


def test_deviation_beyond_a_long(spark):
    rows = [(i, [float(s), 0.0]) for i, s in enumerate((2.0**40, -(2.0**40), 2.0**51, 1.0))]
    got = {r.vec_id: r.deviation for r in V.whiten(frame(spark, rows)).collect()}
    assert set(got) == {0, 1, 3} and got[0] is None
    x = [1024 * 2**40 + 100000, -1024 * 2**40 + 100000, 101024]
    exact = (3 * x[2] - sum(x)) ** 2
    assert got[3] == exact < 2**63


def spectrum(kind, d, r):
    values = np.sort(r.uniform(1, 100, d))[::-1]
    if kind == "equal":
        values[: d // 2] = values[0]
    if kind == "low rank":
        values[2:] = 0
    if kind == "close":
        values[: min(5, d)] = (values[0] * (1 + 1e-9 * np.arange(min(5, d))))[::-1]
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    matrix = (q * values) @ q.T
    return (matrix + matrix.T) / 2


@pytest.mark.parametrize("kind", ["apart", "equal", "low rank", "close"])
@pytest.mark.parametrize("d", [1, 2, 7, 64])
def test_slices_of_the_spectrum(kind, d):
    matrix = spectrum(kind, d, np.random.default_rng(d))
    values, vectors = V.leading_eigenvectors(matrix, 8)
    want = np.linalg.eigvalsh(matrix)[::-1][:8]
    np.testing.assert_allclose(values, want, atol=1e-11 * want[0])
    np.testing.assert_allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-12)
    np.testing.assert_allclose(matrix @ vectors.T, vectors.T * values, atol=1e-11 * want[0])


def test_counts():
    r = np.random.default_rng(0)
    for d in (1, 2, 3, 10, 40):
        for _ in range(20):
            a = r.normal(size=(d, d)) * (r.random((d, d)) < 0.4)
            a = a + a.T
            shift = r.normal()
            assert V.count_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()
    zero_diagonal = np.array([[0.0, 2.0], [2.0, 0.0]])
    assert V.count_above(zero_diagonal, 0.0) == 1 and V.count_above(np.zeros((3, 3)), 0.0) == 0
