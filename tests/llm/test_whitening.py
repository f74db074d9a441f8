import numpy as np
import pytest
from pyspark.sql import types as T

from doeffect.llm import whitening as W

from . import vector_cases


def matrices():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.normal(size=(12, 12)))
    clustered = q @ np.diag([5, 5, 5, 5 - 1e-9, 3, 3 - 1e-5, 1, 1, 1, 0, 0, 0]) @ q.T
    return {
        "random": np.cov(r.normal(size=(40, 9)).T),
        "clustered": (clustered + clustered.T) / 2,
        "identity": np.eye(7),
        "diagonal": np.diag([3.0, 1.0, 3.0, 2.0, 0.0]),
        "rank_one": np.outer(np.arange(6.0), np.arange(6.0)),
        "one": np.array([[4.0]]),
        "two": np.array([[2.0, 1.0], [1.0, 2.0]]),
        "tiny": np.cov(r.normal(size=(40, 8)).T) * 1e-200,
        "large": np.cov(r.normal(size=(40, 8)).T) * 1e200,
        "decoupled": np.kron(np.eye(3), np.array([[2.0, 1.0], [1.0, 2.0]])),
    }


@pytest.mark.parametrize("name", sorted(matrices()))
def test_eigenvectors(name):
    a = matrices()[name]
    k = min(8, len(a))
    values, vectors = W.principal(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    size = np.abs(a).max()
    assert np.abs(values - want).max() <= 1e-12 * size * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-11 * size * len(a)


def test_tridiagonal_is_similar():
    a = matrices()["random"]
    diagonal, off, _ = W.tridiagonal(a)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    assert np.allclose(np.linalg.eigvalsh(t), np.linalg.eigvalsh(a), atol=1e-13)
    points = np.array([-1.0, 0.3, 0.9, 5.0])
    assert W.below(diagonal, off, points, 1e-300).tolist() == [(np.linalg.eigvalsh(a) < p).sum() for p in points]


def taking_part(data, d):
    ok = [r for r in data if r[1] is not None and len(r[1]) == d and all(x is not None and np.isfinite(x) for x in r[1])]
    return ok, [[int(np.floor(1024 * float(x))) + 100000 for x in r[1]] for r in ok]


def brute(data, d, k=8):
    """vec_id and component: everything but the sign of the whitened value."""
    ok, x = taking_part(data, d)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * v - s) / n for v, s in zip(row, sums)] for row in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for r, row, centred in zip(ok, x, y):
        deviation = sum((n * v - s) ** 2 for v, s in zip(row, sums))
        for c in range(min(k, d)):
            z = centred @ vectors[:, c] / np.sqrt(values[c])
            out.append((r[0], c + 1, n, deviation, abs(z), values[c] / values.sum()))
    return out


@pytest.mark.parametrize("element", [T.FloatType(), T.DoubleType()])
def test_matches_brute_force(spark, element):
    d = 10
    data = vector_cases.rows(150, d) + vector_cases.odd_rows(d)
    data += [(3, data[3][1], *data[3][2:]), (None, data[5][1], None, None, None, None, None)]  # repeated, NULL id
    got = W.whiten(vector_cases.frame(spark, data, element)).collect()
    want = brute(data, d)
    key = lambda t: (t[0] is None, t[0] or 0, t[1], t[4])
    got_rows = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    for g, w in zip(got_rows, sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        assert abs(g[4] - w[4]) < 1e-9 and abs(g[5] - w[5]) < 1e-12
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_same_sign_for_all_rows(spark):
    data = vector_cases.rows(90, 4)
    got = {(r.vec_id, r.component): r.whitened for r in W.whiten(vector_cases.frame(spark, data)).collect()}
    z = np.array([[got[i, c] for c in range(1, 5)] for i in range(90)])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(4)).max() < 1e-10


def test_no_variance(spark):
    same = [(i, [1.0, -2.0, 0.5], "", "", 0, 0, 0) for i in range(4)]
    got = W.whiten(vector_cases.frame(spark, same)).collect()
    assert len(got) == 12 and {(r.whitened, r.explained, r.deviation, r.identity_error) for r in got} == {(None, None, 0, 0.0)}
    # Two points: one component has variance.
    line = [(i, [float(i), -2.0 * i, 0.5], "", "", 0, 0, 0) for i in range(5)]
    got = W.whiten(vector_cases.frame(spark, line)).collect()
    assert {r.component for r in got if r.whitened is not None} == {1} and len(got) == 15
    assert all(abs(r.explained - (r.component == 1)) < 1e-12 for r in got)
    for nothing in ([], vector_cases.odd_rows()[:2]):
        assert W.whiten(vector_cases.frame(spark, nothing)).collect() == []


def test_deviation_is_exact_beyond_doubles():
    model = W.Fit(3, [3 * 10**6 + 1, 5], np.zeros(0), np.zeros((2, 0)), 0.0)
    x = np.array([[10**6 + 123456789, 2], [7, 10**18 // 10**9]])
    want = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, model.sums)) for row in x]
    assert W.deviations(x, model) == want
    far = np.array([[1 << 45, 0]])
    assert W.deviations(far, model) == [None]


def test_explained_on_the_tables(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    data = [(r.vec_id, r.embedding) for r in table.collect()]
    d = len(data[0][1])
    want = {(r[0], r[1]): r for r in brute(data, d)}
    got = W.whiten(table).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.vec_id, r.component]
        assert r.deviation == w[3] and abs(abs(r.whitened) - w[4]) < 1e-7 and abs(r.explained - w[5]) < 1e-10
