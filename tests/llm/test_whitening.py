"""Whitening against an eigensolver and exact integers."""

import math

import numpy as np
import pytest

from factlake.llm import whitening as W
from factlake.sources.tables import table


@pytest.mark.parametrize("values", [[9, 5, 4, 2, 1, .5], [1, 1, 1, 1], [3, 3, 2, 2, 0, 0], [1e6, 1, 1e-6], [5], [2, 2, 2, 1e-12, 0]])
def test_components_equal_an_eigensolver(values):
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    e, u = W.spectral_components(v)
    assert np.allclose(e, np.sort(values)[::-1], atol=1e-13 * max(values))
    assert np.allclose(u.T @ u, np.eye(len(values)), atol=1e-13) and np.allclose((u * e) @ u.T, v, atol=1e-13 * max(values))


def test_random_covariance_of_any_size():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 17, 64, 130):
        x = rng.normal(size=(3 * d + 5, d)) * rng.gamma(1, size=d)
        v = np.cov(x.T).reshape(d, d)
        e, u = W.spectral_components(v)
        w, z = np.linalg.eigh(v)
        assert np.allclose(e, w[::-1], rtol=1e-11, atol=1e-14 * w[-1])
        gap = np.abs(np.diff(w, prepend=-np.inf, append=np.inf))
        clear = np.minimum(gap[:-1], gap[1:])[::-1] > 1e-3 * w[-1]
        assert (np.abs(np.einsum("ij,ij->j", u, z[:, ::-1]))[clear] > 1 - 1e-12).all()


def brute(rows, k):
    """The contract by exact integers and numpy's eigensolver."""
    ok = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
          if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in ok}), dtype=object)
    n, s = len(fit), fit.sum(0)
    c = ((n * fit - s) / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in ok:
        y = n * np.array(x, object) - s
        out += [(i, j + 1, n, int((y * y).sum()), abs(float((y / n).astype(float) @ u[:, j] / np.sqrt(e[j]))), e[j] / e.sum()) for j in range(min(k, len(e)))]
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=6) * [3, 2, 1, .7, .5, .3]]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]                       # a third of all rows is one vector
    rows += [(3, rows[3][1]), (None, rows[9][1]), (2000, None), (2001, [1.0, None] + [0.0] * 4), (2002, [float("nan")] * 6), (2003, [float("-inf")] * 6),
             (2004, []), (2005, [1e30] * 6), (2006, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")
    got = sorted((r for r in W.whiten(df, 4).collect()), key=lambda r: (str(r.vec_id), r.component, r.whitened))
    want = sorted(brute([r for r in rows if r[0] not in (2005, 2006)], 4), key=lambda r: (str(r[0]), r[1], r[4]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    assert np.allclose([abs(r.whitened) for r in got], [w[4] for w in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r.explained for r in got], [w[5] for w in want], rtol=1e-10)
    assert {r.identity_error for r in got} and got[0].identity_error < 1e-10


def test_few_rows(spark):
    def run(rows):
        return W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = run([(1, [1.0, 5.0]), (2, [2.0, 5.0])])
    assert [(r.vec_id, r.component, abs(r.whitened)) for r in sorted(got)] == [(1, 1, pytest.approx(1)), (2, 1, pytest.approx(1))]
    big = run([(1, [2.0 ** 33]), (2, [0.0]), (3, [1.0])])
    assert len(big) == 3 and all(r.deviation is None or r.deviation > 0 for r in big)


def test_fixture(spark):
    v = table(spark, "/root/testdata/sf0.001", "embeddings")
    got = W.whiten(v).collect()
    want = {w[:2]: w for w in brute([(r.vec_id, r.embedding) for r in v.collect()], 16)}
    assert len(got) == len(want)
    for r in got:
        w = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == w[2:4] and abs(abs(r.whitened) - w[4]) < 1e-8 and abs(r.explained / w[5] - 1) < 1e-10
    assert got[0].identity_error < 1e-10
