"""Embedding whitening by QDWH spectral divide and conquer.

Spark counts and sums the distinct quantised vectors, then their centred
products.  The covariance, whose size depends on the dimension alone, is taken
apart on the driver: the polar factor of the shifted matrix (QR-based dynamically
weighted Halley iteration) is the matrix sign, which gives the projectors on the
invariant subspaces above and below the shift, and each subspace is split again
until it is one component.  The components travel to the tasks, which whiten
the rows where they lie.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.suffix_dedup import stored

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(2 ** 40)    # entries beyond this have no exact x; their vectors count as not finite
RANK = 1e-11                # components with less than this share of the variance are rounding
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
_EPS = np.finfo(float).eps


# ------------------------------------------------------- spectral decomposition
def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH: each step is the
    best rational map of singular values in ``[low, 1]`` towards 1, taken through
    a QR factorisation, so no inverse is formed.  Six steps lift the smallest
    double to 1."""
    m = len(a)
    x = a / np.linalg.norm(a)
    low = _EPS
    for _ in range(12):
        d = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        wa = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low ** 2) / (low ** 2 * np.sqrt(1 + d)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(m)]))[0]
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:m] @ q[m:].T)
        new = (new + new.T) / 2
        step, x = np.linalg.norm(new - x), new
        low = min(low * (wa + wb * low ** 2) / (1 + wc * low ** 2), 1.0)
        if step < 1e-10 and 1 - low < 1e-8:
            break
    return x


def _split(a: np.ndarray, shift: float):
    """Orthonormal bases of the invariant subspaces of ``a`` above and below
    the shift, or None if the shift does not separate it cleanly."""
    m = len(a)
    shifted = a - shift * np.eye(m)
    c = (polar_factor(shifted) + np.eye(m)) / 2
    k = int(round(np.trace(c)))
    if not 0 < k < m or np.linalg.norm(c @ c - c) > 1e-9 * m:
        return None
    start = np.random.default_rng(m).normal(size=(m, m))
    up, down = c @ start[:, :k], start[:, k:] - c @ start[:, k:]
    for _ in range(2):          # the second pass mends a badly placed start
        up, down = np.linalg.qr(c @ up)[0], np.linalg.qr(down - c @ down)[0]
    q = np.linalg.qr(np.hstack([up, down]))[0]
    return q[:, :k], q[:, k:]


def spectral_components(v: np.ndarray) -> tuple:
    """``(values, vectors)``: eigenvalues of a symmetric matrix, falling, and
    unit eigenvectors as columns."""
    d = len(v)
    scale = np.linalg.norm(v)
    todo, leaves = [np.eye(d)], []
    while todo:
        basis = todo.pop()
        a = basis.T @ v @ basis
        a = (a + a.T) / 2
        m = len(a)
        mean = np.trace(a) / m
        rest = np.linalg.norm(a - mean * np.eye(m))
        if m == 1 or rest <= 4 * m * _EPS * scale:
            leaves.append(basis)
            continue
        # the median halves the work; the mean always lies between the ends
        for shift in (np.median(np.diag(a)), mean, *(mean + rest / m * t for t in (0.31, -0.31, 0.13, -0.13, 0.03, -0.03))):
            parts = _split(a, shift)
            if parts:
                todo += [basis @ p for p in parts]
                break
        else:
            raise ArithmeticError("no shift separates the spectrum")
    q = np.linalg.qr(np.hstack(leaves))[0]
    for _ in range(2):          # first-order correction: takes out what rounding mixed between components
        t = q.T @ v @ q
        gap = np.diag(t)[None, :] - np.diag(t)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(np.abs(gap) > 1e3 * np.abs(t), t / gap, 0.0)
        np.fill_diagonal(w, 0.0)
        u, r = np.linalg.qr(q + q @ w)
        q = u * np.sign(np.diag(r))
    values = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-values, kind="stable")
    return values[order], q[:, order]


# ------------------------------------------------------------------ Spark passes
def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, x array<bigint>)`` of the vectors that take part."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    v = v.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(fine)
    return v.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT)).alias("x"))


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _sums(fit: DataFrame, d: int) -> tuple:
    """Rows and exact sums per dimension."""
    def run(batches):
        n, s = 0, np.zeros(d, object)
        for b in batches:
            n += b.num_rows
            s += _matrix(b.column(0)).sum(axis=0, dtype=np.int64) if b.num_rows else 0
        yield pa.RecordBatch.from_pydict({"i": pa.array([-1, *range(d)], pa.int32()), "s": pa.array([n, *map(int, s)], pa.int64())})

    got = {r["i"]: r["s"] for r in fit.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def _gram(fit: DataFrame, d: int, rows_of) -> np.ndarray:
    """Sum over the fit list of ``y y^T``, ``y`` being ``rows_of`` a block of x.
    One partial triangle per task, added up by Spark: what is collected
    depends on the dimension alone."""
    at = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                y = rows_of(_matrix(b.column(0)))
                total += y.T @ y
        yield pa.RecordBatch.from_pydict({"i": pa.array(at[0], pa.int32()), "j": pa.array(at[1], pa.int32()), "s": total[at]})

    t = fit.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((d, d))
    i, j, s = (t[c].to_numpy() for c in ("i", "j", "s"))
    out[i, j] = out[j, i] = s
    return out


def centring(n: int, sums: list):
    """Function from rows of x to ``x - S/n``: whole parts first, which are exact."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return lambda x: (x - whole) - part


def deviations(x: np.ndarray, n: int, sums: list) -> list:
    """Sum over dimensions of ``(n x - S)^2``, exact; null beyond 64 bits."""
    if not len(x):
        return []
    reach = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)))
    if n * int(np.abs(x).max()) < 2 ** 62 and reach ** 2 * x.shape[1] < 2 ** 62:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 2 ** 63 else None for v in out]


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``,
    one row per vector that takes part and component.

    Entries become ``floor(64 c) + 1000000``.  The covariance is that of the
    distinct vectors; components are its unit eigenvectors by falling
    eigenvalue, numbered from 1.  Null or empty vectors and those with a null, NaN, infinite
    or absurdly large (2^40) entry are dropped; so are vectors whose length is
    not the commonest one (ties: the shorter).  Rows that repeat an id or a
    vector, and null ids, each give rows of their own.  Directions with less
    than ``RANK`` of the variance are no components, so equal vectors alone, or an
    empty table, give an empty result.  ``deviation`` is null where it exceeds a long.
    """
    v = quantised(vectors, id_col, vec_col)
    common = v.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "d").first()
    d = common["d"] if common else 1
    v = v.where(F.size("x") == d)
    fit = stored(v.select("x").distinct())
    n, sums = _sums(fit, d)
    values, vectors_, k, identity = np.zeros(0), np.zeros((d, 0)), 0, 0.0
    trace = 1.0
    if n:
        centred = centring(n, sums)
        cov = _gram(fit, d, centred) / n
        trace = float(np.trace(cov))
        if trace > 0:
            values, vectors_ = spectral_components(cov)
            k = int(min(components, (values > RANK * trace).sum()))
    weights = vectors_[:, :k] / np.sqrt(values[:k])
    if k:
        # a row of ones beside the components gives their means
        g = _gram(fit, k + 1, lambda x: np.hstack([centred(x) @ weights, np.ones((len(x), 1))])) / n
        identity = float(np.abs(g[:k, :k] - np.outer(g[:k, k], g[:k, k]) - np.eye(k)).max())
    explained = values[:k] / trace

    def run(batches):
        for b in batches:
            if not k or not b.num_rows:
                continue
            x = _matrix(b.column(1))
            y = centred(x) @ weights
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_pydict({
                "vec_id": b.column(0).take(at), "component": pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                "n": np.full(len(x) * k, n), "deviation": pa.array(deviations(x, n, sums), pa.int64()).take(at),
                "whitened": y.ravel(), "explained": np.tile(explained, len(x)), "identity_error": np.full(len(x) * k, identity)})

    return v.mapInArrow(run, OUT)
