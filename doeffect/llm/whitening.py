"""Whitening of embeddings by their principal components.

1. Entries become whole numbers; one pass gives their count and exact sums.
2. A second pass centres every row (on the whole number next to the mean, so
   that products are whole numbers too) and adds up its products: a task sends
   one d x d table, the driver gets the sum, d x d whatever the rows.  What is
   left between the whole number and the mean is taken off exactly.
3. The covariance is brought to tridiagonal form by Householder reflections.
   Sturm counts (how many eigenvalues lie below a point) bisect for the
   leading eigenvalues; inverse iteration gives their vectors, those of one
   cluster of eigenvalues made orthogonal to each other each time; the
   reflections bring them back.
4. The projection is sent to the tasks; a third pass measures the covariance
   of what they return, and the result is computed in place, row by row.

Rows take part if their vector is not NULL, has no NULL or non-finite entry
and has the table's commonest length; they also must fit a whole number
(|1024 c| below 2^45).  NULL ids and repeated rows are rows like others.
Components are as many as asked for, at most d.  A component without variance
(rank below that number, or a single row) has ``whitened`` NULL and
``explained`` 0 (NULL if there is no variance at all), and ``identity_error``
is over the others.  ``deviation`` is exact, and NULL beyond 64 bits.  A table
without such rows gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import dimension, finite_rows, vector_column

UNIT = 1024
SHIFT = 100_000
WIDEST = float(1 << 45)
COMPONENTS = 8
CLUSTER = 1e-3  # of the norm: closer eigenvalues share a cluster

WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- eigenvectors of a symmetric matrix --------------------------------------


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a similar tridiagonal matrix."""
    a = np.array(matrix, np.float64)
    d = len(a)
    mirrors = []
    for k in range(d - 2):
        x = a[k + 1 :, k]
        size = np.abs(x).max()
        if size == 0 or not x[1:].any():
            mirrors.append(np.zeros(len(x)))
            continue
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        # Both sides at once: A - v w' - w v'.
        p = a[k + 1 :, k + 1 :] @ v
        w = 2 * (p - (v @ p) * v)
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * (v @ x) * v
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, points: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm count: how many eigenvalues lie below each point."""
    count = np.zeros(len(points), np.int64)
    q, beside = np.ones(len(points)), np.append(0.0, off**2)
    for k in range(len(diagonal)):
        q = diagonal[k] - points - beside[k] / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each bisected to the last bits."""
    beside = np.append(np.abs(off), 0) + np.append(0, np.abs(off))
    low, high = float((diagonal - beside).min()), float((diagonal + beside).max())
    norm = max(abs(low), abs(high))
    tiny = max(norm, np.finfo(np.float64).tiny) * np.finfo(np.float64).eps ** 2
    lo, hi = np.full(k, low - norm * 1e-15), np.full(k, high + norm * 1e-15)
    rank = len(diagonal) - 1 - np.arange(k)  # eigenvalues below the wanted one
    for _ in range(200):
        mid = (lo + hi) / 2
        if not ((mid > lo) & (mid < hi)).any():
            break
        over = below(diagonal, off, mid, tiny) > rank
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
    return (lo + hi) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solve (T - shift) x = right by elimination with row exchanges."""
    d = len(diagonal)
    main = (diagonal - shift).tolist()
    upper, second = [*off.tolist(), 0.0], [0.0] * d
    lower, x = off.tolist(), right.tolist()
    for k in range(d - 1):
        if abs(lower[k]) > abs(main[k]):
            main[k], lower[k] = lower[k], main[k]
            upper[k], main[k + 1] = main[k + 1], upper[k]
            if k + 2 < d:
                second[k], upper[k + 1] = upper[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        if abs(main[k]) < tiny:
            main[k] = tiny
        f = lower[k] / main[k]
        main[k + 1] -= f * upper[k]
        if k + 2 < d:
            upper[k + 1] -= f * second[k]
        x[k + 1] -= f * x[k]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for k in range(d - 1, -1, -1):
        rest = x[k]
        if k + 1 < d:
            rest -= upper[k] * x[k + 1]
        if k + 2 < d:
            rest -= second[k] * x[k + 2]
        x[k] = rest / main[k]
    return np.array(x)


def vectors_of(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix, by inverse iteration."""
    d = len(diagonal)
    norm = float(np.abs(diagonal).max() + (2 * np.abs(off).max() if len(off) else 0)) or 1.0
    tiny = norm * np.finfo(np.float64).eps
    random = np.random.default_rng(1)
    out = np.zeros((d, len(values)))
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # Equal eigenvalues get shifts a little apart.
        shift = min(value, shift - 4 * tiny) if k > first else value
        x = random.standard_normal(d)
        for _ in range(5):
            x = solve_shifted(diagonal, off, shift, x / np.linalg.norm(x), tiny)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= out[:, first:k] @ (out[:, first:k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def principal(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit vectors (columns)."""
    size = float(np.abs(covariance).max())
    if size == 0:
        return np.zeros(k), np.eye(len(covariance))[:, :k]
    diagonal, off, mirrors = tridiagonal(covariance / size)
    values = leading(diagonal, off, k)
    vectors = vectors_of(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1 :] -= 2 * np.outer(v, v @ vectors[at + 1 :])
    # Of the two signs that with the largest entry positive.
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values * size, vectors * sign


# --- distributed passes ------------------------------------------------------


@dataclass
class Fit:
    n: int
    sums: list[int]  # of the whole numbers, by dimension
    values: np.ndarray  # eigenvalues
    components: np.ndarray  # dimensions x components
    trace: float

    @property
    def centre(self) -> np.ndarray:
        """The whole number next to each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the mean lies above the centre."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre)])

    @property
    def with_variance(self) -> np.ndarray:
        return self.values > 1e-12 * max(self.trace, 0.0)


def whole_rows(column, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, whole numbers) of the vectors that take part."""
    rows, matrix = finite_rows(column, d)
    with np.errstate(over="ignore"):
        x = np.floor(UNIT * matrix.astype(np.float64))
    fits = (np.abs(x) < WIDEST).all(axis=1)
    return rows[fits], x[fits].astype(np.int64) + SHIFT


def _table(values: np.ndarray) -> pa.RecordBatch:
    """The cells of a matrix on and below its diagonal."""
    i, j = np.tril_indices(len(values))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values[i, j])], ["i", "j", "v"])


def _summed(cells: DataFrame, d: int) -> np.ndarray:
    """The sum of the tasks' matrices: d x d cells, whatever the rows."""
    out = np.zeros((d, d))
    for r in cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit(table: DataFrame, components: int = COMPONENTS, vec_col: str = "embedding") -> Fit | None:
    """Eigenvalues and components of the covariance of all rows that take part;
    None if there are none."""
    d = dimension(table, vec_col)
    vectors = table.select(vector_column(table, vec_col).alias("v"))

    def add(batches):
        for batch in batches:
            _, x = whole_rows(batch.column(0), d)
            if len(x):
                at = pa.array(np.arange(d), pa.int32())
                yield pa.RecordBatch.from_arrays([at, pa.array(np.full(d, len(x))), pa.array(x.sum(axis=0))], ["i", "n", "s"])

    exact = F.sum(F.col("s").cast("decimal(38,0)")).alias("s")
    found = vectors.mapInArrow(add, "i int, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), exact).orderBy("i").collect()
    if not found:
        return None
    got = Fit(found[0]["n"], [int(r["s"]) for r in found], np.zeros(0), np.zeros((d, 0)), 0.0)
    centre = got.centre

    def products(batches):
        total = np.zeros((d, d))
        for batch in batches:
            _, x = whole_rows(batch.column(0), d)
            y = (x - centre).astype(np.float64)
            total += y.T @ y
        yield _table(total)

    square = _summed(vectors.mapInArrow(products, "i int, j int, v double"), d)
    covariance = square / got.n - np.outer(got.rest, got.rest)
    got.trace = float(np.trace(covariance))
    got.values, got.components = principal(covariance, min(components, d))
    got.values = np.maximum(got.values, 0.0)
    return got


def project(x: np.ndarray, model: Fit) -> np.ndarray:
    """Whitened coordinates (components with variance only)."""
    some = model.with_variance
    y = (x - model.centre).astype(np.float64) - model.rest
    return y @ (model.components[:, some] / np.sqrt(model.values[some]))


def identity_error(table: DataFrame, model: Fit, vec_col: str = "embedding") -> float:
    """The largest entry by which the covariance of the whitened rows misses the identity."""
    d, k = len(model.sums), int(model.with_variance.sum())
    if not k:
        return 0.0

    def products(batches):
        # One more coordinate, 1, adds up the means.
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            _, x = whole_rows(batch.column(0), d)
            z = np.column_stack((project(x, model), np.ones(len(x))))
            total += z.T @ z
        yield _table(total)

    vectors = table.select(vector_column(table, vec_col).alias("v"))
    total = _summed(vectors.mapInArrow(products, "i int, j int, v double"), k + 1) / model.n
    mean = total[:k, k]
    return float(np.abs(total[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """Sum over the dimensions of (n x - sum)^2 of each row, exactly."""
    n, centre = model.n, model.centre
    left = [s - n * int(c) for s, c in zip(model.sums, centre)]
    y = x - centre
    widest = n * int(np.abs(y).max(initial=0)) + max(map(abs, left))
    if widest**2 * len(left) < 1 << 62:
        apart = n * y - np.array(left, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    out = [sum((n * v - r) ** 2 for v, r in zip(row, left)) for row in y.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whiten(
    table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """A row per input row that takes part and component, see the module's text."""
    model = fit(table, components, vec_col)
    rows = table.select(F.col(id_col).cast("long").alias("id"), vector_column(table, vec_col).alias("v"))
    if model is None:
        return table.sparkSession.createDataFrame([], WHITENED)
    error = identity_error(table, model, vec_col)
    d, k = len(model.sums), len(model.values)
    some = np.flatnonzero(model.with_variance)
    explained = pa.array(model.values / model.trace) if model.trace > 0 else pa.nulls(k, pa.float64())

    def run(batches):
        for batch in batches:
            at, x = whole_rows(batch.column(1), d)
            m = len(x)
            z = np.full((m, k), np.nan)
            z[:, some] = project(x, model)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at[each])),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n)),
                    pa.array(deviations(x, model), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel(), from_pandas=True),
                    explained.take(pa.array(np.tile(np.arange(k), m))),
                    pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, WHITENED)
