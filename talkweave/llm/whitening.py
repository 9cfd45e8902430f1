"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
_EXACT = 1 << 53
_LONG = 1 << 63


@dataclass
class Whitening:
    """n vectors with sums per dimension; column k of components is the unit eigenvector of eigenvalues[k], falling."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and what is left of each sum beyond n times these, both exact."""
        mean = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(mean, "i8"), np.array([s - self.n * m for s, m in zip(self.sums, mean)], "i8")


def _finite(column: str):
    """Whether a vector is neither null nor holds null or non-finite entries."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, fine), F.lit(False))


def _grids(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) for each length of the vectors in a batch's last column: x holds floor(64 c) + 1000000 as longs, at most 2^62 in size."""
    v = batch.column(batch.num_columns - 1)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    size = v.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.cumsum(size) - size
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        c = flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), d)
        with np.errstate(over="ignore"):
            yield rows, np.clip(np.floor(SCALE * c), -(2.0**62), 2.0**62).astype("i8") + SHIFT


def _exact_product(x: np.ndarray) -> np.ndarray:
    """x transposed times x, as Python integers. Doubles are exact as long as every sum of a block stays below 2^53; else integers multiply."""
    most = int(np.abs(x).max(initial=0))
    step = max(1, min(len(x), (_EXACT - 1) // max(1, most * most)))
    if most * most >= _EXACT:
        x = x.astype(object)
        return x.T @ x
    total = np.zeros((x.shape[1],) * 2, object)
    for a in range(0, len(x), step):
        f = x[a : a + step].astype("f8")
        total += (f.T @ f).astype("i8").astype(object)
    return total


def _column_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, place, n, total) of each length that a task meets."""
    found: dict[int, list] = {}
    for b in batches:
        for rows, x in _grids(b):
            at = found.setdefault(x.shape[1], [0, np.zeros(x.shape[1], object)])
            at[0] += len(rows)
            at[1] = at[1] + x.sum(0, dtype=object)
    rows = [(d, k, n, t) for d, (n, total) in found.items() for k, t in enumerate(total)]
    yield _sum_batch(rows, ("dim", "place", "n"), (pa.int32(), pa.int32(), pa.int64()))


_HALVES = "high decimal(38,0), low decimal(38,0)"


def _sum_halves():
    return F.sum("high").alias("high"), F.sum("low").alias("low")


def _sum_batch(rows: list[tuple], names: tuple, types: tuple) -> pa.RecordBatch:
    """Rows whose last number, of any size, is cut in two: high and low, in units of 10^18 and 1."""
    columns = list(zip(*rows)) if rows else [()] * (len(types) + 1)
    cut = list(zip(*(divmod(int(x), 10**18) for x in columns[-1]))) or [(), ()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types)] + [pa.array(map(Decimal, c), pa.decimal128(38, 0)) for c in cut]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "high", "low"])


def _whole(row) -> int:
    return int(row.high) * 10**18 + int(row.low)


def _scatter(dim: int, mean: np.ndarray):
    """(i, j, total), i <= j: exact products of vectors centred by the nearest whole mean, summed over a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), object)
        for b in batches:
            for _, x in _grids(b):
                if x.shape[1] == dim:
                    total = total + _exact_product(x - mean)
        rows = [(i, j, total[i, j]) for i in range(dim) for j in range(i, dim) if total[i, j]]
        yield _sum_batch(rows, ("i", "j"), (pa.int32(), pa.int32()))

    return run


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(l, order): v[order][:, order] = l l^T, l lower triangular with as many columns as v has rank in double precision.

    Each step takes the largest remaining diagonal entry; it ends where that one is rounding noise of the first.
    """
    d = len(v)
    left, l, order = v.diagonal().copy(), np.zeros((d, d)), []
    floor = d * np.finfo("f8").eps * max(left.max(initial=0.0), 0.0)
    while len(order) < d:
        free = np.setdiff1d(np.arange(d), order)
        p = free[np.argmax(left[free])]
        if left[p] <= floor:
            break
        k = len(order)
        column = v[:, p] - l[:, :k] @ l[p, :k]
        column[order] = 0.0
        l[:, k] = column / np.sqrt(column[p])
        left -= l[:, k] ** 2
        order.append(int(p))
    rank = len(order)
    order += [int(p) for p in np.setdiff1d(np.arange(d), order)]
    return l[order][:, :rank], order


def one_sided_jacobi(l: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """l times a rotation that makes its columns orthogonal: round-robin pairs, each round's rotations at once."""
    a, r = l.copy(), l.shape[1]
    eps = 4 * np.finfo("f8").eps
    ring = list(range(r + r % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(max(1, len(ring) - 1)):
            half = len(ring) // 2
            pairs = [(x, y) for x, y in zip(ring[:half], ring[: half - 1 : -1]) if x < r and y < r]
            ring = ring[:1] + ring[-1:] + ring[1:-1]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            need = np.abs(xy) > eps * np.sqrt(xx * yy)
            if not need.any():
                continue
            turned = True
            p, q, x, y, xx, yy, xy = p[need], q[need], x[:, need], y[:, need], xx[need], yy[need], xy[need]
            z = (yy - xx) / (2 * xy)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
            c = 1 / np.sqrt(1 + t * t)
            a[:, p], a[:, q] = c * x - c * t * y, c * t * x + c * y
        if not turned:
            break
    return a


def principal_components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(components, eigenvalues) of a covariance, at most ``most`` and as many as its rank; columns are components by falling eigenvalue."""
    l, order = pivoted_cholesky(v)
    a = one_sided_jacobi(l)
    values = (a * a).sum(0)
    first = np.argsort(-values, kind="stable")[:most]
    out = np.empty((len(v), len(first)))
    out[order] = a[:, first] / np.sqrt(values[first])
    return out, values[first]


def _vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    return vectors.where(_finite(vector_col)).select(F.col(vector_col).cast("array<double>").alias("v"))


def fit(vectors: DataFrame, vector_col: str = "embedding", most: int = 32) -> Whitening | None:
    """The whitening of all usable vectors of the commonest length (ties: the longest), or None if there are none.

    Two passes, each summed in tasks and then by Spark: n and the sums of each dimension, then the products of
    centred vectors. All of these are whole numbers and exact, however rows are dealt: vectors are centred by the
    nearest whole mean before they are multiplied, and the rest of the mean, at most a half, comes off afterwards
    without rounding. The driver gets a number for each pair of dimensions, whatever the rows.
    """
    src = _vectors(vectors, vector_col)
    sums = src.mapInArrow(_column_sums, f"dim int, place int, n long, {_HALVES}").groupBy("dim", "place").agg(F.sum("n").alias("n"), *_sum_halves())
    sums = sums.groupBy("dim").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "high", "low"))).alias("sums")).orderBy(F.desc("n"), F.desc("dim"))
    got = sums.first()
    if got is None:
        return None
    dim, n = got.dim, got.n
    model = Whitening(n, [_whole(s) for s in got.sums], np.empty((dim, 0)), np.empty(0), 0.0)
    mean, rest = model.parts()
    v = np.zeros((dim, dim))
    scatter = src.mapInArrow(_scatter(dim, mean), f"i int, j int, {_HALVES}").groupBy("i", "j").agg(*_sum_halves())
    products = {(r.i, r.j): _whole(r) for r in scatter.collect()}
    for i in range(dim):
        for j in range(i, dim):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - int(rest[i]) * int(rest[j])) / (n * n)
    model.components, model.eigenvalues = principal_components(v, most)
    model.trace = float(v.trace())
    return model


def _whitened(x: np.ndarray, model: Whitening, mean: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return ((x - mean) - rest / model.n) @ model.components / np.sqrt(model.eigenvalues)


def _deviations(x: np.ndarray, model: Whitening, mean: np.ndarray, rest: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - sum)^2 of each row, exact."""
    x = x - mean
    most = model.n * (int(np.abs(x).max(initial=0)) + 1)
    rest = rest.astype(object) if x.shape[1] * most * most >= _LONG else rest
    if x.shape[1] * most * most >= _LONG:
        x = x.astype(object)
    return ((model.n * x - rest) ** 2).sum(1).tolist()


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them.

    A task centres its vectors before it multiplies them; its mean and scatter then merge with the others'.
    """
    mean, rest = model.parts()
    k, dim = model.components.shape[1], len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mu, scatter = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            for rows, x in _grids(b):
                if x.shape[1] == dim:
                    w = _whitened(x, model, mean, rest)
                    own = w.mean(0)
                    c, step = w - own, own - mu
                    scatter += c.T @ c + np.outer(step, step) * (n * len(rows) / (n + len(rows)))
                    mu = mu + step * (len(rows) / (n + len(rows)))
                    n += len(rows)
        full = scatter + n * np.outer(mu, mu)
        found = [(i, -1, float(n * mu[i])) for i in range(k)] + [(i, j, float(full[i, j])) for i in range(k) for j in range(i, k)] if n else []
        columns = list(zip(*found)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], names=["i", "j", "total"])

    rows = _vectors(vectors, vector_col).mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    total = {(r.i, r.j): r.total / model.n for r in rows}
    return max((abs(t - total[i, -1] * total[j, -1] - (i == j)) for (i, j), t in total.items() if j >= 0), default=0.0)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Entries c become whole numbers floor(64 c) + 1000000, at most 2^62 in size. Components are numbered from 1, at
    most ``most`` and no more than the covariance's rank, so equal vectors alone give no rows. deviation is exact, as
    decimal(38,0), and null beyond that. Vectors that are null or hold null or non-finite entries, and those of another length than the
    commonest (ties: the longest), are left out of the fit and the result. Ids may be null or repeat and have any
    type; every row counts. No rows give no rows. Other columns don't matter.
    """
    model = fit(vectors, vector_col, most)
    types = f"`{id_col}` {vectors.schema[id_col].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return vectors.sparkSession.createDataFrame([], types)
    error = identity_error(vectors, model, vector_col)
    mean, rest = model.parts()
    k, dim = model.components.shape[1], len(model.sums)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _grids(b):
                if x.shape[1] != dim:
                    continue
                each = np.repeat(np.arange(len(rows)), k)
                deviation = pa.array([Decimal(d) if d < 10**38 else None for d in _deviations(x, model, mean, rest)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows[each])), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(rows))), pa.array(np.full(len(each), model.n)),
                        deviation.take(pa.array(each)), pa.array(_whitened(x, model, mean, rest).ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(len(each), error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    src = vectors.where(_finite(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return src.mapInArrow(run, types)
