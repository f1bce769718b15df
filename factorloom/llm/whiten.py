"""Whitening of embeddings: principal components from own linear algebra, projected and scaled to unit variance.

Entries are whole numbers x. The fit list is each distinct vector once; Spark drops repeats map-side before the shuffle, so a vector that a third of all rows
share is one row a task. Two passes over it: sums per dimension, then products of centred vectors. Centring is exact, as (n*x - S) are whole
numbers, and each task sends one partial matrix, a row per dimension, which are added per dimension and, above that, in groups of FAN_IN.

Only the d x d covariance (d dimensions, never rows) comes to the driver: Householder reflections make it tridiagonal, Sturm counts bisect
its leading eigenvalues, and inverse iteration finds their vectors, orthogonalised again within clusters of close values and turned back by
the reflections. The components go out with the projection, d x k numbers, and a third pass measures the covariance of what was whitened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import query, table
from .vectors import entries, matrix, usable, width

FAN_IN, COMPONENTS, STEPS, EPS = 256, 16, 4, np.finfo(np.float64).eps
LONG_MAX = 2**63 - 1


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and reflections of a symmetric matrix (Householder)."""
    a, n, reflections = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            continue
        v = x / norm
        v[0] += np.copysign(1.0, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (v @ p) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * v * (v @ x)
        reflections.append((k + 1, v))
    return a.diagonal().copy(), a.diagonal(-1).copy(), reflections


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are below each x."""
    tiny = EPS * (np.abs(d).max(initial=0) + np.abs(e).max(initial=0)) ** 2 * EPS + np.finfo(np.float64).tiny
    q, count = np.ones_like(x), np.zeros(len(x), np.int64)
    for i in range(len(d)):
        q = d[i] - x - (e[i - 1] ** 2 / q if i else 0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection."""
    n = len(d)
    reach = np.abs(np.concatenate(([0], e))) + np.abs(np.concatenate((e, [0])))
    lo, hi = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    pad = EPS * max(abs(lo[0]), abs(hi[0])) * n + np.finfo(np.float64).tiny
    lo, hi, rank = lo - pad, hi + pad, n - np.arange(k)  # the j-th largest has n - j eigenvalues up to it
    while True:
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            return mid
        up = below(d, e, mid) >= rank
        hi, lo = np.where(up, mid, hi), np.where(up, lo, mid)


def solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) y = b for a tridiagonal T, by elimination with row exchanges; a vanishing pivot becomes a tiny one."""
    n, scale = len(d), np.abs(d).max() + np.abs(e).max(initial=0) + np.finfo(np.float64).tiny
    # rows of the upper factor have up to three entries
    u, y = np.zeros((n, 3)), b.astype(np.float64).copy()
    row = [d[0] - shift, e[0] if n > 1 else 0.0, 0.0]
    for i in range(n - 1):
        under = [e[i], d[i + 1] - shift, e[i + 1] if i + 2 < n else 0.0]
        if abs(under[0]) > abs(row[0]):
            row, under = under, row
            y[i], y[i + 1] = y[i + 1], y[i]
        if row[0] == 0:
            row[0] = EPS * scale
        f = under[0] / row[0]
        u[i] = row
        y[i + 1] -= f * y[i]
        row = [under[1] - f * row[1], under[2] - f * row[2], 0.0]
    u[-1] = row if abs(row[0]) > EPS * EPS * scale else [EPS * scale, 0, 0]
    for i in range(n - 1, -1, -1):
        y[i] = (y[i] - sum(u[i, j] * y[i + j] for j in (1, 2) if i + j < n)) / u[i, 0]
        if abs(y[i]) > 1e250:
            y *= 1e-250
    return y


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as columns, by inverse iteration; orthogonal also where values lie close together."""
    n, out, rng = len(d), np.zeros((len(d), len(values))), np.random.default_rng(7)
    close = 1e-3 * (np.abs(d).max() + 2 * np.abs(e).max(initial=0))
    start = 0
    for j, v in enumerate(values):
        if j and values[j - 1] - v > close:
            start = j
        y = rng.standard_normal(n)
        for _ in range(STEPS):
            y = solve(d, e, v, y)
            y /= np.linalg.norm(y)
            for _ in range(2):
                y -= out[:, start:j] @ (out[:, start:j].T @ y)
                y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    k = min(k, len(a))
    if not k:
        return np.zeros(0), np.zeros((len(a), 0))
    d, e, reflections = tridiagonal(a)
    values = leading(d, e, k)
    vectors = eigenvectors(d, e, values)
    for at, v in reversed(reflections):
        vectors[at:] -= 2 * np.outer(v, v @ vectors[at:])
    return values, vectors / np.linalg.norm(vectors, axis=0)


def _sums(columns: int):
    def sums(batches):
        total, n = np.zeros(columns, object), 0
        for b in batches:
            x = matrix(b.column("x"), columns, np.int64)
            # halves of 32 bits add up without overflow
            total += ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"pos": np.arange(columns), "total": pa.array([str(v) for v in total])})

    return sums


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """n * x - sums in whole numbers: 64 bits where they suffice, longer ones else."""
    if not x.size or n * int(max(x.max(), -int(x.min()))) + max(map(abs, sums)) < LONG_MAX:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _products(columns: int, of):
    """Sums of products of the columns of of(x) over the rows of a task, a row per column."""

    def products(batches):
        total, seen = None, False
        for b in batches:
            y = of(matrix(b.column("x"), columns, np.int64))
            total, seen = (y.T @ y if total is None else total + y.T @ y), True
        if seen:
            yield pa.RecordBatch.from_pydict({"pos": np.arange(len(total)), "row": pa.array(list(total), pa.list_(pa.float64()))})

    return products


def _added(key: tuple, g: pa.Table) -> pa.Table:
    m = np.stack(g.column("row").to_numpy())
    # in order of size, so that the order in which partial sums arrive does not matter
    return pa.table({"pos": pa.array([key[0].as_py()], pa.int64()), "row": pa.array([np.sort(m, axis=0).sum(0)], pa.list_(pa.float64()))})


def gram(rows: DataFrame, columns: int, of) -> np.ndarray:
    """Y'Y of Y = of(x), summed by Spark; as many rows come back as Y has columns."""
    partial = rows.select("x").mapInArrow(_products(columns, of), "pos long, row array<double>")
    some = partial.withColumn("pile", F.spark_partition_id() % FAN_IN).groupBy("pos", "pile").applyInArrow(_added, "pos long, row array<double>")
    found = some.groupBy("pos").applyInArrow(_added, "pos long, row array<double>").orderBy("pos").collect()
    return np.array([r["row"] for r in found], np.float64)


def whiten(df: DataFrame, key: str, vec: str, components: int = COMPONENTS, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row per row of df and component: (key, component, n, deviation, whitened, explained, identity_error).

    An entry c counts as the whole number floor(scale * c) + shift. n: distinct vectors; deviation: sum over dimensions of (n*x - S)^2, exact, null
    if beyond 64 bits. Components count from 1 by falling variance; those without variance (up to rounding) are left out, as what is divided by
    it has no value: with fewer than two distinct vectors there are none, and no rows.

    Rows whose vector is null or holds a null or non-finite entry are dropped; those with a null key stay, and repeated rows each have their
    rows. Shorter vectors count as ending in c = 0. The other columns of df are not looked at.
    """
    columns = width(df.where(usable(vec)), vec)
    whole = F.transform(entries(vec), lambda c: (F.floor(c * F.lit(float(scale))) + shift).cast("long"))
    # what is missing is c = 0
    padded = F.concat(whole, F.array_repeat(F.lit(shift).cast("long"), F.lit(columns) - F.size(vec)))
    rows = materialize(df.where(usable(vec)).select(F.col(key).alias("k"), padded.alias("x")), "whole-vectors")
    fit = materialize(rows.select("x").distinct(), "fit-list")
    n = fit.count()
    totals = fit.mapInArrow(_sums(columns), "pos long, total string").groupBy("pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    sums = [int(r["s"]) for r in totals]
    covariance = gram(fit, columns, lambda x: centred(x, sums, n).astype(np.float64) / n) / max(n, 1) if n and columns else np.zeros((0, 0))
    values, vectors = leading_eigen(covariance, components)
    trace = float(np.trace(covariance)) if len(covariance) else 0.0
    real = values > len(values) * 64 * EPS * trace
    values, turn = values[real], (vectors / np.sqrt(np.where(real, values, 1)))[:, real]

    def project(x: np.ndarray) -> np.ndarray:
        return (centred(x, sums, n).astype(np.float64) / n) @ turn

    error = float(np.abs(gram(fit, columns, project) / n - np.eye(len(values))).max()) if len(values) else 0.0
    share = values / trace if trace else values

    def rows_of(batches):
        for b in batches:
            x = matrix(b.column("x"), columns, np.int64)
            c, k = centred(x, sums, n), len(values)
            if not k or not len(x):
                continue
            most = float(np.abs(c.astype(np.float64)).max())
            if c.dtype == object or most * most * columns >= 2**62:
                exact = (c.astype(object) ** 2).sum(1)
                deviation = pa.array([int(v) if v <= LONG_MAX else None for v in exact], pa.int64())
            else:
                deviation = pa.array((c * c).sum(1), pa.int64())
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), deviation.take(at),
                 pa.array(project(x).reshape(-1)), pa.array(np.tile(share, len(x))), pa.array(np.full(len(x) * k, error))],
                ["k", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["k"].dataType.simpleString()
    out = rows.mapInArrow(rows_of, f"k {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("k", key)


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
