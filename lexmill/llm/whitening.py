"""Embedding whitening by QDWH spectral divide-and-conquer.

Spark sums what the covariance needs over all distinct vectors; the driver splits the dim x dim
covariance: the polar factor of the shifted matrix gives the projectors on the subspaces of larger and of
smaller eigenvalues, each of which is split again down to single components.  The components go
to the tasks, which whiten every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

EPS = np.finfo(np.float64).eps
#: Entries of a size from which 64 times the entry leaves the whole numbers that a double holds exactly.
LARGEST = 2.0**46


def polar_factor(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric nonsingular matrix by the QR-based dynamically weighted Halley iteration."""
    alpha = np.linalg.norm(a)
    x, eye = a / alpha, np.eye(len(a))
    # A lower bound of the smallest singular value of x.
    low = max(min(1.0, 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(len(a)))), EPS / 4)
    for _ in range(40):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + d) + np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + d)), 0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[: len(a)] @ q[len(a) :].T
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(EPS) / 10 and abs(1 - low) <= 1e-8:
            break
    return (x + x.T) / 2


def _subspaces(a: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Orthonormal columns, and how many of them span the subspace of eigenvalues above the shift; None if a is a multiple of the identity to rounding."""
    n, scale = len(a), np.linalg.norm(a)
    centre = np.trace(a) / n
    spread = np.linalg.norm(a - centre * np.eye(n))
    if spread <= 4 * n * EPS * scale:
        return None
    for shift in (0.0, 0.05, -0.05, 0.13, -0.13, 0.3, -0.3):
        # A shift on an eigenvalue leaves no clear sign; the next one is tried.
        at = a - (centre + shift * spread / np.sqrt(n)) * np.eye(n)
        try:
            u = polar_factor(at)
        except np.linalg.LinAlgError:
            continue
        p = (u + np.eye(n)) / 2
        k = round(float(np.trace(p)))
        if 0 < k < n and np.linalg.norm(p @ p - p) <= 1e-10 * n:
            first = np.argsort(-np.diag(p), kind="stable")
            q, _ = np.linalg.qr(p[:, first[:k]])
            q, _ = np.linalg.qr(p @ q)
            rest, _ = np.linalg.qr((np.eye(n) - q @ q.T)[:, first[k:]])
            rest, _ = np.linalg.qr(rest - q @ (q.T @ rest))
            both = np.hstack([q, rest])
            if np.linalg.norm(both.T @ both - np.eye(n)) <= 1e-12 * n and np.linalg.norm(q.T @ a @ rest) <= 1e-12 * n * scale:
                return both, k
    raise ArithmeticError("no shift splits the matrix")


def spectral_components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by spectral divide-and-conquer."""
    a = (a + a.T) / 2
    basis, todo = np.eye(len(a)), [(0, len(a))]
    while todo:
        start, end = todo.pop()
        if end - start < 2:
            continue
        own = basis[:, start:end]
        block = own.T @ a @ own
        split = _subspaces((block + block.T) / 2)
        if split:
            q, k = split
            basis[:, start:end] = own @ q
            todo += [(start, start + k), (start + k, end)]
    values = np.einsum("ij,ij->j", basis, a @ basis)
    order = np.argsort(-values, kind="stable")
    return values[order], basis[:, order]


class Whitening(NamedTuple):
    n: int
    base: np.ndarray  # whole number near each dimension's mean
    over: np.ndarray  # sum of the dimension less n * base
    values: np.ndarray
    basis: np.ndarray
    trace: float


def lattice(vector: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """Each entry c as the long floor(scale * c) + offset; null where the vector is null, empty or holds an entry that is null, not finite or LARGEST and more in size."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST)
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + offset)
    return F.when((F.size(vector) > 0) & ~F.exists(vector, bad), whole)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _centred(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """n * x - S as whole numbers (an object array where they may not fit 63 bits)."""
    d = x - fit.base
    if (np.abs(d).max(initial=0) + 1.0) * fit.n >= 2.0**62:
        return d.astype(object) * fit.n - fit.over.astype(object)
    return d * fit.n - fit.over


def _gram(fit: Whitening, project: bool):
    """Partial sums of the products of all pairs of dimensions of centred (and, if wanted, whitened) vectors, a row of the matrix a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                d = _centred(_matrix(batch.column(0)), fit).astype(np.float64) / fit.n
                if project:
                    d = d @ fit.basis / np.sqrt(fit.values)
                total = d.T @ d + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "sums"])

    return run


def _matrix_sum(parts: DataFrame) -> np.ndarray:
    rows = parts.select("i", F.posexplode("sums").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max((r["i"] for r in rows), default=-1) + 1
    out = np.zeros((size, size))
    for r in rows:
        out[r["i"], r["j"]] = r["v"]
    return out


def fit_whitening(distinct: DataFrame, components: int) -> tuple[Whitening | None, float]:
    """Whitening from a table of distinct vectors x (array<long>, all of one length), and the largest entry by which the whitened
    covariance differs from the identity.  Eigenvalues at the level of rounding have no component.  None without vectors that differ.

    Only sums come to the driver: one number for each dimension and for each pair of dimensions.
    """
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not sums:
        return None, 0.0
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    fit = Whitening(n, np.array([s // n for s in total]), np.array([s % n for s in total]), np.ones(0), np.ones((len(total), 0)), 0.0)
    cov = _matrix_sum(distinct.select("x").mapInArrow(_gram(fit, False), "i int, sums array<double>")) / n
    values, basis = spectral_components(cov)
    kept = min(components, int((values > len(values) * EPS * max(values.max(initial=0.0), 0.0)).sum()))
    if not kept:
        return None, 0.0
    fit = fit._replace(values=values[:kept], basis=basis[:, :kept], trace=float(np.trace(cov)))
    check = _matrix_sum(distinct.select("x").mapInArrow(_gram(fit, True), "i int, sums array<double>")) / n
    return fit, float(np.abs(check - np.eye(kept)).max())


def whiten_embeddings(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(id_col, component int, n long, deviation long, whitened double, explained double, identity_error double): a row for every vector and component.

    Vectors are fitted as whole numbers (`lattice`), each distinct one once, so copies don't weigh.  Rows whose vector is
    null, empty or holds a null or an entry that isn't finite (or of LARGEST in size) have no result; nor have vectors whose length isn't the one that most rows have
    (ties: the longer).  Repeated and null ids are rows like any other.  With fewer dimensions of any
    variance than `components` there are as many components as those; without any (an empty table, one vector) the result is empty.  deviation
    is null where it doesn't fit a long.  Other columns aren't read.
    """
    light = rows.select(F.col(id_col).alias("id"), lattice(F.col(vec_col), scale, offset).alias("x")).where("x is not null")
    light = cut(light)
    lengths = light.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("dim")).limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    light = light.where(F.size("x") == dim)
    fit, error = fit_whitening(cut(light.select("x").distinct()), components)
    kind = light.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or fit is None:
                continue
            d, k = _centred(_matrix(batch.column(1)), fit), len(fit.values)
            real = d.astype(np.float64)
            white = real / fit.n @ fit.basis / np.sqrt(fit.values)
            fits = d.dtype != object and (real**2).sum(1).max() < 2.0**62
            far = (d * d).sum(1).tolist() if fits else [int(v) if (v := sum(int(e) ** 2 for e in row)) < 2**63 else None for row in d]
            at = np.repeat(np.arange(batch.num_rows), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(at), fit.n, np.int64)),
                 pa.array(far, pa.int64()).take(pa.array(at)), pa.array(white.reshape(-1)), pa.array(np.tile(fit.values / fit.trace, batch.num_rows)), pa.array(np.full(len(at), error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return light.mapInArrow(run, schema).withColumnRenamed("id", id_col)
