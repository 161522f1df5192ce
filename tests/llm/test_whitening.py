"""Whitening against numpy's eigenvectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm.whitening import polar_factor, spectral_components, whiten_embeddings


@pytest.mark.parametrize("n", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["random", "same", "two values", "low rank", "wide range"])
def test_components_diagonalise(n, kind):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, n))
    q = np.linalg.qr(m)[0]
    a = {"random": m @ m.T, "same": 3 * np.eye(n), "two values": (q * np.where(np.arange(n) < n // 2, 5.0, 1.0)) @ q.T,
         "low rank": m[:, : max(1, n // 3)] @ m[:, : max(1, n // 3)].T, "wide range": (q * np.logspace(3, -9, n)) @ q.T}[kind]
    values, basis = spectral_components(a)
    scale = np.abs(a).max()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * n * scale
    assert np.abs(basis.T @ basis - np.eye(n)).max() < 1e-12 * n
    assert np.abs(a @ basis - basis * values).max() < 1e-12 * n * scale


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    signs = np.array([1, 1, -1, -1, -1, 1, -1, 1, 1.0])
    assert np.allclose(polar_factor((q * signs * np.logspace(0, -8, 9)) @ q.T), (q * signs) @ q.T, atol=1e-7)


def lattice(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def test_whitened_rows_are_numpys(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(6, 6))
    vectors = (rng.normal(size=(60, 6)) @ mix).tolist()
    rows = [(i, v) for i, v in enumerate([*vectors, vectors[0], vectors[0], vectors[3]])]
    rows += [(3, vectors[5]), (None, vectors[6]), (100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [math.inf] * 6), (104, [math.nan] * 6), (105, [1.0, 2.0]), (106, [1e30] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit(9), "x": F.lit("x"), "component": F.lit(0), "id": F.lit(1)})
    got = whiten_embeddings(df, components=4).collect()
    good = [(i, lattice(v)) for i, v in rows if v and len(v) == 6 and None not in v and all(map(math.isfinite, v)) and max(v) < 1e9]
    fit = np.unique(np.array([x for _, x in good]), axis=0)
    n, total = len(fit), fit.sum(0)
    d = (n * fit - total) / n
    cov = d.T @ d / n
    e, b = (x[..., ::-1] for x in np.linalg.eigh(cov))
    want = {}
    for i, x in good:
        c = n * np.array(x) - total
        want.setdefault((i, int((c**2).sum())), []).append(c / n @ b[:, :4] / np.sqrt(e[:4]))
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n}
    signs = {}
    for r in got:
        w = want[r.vec_id, r.deviation][0][r.component - 1]
        if abs(w) > 1e-3:
            assert signs.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(abs(w) - abs(r.whitened)) < 1e-9
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-10 and r.identity_error < 1e-9


def test_few_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert whiten_embeddings(df.limit(0)).count() == 0
    assert whiten_embeddings(df.where("vec_id > 1")).count() == 0  # one distinct vector has no direction
    rows = whiten_embeddings(df).collect()
    assert sorted((r.vec_id, r.component, r.deviation) for r in rows) == [(1, 1, 8192), (2, 1, 8192), (3, 1, 8192)]
    assert all(abs(abs(r.whitened) - 1) < 1e-12 for r in rows)


def test_deviations_beyond_63_bits(spark):
    df = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r.deviation for r in whiten_embeddings(df).where("component = 1").collect()}
    assert rows[1] is None and rows[2] is None
    assert rows[3] == (3 * 1_000_000 - 3_000_000) ** 2 + (3 * (320 + 1_000_000) - (3_000_000 + 64 + 320)) ** 2
