"""Whitening against NumPy's eigenvectors and exact integer sums."""

import math
import random

import numpy as np
import pytest

from flowmetrics.llm import whitening

SHAPE = "vec_id long, embedding array<float>, label int"


def brute(rows, count=8):
    """{component: (whitened by row, explained)}, deviations and n, of the vectors of ``rows``."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array(x, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return centred, values, vectors, deviation, min(count, len(sums))


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1 / (1 + j)) for j in range(12)]) for i in range(300)]
    return rows + [rows[3], (None, rows[4][1])]


@pytest.fixture(scope="module")
def table(spark, vectors):
    odd = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, [0.0] * 11 + [None])]
    return spark.createDataFrame([(*r, 1) for r in vectors + odd], SHAPE)


def test_against_numpy(vectors, table):
    got = whitening.whiten(table).toPandas()
    centred, values, basis, deviation, k = brute(vectors)
    assert len(got) == len(vectors) * k and set(got.n) == {len(vectors)}
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for c in range(k):
        rows = got[got.component == c + 1]
        assert np.allclose(rows.explained, values[c] / values.sum(), rtol=1e-9)
        want = centred @ basis[:, c] / np.sqrt(values[c])
        sign = np.sign(want[0] * rows[rows.vec_id == 0].whitened.iloc[0])
        by_id = {vid: sign * w for (vid, _), w in zip(vectors, want)}
        for vid, w in zip(rows.vec_id, rows.whitened):
            assert abs(w - by_id[None if vid != vid else vid]) < 1e-8
    wanted = {vid: str(d) for (vid, _), d in zip(vectors, deviation)}
    assert all(str(d) == wanted[None if vid != vid else vid] for vid, d in zip(got.vec_id, got.deviation))


@pytest.mark.parametrize("d", [1, 2, 3, 20, 65])
def test_components_of_random_matrices(d):
    a = np.random.default_rng(d).standard_normal((d, d + 1))
    v = a @ a.T
    values, vectors = whitening.top_components(v, 8)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:8], rtol=1e-10)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-11 * np.linalg.norm(v))
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


@pytest.mark.parametrize("diagonal", [[3, 3, 3, 1, 1, 0], [0, 0], [5, 0, 0], [1, 1 + 1e-13, 2]])
def test_repeated_and_zero_eigenvalues(diagonal):
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(diagonal),) * 2))
    v = q @ np.diag(diagonal) @ q.T
    values, vectors = whitening.top_components((v + v.T) / 2, 8)
    assert np.allclose(values, sorted(diagonal, reverse=True), atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(diagonal)), atol=1e-12)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-11)


def test_polar_factor_is_orthogonal():
    a = np.random.default_rng(2).standard_normal((30, 30))
    a = a + a.T
    u = whitening.polar(a)
    assert np.allclose(u @ u, np.eye(30), atol=1e-12) and np.linalg.eigvalsh(u @ a).min() > -1e-10


def test_few_and_equal_rows(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], SHAPE)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(c, 1, 0, 0.0, None, 0.0) for c in (1, 2)]
    three = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 0) for i in (1, 1, 2)] + [(3, [2.0, 4.0], 0)], SHAPE)).collect()
    assert len(three) == 8 and max(r.identity_error for r in three) < 1e-9
    assert all(r.whitened == 0.0 and r.explained < 1e-12 for r in three if r.component == 2)


def test_huge_entries(spark):
    rows = [(1, [1e38, 0.0], 0), (2, [-1e38, 1.0], 0), (3, [3.0, 2.0], 0)]
    got = whitening.whiten(spark.createDataFrame(rows, SHAPE)).collect()
    assert len(got) == 6 and all(math.isfinite(r.whitened) for r in got)


def test_lengths_must_agree(spark):
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], 0), (2, [1.0, 2.0], 0)], SHAPE))


def test_clashing_columns_and_empty_table(table):
    import pyspark.sql.functions as F

    more = table.withColumns({c: F.lit("x") for c in ("x", "n", "i", "white", "at", "component", "id", "deviation")})
    assert whitening.whiten(more).count() == whitening.whiten(table).count()
    assert whitening.whiten(table.limit(0)).collect() == []
