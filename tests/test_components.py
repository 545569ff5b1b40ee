"""Sums of products by tiles, and components without the matrix."""

import numpy as np
import pytest

from helixframe.operators import projection as P


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "seq_id long, values array<double>").repartition(parts)


def test_covariance_and_correlation_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(P, "TILE", 4)
    x = np.random.default_rng(2).normal(5, 1, (70, 11))
    x[:, 3] = 0
    cov = {(r.a, r.b): r["cov"] for r in P.covariance(table(spark, x)).collect()}
    want = np.cov(x.T, bias=True)
    assert len(cov) == 66 and all(abs(v - want[k]) < 1e-12 for k, v in cov.items())
    unit = x / np.where(np.linalg.norm(x, axis=0) > 0, np.linalg.norm(x, axis=0), np.nan)
    got = {(r.a, r.b): r.correlation for r in P.feature_correlation(table(spark, x)).collect()}
    assert all((v is None) == (3 in k) and (v is None or abs(v - (unit.T @ unit)[k]) < 1e-12) for k, v in got.items())


@pytest.mark.parametrize("rows, features, n, basis", [(90, 30, 3, 240), (60, 80, 4, 20), (12, 40, 20, 240), (50, 5, 9, 240)])
def test_components_solve_the_eigenproblem(spark, rows, features, n, basis):
    x = np.random.default_rng(features).normal(0, 1, (rows, features)) * np.linspace(4, 0.5, features) + 3
    values, vectors = P.leading_components(table(spark, x), n, most_basis=basis)
    a = np.cov(x.T, bias=True)
    n = min(n, features)
    assert vectors.shape == (features, n)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-9
    assert np.abs(a @ vectors - vectors * values).max() < 1e-6 * values[0]
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:n]).max() < 1e-8 * values[0]


def test_many_features_need_no_matrix(spark, monkeypatch):
    monkeypatch.setattr(P, "gram", None)
    draw = np.random.default_rng(4)
    x = draw.normal(0, 1, (60, 3)) @ (draw.normal(0, 1, (3, 4096)) * np.array([[9.0], [3.0], [1.0]])) + draw.normal(0, 0.01, (60, 4096))
    values, vectors = P.leading_components(table(spark, x), 2)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:2] ** 2 / 60
    assert np.abs(values - s).max() < 1e-6 * s[0] and vectors.shape == (4096, 2)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "seq_id long, values array<double>")
    assert P.covariance(empty).count() == 0 and P.leading_components(empty, 2)[0].shape == (0,)
