"""An adaptive scan of a dense table forms the pairs of near neighbours only, and finds the same layers."""

import numpy as np

from helixframe.operators import clustering as C
from tests.test_adaptive import found, scan, table


def formed(monkeypatch):
    made, real = [], C.pairs_within

    def counted(points, eps, metric):
        pairs = real(points, eps, metric)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(C, "pairs_within", counted)
    return made


def test_a_dense_table_forms_few_pairs(spark, monkeypatch):
    pts = np.random.default_rng(6).uniform(0, 1, (150, 2)).round(3).tolist()
    made = formed(monkeypatch)
    assert found(C.adaptive_dbscan(table(spark, pts), 1.6, 0.02, 2, "l1")) == scan(pts, 1.6, 0.02, 2)
    assert max(made) < 0.3 * 150 * 150


def test_a_point_far_away_is_no_proof(spark, monkeypatch):
    """One cluster, but not of all points, before the next half: the longer halves are looked at, and one of them has two clusters."""
    near, far = [[0.01 * x, 0.0] for x in range(60)], [[x, 5.0] for x in (0.0, 0.9, 1.8, 2.7, 3.6)]
    pts = near + far
    assert found(C.adaptive_dbscan(table(spark, pts), 2.0, 0.5, 2, "l1")) == scan(pts, 2.0, 0.5, 2)


def test_vectors_that_are_no_numbers_do_not_keep_the_scan_going(spark):
    pts = [[float(x), 0.0] for x in range(12)] + [[float("nan"), 0.0], None]
    members, layers = C.adaptive_dbscan(table(spark, pts), 0.5, 0.5, 2, "l1")
    assert {r.seq_id for r in members.collect()} == set(range(12)) and layers.count() == 1
