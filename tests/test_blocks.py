"""Pairs of blocks in numpy: kernels against all pairs, functions as programs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import distance as D
from helixframe.functions import near


def table(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "seq_id long, values array<double>")


SHAPES = {
    "unit": (lambda d: (lambda x: x / np.linalg.norm(x, axis=1)[:, None])(d.normal(size=(150, 64))), (8.2, 1.3)),
    "far from zero": (lambda d: d.normal(size=(150, 5)) + 1e6, (3.0, 1.5)),
    "coarse": (lambda d: np.concatenate([d.normal(size=(140, 3)), 1e9 * d.normal(size=(10, 3))]), (1.0, 1.0)),
    "whole": (lambda d: d.integers(0, 4, (150, 4)).astype(float), (2.0, 1.0)),
    "equal": (lambda d: np.ones((150, 4)), (0.0, 0.0)),
    "no number": (lambda d: np.where(d.random((150, 3)) < 0.05, np.nan, d.normal(size=(150, 3))), (1.0, 1.0)),
    "no end": (lambda d: np.where(d.random((150, 3)) < 0.05, np.inf, d.normal(size=(150, 3))), (1.0, 1.0)),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("metric", ["l1", "l2"])
@pytest.mark.filterwarnings("ignore")
def test_kernels_equal_all_pairs(shape, metric):
    make, limits = SHAPES[shape]
    x = make(np.random.default_rng(2))
    a, b, eps = x[:100], x[60:], limits[metric == "l2"]
    diff = a[:, None] - b[None]
    dist = (np.abs(diff) if metric == "l1" else diff * diff).cumsum(-1)[..., -1]
    want = {(int(i), int(j)) for i, j in np.argwhere(dist <= (eps if metric == "l1" else eps * eps))}
    got = [(int(i), int(j)) for r, c, _ in near.within(a, b, eps, metric) for i, j in zip(r, c)]
    assert want and len(got) == len(set(got)) and set(got) == want


def absolute(a, b):
    return F.aggregate(F.transform(F.zip_with(a, b, lambda x, y: x - y), lambda x: F.sqrt(x * x)), F.lit(0.5), lambda s, x: s + x) - F.lit(0.5)


@pytest.mark.parametrize("metric", [D.l1, D.l2, absolute])
def test_a_function_of_sums_is_computed_by_numpy(spark, monkeypatch, metric):
    points = table(spark, np.random.default_rng(9).uniform(0, 1, (80, 3)).tolist() + [[0.5], [0.6], None])
    assert near.program(metric, F.col("_a"), F.col("_b"), ("_a", "_b")) is not None
    rows = lambda: sorted((r.i, r.j, r.dist) for r in D.pairs_within(points, 0.4, metric).collect())
    fast = rows()
    monkeypatch.setattr(near, "program", lambda *x: None)
    assert fast == rows() and len(fast) > 82


def test_other_functions_are_left_to_spark(spark):
    for metric in (lambda a, b: F.levenshtein(a, b), lambda a, b: F.size(a) + F.size(b), lambda a, b: F.aggregate(a, F.lit(0), lambda s, x: s + x), lambda a, b: a[0] - b[0]):
        assert near.program(metric, F.col("_a"), F.col("_b"), ("_a", "_b")) is None
    words = spark.createDataFrame([(0, "abc"), (1, "abd"), (2, "xyz"), (3, None)], "seq_id long, seq string")
    got = D.pairs_within(words, 1.0, lambda a, b: F.levenshtein(a, b).cast("double"), "seq")
    assert sorted((r.i, r.j) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2)]


def test_every_two_points_of_one_band_do_not_meet_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 20)
    monkeypatch.setattr(D, "LARGER", 1)
    points = table(spark, np.random.default_rng(1).uniform(0, 1, (200, 2)).tolist())
    seen, real = [], D.meetings
    monkeypatch.setattr(D, "meetings", lambda placed, size: seen.append(real(placed, size)) or seen[-1])
    D.pairs_within(points, 5.0, D.l1, bound=lambda v: v[0] + v[1]).count()
    per_key = seen[0].groupBy("cell", "lo", "hi").count()
    assert per_key.count() > 30 and per_key.agg(F.max("count")).first()[0] < 80


def test_no_batch_of_a_group_holds_all_its_pairs(spark):
    points = table(spark, [[1.0, 1.0]] * 700)
    pairs = D.pairs_within(points, 0.0)
    assert pairs.count() == 490_000
    sizes = [b.num_rows for b in near.batched(((np.zeros(4000),) for _ in range(100)), ["x"])]
    assert sum(sizes) == 400_000 and max(sizes) < near.BATCH + 4000
