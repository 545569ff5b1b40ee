"""Pairs within a distance by cells: exact on clustered, equidistant and repeated points, and few copies where points are clustered."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import distance as D


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "seq_id long, values array<double>")


def clustered(draw, n, dims, groups=6):
    return draw.normal(0, 10, (groups, dims))[draw.integers(0, groups, n)] + draw.normal(0, 0.1, (n, dims))


SHAPES = {
    "clustered": (lambda d: clustered(d, 90, 4), 0.4),
    "equidistant": (lambda d: np.eye(40) * 2, 2.9),
    "equal": (lambda d: np.ones((50, 3)), 0.0),
    "spread": (lambda d: d.uniform(0, 1, (100, 2)), 0.2),
    "line": (lambda d: np.arange(60.0)[:, None], 3.0),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_cells_equal_all_pairs(spark, monkeypatch, shape, metric):
    monkeypatch.setattr(D, "BLOCK", 9)
    make, eps = SHAPES[shape]
    x = make(np.random.default_rng(3))
    d = np.abs(x[:, None] - x[None]).sum(-1) if metric == "l1" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    wanted = {(int(i), int(j)) for i, j in np.argwhere(d <= eps)}
    got = [(r.i, r.j) for r in D.pairs_within(table(spark, x), eps, metric).collect()]
    assert len(got) == len(set(got)) and set(got) == wanted


def test_clustered_points_stay_in_their_cells(spark):
    points = table(spark, clustered(np.random.default_rng(5), 600, 8))
    sizes = D.cell_sizes(D.in_cells(points, 1.0, "l2", 6)).agg(F.sum("hosts"), F.sum("guests"), F.count("*")).first()
    assert tuple(sizes) == (600, 0, 6)
    few = D.cell_sizes(D.in_cells(points, 1.0, "l2", 24)).agg(F.sum("guests")).first()[0]
    assert few < 4 * 600  # a group's cells only, of 24


def test_no_key_holds_more_than_two_blocks(spark):
    points = table(spark, np.ones((500, 3)))
    most = D.meetings(D.in_cells(points, 0.0, "l2", 4), 50).groupBy("cell", "lo", "hi").count().agg(F.max("count")).first()[0]
    assert most < 3 * 50


@pytest.mark.parametrize("bound", [None, lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)])
def test_a_function_as_metric(spark, bound):
    points = table(spark, np.random.default_rng(9).uniform(0, 1, (80, 3)))
    rows = lambda df: {(r.i, r.j, round(r.dist, 9)) for r in df.collect()}
    assert rows(D.pairs_within(points, 0.4, D.l1, bound=bound)) == rows(D.pairs_within(points, 0.4, "l1"))


def test_empty_tables(spark):
    assert D.pairs_within(spark.createDataFrame([], "seq_id long, values array<double>"), 1.0).count() == 0
