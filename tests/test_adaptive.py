"""The sweep over all steps of epsilon against one clustering a step, and scans that go on after a stop."""

import random

import numpy as np
import pytest

from helixframe.operators import clustering as C
from tests.test_clustering import sequential


def table(spark, pts):
    return spark.createDataFrame(list(enumerate(pts)), "seq_id long, values array<double>")


def scan(pts, eps, step, minpts, max_steps=None):
    """(epsilon, clusters as sets) of the layers that are kept, one step after the other."""
    at = lambda e: sequential(pts, e, minpts)
    far = max(np.abs(np.subtract(p, q)).sum() for p in pts for q in pts)
    for _ in range(20):
        if len(set(at(eps).values())) != 1:
            break
        eps /= 2
    out, last, k = [], None, 0
    while max_steps is None or k < max_steps:
        e = eps + k * step
        label = at(e)
        n = len(set(label.values()))
        if n and (last is None or n < last):
            last = n
            out.append((round(e, 9), n, round(len(label) / len(pts), 9), sorted((c, i) for i, c in label.items())))
        if n == 1 or e >= far:
            return out
        k += 1
    return out


def found(result):
    members, layers = result
    own = {}
    for r in members.collect():
        own.setdefault(r.layer, []).append((r.cluster, r.seq_id))
    return [(round(r.epsilon, 9), r.n_clusters, round(r.coverage, 9), sorted(own[r.layer])) for r in layers.orderBy("layer").collect()]


@pytest.mark.parametrize("seed, eps, step, minpts, max_steps", [(0, 1.0, 1.0, 3, None), (1, 2.0, 0.5, 2, None), (2, 30.0, 0.75, 3, None), (4, 1.0, 1.0, 3, 3)])
def test_sweep_equals_a_clustering_for_each_step(spark, seed, eps, step, minpts, max_steps):
    draw = random.Random(seed)
    pts = [[float(draw.randint(0, 12)), float(draw.randint(0, 12))] for _ in range(42)]
    assert found(C.adaptive_dbscan(table(spark, pts), eps, step, minpts, "l1", max_steps)) == scan(pts, eps, step, minpts, max_steps)


def test_work_does_not_follow_the_number_of_steps(spark, monkeypatch):
    """A tenth of the step: ten times the steps, the same tables."""
    written, real = [], C.saved
    monkeypatch.setattr(C, "saved", lambda df: written.append(1) or real(df))
    pairs = C.pairs_within(table(spark, [[float(x * x), 0.0] for x in range(25)]), 60.0, "l1")
    for step in (1.0, 0.1):
        rows = C.label_steps(pairs.select("i", "j", C.first_step(pairs["dist"], 0.0, step).alias("at")), 3)
        written.append(rows.count())
    cut = written.index(written[-1])
    assert written[cut] == written[-1] and cut == len(written) - cut - 2


def test_steps_follow_double_arithmetic(spark):
    dist = [0.3, 0.30000000000000004, 0.1, 0.7, 0.7999999999999999, 0.0, 5.0]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in dist], "d double").select(C.first_step(C.F.col("d"), 0.1, 0.1)).collect()]
    assert got == [next(k for k in range(100) if d <= 0.1 + k * 0.1) for d in dist]


def test_a_stopped_scan_goes_on(spark, tmp_path, monkeypatch):
    pts = [[start + 0.1 * i, 0.0] for start in (0.0, 3.0, 7.0, 12.0, 18.0) for i in range(5)]
    own, args = table(spark, pts), (1.0, 0.5, 3, "l1")
    wanted = found(C.adaptive_dbscan(own, *args))
    assert len(wanted) > 3
    real, done = C.Finished.finish, []

    def stops(self, members, row):
        if len(done) == 2:
            raise KeyboardInterrupt
        done.append(row[0])
        real(self, members, row)

    monkeypatch.setattr(C.Finished, "finish", stops)
    with pytest.raises(KeyboardInterrupt):
        C.adaptive_dbscan(own, *args, path=f"{tmp_path}/scan")
    kept = C.Finished(spark, f"{tmp_path}/scan", "eps=1.0 step=0.5 minpts=3 metric=l1 max_steps=None halvings=20")
    assert [x[0] for x in kept.layers()] == [0, 1]
    again = []
    monkeypatch.setattr(C.Finished, "finish", lambda self, members, row: again.append(row[0]) or real(self, members, row))
    monkeypatch.setattr(C, "pairs_within", None)  # nothing is searched again
    assert found(C.adaptive_dbscan(own, *args, path=f"{tmp_path}/scan")) == wanted and again == list(range(2, len(wanted)))
    with pytest.raises(ValueError):
        C.adaptive_dbscan(own, 2.0, 0.5, 3, "l1", path=f"{tmp_path}/scan")


def test_empty_table(spark):
    members, layers = C.adaptive_dbscan(spark.createDataFrame([], "seq_id long, values array<double>"), 1.0, 1.0, 3)
    assert members.count() == 0 and layers.count() == 0
