import random

import numpy as np
import pytest

from helixframe.functions import distance
from helixframe.functions.distance import alignment_distances, pairs_within
from helixframe.operators import clustering as C
from helixframe.operators import compare as K
from helixframe.operators import layers as L
from helixframe.operators import sequences as O
from helixframe.plans import catalog

TREE = "(L1C4N4:1.000000,L1C3N5:1.000000,L1C2N5:1.000000,(L0C8N4:1.000000)L1C1N4:1.000000,(L0C11N4:1.000000,L0C10N4:1.000000,L0C9N5:1.000000,L0C7N18:1.000000,L0C6N5:1.000000,L0C5N5:1.000000,L0C4N26:1.000000,L0C3N13:1.000000,L0C2N8:1.000000,L0C1N29:1.000000,L0C0N36:1.000000)L1C0N272:1.000000)L2C0;"


def cells(a, b):
    """The distance, cell by cell."""
    x, y = a[1:] + "\0", b[1:] + "\0"
    h = [[0] * (len(x) + 1) for _ in range(len(y) + 1)]
    best = 0
    for j in range(1, len(y) + 1):
        for i in range(1, len(x) + 1):
            h[j][i] = max(0, h[j - 1][i - 1] + (4 if x[i - 1] == y[j - 1] else -4), h[j - 1][i] - 3, h[j][i - 1] - 3)
            best = max(best, h[j][i])
    return 4 * max(len(a), len(b)) - best


def test_alignment_matches_cell_by_cell():
    draw = random.Random(4)
    a = ["".join(draw.choice("ACGT") for _ in range(draw.randint(1, 25))) for _ in range(200)]
    b = ["".join(draw.choice("ACGT") for _ in range(draw.randint(1, 25))) for _ in range(200)]
    assert alignment_distances(a, b).tolist() == [cells(x, y) for x, y in zip(a, b)]


def sequential(points, eps, minpts):
    """Seeds in order; a failed seed is never expanded again."""
    near = {i: [j for j, q in enumerate(points) if np.abs(np.subtract(p, q)).sum() <= eps] for i, p in enumerate(points)}
    seen, label, n = set(), {}, 0
    for s in near:
        if s in seen:
            continue
        seen.add(s)
        if len(near[s]) <= minpts:
            continue
        label[s] = n
        queue = list(near[s])
        while queue:
            p = queue.pop(0)
            if p not in label:
                label[p] = n
            if p not in seen:
                seen.add(p)
                if len(near[p]) >= minpts:
                    queue += near[p]
        n += 1
    return label


@pytest.mark.parametrize("seed", range(2))
def test_dbscan_matches_the_sequential_procedure(spark, seed):
    draw = random.Random(seed)
    pts = [[float(draw.randint(0, 9)), float(draw.randint(0, 9))] for _ in range(45)]
    df = spark.createDataFrame(list(enumerate(pts)), "seq_id long, values array<double>")
    got = {r.seq_id: r.cluster for r in C.dbscan(df, 1.0, 3, "l1").collect()}
    assert got == sequential(pts, 1.0, 3)


def test_pairs_within_is_complete(spark):
    draw = np.random.default_rng(1)
    pts = draw.random((60, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "seq_id long, values array<double>")
    for metric, order in (("l1", 1), ("l2", 2)):
        want = {(i, j) for i in range(60) for j in range(60) if np.linalg.norm(pts[i] - pts[j], order) <= 0.4}
        assert {(r.i, r.j) for r in pairs_within(df, 0.4, metric).collect()} == want


def test_tree_fixture(spark):
    m = catalog.membership(spark, "/root/testdata/sf0.01")
    assert L.newick(m) == TREE
    t = catalog.target(spark, "/root/testdata/sf0.01")
    rows = L.purity(m, t).orderBy("layer").collect()
    assert [(round(r.purity, 6), round(r.cluster_factor, 6), round(r.impure_fraction, 6)) for r in rows] == [(1.0, 0.2, 1.0), (0.96, 0.5, 1.0), (1.0, 0.9, 1.0)]


def test_stats_and_silhouette(spark):
    a = spark.createDataFrame(list(enumerate(["TAAGAAAGCT", "TCAGATAGCT"])), "seq_id long, seq string")
    rows = K.distance_matrix(a, a).collect()
    assert {(r.i, r.j): r.dist for r in rows} == {(0, 0): 0, (0, 1): 12, (1, 0): 12, (1, 1): 0}
    stats = K.distance_stats(K.distance_matrix(a, a), 2, 2).first()
    assert stats.mean == 6 and abs(stats.sigma - 12 / 4) < 1e-12
    assert K.silhouette(a.limit(1), a).first()[0] is None


TEST2 = ["TCAGAAAGCTT", "TCAGGGAAAGCTTA", "TCAGAAAGCTT", "ACAGAACAGCTT"]
TEST3 = ["TCAGAAAGCT", "TCAGGCAAAG", "TCAGCAAGCT", "ACAGAACAGC", "TCAGAGCTTA"]
TEST4 = ["TAAGAAAGCT", "TCAGATAGCT", "TCAGTTAGCT", "TCAGATTGCT"]
MATRICES = [
    (TEST2, "0 21 0 7 / 21 0 21 24 / 0 21 0 7 / 7 24 7 0"),
    (TEST3, "0 18 8 10 18 / 18 0 18 20 23 / 8 18 0 18 18 / 10 20 18 0 24 / 18 23 18 24 0"),
    (TEST4, "0 12 20 20 / 12 0 8 8 / 20 8 0 10 / 20 8 10 0"),
]


def test_alignment_matrices():
    """Expected values of the fixtures."""
    for rows, want in MATRICES:
        got = [alignment_distances([a] * len(rows), rows).tolist() for a in rows]
        assert got == [[float(x) for x in row.split()] for row in want.split(" / ")]


def test_alignment_stats_of_the_fixtures(spark):
    a, b = (spark.createDataFrame(list(enumerate(x)), "seq_id long, seq string") for x in (TEST3, TEST4))
    stats = K.distance_stats(K.distance_matrix(a, b), 5, 4).first()
    assert [round(stats.mean, 6), round(stats.sigma, 6), round(stats.stddev_pop, 6)] == [18.1, 3.181350, 6.402343]
    assert round(K.silhouette(a, b).first()[0], 6) == -0.000792


def test_closest_settles_far_lengths(spark):
    a = spark.createDataFrame([(0, "ACGT" * 40), (1, "ACGTACGT")], "seq_id long, seq string")
    q = spark.createDataFrame([(7, "ACGTACGA"), (8, "AC")], "seq_id long, seq string")
    got = {r.query_id: (r.seq_id, r.dist) for r in O.closest(a, q, radius=4).collect()}
    pairs = [(i, s, j, t) for i, s in ((0, "ACGT" * 40), (1, "ACGTACGT")) for j, t in ((7, "ACGTACGA"), (8, "AC"))]
    dist = dict(zip([(j, i) for i, _, j, _ in pairs], alignment_distances([p[3] for p in pairs], [p[1] for p in pairs]), strict=True))
    assert got == {j: min(((d, i) for (x, i), d in dist.items() if x == j))[::-1] for j in (7, 8)}


def test_pairs_within_blocks(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCK", 8)
    draw = np.random.default_rng(4)
    pts = draw.random((45, 3))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(pts)], "seq_id long, values array<double>")
    for metric, order in (("l1", 1), ("l2", 2)):
        want = sorted((i, j) for i in range(45) for j in range(45) if np.linalg.norm(pts[i] - pts[j], order) <= 0.4)
        assert sorted((r.i, r.j) for r in pairs_within(df, 0.4, metric).collect()) == want


def test_adaptive_layers_runs_until_one_cluster(spark, tmp_path):
    """One cluster at 1.13, none at half of it and up to 0.7: the scan has to go on."""
    from helixframe.plans import catalog

    rows = [(5 * x + y, [0.7 * x, 0.7 * y], 0) for x in range(5) for y in range(5)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["adaptive_layers"](spark, str(tmp_path)).collect()
    assert [(r.n_clusters, r.coverage) for r in got] == [(1, 1.0)] and abs(got[0].epsilon - 0.705) < 1e-9
