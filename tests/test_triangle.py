"""Every pair of vectors with both norms."""

import duckdb
import numpy as np

from helixframe.functions import distance as D
from helixframe.operators import compare as K
from helixframe.plans import catalog


def test_every_pair_has_both_norms(spark, monkeypatch, tmp_path):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=6).tolist(), 0) for i in range(60)] + [(77, None, 0), (78, [1.0, 2.0], 0), (79, [], 0)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(con.sql(catalog.ORACLES["norms_triangular"]).fetchall())
    for size in (4096, 20):
        monkeypatch.setattr(D.meetings, "__defaults__", (size,))
        assert sorted(map(tuple, catalog.QUERIES["norms_triangular"](spark, str(tmp_path)).collect()), key=lambda r: r[:2]) == want


def test_every_two_blocks_meet_in_a_task_of_their_own(spark):
    points = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(9000)], "seq_id long, values array<double>")
    got = K.triangle(points)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 9000 * 8999 // 2
