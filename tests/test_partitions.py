"""Equal id ranges that clusters recover, also where the sequences are no multiple of the ranges."""

import duckdb
import pytest

from helixframe.operators import layers as L
from helixframe.plans import catalog


def found(spark, rows, n, partitions, precision):
    membership = spark.createDataFrame(rows, "layer int, cluster int, seq_id long")
    return sorted(r.partition_no for r in L.partitions_found(membership, n, partitions, precision).collect())


def test_a_rest_is_no_error(spark):
    rows = [(0, i // 5, i) for i in range(15)] + [(0, 3, i) for i in range(20, 23)]
    assert found(spark, rows, 23, 4, 0.9) == [0, 1, 2]
    assert found(spark, rows, 20, 4, 0.9) == [0, 1, 2]
    assert found(spark, rows, 23, 4, 0.5) == [0, 1, 2, 4]  # the rest, 3 of 5 ids, is a range as in the SQL
    assert found(spark, rows, 3, 4, 0.5) == []
    with pytest.raises(ValueError):
        found(spark, rows, 20, 4, 1.5)


@pytest.mark.parametrize("n", [27, 30, 9])
def test_recovery_equals_sql(spark, tmp_path, n):
    rows = [(i, [2.0 * (i // 3), 0.01 * i], 0) for i in range(n)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = sorted(r[0] for r in con.sql(catalog.ORACLES["partition_recovery"]).fetchall())
    assert sorted(r.partition_no for r in catalog.QUERIES["partition_recovery"](spark, str(tmp_path)).collect()) == want
