import struct
import zlib

import numpy as np
import pytest
from helixframe.operators import projection as P
from helixframe.sources import named_files, pictures, split_sets
from helixframe.sources import readers as R
from helixframe.sources import writers as W
from helixframe.streaming import stateless
from pyspark.sql import functions as F


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">x one\nacgt  extra\n\n TTg\n>x\nCC\n>empty\n")
    rows = R.read_fasta(spark, str(tmp_path / "a.fasta")).orderBy("seq_id").collect()
    assert [(r.seq_id, r.seq, r.seq_len) for r in rows] == [(0, "ACGTTTG", 7), (1, "CC", 2), (2, "", 0)]
    W.write_fasta(R.read_fasta(spark, str(tmp_path / "a.fasta")), str(tmp_path / "out"))
    assert [r.seq for r in R.read_fasta(spark, str(tmp_path / "out")).orderBy("seq_id").collect()] == ["ACGTTTG", "CC", ""]


def test_tables(spark, tmp_path):
    (tmp_path / "k").write_text("sequence_0\t1\t2\t\nsequence_1\t3\t4\t\n")
    assert [r["values"] for r in R.read_kmer_table(spark, str(tmp_path / "k")).orderBy("seq_id").collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert tuple(R.table_shape(R.read_kmer_table(spark, str(tmp_path / "k"))).first()) == (2, 2)
    (tmp_path / "p").write_text("0.5\t-1\n2\t3\n")
    assert R.read_projections(spark, str(tmp_path / "p"), 2).count() == 2
    (tmp_path / "log").write_text("epsilon_start: 1\n  Epsilon at layer 0: 1.25\n  Epsilon at layer 1: 1.5\n")
    assert [tuple(r) for r in R.read_clustering_log(spark, str(tmp_path / "log")).orderBy("layer").collect()] == [(0, 1.25), (1, 1.5)]
    (tmp_path / "q").write_text("@a\nAC\n+\n!!\n@b\nGG\n+\n!!\n")
    assert [r.value for r in R.fastq_to_fasta(spark, str(tmp_path / "q")).orderBy("line_no").collect()] == [">a", "AC", ">b", "GG"]


def test_swarm(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "A"), (1, "C"), (2, "A"), (3, "G")], "seq_id long, seq string")
    (tmp_path / "s").write_text("sequence_0_mutiplicity_2 sequence_1_mutiplicity_1\nsequence_2_mutiplicity_1 sequence_3_mutiplicity_1\n")
    assert {(r.cluster, r.seq_id) for r in R.read_swarm(spark, str(tmp_path / "s"), seqs).collect()} == {(0, 0), (0, 2), (0, 1), (1, 3)}


def test_split_set_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(0, 0, 5), (0, 0, 3), (0, 1, 9)], "layer int, cluster int, seq_id long")
    data = W.split_set_bytes(m).first().data
    assert data[:9] == b"SPLIT_SET" and struct.unpack_from("=i", data, 9) == (2,)
    (tmp_path / "x0000").write_bytes(data)
    assert {tuple(r) for r in R.read_split_sets(spark, str(tmp_path / "x0000")).collect()} == {(0, 0, 5), (0, 0, 3), (0, 1, 9)}


def test_split_set_files(spark, tmp_path):
    rows = [(layer, c, m) for layer in (0, 3) for c in range(layer + 2) for m in range(0, 1 + 700 * c, 1 + c)]
    m = spark.createDataFrame(rows, "layer int, cluster int, seq_id long").repartition(5)
    split_sets.write_split_sets(m, str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["layer0000", "layer0003"]
    own = {k: sorted(x for layer, c, x in rows if (layer, c) == (3, k)) for k in range(5)}
    data = (tmp_path / "s" / "layer0003").read_bytes()
    assert data == b"SPLIT_SET" + struct.pack("=i", 5) + b"".join(struct.pack(f"={2 + len(v)}i", len(v), k, *v) for k, v in own.items())
    for piece in (1 << 20, 7, 1):
        assert sorted(map(tuple, split_sets.read_split_sets(spark, str(tmp_path / "s"), piece).collect())) == sorted(rows)
    # batches of a few rows cut clusters and layers anywhere
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        split_sets.write_split_sets(m, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert (tmp_path / "t" / "layer0003").read_bytes() == data
    split_sets.write_split_sets(m.limit(0), str(tmp_path / "u"))
    assert list((tmp_path / "u").iterdir()) == []


@pytest.mark.parametrize("data", [b"SPLIT", b"SPLIT_TES" + bytes(4), b"SPLIT_SET" + struct.pack("=3i", 1, 2, 0), b"SPLIT_SET" + struct.pack("=2i", 1, -1)])
def test_bad_split_sets_are_errors(spark, tmp_path, data):
    (tmp_path / "x0").write_bytes(data)
    with pytest.raises(Exception, match="split set"):
        split_sets.read_split_sets(spark, str(tmp_path / "x0")).collect()
    with pytest.raises(ValueError, match="split set"):
        R.decode_split_set(data)


def test_split_sets_hold_32_bits(spark, tmp_path):
    with pytest.raises(Exception, match="32 bits"):
        split_sets.write_split_sets(spark.createDataFrame([(0, 0, 1 << 31)], "layer int, cluster int, seq_id long"), str(tmp_path / "s"))


def test_named_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, b"y"), ("a", 0, b"1"), ("b", 0, b"x"), ("c", 0, None)], "name string, turn int, data binary").repartition(3)
    named_files.write_files(rows, str(tmp_path / "n"), "turn")
    assert {p.name: p.read_bytes() for p in (tmp_path / "n").iterdir()} == {"a": b"1", "b": b"xy", "c": b""}
    named_files.write_files(rows.where("name = 'a'"), str(tmp_path / "n"))
    assert [p.name for p in (tmp_path / "n").iterdir()] == ["a"]
    for bad in (".x", "_x", "a/b", ""):
        with pytest.raises(Exception, match="not a name"):
            named_files.write_files(spark.createDataFrame([(bad, b"1")], "name string, data binary"), str(tmp_path / "n"))
    with pytest.raises(Exception, match="more than one partition"):
        named_files.put(spark.createDataFrame([("a", b"1"), ("a", b"2")], "name string, data binary").repartition(2), str(tmp_path / "n"))
    assert [(p.name, p.read_bytes()) for p in (tmp_path / "n").iterdir()] == [("a", b"1")]


def test_pictures(spark, tmp_path):
    rows = [(x, y, z, (x * 7 + y * 31 + z * 3) % 256 if z < 2 else 0) for x in range(9) for y in range(4) for z in range(3)]
    scaled = spark.createDataFrame(rows, "x int, y int, z int, level int")
    pictures.write_pictures(scaled, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["density0000.png", "density0001.png", "density0002.png"]
    # decoded without the library: the data chunk follows a head of 25 bytes and a mark of 8
    data = (tmp_path / "p" / "density0001.png").read_bytes()
    lines = zlib.decompress(data[41 : 41 + struct.unpack_from(">I", data, 33)[0]])
    assert struct.unpack_from(">II", data, 16) == (9, 4) and [list(lines[10 * y + 1 : 10 * y + 10]) for y in range(4)] == [[(x * 7 + y * 31 + 3) % 256 for x in range(9)] for y in range(4)]
    assert {(r.x, r.y, r.z, r.level) for r in pictures.read_pictures(spark, str(tmp_path / "p")).collect()} == set(rows)
    flat = W.density_png(scaled.where("z = 0").drop("z"))
    assert list(flat) == [0] and (pictures.decode(flat[0]) == np.array([[(x * 7 + y * 31) % 256 for x in range(9)] for y in range(4)])).all()
    assert W.density_png(scaled.limit(0)) == {}
    with pytest.raises(ValueError, match="damaged"):
        pictures.decode(data[:-20] + b"x" + data[-19:])


def test_files_of_clusters(spark, tmp_path):
    seqs = spark.range(300).selectExpr("id seq_id", "concat('AC', repeat('G', cast(id % 7 as int))) seq")
    members = spark.range(300).selectExpr("id seq_id", "if(id < 250, 0, cast(id % 3 as int)) cluster")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that little data has several tasks
    try:
        W.write_cluster_fasta(seqs, members, str(tmp_path / "f"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    W.write_cluster_values(seqs.selectExpr("seq_id", "array(cast(seq_id as double), 0.5) `values`"), members, str(tmp_path / "v"))
    own = {c: [i for i in range(300) if (0 if i < 250 else i % 3) == c] for c in range(3)}
    for c, ids in own.items():
        parts = sorted((tmp_path / "f" / f"file={c:03d}").glob("part-*"))
        text = "".join(p.read_text() for p in parts)
        assert [line for line in text.split("\n") if line[:1] == ">"] == [f">sequence_{i}" for i in ids]
        assert len(parts) > 1 or c
        values = "".join(p.read_text() for p in sorted((tmp_path / "v" / f"file={c:03d}").glob("part-*")))
        assert values.splitlines() == [f"{i:f}\t0.500000" for i in ids]


def test_grid_png_and_pca(spark):
    pts = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.2]), (2, [1.0, 0.2])], "seq_id long, values array<double>")
    grid = P.density_grid(pts, 0.5)
    assert {(r.x, r.y): r.n for r in grid.collect()} == {(0, 0): 1, (1, 0): 0, (2, 0): 2}
    assert W.density_png(P.density_scaled(grid))[0][:8] == b"\x89PNG\r\n\x1a\n"
    values, vectors = P.principal_components(pts, 1)
    assert values[0] <= values[1] and abs(values.sum() - (2 / 9 + 0.04 * 2 / 9)) < 1e-9
    assert P.project(pts, vectors).count() == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(0, "xAACCx"), (1, "AACC")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    q = stateless.multiplicity_stream(stateless.sequence_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("m").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.seq, r.multiplicity) for r in spark.table("m").collect()] == [("AACC", 2)]
    k = stateless.kmer_stream(stateless.sequence_stream(spark, str(tmp_path / "in")), 2)
    assert k.isStreaming and F.col("kmer") is not None
