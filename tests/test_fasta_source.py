"""The FASTA data source: ranges of bytes, files in order, committed writes."""

import io

import pytest
from pyspark.sql import functions as F

from helixframe.sources import fasta_source as S
from helixframe.sources import readers as R

TEXT = b"junk\n>a one\nACGT  x\n\n TT\n>b\n>c\r\nGG\r\n>\nA>C\n>last\nTT\nCC"
WANTED = [(b"a", b"ACGTTT"), (b"b", b""), (b"c", b"GG"), (b"", b"A>C"), (b"last", b"TTCC")]


@pytest.mark.parametrize("text, wanted", [(TEXT, WANTED), (TEXT + b"\n>x", [*WANTED, (b"x", b"")]), (b">only", [(b"only", b"")]), (b"none\nhere", []), (b">a\n" + b"G" * 50, [(b"a", b"G" * 50)])])
@pytest.mark.parametrize("read", [1, 3, 7, 1000])
def test_every_cut_gives_the_same_records(monkeypatch, text, wanted, read):
    monkeypatch.setattr(S, "READ_BYTES", read)
    for size in range(1, len(text) + 2):
        got = [r for lo in range(0, len(text), size) for r in S.records(io.BytesIO(text), lo, min(len(text), lo + size))]
        assert [(n, b"".join(p)) for _, n, p in got] == wanted, size
        assert all(text[at : at + 1] == b">" for at, _, _ in got)


@pytest.mark.parametrize("size", [3, 17, 10_000])
def test_files_are_read_in_order(spark, tmp_path, size):
    for k in range(3):
        (tmp_path / f"part-{k}.fasta").write_text("".join(f">s{k}{i}\n{'acgt' * (i + 1)}\n" for i in range(4 - k)))
    (tmp_path / "_SUCCESS").write_text(">no\nA\n")
    rows = S.scan(spark, str(tmp_path), size).orderBy("path", "offset").collect()
    names = [f"s{k}{i}" for k in range(3) for i in range(4 - k)]
    assert [r.name for r in rows] == names
    got = R.read_fasta(spark, str(tmp_path), size).orderBy("seq_id").collect()
    assert [(r.seq_id, r.seq) for r in got] == [(i, "ACGT" * (int(n[2]) + 1)) for i, n in enumerate(names)]


def test_writes_are_committed_whole(spark, tmp_path):
    S.register(spark)
    rows = spark.createDataFrame([(i, "ACGT" * i) for i in range(40)], "seq_id long, seq string").repartitionByRange(3, "seq_id")
    to = str(tmp_path / "out")
    for _ in range(2):
        rows.write.format("fasta").mode("overwrite").save(to)
        assert [r.seq for r in R.read_fasta(spark, to).orderBy("seq_id").collect()] == ["ACGT" * i for i in range(40)]
    rows.limit(2).write.format("fasta").mode("append").save(to)
    assert [r.seq_len for r in R.read_fasta(spark, to).orderBy("seq_id").collect()][-2:] == [0, 4]
    broken = rows.withColumn("seq", F.when(F.col("seq_id") == 33, F.raise_error("stop")).otherwise(F.col("seq")))
    before = sorted(p.name for p in (tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="stop"):
        broken.write.format("fasta").mode("append").save(to)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == before
    assert spark.read.format("fasta").load(to).where("name = 'sequence_39'").first().seq_len == 156
    with pytest.raises(Exception, match="seq"):
        spark.range(2).write.format("fasta").mode("append").save(to)


def test_lines_of_several_files(spark, tmp_path):
    for k, n in enumerate((1, 30, 4)):
        (tmp_path / f"f{k}").write_text("".join(f"{k}-{i}\n" for i in range(n)))
    got = R.numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [tuple(r) for r in got] == list(enumerate(f"{k}-{i}" for k, n in enumerate((1, 30, 4)) for i in range(n)))
