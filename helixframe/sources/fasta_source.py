"""FASTA as a data source of Spark: spark.read.format("fasta") and df.write.format("fasta").

A file is read in ranges of bytes by as many tasks as it has ranges.  A record belongs to the range in which its header begins, so a
task starts at the first header of its range and reads on beyond the range's end to the next header; a range without one has no
rows.  Rows come in Arrow batches: path, offset (of the header in the file), name (the header's first token), seq and seq_len, and
in the order of (path, offset) they are numbered as in the file.  Files are opened through pyarrow's file systems, by the scheme of the path.

Writing makes one file a partition under a name of the attempt, and commit puts those of the successful attempts in place, so a
task that is repeated leaves no second copy of its records; abort removes what was written.  Files bear the numbers of their
partitions, so those of a frame sorted by range follow each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "path string, offset long, name string, seq string, seq_len int"
#: Bytes of a range, of a read, and of the sequences of an Arrow batch.
RANGE_BYTES, READ_BYTES, BATCH_BYTES = 32 << 20, 4 << 20, 16 << 20
WIDTH = 50


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    import pyarrow.fs

    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder, by name; hidden and marker files and folders are passed over."""
    import pyarrow.fs

    fs, own = file_system(path)
    info = fs.get_file_info(own)
    if info.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pyarrow.fs.FileType.File:
        return [(own, info.size)]
    found = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(own, recursive=True)) if f.type == pyarrow.fs.FileType.File]
    return sorted((f.path, f.size) for f in found if not any(part.startswith(("_", ".")) for part in f.path.removeprefix(own).split("/")))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


def first_header(data: bytes, at_line_start: bool) -> int:
    """Where the first line that starts with > begins, or -1."""
    if at_line_start and data[:1] == b">":
        return 0
    at = data.find(b"\n>")
    return at + 1 if at >= 0 else -1


def chunks(handle, at: int) -> Iterator[bytes]:
    handle.seek(at)
    while data := handle.read(READ_BYTES):
        yield data


def records(handle, start: int, end: int) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(offset, name, pieces) of the records whose headers begin in start..end; pieces are the first tokens of the lines."""
    # one byte earlier, to know whether the range begins with a line
    at, held, fresh = max(0, start - 1), b"", start == 0
    current: tuple[int, bytes, list[bytes]] | None = None
    for data in chunks(handle, at):
        held += data
        if current is None:
            skip = first_header(held, fresh)
            if skip < 0:
                if at + len(held) > end:
                    return
                at, held, fresh = at + len(held) - 1, held[-1:], False
                continue
            at, held = at + skip, held[skip:]
            if at >= end:
                return
        lines = held.split(b"\n")
        held = lines.pop()
        for line in lines:
            if line[:1] == b">":
                if current is not None:
                    yield current
                if at >= end:
                    return
                current = (at, (line[1:].split() or [b""])[0], [])
            elif current is not None and (token := line.split(None, 1)):
                current[2].append(token[0])
            at += len(line) + 1
        fresh = True
    if held[:1] == b">" and (fresh or current is not None) and at < end:  # a last line without an end
        if current is not None:
            yield current
        current, held = (at, (held[1:].split() or [b""])[0], []), b""
    if current is not None:
        if held[:1] != b">" and (token := held.split(None, 1)):
            current[2].append(token[0])
        yield current


class FastaReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> Sequence[InputPartition]:
        return [ByteRange(path, lo, min(size, lo + self.range_bytes)) for path, size in files_under(self.path) for lo in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.end:
            return
        names = ["path", "offset", "name", "seq", "seq_len"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        rows, held = [], 0
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as handle:
            for offset, name, pieces in records(handle, partition.start, partition.end):
                seq = b"".join(pieces).decode("utf-8", "replace").upper()
                rows.append((prefix + partition.path, offset, name.decode("utf-8", "replace"), seq, len(seq)))
                held += len(seq)
                if held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    path: str
    final: str
    records: int


class FastaWriter(DataSourceWriter):
    """Rows with seq, and seq_id or name for the header."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        names = schema.fieldNames()
        if "seq" not in names or not {"seq_id", "name"} & set(names):
            raise ValueError("a FASTA table has seq, and seq_id or name")
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:12]
        self.named = "name" in names
        #: Appended files come after those that are there.
        self.turn = 0 if overwrite else len({p.rsplit("/", 1)[-1].split("-")[0] for p in self.existing()})

    def existing(self) -> list[str]:
        try:
            return [p for p, _ in files_under(self.path)]
        except FileNotFoundError:
            return []

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, own = file_system(self.path)
        waiting = f"{own}/_waiting-{self.run}"
        fs.create_dir(waiting, recursive=True)
        path, n = f"{waiting}/{task.partitionId():06d}-{task.taskAttemptId()}", 0
        with fs.open_output_stream(path) as out:
            for row in iterator:
                seq = row["seq"] or ""
                name = row["name"] if self.named else f"sequence_{row['seq_id']}"
                lines = [f">{name}", *[seq[i : i + WIDTH] for i in range(0, len(seq), WIDTH)]]
                out.write(("\n".join(lines) + "\n").encode())
                n += 1
        return Written(path, f"{own}/{self.turn:04d}-{task.partitionId():06d}.fasta", n)

    def commit(self, messages: list[Written | None]) -> None:
        fs, own = file_system(self.path)
        fs.create_dir(own, recursive=True)
        if self.overwrite:
            for old in self.existing():
                fs.delete_file(old)
        for m in messages:
            if m is not None and m.records:
                fs.move(m.path, m.final)
        self.clear(fs, own)

    def abort(self, messages: list[Written | None]) -> None:
        self.clear(*file_system(self.path))

    def clear(self, fs, own: str) -> None:
        import pyarrow.fs

        waiting = f"{own}/_waiting-{self.run}"
        if fs.get_file_info(waiting).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(waiting)


class FastaSource(DataSource):
    """Options: path, and range_bytes for reading."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FastaReader:
        return FastaReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FastaWriter:
        return FastaWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make format("fasta") known to a session."""
    spark.dataSource.register(FastaSource)


def scan(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    register(spark)
    return spark.read.format("fasta").option("range_bytes", range_bytes).load(path)
