"""Files by name as a sink of Spark: df.write.format("named_files").

Rows are (name, data): a file is its rows' data one after another, so a task holds one Arrow batch of it, however long it is.  All
rows of a name come from one partition, next to each other; write_files sees to it.  Files are written under the name of the
attempt and put in place by commit, so a repeated task leaves nothing twice; abort removes what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .fasta_source import file_system, files_under


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class NamedFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        if schema.fieldNames() != ["name", "data"]:
            raise ValueError("named files have the columns name and data")
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex[:12]

    def waiting(self) -> str:
        return f"{file_system(self.path)[1]}/_waiting-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, _ = file_system(self.path)
        folder = f"{self.waiting()}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(folder, recursive=True)
        names: dict[str, None] = {}
        current, out = None, None
        try:
            for batch in iterator:
                for name, data in zip(batch.column(0), batch.column(1), strict=True):
                    if name.as_py() != current:
                        current = name.as_py()
                        if not current or "/" in current or current[0] in "_.":
                            raise ValueError(f"not a name of a file: {current!r}")
                        if current in names:
                            raise ValueError(f"the rows of {current} do not stand together")
                        names[current] = None
                        if out:
                            out.close()
                        out = fs.open_output_stream(f"{folder}/{current}")
                    if data.is_valid:
                        out.write(data.as_buffer())
        finally:
            if out:
                out.close()
        return Written(folder, list(names))

    def commit(self, messages: list[Written | None]) -> None:
        fs, own = file_system(self.path)
        fs.create_dir(own, recursive=True)
        done: set[str] = set()
        for m in messages:
            if m is not None:
                if not done.isdisjoint(m.names):
                    raise ValueError(f"more than one partition has rows of {sorted(done.intersection(m.names))[0]}")
                done.update(m.names)
        if self.overwrite:
            try:
                for old, _ in files_under(self.path):
                    fs.delete_file(old)
            except FileNotFoundError:
                pass
        for m in messages:
            for name in m.names if m is not None else ():
                fs.move(f"{m.folder}/{name}", f"{own}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        import pyarrow.fs

        fs, _ = file_system(self.path)
        if fs.get_file_info(self.waiting()).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(self.waiting())


class NamedFiles(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"], schema, overwrite)


def put(rows: DataFrame, path: str) -> None:
    """rows(name, data), the rows of a name in order and in one partition, as files in a folder."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "data").write.format("named_files").mode("overwrite").save(path)


def write_files(rows: DataFrame, path: str, *order: str) -> None:
    """rows(name, data, ...) as files whose parts follow each other by the columns of order."""
    put(rows.repartition("name").sortWithinPartitions("name", *order), path)
