"""Binary split sets: one file a layer, with the members of each cluster.

A file is MAGIC, the number of clusters, and for each cluster its size, its number and its members, all in 32 bits.  Reading looks
for the heads of clusters first, in one task a file that skips the members; the members are then read in pieces of at most
PIECE, a task having many pieces or one, so neither a large file nor a large cluster is one task.  Writing sorts the members by
layer and cluster and streams a layer's file from one task, which holds one Arrow batch of it.

Defined results: members that do not fit in 32 bits, and files with another mark or a cut end, are errors; clusters are numbered by
their place in a file; a repeated member stays; an empty table writes no file.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved
from . import named_files
from .fasta_source import file_system

#: Fixed value: the mark at the start of a file.
MAGIC = b"SPLIT_SET"
#: Members of a piece, and bytes of a read while heads are sought.
PIECE, READ_BYTES = 1 << 20, 1 << 16
MEMBERSHIP = "layer int, cluster int, seq_id long"


def heads(handle, size: int) -> Iterator[tuple[int, int]]:
    """(place of the first member, members) of every cluster of an open file."""
    held, start = b"", 0

    def at(place: int, n: int) -> bytes:
        nonlocal held, start
        if not start <= place <= start + len(held) - n:
            handle.seek(place)
            held, start = handle.read(max(n, READ_BYTES)), place
        if start + len(held) < place + n:
            raise ValueError("a split set is cut")
        return held[place - start : place - start + n]

    if size < len(MAGIC) + 4 or at(0, len(MAGIC)) != MAGIC:
        raise ValueError("not a split set")
    place = len(MAGIC) + 4
    for _ in range(struct.unpack("=i", at(len(MAGIC), 4))[0]):
        (n,) = struct.unpack("=i", at(place, 4))
        place += 8
        if n < 0 or place + 4 * n > size:
            raise ValueError("a split set is cut")
        yield place, n
        place += 4 * n


def layer_of(path: str) -> int:
    """The number that ends a file's name."""
    return int((re.findall(r"\d+", path.rsplit("/", 1)[-1]) or ["0"])[-1])


def pieces(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, layer, cluster, place, n) of files(path, length): where the members of each cluster stand, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "layer", "cluster", "place", "n"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, own = file_system(path)
                rows = []
                with fs.open_input_file(own) as handle:
                    for cluster, (place, n) in enumerate(heads(handle, size)):
                        for done in range(0, n, piece):
                            rows.append((path, layer_of(path), cluster, place + 4 * done, min(piece, n - done)))
                            if len(rows) == 10_000:
                                yield pack(rows)
                                rows = []
                if rows:
                    yield pack(rows)

    return files.select("path", "length").repartition("path").mapInArrow(run, "path string, layer int, cluster int, place long, n long")


def read_split_sets(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """membership of binary split sets; the number that ends a file's name is its layer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle = None, None
        for b in batches:
            for path, layer, cluster, place, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if path != opened:
                    if handle:
                        handle.close()
                    fs, own = file_system(path)
                    opened, handle = path, fs.open_input_file(own)
                members = np.frombuffer(handle.read_at(4 * n, place), dtype=np.int32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, layer, np.int32)), pa.array(np.full(n, cluster, np.int32)), pa.array(members)], names=["layer", "cluster", "seq_id"])
        if handle:
            handle.close()

    found = saved(pieces(spark.read.format("binaryFile").load(path), piece))
    return found.repartition("path", "place").sortWithinPartitions("path", "place").mapInArrow(run, MEMBERSHIP)


def file_parts(membership: DataFrame, prefix: str = "layer") -> DataFrame:
    """(name, data): the files of membership(layer, cluster, seq_id) in parts that stand in order, each layer's in one partition."""
    sizes = membership.groupBy("layer", "cluster").agg(F.count("*").alias("n"))
    counts = sizes.groupBy("layer").agg(F.count("*").alias("clusters"))
    rows = membership.join(sizes, ["layer", "cluster"]).join(counts, "layer").select("layer", "cluster", "seq_id", "n", "clusters")
    ordered = rows.repartition("layer").sortWithinPartitions("layer", "cluster", "seq_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            layer, cluster, seq, n, clusters = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if len(seq) and (seq.min() < -(1 << 31) or max(seq.max(), n.max()) >= 1 << 31):
                raise ValueError("a split set holds numbers of 32 bits")
            first = np.ones(len(layer), dtype=bool)
            first[1:] = (np.diff(layer) != 0) | (np.diff(cluster) != 0)
            first[0] = before != (layer[0], cluster[0])
            cut = [0, *(np.flatnonzero(np.diff(layer)) + 1).tolist(), len(layer)]
            names, data = [], []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                starts = np.flatnonzero(first[lo:hi])
                head = np.stack([n[lo:hi][starts], cluster[lo:hi][starts]], axis=1).reshape(-1)
                body = np.insert(seq[lo:hi], np.repeat(starts, 2), head).astype("=i4").tobytes()
                if before is None or before[0] != layer[lo]:
                    body = MAGIC + struct.pack("=i", int(clusters[lo])) + body
                names.append(f"{prefix}{int(layer[lo]):04d}")
                data.append(body)
                before = (int(layer[hi - 1]), int(cluster[hi - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(data, pa.binary())], names=["name", "data"])

    return ordered.mapInArrow(run, "name string, data binary")


def write_split_sets(membership: DataFrame, path: str, prefix: str = "layer") -> None:
    """A file a layer, named by the prefix and the layer's number."""
    named_files.put(file_parts(membership, prefix), path)
