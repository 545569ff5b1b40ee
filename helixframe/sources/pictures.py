"""Pictures of density grids: a slice of the grid is drawn and encoded in the task that has it, and only its bytes leave it.

Defined results: a grid without z is one picture of z 0; cells that the grid does not name are 0; rows of the picture are y, from 0 at
the top; an empty grid has no pictures.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import named_files

#: Fixed value: the mark at the start of a picture.
MAGIC = b"\x89PNG\r\n\x1a\n"


def encode(levels: np.ndarray) -> bytes:
    """An 8-bit gray picture of an array of bytes, rows first."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", levels.shape[1], levels.shape[0], 8, 0, 0, 0, 0)
    lines = np.pad(levels.astype(np.uint8), ((0, 0), (1, 0)))  # no filter
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """The levels of a picture as encode makes them: 8-bit gray, lines without a filter."""
    if data[:8] != MAGIC:
        raise ValueError("not a picture")
    at, packed, wide, tall = 8, [], 0, 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a picture is damaged")
        if kind == b"IHDR":
            wide, tall, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit gray picture")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(tall, wide + 1)
    if lines[:, 0].any():
        raise ValueError("lines of a picture are filtered")
    return lines[:, 1:]


def pictures(scaled: DataFrame) -> DataFrame:
    """(z, png) of a rescaled grid (x, y[, z], level): one picture for each z.  A task holds the picture it draws, not the cells
    of others; the picture's size comes from the grid as two numbers."""
    cells = scaled.select("x", "y", (F.col("z") if "z" in scaled.columns else F.lit(0)).cast("int").alias("z"), F.col("level").cast("int").alias("level"))
    wide, tall = cells.agg(F.max("x") + 1, F.max("y") + 1).first()

    def draw(own: pa.Table) -> pa.Table:
        levels = np.zeros((tall, wide), np.uint8)
        levels[own.column("y").to_numpy(), own.column("x").to_numpy()] = own.column("level").to_numpy()
        return pa.table([own.column("z").slice(0, 1), pa.array([encode(levels)], pa.binary())], names=["z", "png"])

    # dark cells need not travel, but a slice without a light one is a picture, too
    return cells.where("level > 0 or (x = 0 and y = 0)").groupBy("z").applyInArrow(draw, "z int, png binary")


def write_pictures(scaled: DataFrame, path: str, prefix: str = "density") -> None:
    """A file for each z, named by the prefix and z."""
    rows = pictures(scaled).select(F.format_string(f"{prefix}%04d.png", "z").alias("name"), F.col("png").alias("data"))
    named_files.write_files(rows, path)


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, level) of the cells of pictures; the number that ends a file's name is z."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for z, data in zip(p["z"], p["content"], strict=True):
                levels = decode(data)
                y, x = np.indices(levels.shape)
                yield pd.DataFrame({"z": np.full(levels.size, z), "x": x.reshape(-1), "y": y.reshape(-1), "level": levels.reshape(-1)})

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"(\d+)\.png$", 1).cast("int").alias("z"), "content").mapInPandas(run, "z int, x int, y int, level int")
