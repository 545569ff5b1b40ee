"""Readers of the text and binary formats.  Rows that are aligned by position get an explicit ordinal, seq_id."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import saved, small
from . import fasta_source, split_sets
from .split_sets import read_split_sets  # noqa: F401


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a file, or of several in the order of their names, numbered from 0.

    Lines are counted for each split of a file first; a line's number is its place in the split after the lines of the splits before.
    There is one row of offsets a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")
    offsets = saved(counts.select("file", "start", (before - F.col("first")).alias("shift")))
    return lines.join(small(offsets), ["file", "start"]).select((F.col("place") + F.col("shift")).alias("line_no"), "value")


def read_fasta(spark: SparkSession, path: str, range_bytes: int = fasta_source.RANGE_BYTES) -> DataFrame:
    """(seq_id, seq, seq_len): the first token of each line, in upper case; blank lines and names are passed over.  seq_id is the place in the
    files; records are stored once parsed, and counted for each range."""
    rows = fasta_source.scan(spark, path, range_bytes).withColumn("place", F.monotonically_increasing_id())
    rows = saved(rows.select("seq", "seq_len", "place").withColumn("part", F.shiftright("place", 33)))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = saved(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    return rows.join(small(before), "part").select((F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("seq_id"), "seq", "seq_len")


def fastq_to_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): name and bases of four-line records as FASTA lines."""
    k = F.col("line_no") % 4
    return numbered_lines(spark, path).where(k < 2).select("line_no", F.when(k == 0, F.regexp_replace("value", "^@", ">")).otherwise(F.col("value")).alias("value"))


def read_kmer_table(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, values) of a k-mer table: a label and tab-separated counts."""
    cells = F.filter(F.split(F.rtrim("value"), "\t"), lambda c: c != "")
    return numbered_lines(spark, path).where("value <> ''").select(F.col("line_no").alias("seq_id"), F.transform(F.slice(cells, 2, F.size(cells)), lambda c: c.cast("double")).alias("values"))


def table_shape(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("n_samples"), F.max(F.size("values")).alias("n_features"))


def read_projections(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(seq_id, values); a row with another number of values fails."""
    values = F.transform(F.split(F.trim("value"), r"\s+"), lambda c: c.cast("double"))
    rows = numbered_lines(spark, path).where("trim(value) <> ''").select(F.col("line_no").alias("seq_id"), values.alias("values"))
    return rows.select("seq_id", F.when(F.size("values") == dims, F.col("values")).otherwise(F.raise_error(F.lit(f"a projection does not have {dims} values"))).alias("values"))


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select(F.col("line_no").alias("seq_id"), F.trim("value").cast("int").alias("mask"))


def read_annotation(spark: SparkSession, path: str) -> DataFrame:
    return numbered_lines(spark, path).select(F.col("line_no").alias("seq_id"), F.regexp_extract("value", r"^\s*(\S+)", 1).alias("annotation"))


def read_clustering_log(spark: SparkSession, path: str) -> DataFrame:
    """(layer, epsilon) of the lines 'Epsilon at layer i: x'."""
    pattern = r"Epsilon at layer (\d+): ([-+.eE0-9]+)"
    return spark.read.text(path).where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).cast("int").alias("layer"), F.regexp_extract("value", pattern, 2).cast("double").alias("epsilon"))


def read_swarm(spark: SparkSession, path: str, seqs: DataFrame) -> DataFrame:
    """(cluster, seq_id): a cluster a line; each token stands for all sequences equal to its own; the first cluster wins."""
    return swarm_clusters(numbered_lines(spark, path).select(F.col("line_no").cast("int").alias("cluster"), "value"), seqs)


def swarm_clusters(lines: DataFrame, seqs: DataFrame) -> DataFrame:
    tokens = lines.select("cluster", F.explode(F.split(F.trim("value"), r"\s+")).alias("token"))
    ids = tokens.select("cluster", F.regexp_extract("token", r"^sequence_(\d+)_mutiplicity_\d+", 1).cast("long").alias("seq_id")).where("seq_id is not null")
    named = ids.join(seqs.select("seq_id", "seq"), "seq_id").groupBy("seq").agg(F.min("cluster").alias("cluster"))
    return seqs.join(named, "seq").select("cluster", "seq_id")


def decode_split_set(data: bytes) -> list[tuple[int, int]]:
    """(cluster, seq_id) of a binary split set."""
    found = split_sets.heads(io.BytesIO(data), len(data))
    return [(k, m) for k, (at, n) in enumerate(found) for m in struct.unpack_from(f"={n}i", data, at)]


def unpacked(sets: DataFrame) -> DataFrame:
    """membership of sets(layer, data), binary split sets in a table."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for layer, data in zip(p["layer"], p["data"], strict=True):
                yield pd.DataFrame([(layer, c, m) for c, m in decode_split_set(data)], columns=["layer", "cluster", "seq_id"])

    return sets.mapInPandas(run, "layer int, cluster int, seq_id long")
