"""The per-record operators and multiplicity on streams of (seq_id, seq): the batch expressions run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import sequences as O


def sequence_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of Parquet files with doc_id and text, as sequences."""
    rows = spark.readStream.schema("doc_id long, text string").parquet(path)
    return rows.select(F.col("doc_id").alias("seq_id"), F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("seq"))


def kmer_stream(seqs: DataFrame, k: int) -> DataFrame:
    return seqs.select("seq_id", F.explode(S.kmers(F.col("seq"), k)).alias("kmer"))


def digest_stream(seqs: DataFrame, enzyme: str) -> DataFrame:
    return O.digest(seqs, enzyme)


def multiplicity_stream(seqs: DataFrame) -> DataFrame:
    """Counts of equal sequences; run in complete or update mode."""
    return O.multiplicity(seqs)
