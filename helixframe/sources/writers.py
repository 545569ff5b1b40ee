"""Writers of the text, binary and picture formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sequences import fasta_text, kmer_lines
from . import fasta_source, pictures, split_sets


def write_text(rows: DataFrame, column: str, path: str, *order: str) -> None:
    """One column as text files, in order: a range sort, so that the files follow each other."""
    rows.orderBy(*order).select(column).write.mode("overwrite").text(path)


def write_fasta(seqs: DataFrame, path: str) -> None:
    """Files that follow each other by seq_id: a range sort, and the data source's committed files."""
    fasta_source.register(seqs.sparkSession)
    seqs.orderBy("seq_id").select("seq_id", "seq").write.format("fasta").mode("overwrite").save(path)


def write_kmer_table(dense: DataFrame, path: str) -> None:
    write_text(kmer_lines(dense), "line", path, "seq_id")


def cluster_records(seqs: DataFrame, membership: DataFrame) -> DataFrame:
    """(file, seq_id, record): FASTA records under the name suffix of their cluster."""
    return fasta_text(seqs).join(membership, "seq_id").select(F.format_string("%03d", "cluster").alias("file"), "seq_id", "record")


def write_cluster_fasta(seqs: DataFrame, membership: DataFrame, path: str) -> None:
    """A folder for every cluster; a large cluster's records are several files in it, which follow each other by seq_id."""
    cluster_records(seqs, membership).repartitionByRange("file", "seq_id").sortWithinPartitions("file", "seq_id").select("file", "record").write.mode("overwrite").partitionBy("file").text(path)


def value_lines(points: DataFrame) -> DataFrame:
    """(seq_id, line): values with six decimals, tab-separated."""
    return points.select("seq_id", F.array_join(F.transform("values", lambda v: F.format_string("%f", v)), "\t").alias("line"))


def write_projections(points: DataFrame, path: str) -> None:
    write_text(value_lines(points), "line", path, "seq_id")


def write_cluster_values(points: DataFrame, membership: DataFrame, path: str) -> None:
    """A folder for every cluster, as write_cluster_fasta makes them."""
    rows = value_lines(points).join(membership, "seq_id").select(F.format_string("%03d", "cluster").alias("file"), "seq_id", "line")
    rows.repartitionByRange("file", "seq_id").sortWithinPartitions("file", "seq_id").select("file", "line").write.mode("overwrite").partitionBy("file").text(path)


def eigenvalue_text(values) -> str:
    return "".join(f"{v:f}\n" for v in values)


def split_set_bytes(membership: DataFrame) -> DataFrame:
    """(layer, data): small split sets as values, whole in a row; write_split_sets makes files of any size."""
    parts = split_sets.file_parts(membership).select(F.regexp_extract("name", r"(\d+)$", 1).cast("int").alias("layer"), F.monotonically_increasing_id().alias("turn"), "data")
    own = F.transform(F.array_sort(F.collect_list(F.struct("turn", "data"))), lambda p: p["data"])
    return parts.groupBy("layer").agg(F.aggregate(own, F.lit(b""), lambda a, b: F.concat(a, b)).alias("data"))


def density_png(scaled: DataFrame) -> dict[int, bytes]:
    """Pictures to look at, one for each z (0 without z), drawn in the tasks; write_pictures makes files of them."""
    return {r["z"]: bytes(r["png"]) for r in pictures.pictures(scaled).toLocalIterator()}
