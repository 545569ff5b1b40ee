"""The registered queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytededup, collocations, decontam, html_main, langid, license, linededup, merkle, neardup, quality, substring, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.license_scan(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest_repeats(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_bytededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytededup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_license": op2_license,
    "op3_neardup": op3_neardup,
    "op4_html": op4_html,
    "op5_decontam": op5_decontam,
    "op6_linededup": op6_linededup,
    "op7_toxicity": op7_toxicity,
    "op8_langid": op8_langid,
    "op9_bpe": op9_bpe,
    "op10_substring": op10_substring,
    "op11_merkle": op11_merkle,
    "op12_collocations": op12_collocations,
    "op13_bytededup": op13_bytededup,
}

ORACLES: dict[str, str] = {"op2_license": license.oracle_sql(), "op11_merkle": merkle.oracle_sql(), "op12_collocations": collocations.oracle_sql()}
