"""Column functions on DNA and protein sequences.  Everything is a built-in expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DNA = "ACGT"
PROTEIN = "ACDEFGHIKLMNPQRSTVWY"
#: name: (recognition site with N for any base, bases before the cut, bases after it); fixed values.
ENZYMES = {
    "XbaI": ("TCTAGA", 1, 5),
    "HindIII": ("AAGCTT", 1, 5),
    "XmnI": ("GAANNNNTTC", 5, 5),
}


def first_token(line: Column) -> Column:
    """The first token of a line that white space ends, in upper case."""
    return F.upper(F.regexp_extract(line, r"^\s*(\S+)", 1))


def reverse_complement(seq: Column) -> Column:
    """Other letters than ACGT stay."""
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def encode_2bit(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "0123")


def decode_2bit(code: Column) -> Column:
    return F.translate(code, "0123", "ACGT")


def kmers(seq: Column, k: int, include_last_window: bool = False) -> Column:
    """The windows of k letters in order; the last one is left out unless asked for.  Linear in the length: a look-ahead matches
    at every letter."""
    windows = F.regexp_extract_all(seq, F.lit(rf"(?s)(?=(\P{{Cs}}.{{{k - 1}}}))"), F.lit(1))
    return windows if include_last_window else F.slice(windows, F.lit(1), F.greatest(F.size(windows) - 1, F.lit(0)))


def dna_kmer_index(kmer: Column, k: int) -> Column:
    """Base 4, the first letter least significant; null for other letters."""
    total = F.lit(0)
    for j in range(k):
        total = total + (F.instr(F.lit(DNA), F.substring(kmer, j + 1, 1)) - 1) * (4**j)
    return F.when(kmer.rlike(f"^[{DNA}]{{{k}}}$"), total)


def protein_kmer_index(kmer: Column, k: int) -> Column:
    """Base 20, the first letter most significant; null for other letters."""
    total = F.lit(0)
    for j in range(k):
        total = total * 20 + (F.instr(F.lit(PROTEIN), F.substring(kmer, j + 1, 1)) - 1)
    return F.when(kmer.rlike(f"^[{PROTEIN}]{{{k}}}$"), total)


def dna_kmer_universe(spark: SparkSession, k: int) -> DataFrame:
    """(kmer_idx, kmer) of all 4^k DNA k-mers."""
    if not 1 <= k <= 15:
        raise ValueError("k must be between 1 and 15 for DNA")
    digit = lambda j: F.shiftright(F.col("id"), 2 * j).bitwiseAND(F.lit(3)).cast("int") + 1
    return spark.range(4**k).select(F.col("id").cast("int").alias("kmer_idx"), F.concat(*[F.substring(F.lit(DNA), digit(j), F.lit(1)) for j in range(k)]).alias("kmer"))


def protein_kmer_universe(spark: SparkSession, k: int) -> DataFrame:
    """(kmer_idx, kmer) of all 20^k protein k-mers, in lexicographic order."""
    digit = lambda j: (F.floor(F.col("id") / 20 ** (k - 1 - j)) % 20).cast("int") + 1
    return spark.range(20**k).select(F.col("id").cast("int").alias("kmer_idx"), F.concat(*[F.substring(F.lit(PROTEIN), digit(j), F.lit(1)) for j in range(k)]).alias("kmer"))


def fragments(seq: Column, site: str, before: int, after: int) -> Column:
    """The pieces of a sequence cut at a recognition site (N: any base); a site flush with the end is not cut.  Linear in the
    length: the sequence is split where the site stands around a place."""
    letters = site.replace("N", ".")
    return F.split(seq, f"(?s)(?<={letters[:before]})(?={letters[before : before + after]}.)", -1)


def n_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("N"), F.lit("")))


def n_expansion(seq: Column, code: Column) -> Column:
    """The sequence in which the digits of code in base 4, least significant first, replace the letters N."""
    state = lambda out, left: F.struct(out.alias("out"), left.alias("left"))
    base = lambda acc: F.substring(F.lit(DNA), (acc["left"] % 4).cast("int") + 1, F.lit(1))
    step = lambda acc, c: F.when(c == "N", state(F.concat(acc["out"], base(acc)), F.shiftright(acc["left"], 2))).otherwise(state(F.concat(acc["out"], c), acc["left"]))
    return F.aggregate(F.split(seq, ""), state(F.lit(""), code.cast("long")), step, lambda acc: acc["out"])
