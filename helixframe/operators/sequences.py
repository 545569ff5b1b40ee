"""Operators on tables of sequences: k-mer tables, multiplicity, consensus, digests, filters, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sequences as S
from ..functions.distance import near_pairs
from ..storage import saved


def with_lengths(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", "seq", F.length("seq").alias("seq_len"))


def max_length(seqs: DataFrame) -> DataFrame:
    return seqs.agg(F.max(F.length("seq")).alias("max_len"))


def masked(seqs: DataFrame, mask: DataFrame, change: Column) -> DataFrame:
    """change where mask(seq_id, mask) is 1; rows without a mask keep their sequence."""
    return seqs.join(mask, "seq_id", "left").select("seq_id", F.when(F.col("mask") == 1, change).otherwise(F.col("seq")).alias("seq"))


def reverse_masked(seqs: DataFrame, mask: DataFrame) -> DataFrame:
    return masked(seqs, mask, F.reverse("seq"))


def reverse_complement_masked(seqs: DataFrame, mask: DataFrame) -> DataFrame:
    return masked(seqs, mask, S.reverse_complement(F.col("seq")))


def kmer_counts(seqs: DataFrame, k: int, protein: bool = False, include_last_window: bool = False) -> DataFrame:
    """(seq_id, kmer, cnt) of the k-mers over the alphabet that occur; counted before the shuffle."""
    letters = S.PROTEIN if protein else S.DNA
    own = seqs.select("seq_id", F.explode(S.kmers(F.col("seq"), k, include_last_window)).alias("kmer")).where(F.col("kmer").rlike(f"^[{letters}]+$"))
    return own.groupBy("seq_id", "kmer").agg(F.count("*").alias("cnt"))


def kmer_dense(seqs: DataFrame, k: int, protein: bool = False) -> DataFrame:
    """(seq_id, counts): one array a sequence in the order of the k-mer universe; k-mers are counted before the only shuffle, and
    an array is as long as the universe by definition."""
    size, letters = (20**k, S.PROTEIN) if protein else (4**k, S.DNA)
    index = S.protein_kmer_index if protein else S.dna_kmer_index
    counts = kmer_counts(seqs, k, protein).select("seq_id", index(F.col("kmer"), k).alias("at"), F.col("cnt").cast("int").alias("cnt"))
    own = seqs.select("seq_id", F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("cnt")).unionByName(counts)
    maps = own.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "cnt")))).alias("own"))
    return maps.select("seq_id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("own", i), F.lit(0))).alias("counts"))


def kmer_lines(dense: DataFrame) -> DataFrame:
    """Text rows of a k-mer table."""
    return dense.select("seq_id", F.concat(F.format_string("sequence_%d\t", "seq_id"), F.array_join(F.col("counts").cast("array<string>"), "\t")).alias("line"))


def multiplicity(seqs: DataFrame) -> DataFrame:
    """(seq_id, seq, multiplicity): each distinct sequence under its first id."""
    return seqs.groupBy("seq").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("multiplicity")).select("seq_id", "seq", "multiplicity")


def wrapped(seq: Column, width: int = 50) -> Column:
    return F.regexp_replace(seq, rf"(.{{{width}}})(?=.)", "$1\n")


def fasta_text(seqs: DataFrame) -> DataFrame:
    return seqs.select("seq_id", F.concat(F.format_string(">sequence_%d\n", "seq_id"), wrapped(F.col("seq"))).alias("record"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank, from 0 in the given order: a range sort, numbered in each range after the rows of the ranges before."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = saved(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_range")
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    return placed.select("*", part).join(F.broadcast(before), "_range").select(*rows.columns, (F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank"))


def multiplicity_fasta(seqs: DataFrame) -> DataFrame:
    """(seq_id, multiplicity, record, rank): unique records, ranked by ascending multiplicity and id."""
    rows = ranked(multiplicity(seqs), "multiplicity", "seq_id")
    return rows.select("seq_id", "multiplicity", F.concat(F.format_string(">sequence_%d_mutiplicity_%d\n", "seq_id", "multiplicity"), wrapped(F.col("seq"))).alias("record"), "rank")


def carried(rows: DataFrame, place: str, column: str, size: int = 4096) -> DataFrame:
    """rows, a stored table, with nulls of a column replaced by the last value at an earlier place.

    In two steps, so that no task sees all places: the last value of each block of `size` places is carried over the blocks, one row
    each, and then within the blocks.
    """
    block = F.floor(F.col(place) / size).alias("_block")
    lasts = rows.where(F.col(column).isNotNull()).groupBy(block).agg(F.max_by(column, place).alias("_last"))
    blocks = rows.select(block).distinct().join(lasts, "_block", "left")
    before = F.last("_last", ignorenulls=True).over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("_block", before.alias("_before"))
    within = F.last(column, ignorenulls=True).over(Window.partitionBy("_block").orderBy(place))
    out = rows.select("*", block).join(starts, "_block").withColumn(column, F.coalesce(within, "_before"))
    return out.select(*rows.columns)


def consensus(seqs: DataFrame) -> DataFrame:
    """One row a position: base, counts and shares of ACGT; a position without ACGT takes the base before it."""
    total = seqs.agg(F.count("*").alias("n"))
    chars = seqs.where(F.length("seq") > 0).select(F.posexplode(F.split("seq", "")).alias("pos", "c"))
    counts = chars.groupBy("pos").agg(*[F.count_if(F.col("c") == b).alias(f"n_{b.lower()}") for b in S.DNA])
    names = [f"n_{b.lower()}" for b in S.DNA]
    top = F.greatest(*names)
    base = F.lit(None).cast("string")
    for b in reversed(S.DNA):
        base = F.when(F.col(f"n_{b.lower()}") == top, F.lit(b)).otherwise(base)
    own = counts.withColumn("own", F.when(top > 0, base)).join(F.broadcast(total))
    shares = [(F.col(n) / F.col("n")).alias(f"f_{n[2:]}") for n in names]
    return carried(saved(own), "pos", "own").select("pos", F.col("own").alias("base"), *names, *shares)


def consensus_string(cons: DataFrame) -> DataFrame:
    return cons.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda s: s["base"]), "").alias("consensus"))


def consensus_stats(cons: DataFrame) -> DataFrame:
    top = F.greatest("f_a", "f_c", "f_g", "f_t")
    return cons.agg(F.avg(top).alias("mean_max"), F.stddev_pop(top).alias("sigma_max"))


def consensus_report(cons: DataFrame) -> DataFrame:
    top = F.greatest("f_a", "f_c", "f_g", "f_t")
    return cons.select("pos", "base", top.alias("max_share"), (top < 0.85).alias("low_confidence"))


def digest(seqs: DataFrame, enzyme: str | tuple[str, int, int]) -> DataFrame:
    """(seq_id, fragment, fragment_seq, fragment_len) of every sequence."""
    site, before, after = S.ENZYMES[enzyme] if isinstance(enzyme, str) else enzyme
    rows = seqs.where("seq is not null").select("seq_id", F.posexplode(S.fragments(F.col("seq"), site, before, after)).alias("fragment", "fragment_seq"))
    return rows.select("*", F.length("fragment_seq").alias("fragment_len"))


def length_window(seqs: DataFrame, size: int, plus: int, minus: int) -> DataFrame:
    return seqs.where(F.length("seq").between(max(0, size - minus), size + plus))


def exact_lookup(seqs: DataFrame, queries: DataFrame) -> DataFrame:
    """The sequences that equal one of queries(seq)."""
    return seqs.join(queries.select("seq").distinct(), "seq", "left_semi")


def near_sequences(seqs: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """(seq_id, target_id, dist) of the sequences within an alignment distance of targets."""
    return near_pairs(seqs, targets, most).select(F.col("i").alias("seq_id"), F.col("j").alias("target_id"), "dist")


def satellites(seqs: DataFrame, target: DataFrame, size: int, plus: int, minus: int, most: float) -> DataFrame:
    return near_sequences(length_window(seqs, size, plus, minus), target, most)


def closest(seqs: DataFrame, queries: DataFrame, radius: float = 64) -> DataFrame:
    """For every query its nearest sequence; ties go to the smallest id.

    All sequences within a radius are found by their rare grams, so a query that has one there is settled; for the others the radius
    grows fourfold, up to four times the longest length, beyond which no distance lies.
    """
    left = saved(queries.select("seq_id", "seq"))
    done = None
    longest = max(x or 0 for t in (seqs, left) for x in t.agg(F.max(F.length("seq"))).first())
    while True:
        rows = near_pairs(left, seqs, radius)
        settled = saved(rows.groupBy("i").agg(F.min(F.struct("dist", F.col("j").alias("seq_id"))).alias("best")).select(F.col("i").alias("query_id"), "best.seq_id", "best.dist"))
        done = settled if done is None else done.unionByName(settled)
        left = left.join(settled.select(F.col("query_id").alias("seq_id")), "seq_id", "left_anti")
        if radius >= 4 * longest or not left.limit(1).count():
            return done
        left, radius = saved(left), 4 * radius


def n_expanded(seqs: DataFrame) -> DataFrame:
    """(seq_id, k, seq): every sequence that the letters N of one stand for, in k-mer order; one without N as it is.

    The codes are dealt out in levels of six letters each, so no row holds more than 4096 of them.
    """
    rows = seqs.select("seq_id", "seq", S.n_count(F.col("seq")).alias("n"), F.lit(0).cast("long").alias("k"))
    rows = rows.where(F.when(F.col("n") > 30, F.raise_error("more than 30 letters N stand for over 2^60 sequences")).otherwise(F.lit(True)))
    for level in range(5):
        count = F.pow(F.lit(4), F.greatest(F.lit(0), F.least(F.lit(6), F.col("n") - 6 * level))).cast("long")
        rows = rows.select("seq_id", "seq", "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("more"))
        rows = rows.select("seq_id", "seq", "n", (F.col("k") + F.shiftleft("more", 12 * level)).alias("k"))
    return rows.select("seq_id", "k", S.n_expansion(F.col("seq"), F.col("k")).alias("seq"))
