"""Table functions for SQL: FROM seqs, LATERAL fasta_kmers(seq, 2).  A row of input is worked on alone, and its rows are handed on one by one."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .sequences import DNA, ENZYMES


class FastaKmers:
    """(kmer, cnt) of the k-mers of a sequence over the letters ACGT; the last window does not count."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[str, int]]:
        if seq is not None:
            counts = Counter(seq[i : i + k] for i in range(len(seq) - k))
            yield from ((kmer, n) for kmer, n in counts.items() if not kmer.strip(DNA))


class Digest:
    """(fragment, fragment_seq, fragment_len) of a sequence cut by an enzyme; a site flush with the end is not cut."""

    def eval(self, seq: str, enzyme: str) -> Iterator[tuple[int, str, int]]:
        if seq is not None:
            site, before, _ = ENZYMES[enzyme]
            letters = site.replace("N", ".")
            start = n = 0
            for found in re.finditer(f"(?s)(?={letters}.)", seq):
                cut = found.start() + before
                yield n, seq[start:cut], cut - start
                start, n = cut, n + 1
            yield n, seq[start:], len(seq) - start


class ExpandN:
    """(k, expanded) for every sequence that the letters N of one stand for: the digits of k in base 4, least significant first."""

    def eval(self, seq: str) -> Iterator[tuple[int, str]]:
        if seq is not None:
            parts = seq.split("N")
            if len(parts) > 31:
                raise ValueError("more than 30 letters N stand for over 2^60 sequences")
            for k in range(4 ** (len(parts) - 1)):
                letters = [DNA[k >> 2 * i & 3] for i in range(len(parts) - 1)]
                yield k, "".join(a + b for a, b in zip(parts, [*letters, ""], strict=True))


def register(spark: SparkSession) -> None:
    """Make the functions known to a session's SQL."""
    for name, of, rows in (("fasta_kmers", FastaKmers, "kmer: string, cnt: bigint"), ("digest", Digest, "fragment: int, fragment_seq: string, fragment_len: int"), ("expand_n", ExpandN, "k: bigint, expanded: string")):
        spark.udtf.register(name, udtf(of, returnType=rows))
