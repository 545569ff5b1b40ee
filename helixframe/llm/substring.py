"""Substring dedup: repeated runs of 20 words are found with a compressed FM-index in every shard.

Every window of 20 words has a minimiser, the least hash of its 16 runs of five words; consecutive windows with one minimiser
form a segment.  Equal windows have equal minimisers, so segments are dealt to shards by minimiser and every shard sees all
occurrences of its windows.  First the minimisers are counted over all documents.  Segments whose minimiser occurs once hold
nothing that repeats and stay where they are; a minimiser in more than 1/64 as many segments as there are documents is hot, and its
windows are dealt one by one, by their own hash, with equal ones combined before the shuffle.

A shard keeps one copy of equal segments, the earliest.  Over the others of minimisers with several segments it builds a
Burrows-Wheeler transform sorted by 32 words and a wavelet matrix of packed bits with rank samples, and streams the segments'
windows through backward search, dropping those whose interval shrinks to one.  What is left with an interval of two or more
has a matching statistic of at least 20 words, and all but the earliest occurrence of it is reported.

The minimisers that repeat are broadcast if they are found to be at most MOST_KEYS; beyond that all segments are dealt.

Defined results: null and empty texts have no words; texts under 20 words lose nothing; rows equal in doc_id and text count as
one document and are treated alike; a null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from .textscan import Scan, _powers, mix, slices, windows

WINDOW, GRAM, ORDER = 20, 5, 32
HOT_SHARE = 1 / 64
MOST_KEYS = 4_000_000
SHARD_WORDS = 2_000_000
_U = np.uint64


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words starts..ends."""
    up, down = _powers(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Segments:
    """Segments of the texts of a scan: minimiser, text, first word, number of windows, and occurrences of the minimiser."""

    def __init__(self, scan: Scan):
        n = len(scan.words) - GRAM + 1
        gram = np.full(max(0, n), _U(0xFFFFFFFFFFFFFFFF))
        at, h = scan.windows(GRAM)
        gram[at] = h
        first, self.window_hash = scan.windows(WINDOW)
        low = gram
        for k in (1, 2, 4, 8):
            low = np.minimum(low[: len(low) - k], low[k:]) if len(low) > k else low[:0]
        key = low[first]
        doc = np.searchsorted(scan.ptr, first, side="right") - 1
        new = np.ones(len(first), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        cut = np.flatnonzero(new)
        self.key, self.doc, self.first = key[cut], doc[cut], first[cut]
        self.count = np.diff(np.append(cut, len(first)))
        self.window = cut
        width = self.count + WINDOW - GRAM
        off = np.cumsum(width) - width
        inside = np.repeat(self.first - off, width) + np.arange(width.sum())
        self.seen = np.add.reduceat(gram[inside] == np.repeat(self.key, width), off) if len(off) else np.zeros(0, np.int64)


def key_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of all minimisers; counted within pieces of a task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own = Segments(Scan(b.column(0)))
            key, inverse = np.unique(own.key, return_inverse=True)
            n = np.bincount(inverse, own.seen, minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


_SEGMENT = "key long, doc long, rid long, start long, n long, words binary"


def repeated_segments(docs: DataFrame, keys, hot: np.ndarray) -> DataFrame:
    """Segments of the minimisers in the broadcast keys (all, if None) with their word hashes; words is null for one that
    equals an earlier one of its piece, which is to be removed at once."""
    heat = docs.sparkSession.sparkContext.broadcast(hot)

    def member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.zeros(len(x), dtype=bool)
        return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 23):
            scan = Scan(b.column(2))
            own = Segments(scan)
            pick = np.ones(len(own.key), dtype=bool) if keys is None else member(keys.value, own.key)
            warm = member(heat.value, own.key)
            key, doc, first, count = (np.concatenate([x[pick & ~warm], np.repeat(x[warm], own.count[warm])]) for x in (own.key, own.doc, own.first, own.count))
            single = int(own.count[warm].sum())
            if single:  # the windows of hot minimisers, one by one
                cold = len(key) - single
                nth = np.arange(single) - np.repeat(np.cumsum(own.count[warm]) - own.count[warm], own.count[warm])
                first[cold:] += nth
                key[cold:] = own.window_hash[np.repeat(own.window[warm], own.count[warm]) + nth]
                count[cold:] = 1
            if not len(key):
                continue
            end = first + count + WINDOW - 1
            ids, rids = (np.asarray(b.column(k)) for k in (0, 1))
            content = run_hashes(scan.words, first, end) ^ mix(key)
            order = np.lexsort((first, ids[doc]))
            key, doc, first, count, end, content = (x[order] for x in (key, doc, first, count, end, content))
            start = first - scan.ptr[doc]
            _, lead, inverse = np.unique(content, return_index=True, return_inverse=True)
            lead = lead[inverse]
            later = (ids[doc] > ids[doc[lead]]) | ((ids[doc] == ids[doc[lead]]) & (start > start[lead]))
            size = np.where(later, 0, end - first)
            off = np.concatenate([[0], np.cumsum(size)])
            flat = scan.words[np.repeat(first - off[:-1], size) + np.arange(off[-1])]
            blob = pa.Array.from_buffers(pa.large_binary(), len(key), [pa.array(~later).buffers()[1], pa.py_buffer(8 * off), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc]), pa.array(rids[doc]), pa.array(start), pa.array(count), blob], names=[f.split()[0] for f in _SEGMENT.split(", ")])

    return docs.select(ordered_id(), row_id(), "text").mapInArrow(run, _SEGMENT)


def ordered_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc")


def row_id() -> Column:
    """With the id, the identity of a row."""
    return F.xxhash64(F.col("doc_id").isNull(), "text").alias("rid")


class WaveletMatrix:
    """Rank queries on a sequence of symbols; each level is packed bits with a count before every 64."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            on = (symbols >> bit & 1).astype(bool)
            words = np.zeros((len(on) >> 6) + 1, dtype=np.uint64)
            packed = np.packbits(on, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1]
            self.levels.append((bit, words, before, int(len(on) - on.sum())))
            symbols = np.concatenate([symbols[~on], symbols[on]])

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` leads on the lowest level along the bits of the symbol."""
        for bit, words, before, zeros in self.levels:
            cell = at >> 6
            ones = before[cell] + np.bitwise_count(words[cell] & ((_U(1) << (at & 63).astype(np.uint64)) - _U(1))).astype(np.int64)
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search for patterns of up to ORDER words in a text sorted by its next ORDER words."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        rank = text.astype(np.int64)
        reach = 1
        order = np.argsort(rank, kind="stable")
        while reach < ORDER:
            after = np.zeros(n, dtype=np.int64)
            after[: n - reach] = rank[reach:] + 1
            key = rank * (n + n_symbols + 2) + after
            order = np.argsort(key, kind="stable")
            own = key[order]
            new = np.zeros(n, dtype=np.int64)
            new[1:] = own[1:] != own[:-1]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            reach *= 2
        self.matrix = WaveletMatrix(text[order - 1], n_symbols)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.base = self.matrix.down(np.arange(n_symbols), np.zeros(n_symbols, dtype=np.int64))
        self.n = n

    def repeated(self, text: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of the patterns text[at:at+k] occur at least twice, the first row of the interval of each of these)."""
        own = np.arange(len(at))
        lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.n, dtype=np.int64)
        for j in range(k - 1, -1, -1):
            c = text[at[own] + j]
            lo = self.below[c] + self.matrix.down(c, lo) - self.base[c]
            hi = self.below[c] + self.matrix.down(c, hi) - self.base[c]
            keep = hi - lo > 1
            own, lo, hi = own[keep], lo[keep], hi[keep]
        return own, lo


_GONE = "doc long, rid long, start long, n long"


def shard_repeats(shard: pa.Table) -> pa.Table:
    """(doc, rid, start, n): windows start..start+n of a document that have occurred before."""
    column = lambda k: np.asarray(shard.column(k).combine_chunks())
    key, doc, rid, start, count = (column(k) for k in ("key", "doc", "rid", "start", "n"))
    order = np.lexsort((start, doc))
    key, doc, rid, start, count = (x[order] for x in (key, doc, rid, start, count))
    blobs = shard.column("words").combine_chunks()
    off = np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64) // 8
    flat = np.frombuffer(blobs.buffers()[2], dtype=np.uint64) if blobs.buffers()[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint64)
    begin, size = off[:-1][order], np.diff(off)[order]
    content = run_hashes(flat, begin, begin + size) ^ mix(key.view(np.uint64))
    _, lead, inverse = np.unique(content, return_index=True, return_inverse=True)
    lead = lead[inverse]
    later = (doc > doc[lead]) | ((doc == doc[lead]) & (start > start[lead]))
    out = [(doc[later], rid[later], start[later], count[later])]

    lone = np.flatnonzero(lead == np.arange(len(lead)))  # one of each content, the earliest
    _, inverse, n = np.unique(key[lone], return_inverse=True, return_counts=True)
    width = size[lone] + 1
    place = np.cumsum(width) - width
    text = np.zeros(int(width.sum()), dtype=np.uint64)
    inner = np.arange(len(text)) - np.repeat(place, width)
    body = inner < np.repeat(size[lone], width)
    text[body] = flat[(np.repeat(begin[lone], width) + inner)[body]]
    at, gram = windows(text, np.concatenate([place, [len(text)]]), GRAM)
    owner = np.searchsorted(place, at, side="right") - 1
    inside = inner[at] + GRAM < width[owner]
    seen = np.bincount(owner[inside & (gram == key[lone].view(np.uint64)[owner])], minlength=len(lone))
    lone = lone[(n[inverse] > 1) | (seen > 1)]
    if len(lone):
        width = size[lone] + 1
        place = np.cumsum(width) - width
        text = np.zeros(int(width.sum()), dtype=np.int64)
        inner = np.arange(len(text)) - np.repeat(place, width)
        body = inner < np.repeat(size[lone], width)
        alphabet, code = np.unique(flat[(np.repeat(begin[lone], width) + inner)[body]], return_inverse=True)
        text[body] = code + 1  # 0 ends a segment
        index = FMIndex(text, len(alphabet) + 1)
        head = np.flatnonzero(inner + WINDOW < np.repeat(width, width))
        own, interval = index.repeated(text, head, WINDOW)
        _, earliest, inverse = np.unique(interval, return_index=True, return_inverse=True)
        owner = np.searchsorted(place, head[own], side="right") - 1
        d, s = doc[lone][owner], start[lone][owner] + head[own] - place[owner]
        lead = earliest[inverse]
        later = (d > d[lead]) | ((d == d[lead]) & (s > s[lead]))
        out.append((d[later], rid[lone][owner][later], s[later], np.ones(int(later.sum()), dtype=np.int64)))
    d, r, s, n = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((s, r, d))
    d, r, s, n = d[order], r[order], s[order], n[order]
    new = np.ones(len(r), dtype=bool)  # windows that follow each other become one row
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (s[1:] > (s + n)[:-1])
    group = np.cumsum(new) - 1
    end = np.zeros(int(new.sum()), dtype=np.int64)
    np.maximum.at(end, group, s + n)
    return pa.table({"doc": pa.array(d[new]), "rid": pa.array(r[new]), "start": pa.array(s[new]), "n": pa.array(end - s[new])})


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables (doc, rid, start, n) of the windows to be removed: what the shards report, and copies that were met before."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n_docs = docs.count()
    found = saved(key_counts(docs).where("n > 1"))
    total = found.agg(F.count("*"), F.sum("n")).first()
    hot = [r[0] for r in found.where(F.col("n") > max(64.0, n_docs * HOT_SHARE)).select("key").collect()]  # 64 times the mean text at most
    keys = None
    if total[0] <= MOST_KEYS:
        keys = spark.sparkContext.broadcast(np.sort(np.asarray(found.select("key").toArrow().column(0).combine_chunks()).view(np.uint64)))
    rows = repeated_segments(docs, keys, np.sort(np.array(hot, dtype=np.int64).view(np.uint64)))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-28 * (total[1] or 0) // SHARD_WORDS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    empty = dealt.where("words is null").select("doc", "rid", "start", "n")
    kept = dealt.where("words is not null")
    return kept.groupBy("shard").applyInArrow(shard_repeats, _GONE), empty


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words that stay, joined by a space, for every row of docs(doc_id, text)."""
    return _remove(docs, False)


def digest_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""
    return _remove(docs, True)


def _remove(docs: DataFrame, digest: bool) -> DataFrame:
    several, equal = repeats(docs)
    gone = saved(several.unionByName(equal).groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "n")).alias("gone")))
    # what goes grows with the texts, so they meet by a shuffle at every size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", ordered_id(), row_id()).join(gone.hint("merge"), ["doc", "rid"], "left").select("doc_id", "text", F.col("gone.start").alias("start"), F.col("gone.n").alias("n"))
    name = "kept_sha256" if digest else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            n_words, n_removed, kept = [], [], []
            for text, start, n in zip(b.column(1), b.column(2), b.column(3), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                size = len(words)
                if start.is_valid:
                    a, n = np.asarray(start.values), np.asarray(n.values)
                    step = np.zeros(size + 1, dtype=np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, np.minimum(a + n + WINDOW - 1, size), -1)
                    words = list(compress(words, np.cumsum(step[:-1]) == 0))
                n_words.append(size)
                n_removed.append(size - len(words))
                data = b" ".join(words)
                kept.append(hashlib.sha256(data).hexdigest() if digest else data.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", name])

    return rows.mapInArrow(run, f"doc_id long, n_words long, n_removed long, {name} string")
