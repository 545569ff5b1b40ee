"""Byte substring dedup: passages of WINDOW bytes that stand in more than one place are found with suffix arrays, shard by shard.

Every window of 400 bytes has a minimiser, the least hash of its runs of 64 bytes; consecutive windows with one minimiser are a
segment, the bytes from the first window's first to the last one's last.  Equal windows have equal minimisers, so whatever
repeats meets by minimiser.  Segments are first combined by minimiser and content: where a content stands twice, all its windows
repeat, in every place.  Contents whose minimiser has no other content, and that do not repeat it inside, are settled with
that.  The others are cut out of the texts, dealt by minimiser, and sorted in shards; what stands in several places stands there once.

A shard's suffix array is made in two stages.  Suffixes that are smaller than their successors are sorted directly, by eight bytes
at a time and only as far as ties last; all others are induced by a scan over the buckets of first bytes: a suffix that is larger
than its successor takes its place in its bucket when its successor is passed.  Neighbours in the array with a common prefix
of 400 bytes are windows that repeat.

A minimiser with more than HOT contents (a passage in very many documents, with other text around it in each) is dealt by windows
instead: its windows are numbered by 128-bit hashes in slices, so that it does not have to fit in a task.

Defined results: null and empty texts have no bytes; texts under 400 bytes lose nothing; every copy of a passage goes, the first
too; equal rows are documents of their own, and so lose all windows; a null doc_id is a document like others; columns beyond
doc_id and text are passed over.  What stays may begin or end inside a character, so the operator returns bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved, small
from .textscan import _BYTE, _powers, mix, slices, text_buffer

WINDOW, GRAM = 400, 64
#: Bytes of a shard.
SHARD_BYTES = 3_000_000
#: A minimiser with more contents is dealt by windows.
HOT = 4096
_U = np.uint64


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    low, reach = values, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


class RunHashes:
    """64-bit hashes of runs of bytes of a buffer, from one prefix sum."""

    def __init__(self, raw: np.ndarray, table: np.ndarray = _BYTE):
        up, self.down = _powers(len(raw) + 1)
        self.sum = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(table[raw] * up[: len(raw)], out=self.sum[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start])

    def runs(self, width: int) -> np.ndarray:
        n = max(0, len(self.sum) - width)
        return mix((self.sum[width : width + n] - self.sum[:n]) * self.down[:n])


#: A second, independent table of byte values, for 128 bits together.
_OTHER = np.random.default_rng(20250613).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def segments_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, windows, minimiser, content, again) of the segments of a buffer of texts: start is counted in the text, content is a
    hash of all bytes, again tells whether the minimiser stands in the segment twice."""
    hashes = RunHashes(raw)
    gram = hashes.runs(GRAM)
    span = WINDOW - GRAM + 1
    if len(raw) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(_U), none.view(_U), none.astype(bool)
    low = sliding_least(gram, span)
    ok = np.zeros(len(raw) + 1, dtype=np.int64)  # windows that stay inside a text
    size = np.diff(off)
    long = size >= WINDOW
    np.add.at(ok, off[:-1][long], 1)
    np.add.at(ok, off[1:][long] - WINDOW + 1, -1)
    at = np.flatnonzero(np.cumsum(ok)[: len(low)])
    doc = np.repeat(np.flatnonzero(long), size[long] - WINDOW + 1)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[at[1:]] != low[at[:-1]]) | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(new)
    windows = np.diff(np.append(cut, len(at)))
    first, key = at[cut], low[at[cut]]
    again = np.zeros(len(cut), dtype=bool)
    end = first + windows - 1 + span
    for lo in range(0, len(cut), 4096):  # in stretches, for memory
        f, e, k = first[lo : lo + 4096], end[lo : lo + 4096], key[lo : lo + 4096]
        width = e - f
        inner = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width) + np.repeat(f, width)
        hits = gram[inner] == np.repeat(k, width)
        again[lo : lo + 4096] = np.add.reduceat(hits, np.cumsum(width) - width) > 1
    content = hashes.spans(first, first + windows - 1 + WINDOW)
    return doc[cut], first - off[doc[cut]], windows, key, content, again


_SEGMENT = "row long, start int, windows int, key long, content long, again boolean"


def row_id() -> Column:
    """Rows equal in doc_id and text share it: they are met together and lose the same."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), "text").alias("row")


def segments(docs: DataFrame) -> DataFrame:
    """(row, start, windows, key, content, again) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = np.asarray(b.column(0))
            doc, start, windows, key, content, again = segments_of(*text_buffer(b.column(1)))
            if len(doc):
                columns = [pa.array(rows[doc]), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SEGMENT.split(", ")])

    return docs.select(row_id(), "text").mapInArrow(run, _SEGMENT)


def ranked(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): items sorted by (group, key), and which of them differ from the one before."""
    order = np.lexsort((keys, group))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (group[order][1:] != group[order][:-1]) | (keys[order][1:] != keys[order][:-1])
    return order, new


def sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes `at`, sorted by their first `depth` symbols; eight at a time, and only those that still tie."""
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
    chunk = np.zeros(len(text) + depth, dtype=np.uint64)
    for j in range(8):
        chunk |= padded[j : j + len(chunk)].astype(np.uint64) << _U(56 - 8 * j)
    order = np.argsort(chunk[at], kind="stable")
    at = at[order]
    key = chunk[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    lone = new & np.append(new[1:], True)
    tied = np.flatnonzero(~lone)
    for done in range(8, depth, 8):
        if not len(tied):
            break
        # a group whose next symbols are all equal stays as it is; only the others are sorted
        first = new[tied]
        key, group = chunk[at[tied] + done], np.cumsum(first) - 1
        differs = np.zeros(len(tied), dtype=bool)
        differs[1:] = ~first[1:] & (key[1:] != key[:-1])
        parted = np.zeros(int(group[-1]) + 1, dtype=bool)
        parted[group[differs]] = True
        own = parted[group]
        if own.any():
            order, fresh = ranked(key[own], group[own])
            sub = tied[own]
            at[sub] = at[sub][order]
            new[sub] = fresh
            tied = tied[~(new[tied] & np.append(new, True)[tied + 1])]
    return at


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a text of bytes that ends with its least symbol, 0, in the order of their first `depth` symbols.

    Stage one sorts the suffixes that are smaller than their successors; stage two scans the buckets of first symbols in order
    and puts each larger suffix at the next free place of its bucket when its successor is passed.
    """
    n = len(text)
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    change = np.flatnonzero(step)
    nxt = np.searchsorted(change, np.arange(n))
    smaller = np.zeros(n, dtype=bool)  # a suffix is smaller than its successor if the next symbol that differs is larger
    smaller[nxt < len(change)] = step[change[nxt[nxt < len(change)]]] > 0
    direct = sorted_directly(text, np.flatnonzero(smaller), depth)
    ends = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[0].append(np.array([n - 1]))
    out = []

    def hand_on(passed: np.ndarray, c: int) -> np.ndarray:
        """Tell the predecessors of suffixes of bucket c that they come next; those in bucket c itself are returned."""
        before = passed[passed > 0] - 1
        before = before[~smaller[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cut = np.searchsorted(first, np.arange(257))
        for b in np.unique(first[cut[c + 1] :]) if c < 255 else ():
            waiting[b].append(before[cut[b] : cut[b + 1]])
        return before[cut[c] : cut[c + 1]]

    for c in range(256):
        new = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(new):  # a run of one symbol follows the shorter runs
            out.append(new)
            new = hand_on(new, c)
        own = direct[ends[c] : ends[c + 1]]
        out.append(own)
        hand_on(own, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix in the order and the next, whether they share `depth` symbols: compared by 8 symbols at a time, as far as they
    agree, from the end, where those that differ do so first."""
    padded = np.concatenate([text, np.zeros(depth + 8, dtype=np.uint8)])
    chunk = np.zeros(len(text) + depth, dtype=np.uint64)
    for j in range(8):
        chunk |= padded[j : j + len(chunk)].astype(np.uint64) << _U(56 - 8 * j)
    left = np.arange(len(order) - 1)
    for done in reversed(range(0, depth, 8)):
        left = left[chunk[order[left] + done] == chunk[order[left + 1] + done]]
    out = np.zeros(max(0, len(order) - 1), dtype=bool)
    out[left] = True
    return out


def repeated_windows(bodies: list[bytes]) -> list[np.ndarray]:
    """Of each body, the starts of the windows of WINDOW bytes that start anywhere else in these bodies, too."""
    # symbols 1..255 and 0 as the end: bytes of UTF-8 never are 0xFF, so all go up by one
    text = np.frombuffer(b"".join(bytes(b) + b"\xff" for b in bodies), dtype=np.uint8) + np.uint8(1)
    size = np.array([len(b) + 1 for b in bodies])
    off = np.cumsum(size) - size
    order = suffix_array(text, WINDOW)
    room = np.repeat(off + size - 1, size) - np.arange(len(text))
    order = order[room[order] >= WINDOW]
    same = common_prefixes(text, order, WINDOW)
    twice = np.zeros(len(text), dtype=bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return [np.flatnonzero(twice[a : a + n]) for a, n in zip(off, size, strict=True)]


def runs_of(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of consecutive places."""
    new = np.ones(len(places), dtype=bool)
    new[1:] = np.diff(places) != 1
    start = np.flatnonzero(new)
    return places[start], np.diff(np.append(start, len(places)))


_GONE = "row long, start int, windows int"


def shard_repeats(shard: pa.Table) -> pa.Table:
    """(row, start, windows): windows of the segments of a shard that stand elsewhere."""
    found = repeated_windows(shard.column("body").to_pylist())
    out = [[], [], []]
    for row, base, places in zip(shard.column("row").to_pylist(), shard.column("start").to_pylist(), found, strict=True):
        start, n = runs_of(places)
        out[0] += [row] * len(start)
        out[1] += (start + base).tolist()
        out[2] += n.tolist()
    return pa.table({"row": pa.array(out[0], pa.int64()), "start": pa.array(out[1], pa.int32()), "windows": pa.array(out[2], pa.int32())})


def cut_out(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(key, row, start, body) of wanted(key, row, start, windows): the texts meet them by a shuffle, unless they are few."""
    lists = wanted.groupBy("row").agg(F.collect_list(F.struct("key", "start", "windows")).alias("own"))
    rows = docs.select(row_id(), "text").join(small(lists, n), "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for row, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for lo in range(0, len(own), 4096):
                    part = own[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([s["key"] for s in part], pa.int64()), pa.array([row] * len(part), pa.int64()), pa.array([s["start"] for s in part], pa.int32()),
                        pa.array([data[s["start"] : s["start"] + s["windows"] - 1 + WINDOW] for s in part], pa.binary()),
                    ], names=["key", "row", "start", "body"])

    return rows.select("row", "text", "own").mapInArrow(run, "key long, row long, start int, body binary")


def window_repeats(bodies: DataFrame, slices_: int) -> DataFrame:
    """(row, start, windows) of the windows of bodies(row, start, body) that stand twice among them, by 128-bit hashes dealt in slices."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [np.frombuffer(x, dtype=np.uint8) for x in b.column(2).to_pylist()]
            a, c = ([RunHashes(x, t).runs(WINDOW) for x in raw] for t in (_BYTE, _OTHER))
            n = [len(x) for x in a]
            row = np.repeat(np.asarray(b.column(0)), n)
            start = np.concatenate([np.arange(k) + s for k, s in zip(n, b.column(1).to_pylist(), strict=True)])
            a, c = np.concatenate(a), np.concatenate(c)
            dealt = (a % _U(slices_)).astype(np.int64)
            order = np.argsort(dealt, kind="stable")
            cut = np.searchsorted(dealt[order], np.arange(slices_ + 1))
            for s in np.flatnonzero(np.diff(cut)):
                own = order[cut[s] : cut[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int64()), *[pa.array([x[own].tobytes()], pa.binary()) for x in (a, c, row, start)]], names=["slice", "a", "c", "row", "start"])

    def meet(part: pa.Table) -> pa.Table:
        a, c, row, start = (np.concatenate([np.frombuffer(x, dtype=k) for x in part.column(name).to_pylist()]) for name, k in (("a", _U), ("c", _U), ("row", np.int64), ("start", np.int64)))
        order, new = ranked(c, a)
        several = ~(new & np.append(new[1:], True))
        row, start = row[order][several], start[order][several]
        return pa.table({"row": pa.array(row), "start": pa.array(start.astype(np.int32)), "windows": pa.array(np.ones(len(row), np.int32))})

    dealt = bodies.select("row", "start", "body").mapInArrow(deal, "slice long, a binary, c binary, row binary, start binary")
    return dealt.groupBy("slice").applyInArrow(meet, _GONE)


def repeats(docs: DataFrame) -> DataFrame:
    """(row, start, windows): stretches of windows of each row that stand elsewhere, too."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    found = saved(segments(docs))
    keys = found.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("key")
    several = found.join(small(saved(keys)), "key")
    contents = saved(several.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "windows")).alias("place"), F.max("again").alias("again")))
    mixed = saved(contents.groupBy("key").agg(F.count("*").alias("contents"), F.max("again").alias("again")).where("contents > 1 or again").select("key", "contents"))
    copies = contents.where("n > 1").select("key", "content")
    whole = found.join(small(copies), ["key", "content"]).select("row", "start", "windows")
    open_ = saved(contents.select("key", "place.*").join(small(mixed), "key"))
    total, n, hot = open_.agg(F.sum(F.col("windows") + WINDOW), F.count("*"), F.count_if(F.col("contents") > HOT)).first()
    if not n:
        return whole
    bodies = saved(cut_out(docs, open_, n))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    hot_keys = open_.where(F.col("contents") > HOT).select("key").distinct()
    cold = bodies.join(small(hot_keys), "key", "left_anti") if hot else bodies
    out = cold.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(shard_repeats, _GONE)
    if hot:
        out = out.unionByName(window_repeats(bodies.join(small(hot_keys), "key"), shards))
    return whole.unionByName(out)


def remove_repeats(docs: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for every row of docs(doc_id, text): kept is the bytes that stay, or with digest
    kept_sha256 their sha256."""
    gone = saved(repeats(docs).groupBy("row").agg(F.collect_list(F.struct("start", "windows")).alias("gone")))
    n = gone.agg(F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()[0]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_id()).join(small(gone, n), "row", "left")
    rows = rows.select("doc_id", "text", F.col("gone.start").alias("start"), F.col("gone.windows").alias("windows"))
    name, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            out = [[], [], [], []]
            for text, start, windows in zip(b.column(1), b.column(2), b.column(3), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                size, spans = len(data), 0
                if start.is_valid:
                    step = np.zeros(size + 1, dtype=np.int64)
                    first, count = np.asarray(start.values).astype(np.int64), np.asarray(windows.values).astype(np.int64)
                    np.add.at(step, first, 1)
                    np.add.at(step, first + count - 1 + WINDOW, -1)
                    stays = np.cumsum(step[:-1]) == 0
                    spans = int((np.diff(np.concatenate([[True], stays]).astype(np.int8)) < 0).sum())
                    data = np.frombuffer(data, dtype=np.uint8)[stays].tobytes()
                for x, v in zip(out, (size, size - len(data), spans, hashlib.sha256(data).hexdigest() if digest else data), strict=True):
                    x.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", name])

    return rows.mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {kind}")
