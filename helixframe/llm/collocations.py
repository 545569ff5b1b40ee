"""Phrase collocations, mined with relations of occurrences (SETM).

The relation of length 1 has every word of every piece with its place; places of neighbours in a piece differ by one, and a place is
left free between pieces.  It is stored in blocks of whole documents of one language, sorted by place, each with its own
vocabulary.  Groups are counted within a block first; the counts of all blocks meet in a shuffle, and every block is told which of
its groups are frequent, and by what number they go.  That reply is the semi-join: only occurrences of frequent groups
are extended.  A relation is merge-joined with itself by adjacent places, which makes occurrences one word longer, of a frequent
group and a frequent group that overlaps it in all but the first word; these are counted likewise.

Words are counted as text, and longer groups as (number of the group without its last word, number of the last word), so all
counts are exact; a slice of the groups, dealt by a hash, is one task, and the number of slices follows the number of
occurrences.  A group stands once for each block in its slice, however frequent it is.

Candidates, their parts and the longer phrases that swallow them are joined by their text.  The best of each language come
from a range sort with offsets, so no language has to fit in a task.

Defined results: a null or empty text has no words; a null language is `und`, together with a language of that name; equal rows count
each; columns beyond text and lang are passed over; an empty table has no phrases; NUL and other control characters are letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved, small
from .shared import positions
from .textscan import Scan, mix, slices

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A longer phrase swallows a part of it if it has at least so many in a hundred of its occurrences.
SWALLOWS = 50
BLOCK_WORDS = 250_000
SLICE_GROUPS = 1_000_000
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def packed(values: np.ndarray, kind: type = np.int64) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(data, dtype=kind)


def numbers(value: pa.BinaryScalar, kind: type = np.int64) -> np.ndarray:
    """The numbers in a binary value, which is not copied."""
    return np.frombuffer(value.as_buffer(), dtype=kind)


def all_numbers(column: pa.ChunkedArray, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of a binary column in one array, and how many each value has."""
    parts, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for x in column.chunks:
        off = np.frombuffer(x.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(x.type) else np.int32)[x.offset : x.offset + len(x) + 1]
        if len(x) and off[-1] > off[0]:
            parts.append(np.frombuffer(x.buffers()[2], dtype=np.uint8)[off[0] : off[-1]].view(kind))
        sizes.append(np.diff(off) // np.dtype(kind).itemsize)
    return np.concatenate(parts), np.concatenate(sizes)


class Words:
    """Occurrences of the words of some texts: hash, place, and where a word of that hash stands first."""

    def __init__(self, texts: pa.Array):
        scan = Scan(texts, _INSIDE, _LOWER)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[scan.buf])])
        new = np.zeros(len(scan.starts), dtype=np.int64)
        new[1:] = breaks[scan.starts[1:]] != breaks[scan.ends[:-1]]
        first = scan.ptr[:-1]
        new[first[(first > 0) & (first < len(new))]] = 1
        self.place = (np.arange(len(new)) + np.cumsum(new)).astype(np.int32)
        self.hash = scan.words
        self.size = len(new)
        self.key, at = np.unique(self.hash, return_index=True)
        self.text = strings(scan.buf, scan.starts[at], scan.ends[at])


def strings(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of a buffer as strings; no Python object is made for a word."""
    off = np.concatenate([[0], np.cumsum(end - start)])
    inner = np.repeat(start - off[:-1], end - start) + np.arange(off[-1])
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw[inner])))


_BLOCK = "lang string, block long, size long, words array<string>, counts array<long>, places binary, codes binary"


def word_blocks(docs: DataFrame) -> DataFrame:
    """The relation of length 1: a block a row, with a code for each place, the number of a word in the block's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task = 0, TaskContext.get().partitionId()
        held: dict[str, list[Words]] = {}

        def block(lang: str) -> pa.RecordBatch:
            nonlocal made
            own = held.pop(lang)
            places, start = [], 0
            for x in own:
                places.append(x.place.astype(np.int64) + start)
                start += int(x.place[-1]) + 2
            key, code, n = np.unique(np.concatenate([x.hash for x in own]), return_inverse=True, return_counts=True)
            _, at = np.unique(np.concatenate([x.key for x in own]), return_index=True)
            text = pa.concat_arrays([x.text for x in own]).take(pa.array(at))
            made += 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([lang]), pa.array([(task << 32) + made]), pa.array([len(code)]), one(text), one(pa.array(n.astype(np.int64)))]
            columns += [pa.array([packed(x, np.int32)], pa.binary()) for x in (np.diff(np.concatenate(places), prepend=0), code)]
            return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _BLOCK.split(", ")])

        for b in slices(batches, "text", 1 << 21):
            langs = b.column(0).to_pylist()
            for lang in sorted(set(langs)):
                words = Words(b.column(1).filter(pa.array([x == lang for x in langs])))
                if words.size:
                    held.setdefault(lang, []).append(words)
                if sum(x.size for x in held.get(lang, [])) >= BLOCK_WORDS:
                    yield block(lang)
            while sum(x.size for own in held.values() for x in own) >= 2 * BLOCK_WORDS:
                yield block(max(held, key=lambda k: sum(x.size for x in held[k])))
        for lang in list(held):
            yield block(lang)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, _BLOCK)


def frequent_words(blocks: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, id, phrase, f) of the frequent words; (lang, n) of all; (block, codes, ids) of the frequent words of each block."""
    rows = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("lang", "block", "code", F.col("w.words").alias("phrase"), F.col("w.counts").alias("m"))
    counts = saved(rows.groupBy("lang", "phrase").agg(F.sum("m").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()))
    told = rows.join(counts, ["lang", "phrase"]).groupBy("block").agg(F.collect_list(F.struct("code", "id")).alias("told"))
    return counts, blocks.groupBy("lang").agg(F.sum("size").alias("n")), told.select("block", F.col("told.code").alias("frequent"), F.col("told.id").alias("ids"))


def slice_of(prefix: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    return (mix(mix(prefix.view(_U)) + word.view(_U)) % _U(n)).astype(np.int64)


_GROUPS = "block long, size long, places binary, codes binary, prefix binary, word binary, counts binary"


def group_row(block: int, place: np.ndarray, prefix: np.ndarray, word: np.ndarray, kept: bool) -> pa.RecordBatch:
    """A block of a relation of (prefix, word) occurrences, whose groups are counted; without the places, if it is the last.

    Groups are ordered by prefix, and the differences of prefixes are stored, which compress well."""
    codes_p, p = np.unique(prefix, return_inverse=True)
    codes_w, w = np.unique(word, return_inverse=True)
    key, code, n = np.unique(p * max(1, len(codes_w)) + w, return_inverse=True, return_counts=True)
    p, w = np.divmod(key, max(1, len(codes_w)))
    places, codes = (packed(np.diff(place, prepend=0), np.int32), packed(code, np.int32)) if kept else (b"", b"")
    row = [block, len(place), places, codes, packed(np.diff(codes_p[p], prepend=0)), packed(codes_w[w]), packed(n, np.int32)]
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in _GROUPS.split(", ")])


def neighbours(place: np.ndarray) -> np.ndarray:
    """Which occurrences of a sorted relation have one at the next place (it follows directly)."""
    return np.flatnonzero(np.diff(place) == 1)


def pairs_of_words(blocks: DataFrame, told: DataFrame, kept: bool) -> DataFrame:
    """The relation of length 2: frequent words at adjacent places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = b.slice(k, 1)
                block, places, codes = own.column(0)[0].as_py(), *(numbers(own.column(i)[0], np.int32) for i in (1, 2))
                ids = np.full(int(codes.max()) + 1, -1, dtype=np.int64)
                ids[np.asarray(own.column(3)[0].values)] = np.asarray(own.column(4)[0].values)
                ids = ids[codes]
                place = np.cumsum(places, dtype=np.int64)[ids >= 0]
                ids = ids[ids >= 0]
                at = neighbours(place)
                if len(at):
                    yield group_row(block, place[at], ids[at], ids[at + 1], kept)

    return blocks.select("block", "places", "codes").join(told, "block").mapInArrow(run, _GROUPS)


def extended(relation: DataFrame, told: DataFrame, slices_: int, kept: bool) -> DataFrame:
    """The relation one word longer: occurrences of frequent groups, joined with those at the next place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                own = b.slice(k, 1)
                block, places, codes, prefix, word = own.column(0)[0].as_py(), *(numbers(own.column(i)[0], kind) for i, kind in zip(range(1, 5), (np.int32, np.int32, np.int64, np.int64), strict=True))
                prefix = np.cumsum(prefix)
                dealt = slice_of(prefix, word, slices_)
                ids = np.full(len(prefix), -1, dtype=np.int64)
                for reply in own.column(5)[0].values:
                    ids[dealt == reply["slice"].as_py()] = numbers(reply["ids"])
                frequent = ids[codes] >= 0
                place, codes = np.cumsum(places, dtype=np.int64)[frequent], codes[frequent]
                at = neighbours(place)
                if len(at):
                    yield group_row(block, place[at], ids[codes[at]], word[codes[at + 1]], kept)

    replies = told.groupBy("block").agg(F.collect_list(F.struct("slice", "ids")).alias("told"))
    return relation.select("block", "places", "codes", "prefix", "word").join(replies, "block").mapInArrow(run, _GROUPS)


_TALLY = "slice long, block long, ids binary, id long, prefix long, word long, f long"


def tally(part: pa.Table, least: int, reply: bool) -> pa.Table:
    """What tallied returns, for one slice; the groups are ordered once, and no copy of the input is kept beside them."""
    own = int(part.column("slice")[0].as_py())
    blocks = part.column("block").to_pylist()
    (prefix, size), (word, _), (counts, _) = (all_numbers(part.column(c), kind) for c, kind in (("prefix", np.int64), ("word", np.int64), ("counts", np.int32)))
    first, prefix = np.cumsum(size) - size, np.cumsum(prefix)
    prefix -= np.repeat(np.where(first > 0, prefix[first - 1], 0), size)  # each value starts anew
    order = np.lexsort((word, prefix))
    prefix, word, counts = prefix[order], word[order], counts[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (prefix[1:] != prefix[:-1]) | (word[1:] != word[:-1])
    start = np.flatnonzero(new)
    f = np.add.reduceat(counts, start, dtype=np.int64)
    kept = f >= least
    n, m = int(kept.sum()), len(blocks) if reply else 0
    ids = np.full(len(f), -1, dtype=np.int64)
    ids[kept] = (own << 40) + np.arange(n)
    rows = {"id": ids[kept], "prefix": prefix[start][kept], "word": word[start][kept], "f": f[kept]}
    del prefix, word, counts, start, f
    back = []
    if reply:
        each = np.empty(len(order), dtype=np.int64)
        each[order] = ids[np.cumsum(new, dtype=np.int32) - 1]
        back = [packed(x) for x in np.split(each, np.cumsum(size)[:-1])]
    columns = [pa.array([own] * (n + m), pa.int64()), pa.array([None] * n + blocks[:m], pa.int64()), pa.array([None] * n + back, pa.binary())]
    columns += [pa.concat_arrays([pa.array(rows[c], pa.int64()), pa.nulls(m, pa.int64())]) for c in ("id", "prefix", "word", "f")]
    return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _TALLY.split(", ")])


def tallied(relation: DataFrame, slices_: int, least: int, reply: bool) -> DataFrame:
    """Rows (id, prefix, word, f) of the frequent groups of a relation, and rows (slice, block, ids) that tell a block the numbers
    of its groups in a slice, -1 for those that are not frequent."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, *values in zip(*b.columns, strict=True):
                block, prefix, word, counts = block.as_py(), *(numbers(x, kind) for x, kind in zip(values, (np.int64, np.int64, np.int32), strict=True))
                prefix = np.cumsum(prefix)
                dealt = slice_of(prefix, word, slices_)
                order = np.argsort(dealt, kind="stable")
                cut = np.searchsorted(dealt[order], np.arange(slices_ + 1))
                for s in np.flatnonzero(np.diff(cut)):
                    own = order[cut[s] : cut[s + 1]]
                    row = [int(s), block, packed(np.diff(prefix[own], prepend=0)), packed(word[own]), packed(counts[own], np.int32)]
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["slice", "block", "prefix", "word", "counts"])

    dealt = relation.select("block", "prefix", "word", "counts").mapInArrow(deal, "slice long, block long, prefix binary, word binary, counts binary")
    return dealt.groupBy("slice").applyInArrow(lambda part: tally(part, least, reply), _TALLY)


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of at most `longest` words with f >= least, and (lang, n)."""
    spark = docs.sparkSession
    blocks = saved(word_blocks(docs))
    words, totals, told = frequent_words(blocks, least)
    named = words.select("id", F.col("phrase").alias("last"))
    level = words.select("lang", "id", "phrase", "f")
    out = level.select("lang", F.lit(1).alias("words"), "phrase", "f")
    relation = tally = None
    slices_ = 1
    for k in range(2, longest + 1):
        kept = k < longest
        relation = saved(pairs_of_words(blocks, told, kept) if k == 2 else extended(relation, tally.where("block is not null"), slices_, kept))
        slices_ = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (relation.agg(F.sum("size")).first()[0] or 0) // SLICE_GROUPS)
        tally = saved(tallied(relation, slices_, least, kept))
        found = tally.where("block is null").select("id", F.col("prefix"), "word", "f")
        longer = found.join(level.select(F.col("id").alias("prefix"), "lang", "phrase"), "prefix").join(named.withColumnRenamed("id", "word"), "word")
        level = saved(longer.select("lang", "id", F.concat_ws(" ", "phrase", "last").alias("phrase"), "f"))
        out = out.unionByName(level.select("lang", F.lit(k).alias("words"), "phrase", "f"))
    return out, totals


def scored(phrases: DataFrame, longest: int = MAX_WORDS) -> DataFrame:
    """(lang, phrase, a, l, r, score) of every candidate: the cut with the lowest score."""
    known = phrases.select("lang", "phrase", "f")
    rows = phrases.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cuts = rows.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    words = F.split("phrase", " ")
    cuts = cuts.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " ").alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    big = lambda c: F.col(c).cast("decimal(16,0)")  # noqa: E731  # products of two counts have 32 digits, times a million 38
    cuts = cuts.select("*", (big("a") * big("a")).cast("decimal(32,0)").alias("aa"), (big("l") * big("r")).cast("decimal(32,0)").alias("lr"))
    cuts = cuts.withColumn("score", F.expr("cast(cast(aa * 1000000BD as decimal(38,0)) div lr as long)"))
    least = F.min(F.struct("score", "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "a").agg(least.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def swallowed(phrases: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase) of the candidates that stand inside a longer one often enough."""
    rows = phrases.where("words > 2").select("lang", "words", "phrase", "f")
    words = F.split("phrase", " ")
    inner = [F.when(F.lit(at + k) <= F.col("words"), F.array_join(F.slice(words, F.lit(at + 1), F.lit(k)), " ")) for k in range(2, longest) for at in range(longest - k + 1)]
    parts = rows.select("lang", F.col("f").alias("longer"), F.explode(F.array_compact(F.array(*inner))).alias("phrase")).where("phrase is not null") if inner else rows.select("lang", F.col("f").alias("longer"), "phrase").limit(0)
    most = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return most.join(phrases.select("lang", "phrase", "f"), ["lang", "phrase"]).where(100 * F.col("longer") >= SWALLOWS * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = MAX_WORDS, top: int | None = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the phrases of 2 to `longest` words of each language, the best `top` of them (None: all)."""
    phrases, totals = frequent_phrases(docs, least, longest)
    phrases = saved(phrases)
    rows = scored(phrases, longest).join(swallowed(phrases, longest), ["lang", "phrase"], "left_anti")
    ranked = positions(saved(rows.withColumn("_score", -F.col("score")).withColumn("_a", -F.col("a"))), ["lang"], ["_score", "_a", "phrase"]).drop("n")
    best = ranked if top is None else ranked.where(F.col("pos") < top)
    return best.join(small(saved(totals)), "lang").select("lang", (F.col("pos") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql() -> str:
    """DuckDB SQL for collocations over the table documents, with the defaults."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
    ), words AS (
      SELECT lang, w FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces) WHERE len(w) > 0
    ), totals AS (
      SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang
    ), phrases AS (
      SELECT lang, k, phrase, count(*) AS f
      FROM (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (SELECT unnest([1, 2, 3]) AS k))
      GROUP BY lang, k, phrase HAVING count(*) >= {MIN_COUNT}
    ), cuts AS (
      SELECT c.lang, c.phrase, c.f AS a, h.f AS l, t.f AS r, h.k AS cut, (1000000 * c.f::HUGEINT * c.f::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT) AS score
      FROM phrases c JOIN phrases h ON h.lang = c.lang AND h.k < c.k AND starts_with(c.phrase, h.phrase || ' ')
      JOIN phrases t ON t.lang = c.lang AND t.k = c.k - h.k AND c.phrase = h.phrase || ' ' || t.phrase
      WHERE c.k > 1
    ), scored AS (
      SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM cuts) WHERE nth = 1
    ), swallowed AS (
      SELECT DISTINCT s.lang, s.phrase FROM phrases s JOIN phrases c ON c.lang = s.lang AND c.k > s.k AND contains(' ' || c.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * c.f >= {SWALLOWS} * s.f
      WHERE s.k = 2 AND c.k = 3
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM (
      SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, t.n, CAST(s.score AS BIGINT) AS score
      FROM scored s JOIN totals t ON t.lang = s.lang LEFT JOIN swallowed x ON x.lang = s.lang AND x.phrase = s.phrase WHERE x.phrase IS NULL
    ) WHERE rank <= {TOP}
    """
