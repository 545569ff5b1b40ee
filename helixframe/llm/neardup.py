"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five consecutive words (runs of letters and digits, lower-cased).  The j-th occurrence of a shingle in a text is
an element of its own, so term frequency counts; an element's weight is its shingle's inverse document frequency, 1 for
shingles in at most 1/64 of the documents and falling with the logarithm of the share to 0.75 for one in all of them.  The
document frequencies that matter are exact: a shingle above that share is above it in some chunk of documents, so one pass
gathers the chunks' candidates and a second counts them everywhere; the table is bounded by 64 times the mean text.

A text gets 56 consistent weighted samples in 14 bands of 4: a pair with similarity 0.8 meets in a band with probability
0.9994.  Equal texts are one class.  Within a bucket every class is compared with the bucket's lead, the one that shares most buckets; what these links connect
is one component, and pairs are formed only between classes of a bucket that are still in different components, and only if
their sketches allow the similarity (see alike).  Every pair is verified on its texts.

Defined results: a text under five words has no shingles and is near equal texts only; a null text is a class of its own
document; repeated rows fall into one class; class_id is the smallest doc_id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import _WORD, _fold
from ..storage import saved, small
from .shared import components, led_buckets, unused
from .textscan import Scan, mix, per_doc, slices
from .workers import returning

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
SHARE, LOWEST = 1 / 64, 0.75
LEAST_AGREEING = 30
CHUNK = 16_000_000
MOST_CANDIDATES = 4_000_000
_U = np.uint64
_draw = np.random.default_rng(64)
_R = _draw.gamma(2.0, 1.0, 1 << 12).astype(np.float32)
_BETA = _draw.random(1 << 12).astype(np.float32)
_LOG_C = np.log(_draw.gamma(2.0, 1.0, 1 << 20)).astype(np.float32)
_SALT = _draw.integers(1, 1 << 32, (SAMPLES, 2), dtype=np.uint32) | np.uint32(1)
#: Of elements of weight 1: ln a - ln c = -r (1 - beta).
_UNIT = -_R * (1 - _BETA)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, first of each text with the end last)."""
    scan = Scan(texts, _WORD, _fold)
    at, h = scan.windows(SHINGLE)
    return h, np.searchsorted(at, scan.ptr)


def elements(h: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Hashes of (shingle, how many times it came before in its text)."""
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)).astype(np.uint64)
    key = h ^ mix(doc + _U(1))
    order = np.argsort(key, kind="stable")
    own = key[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = own[1:] != own[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    nth = np.empty(len(own), dtype=np.uint64)
    nth[order] = (np.arange(len(own)) - start).astype(np.uint64)
    return np.where(nth > 0, mix(h + nth * _U(0x9E3779B97F4A7C15)), h)


class Idf:
    """Weights below 1 of the shingles in more than SHARE of the documents."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_docs: int):
        order = np.argsort(hashes)
        self.hash = hashes[order]
        share = np.minimum(1.0, counts[order] / max(1, n_docs))
        self.weight = (1 - (1 - LOWEST) * np.log(share / SHARE) / np.log(1 / SHARE)).astype(np.float32)

    def weights(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=np.float32)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            hit = self.hash[at] == h
            out[hit] = self.weight[at[hit]]
        return out


def document_frequencies(docs: DataFrame) -> Idf:
    """Exact document frequencies of the shingles in more than SHARE of the rows of docs(text)."""
    n_docs = docs.count()
    texts = docs.select("text")

    def counted(candidates) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            only = candidates.value if candidates is not None and not isinstance(candidates, str) else None
            held: list[np.ndarray] = []
            size = n = 0

            def flush() -> Iterator[pa.RecordBatch]:
                h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                under = -(-n // 64) - 1  # a shingle seen no more often here can still be frequent elsewhere
                if candidates is None:
                    own = c > under
                    h, c = np.append(h[own], _U(0)), np.append(c[own], 0)  # the last row stands for the chunk
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(np.full(len(h), under))], names=["h", "n", "under"])

            for b in slices(batches, "text"):
                h, ptr = shingles(b.column(0))
                if only is not None:
                    at = np.minimum(np.searchsorted(only, h), len(only) - 1)
                    keep = only[at] == h
                    ptr = np.concatenate([[0], np.cumsum(keep)])[ptr]
                    h = h[keep]
                doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)).astype(np.uint64)
                _, first = np.unique(h ^ mix(doc + _U(1)), return_index=True)
                held.append(h[first])
                size, n = size + len(first), n + b.num_rows
                if size > CHUNK:
                    yield from flush()
                    held, size, n = [], 0, 0
            if n:
                yield from flush()

        return texts.mapInArrow(returning(run), "h long, n long, under long")

    parts = saved(counted(None))
    base = parts.where("n = 0").agg(F.sum("under")).first()[0] or 0
    maybe = parts.where("n > 0").groupBy("h").agg(F.sum(F.col("n") - F.col("under")).alias("over")).where(F.col("over") + base > n_docs * SHARE).select("h")
    maybe = saved(maybe)
    n_maybe = maybe.count()
    if not n_maybe:
        return Idf(np.zeros(0, np.uint64), np.zeros(0), n_docs)
    if n_maybe <= MOST_CANDIDATES:
        own = np.sort(np.asarray(maybe.toArrow().column(0).combine_chunks()).view(np.uint64))
        exact = counted(docs.sparkSession.sparkContext.broadcast(own))
    else:
        exact = counted("all")
    rows = exact.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > n_docs * SHARE).collect()  # 64 times the mean text at most
    return Idf(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64), np.array([r[1] for r in rows], dtype=float), n_docs)


def samples(e: np.ndarray, w: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """(SAMPLES, texts) 32-bit hashes of the sampled (element, level), for texts with elements."""
    lo, hi = (e & _U(0xFFFFFFFF)).astype(np.uint32), (e >> _U(32)).astype(np.uint32)
    odd = np.flatnonzero(w != 1)
    log_w = np.log(w[odd])
    out = np.empty((SAMPLES, len(ptr) - 1), dtype=np.uint32)
    for k in range(SAMPLES):
        x = lo * _SALT[k, 0]
        x ^= hi * _SALT[k, 1]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        x *= np.uint32(0x297A2D39)
        x ^= x >> np.uint32(15)
        y = x * np.uint32(0x9E3779B1)
        j = x & np.uint32(0xFFF)
        log_a = _LOG_C[y >> np.uint32(12)] + _UNIT[j]
        if len(odd):
            r, beta = _R[j[odd]], _BETA[j[odd]]
            t = np.floor(log_w / r + beta)
            log_a[odd] = _LOG_C[y[odd] >> np.uint32(12)] - r * (t - beta + 1)
            x[odd] += t.astype(np.int64).astype(np.uint32) * np.uint32(0x85EBCA6B)
        log_a += np.float32(128)  # positive floats sort as their bits do
        key = (log_a.view(np.uint32).astype(np.uint64) << _U(32)) | x
        out[k] = (np.minimum.reduceat(key, ptr[:-1]) & _U(0xFFFFFFFF)).astype(np.uint32)
    return out


_SIGS = [f"s{i}" for i in range(SAMPLES // 8)]
_ODD = [f"o{i}" for i in range(16)]
_COLUMNS = ["total", *_SIGS, *_ODD]
_SIGNATURE = "doc_id long, cls binary, total double, " + ", ".join(f"{s} long" for s in _SIGS + _ODD) + ", bands array<long>"


def signatures(docs: DataFrame, idf: Idf) -> DataFrame:
    """For every row: its class (a hash of the text), total weight, a byte of each sample in seven numbers, the parities of its
    elements of weight 1 over 512 bits and of the others over 512 more in sixteen numbers, and its buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for b in slices(batches, "text", 1 << 20):
            h, ptr = shingles(b.column(2))
            w = idf.weights(h)
            has = np.flatnonzero(np.diff(ptr))
            sig = np.zeros((len(_SIGS), b.num_rows), dtype=np.uint64)
            bands = np.zeros((BANDS, len(has)), dtype=np.uint64)
            odd = np.zeros((b.num_rows, 1024), dtype=np.uint8)
            if len(has):
                e = elements(h, ptr)
                cell = np.repeat(np.arange(b.num_rows), np.diff(ptr)) * 1024 + (e >> _U(55)).astype(np.int64) + np.where(w == 1, 0, 512)
                odd = (np.bincount(cell, minlength=odd.size) & 1).astype(np.uint8).reshape(odd.shape)
                s = samples(e, w, np.append(ptr[has], ptr[-1]))
                for k in range(SAMPLES):
                    sig[k // 8, has] |= (mix(s[k].astype(np.uint64)) & _U(255)) << _U(8 * (k % 8))
                for k in range(BANDS):
                    key = np.full(len(has), k + 1, dtype=np.uint64)
                    for x in s[k * ROWS : (k + 1) * ROWS]:
                        key = mix(key * _U(0x9E3779B97F4A7C15) + x)
                    bands[k] = key
            parity = np.ascontiguousarray(np.packbits(odd, axis=1).view(np.int64).T)
            off = np.zeros(b.num_rows + 1, dtype=np.int32)
            off[1:] = np.cumsum(np.where(np.diff(ptr) > 0, BANDS, 0))
            lists = pa.ListArray.from_arrays(pa.array(off), pa.array(bands.T.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(per_doc(w, ptr).astype(float)), *[pa.array(x.view(np.int64)) for x in sig], *[pa.array(x) for x in parity], lists], names=["doc_id", "cls", *_COLUMNS, "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_class(), "text").mapInArrow(returning(run), _SIGNATURE)


def text_class() -> Column:
    """128 bits of a digest of the text; of the id and a further byte, where the text is null."""
    null = F.concat(F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")).cast("binary"))), F.lit(b"\x00"))
    return F.when(F.col("text").isNull(), null).otherwise(F.unhex(F.md5(F.col("text").cast("binary")))).alias("cls")


def agreeing(a: str, b: str) -> Column:
    """How many of the samples' bytes are equal in columns a_s0.. and b_s0..: the zero bytes of their xor."""
    total = F.lit(0)
    for s in _SIGS:
        x = F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))
        for k in (1, 2, 4):
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        total = total + 8 - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def prefixed(sigs: DataFrame, p: str) -> DataFrame:
    return sigs.select(F.col("cls").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in _COLUMNS])


def first_meeting() -> Column:
    """Whether the bucket is the least that classes a and b share, so that a pair is formed in one of its buckets only."""
    return F.array_min(F.array_intersect("a_bands", "b_bands")) == F.col("bucket")


def alike() -> Column:
    """Whether classes a and b can reach the similarity.

    Their weights and samples must allow it, and their parities: every element that only one of them has flips one bit, so no
    more bits differ than there are such elements, each of which weighs 1 or at least LOWEST; at the similarity they weigh
    (1 - s) / (1 + s) of both texts at most.
    """
    differ = F.lit(0)
    for k, o in enumerate(_ODD):
        bits = F.bit_count(F.col(f"a_{o}").bitwiseXOR(F.col(f"b_{o}")))
        differ = differ + (bits if k < 8 else bits * LOWEST)
    near = differ <= (F.col("a_total") + F.col("b_total")) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6
    return (F.least("a_total", "b_total") >= SIMILARITY * F.greatest("a_total", "b_total")) & (agreeing("a", "b") >= LEAST_AGREEING) & near


def verified(docs: DataFrame, pairs: DataFrame, idf: Idf) -> DataFrame:
    """The pairs (a, b) of classes with a weighted Jaccard similarity of at least SIMILARITY."""
    pairs = saved(pairs.select("a", "b").distinct())
    if not pairs.count():
        return pairs
    need = saved(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct())
    texts = saved(docs.select(text_class(), "text").join(small(need), "cls", "left_semi").groupBy("cls").agg(F.first("text").alias("text")))
    both = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for b in slices(batches, "ta", 1 << 21):
            (ha, pa_), (hb, pb) = shingles(b.column(2)), shingles(b.column(3))
            ka, kb = (elements(h, p) ^ mix(np.repeat(np.arange(b.num_rows), np.diff(p)).astype(np.uint64) + _U(1)) for h, p in ((ha, pa_), (hb, pb)))
            wa = idf.weights(ha)
            common = per_doc(np.where(np.isin(ka, kb), wa, 0).astype(float), pa_)
            union = per_doc(wa.astype(float), pa_) + per_doc(idf.weights(hb).astype(float), pb) - common
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(common >= SIMILARITY * union - 1e-9))

    return saved(both.select("a", "b", "ta", "tb").mapInArrow(returning(run), "a binary, b binary"))


def near_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, cls, class_id, n_links) for every row of docs(doc_id, text): n_links counts the links of its text that were
    verified to form the classes: those to leads of buckets, and those between components."""
    docs = docs.select("doc_id", "text")
    idf = document_frequencies(docs)
    rows = saved(signatures(docs, idf))
    own = [F.first(c).alias(c) for c in [*_COLUMNS, "bands"]]
    classes = saved(rows.groupBy("cls").agg(F.min("doc_id").alias("first"), *own))
    sigs = classes.drop("first")

    near = saved(led_buckets(classes.select("cls", F.explode("bands").alias("bucket"))))
    stars = near.where("lead <> cls").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    light = sigs.drop("bands")
    stars = stars.join(prefixed(light, "a"), "a").join(prefixed(light, "b"), "b").where(alike())
    links = verified(docs, stars, idf)
    comp = components(links, "a", "b")

    member = saved(near.select("bucket", "cls").join(small(comp.withColumnRenamed("id", "cls")), "cls", "left").withColumn("comp", F.coalesce("comp", "cls")))
    mixed = member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    open_ = saved(member.join(mixed, "bucket").join(sigs, "cls"))
    left, right = (open_.select("bucket", F.col("cls").alias(p), F.col("comp").alias(f"{p}_comp"), *[F.col(c).alias(f"{p}_{c}") for c in [*_COLUMNS, "bands"]]) for p in ("a", "b"))
    cross = left.join(right, "bucket").where("a < b and a_comp <> b_comp").where(alike()).where(first_meeting()).drop("bucket")
    links = links.unionByName(verified(docs, cross, idf))
    comp = components(links, "a", "b").withColumnRenamed("id", "cls")
    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls")))
    degree = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    named = classes.select("cls", "first").join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    best = named.groupBy("comp").agg(F.min("first").alias("class_id"))
    named = named.join(best, "comp").join(degree, "cls", "left").select("cls", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.select("doc_id", "cls").join(named, "cls")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_links) for every row."""
    return near_classes(docs).select("doc_id", "class_id", "n_links")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest doc_id, with its columns unchanged; of repeated rows one stays too."""
    own, cls, least = unused(docs.columns, "_own", "_cls", "_keep")
    keep = near_classes(docs.select("doc_id", "text")).where("doc_id <=> class_id").groupBy("cls").agg(F.min("doc_id").alias("least")).toDF(cls, least)
    rows = docs.select("*", text_class().alias(own))
    kept = rows.join(keep, (F.col(own) == F.col(cls)) & F.col("doc_id").cast("long").eqNullSafe(F.col(least)))
    return kept.dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in docs.columns])
