"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is a run of letters, lower-cased.  Its input joins a hashed embedding of the word and the mean of the hashed embeddings
of its character 3- and 5-grams, with marks where it begins and ends; all are learned by gradient descent.  A gated recurrent
layer reads the words in both directions, in stretches of CHUNK words that overlap, so that every word has MARGIN words of
context on either side.  Attention pools the states of every window of WINDOW consecutive words, one at each word of the text,
into a logit; prefix sums of the attention weights make each of these overlapping windows one difference.  A document's logit
is that of its worst window.

Training takes three rounds of Adam steps over stretches: first of all toxic documents with attention over the
whole stretch, then of the stretch with the worst window of each toxic document against the worst and random ones of others,
attention over the worst window.  Scores are calibrated on rows that were not learned from by Platt's method.

Defined results: a null text, or one without a letter, scores 0; repeated rows are scored alike; with no labelled row, or
one class only, every text scores 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import platt
from .textscan import Scan, mix, slices
from .training import crc_remainder, labelled_rows, place
from .workers import returning

MAX_TRAIN_ROWS = 4000
WINDOW, CHUNK, MARGIN = 16, 64, 8
WORD_BITS, GRAM_BITS, GRAMS, EMBED, HIDDEN = 17, 16, (3, 5), 8, 16
#: Characters scanned at once in training, bytes in scoring, and distinct words whose grams are gathered at once.
BLOCK, PART, GATHERED = 1 << 20, 1 << 19, 1 << 14
_U = np.uint64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def words_of(texts: pa.Array) -> Scan:
    return Scan(texts, _LETTER, _FOLD)


class Words(NamedTuple):
    """Buckets of words and of their grams, with the first gram of every word."""

    bucket: np.ndarray
    gram: np.ndarray
    ptr: np.ndarray

    def take(self, used: np.ndarray) -> "Words":
        own = np.concatenate([[0], np.cumsum(np.diff(self.ptr)[used])])
        return Words(self.bucket[used], self.gram[np.repeat(self.ptr[used] - own[:-1], np.diff(own)) + np.arange(own[-1])], own)


def distinct_words(scan: Scan) -> tuple[np.ndarray, Words, np.ndarray]:
    """(hashes of the distinct words of a scan, their buckets and grams, which of them each word of the scan is)."""
    key, first, inverse = np.unique(scan.words, return_index=True, return_inverse=True)
    a, z = scan.starts[first], scan.ends[first]
    size = z - a + 2  # a mark before and one after
    total = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(total[-1]) - np.repeat(total[:-1], size)
    left = np.repeat(size, size) - place
    inner = (place > 0) & (left > 1)
    b = np.where(inner, scan.buf[np.where(inner, np.repeat(a, size) + place - 1, 0)] if len(scan.buf) else 0, 1).astype(np.uint64)
    count = sum(np.maximum(0, size - n + 1) for n in GRAMS)
    ptr = np.concatenate([[0], np.cumsum(count)])
    gram = np.empty(ptr[-1], dtype=np.int32)
    before = ptr[:-1].copy()
    for n in GRAMS:
        g = b.copy()
        for j in range(1, n):
            g[: len(g) - j] |= b[j:] << _U(8 * j)
        ok = left >= n
        gram[np.repeat(before, size)[ok] + place[ok]] = (mix(g[ok] + _U(n)) >> _U(64 - GRAM_BITS)).astype(np.int32)
        before += np.maximum(0, size - n + 1)
    return key, Words((key >> _U(64 - WORD_BITS)).astype(np.int32), gram, ptr), inverse.astype(np.int32)


def read(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """(distinct words, which of them stands at each place, first place of each text), scanned in blocks of BLOCK characters."""
    keys, blocks, index, sizes, lo = [], [], [], [], 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= BLOCK):
            n += len(texts[hi])
            hi += 1
        scan = words_of(pa.array(texts[lo:hi], pa.string()))
        key, words, at = distinct_words(scan)
        index.append(at + sum(map(len, keys)))
        keys.append(key)
        blocks.append(words)
        sizes.append(np.diff(scan.ptr))
        lo = hi
    if not keys:
        return Words(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)), np.zeros(0, np.int64), np.zeros(1, np.int64)
    shift = np.cumsum([0, *(len(w.gram) for w in blocks)])
    every = Words(np.concatenate([w.bucket for w in blocks]), np.concatenate([w.gram for w in blocks]), np.concatenate([[0], *(w.ptr[1:] + s for w, s in zip(blocks, shift, strict=False))]))
    _, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return every.take(first), inverse.astype(np.int32)[np.concatenate(index)], np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class Chunks(NamedTuple):
    """Stretches of texts: first place, length, and the places lo..hi whose states are taken from them."""

    first: np.ndarray
    size: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray


def chunks_of(ptr: np.ndarray) -> Chunks:
    n, step = np.diff(ptr), CHUNK - 2 * MARGIN
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - CHUNK) // step)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = ptr[doc] + k * step
    size = np.minimum(CHUNK, ptr[doc + 1] - first)
    return Chunks(first, size, np.where(k == 0, first, first + MARGIN), np.where(k == count[doc] - 1, first + size, first + CHUNK - MARGIN), doc)


def window_logits(e: np.ndarray, y: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, logit) of every window of WINDOW places of a text; of the whole text, if it is shorter."""
    weight = np.exp(np.clip(e.astype(np.float64), -20, 20))
    total = np.zeros((2, len(e) + 1))
    np.cumsum(weight, out=total[0, 1:])
    np.cumsum(weight * y, out=total[1, 1:])
    end = np.repeat(ptr[1:], np.diff(ptr))
    begin = np.repeat(ptr[:-1], np.diff(ptr))
    at = np.arange(len(e))
    at = at[(at + WINDOW <= end) | (at == begin)]
    stop = np.minimum(at + WINDOW, end[at])
    return at, (total[1, stop] - total[1, at]) / (total[0, stop] - total[0, at])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_gru(x: np.ndarray, mask: np.ndarray | None, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, B, H) for projected inputs (T, B, 3H); a masked step keeps the state."""
    steps, n, _ = x.shape
    hid = u.shape[0]
    h = np.zeros((n, hid), dtype=x.dtype)
    out = np.empty((steps, n, hid), dtype=x.dtype)
    for t in range(steps):
        hu = h @ u
        rz = sigmoid(x[t, :, : 2 * hid] + hu[:, : 2 * hid])
        r, z = rz[:, :hid], rz[:, hid:]
        c = np.tanh(x[t, :, 2 * hid :] + r * hu[:, 2 * hid :])
        new = c + z * (h - c)
        m = None if mask is None else mask[t][:, None]
        if keep is not None:
            keep.append((h, r, z, c, hu[:, 2 * hid :], m))
        h = new if m is None else np.where(m, new, h)
        out[t] = h
    return out


def back_gru(keep: list, d_out: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u."""
    steps, n, hid = d_out.shape
    dx, du, dh = np.empty((steps, n, 3 * hid), dtype=d_out.dtype), np.zeros_like(u), np.zeros((n, hid), dtype=d_out.dtype)
    for t in range(steps - 1, -1, -1):
        h, r, z, c, hc, m = keep[t]
        dh = dh + d_out[t]
        dn = dh * m
        dc = dn * (1 - z) * (1 - c * c)
        dz = dn * (h - c) * z * (1 - z)
        dr = dc * hc * r * (1 - r)
        dx[t] = np.concatenate([dr, dz, dc], axis=1)
        dhu = np.concatenate([dr, dz, dc * r], axis=1)
        du += h.T @ dhu
        dh = dh * ~m + dn * z + dhu @ u.T
    return dx, du


class ToxicityModel:
    """Parameters p, and the calibration of a document's logit."""

    def __init__(self, seed: int = 5):
        draw = np.random.default_rng(seed)
        d, h = 2 * EMBED, HIDDEN
        shape = {"word": (1 << WORD_BITS, EMBED), "gram": (1 << GRAM_BITS, EMBED), "wf": (d, 3 * h), "wb": (d, 3 * h), "bf": (3 * h,), "bb": (3 * h,), "uf": (h, 3 * h), "ub": (h, 3 * h), "att": (2 * h, h), "v": (h,), "out": (2 * h,), "o": (1,)}
        size = {"word": 0.05, "gram": 0.05, "bf": 0, "bb": 0, "o": 0}
        self.p = {k: (draw.standard_normal(s) * size.get(k, 0.35)).astype(np.float32) for k, s in shape.items()}
        self.scale, self.shift, self.trained = 1.0, 0.0, False

    def inputs(self, words: Words) -> np.ndarray:
        """Word embedding and mean gram embedding of every word."""
        size = np.diff(words.ptr)
        out = np.zeros((len(size), 2 * EMBED), dtype=np.float32)
        out[:, :EMBED] = self.p["word"][words.bucket]
        for lo in range(0, len(size), GATHERED):
            ptr = words.ptr[lo : lo + GATHERED + 1]
            has = np.flatnonzero(np.diff(ptr))
            if len(has):
                out[lo + has, EMBED:] = np.add.reduceat(self.p["gram"][words.gram[ptr[0] : ptr[-1]]], ptr[has] - ptr[0], axis=0) / size[lo + has, None]
        return out

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]

    def windows(self, x: tuple[np.ndarray, np.ndarray], index: np.ndarray, ptr: np.ndarray, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """(first place, logit) of every window; x holds the projected inputs of the distinct words."""
        p, c, (xf, xb) = self.p, chunks_of(ptr), x
        e, y = np.empty(len(index), dtype=np.float32), np.empty(len(index), dtype=np.float32)
        order = np.argsort(c.size, kind="stable")
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            steps = int(c.size[own[-1]])
            at = c.first[own] + np.arange(steps)[:, None]
            even = c.size[own[0]] == steps
            mask = None if even else np.arange(steps)[:, None] < c.size[own]
            i = index[at if even else np.where(mask, at, c.first[own])]
            back = None if even else mask[::-1]
            hs = np.concatenate([run_gru(xf[i], mask, p["uf"]), run_gru(xb[i[::-1]], back, p["ub"])[::-1]], axis=2)
            take = (at >= c.lo[own]) & (at < c.hi[own])
            e[at[take]] = (np.tanh(hs @ p["att"]) @ p["v"])[take]
            y[at[take]] = (hs @ p["out"])[take]
        first, logits = window_logits(e, y, ptr)
        return first, logits + p["o"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, pooled: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean logistic loss of stretches with inputs x (T, B, D), attention over the places `pooled`; also with respect
        to x."""
        p, (steps, n, _) = self.p, x.shape
        kf: list = []
        kb: list = []
        hf = run_gru(x @ p["wf"] + p["bf"], mask, p["uf"], kf)
        hb = run_gru(x[::-1] @ p["wb"] + p["bb"], mask[::-1], p["ub"], kb)[::-1]
        hs = np.concatenate([hf, hb], axis=2)
        a = np.tanh(hs @ p["att"])
        e = np.where(pooled, a @ p["v"], np.float32(-1e9))
        alpha = np.exp(e - e.max(axis=0))
        alpha /= alpha.sum(axis=0)
        s = hs @ p["out"]
        logit = (alpha * s).sum(axis=0) + p["o"]
        d = (sigmoid(logit) - y) / n
        g = {"o": d.sum(keepdims=True)}
        ds = alpha * d
        g["out"] = np.einsum("tb,tbh->h", ds, hs)
        de = alpha * d * (s - (alpha * s).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", de, a)
        da = de[..., None] * p["v"] * (1 - a * a)
        flat = lambda z: z.reshape(steps * n, -1)
        g["att"] = flat(hs).T @ flat(da)
        dhs = ds[..., None] * p["out"] + da @ p["att"].T
        dxf, g["uf"] = back_gru(kf, dhs[..., :HIDDEN], p["uf"])
        dxb, g["ub"] = back_gru(kb, dhs[::-1, :, HIDDEN:], p["ub"])
        dxb = dxb[::-1]
        g["wf"], g["wb"] = flat(x).T @ flat(dxf), flat(x).T @ flat(dxb)
        g["bf"], g["bb"] = dxf.sum(axis=(0, 1)), dxb.sum(axis=(0, 1))
        return g, dxf @ p["wf"].T + dxb @ p["wb"].T

    def doc_logits(self, texts: pa.Array) -> np.ndarray:
        """The worst window's logit of every text; -inf without words."""
        scan = words_of(texts)
        if not len(scan.starts):
            return np.full(scan.n_docs, -np.inf)
        _, words, index = distinct_words(scan)
        return worst(self.windows(self.projected(self.inputs(words)), index, scan.ptr)[1], scan.ptr)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        z = self.doc_logits(texts)
        return np.where(np.isfinite(z), sigmoid(np.clip(self.scale * np.where(np.isfinite(z), z, 0) + self.shift, -40, 40)), 0.0)


def worst(logits: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The largest of each text's window logits."""
    n = np.diff(ptr)
    count = np.where(n > 0, np.maximum(1, n - WINDOW + 1), 0)
    out, has = np.full(len(n), -np.inf), np.flatnonzero(count)
    if len(has):
        out[has] = np.maximum.reduceat(logits, (np.cumsum(count) - count)[has])
    return out


def worst_windows(model: ToxicityModel, words: Words, index: np.ndarray, ptr: np.ndarray, c: Chunks, texts: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit of the worst window of every stretch, its first place, logit of every text), by blocks of texts."""
    top, lo, logit = np.full(len(c.first), -np.inf), c.first.copy(), np.full(len(ptr) - 1, -np.inf)
    x = model.projected(model.inputs(words))
    for k in range(0, len(ptr) - 1, texts):
        own = ptr[k : k + texts + 1]
        start, z = model.windows(x, index[own[0] : own[-1]], own - own[0])
        if not len(start):
            continue
        logit[k : k + texts] = worst(z, own - own[0])
        start = start + own[0]
        home = np.searchsorted(c.first, start, side="right") - 1
        order = np.lexsort((z, home))
        last = order[np.append(np.diff(home[order]) != 0, True)]
        top[home[last]], lo[home[last]] = z[last], start[last]
    return top, lo, logit


def fit(sample: list[tuple[str, int]], rounds: tuple[int, ...] = (220, 160, 120), batch: int = 96, rate: float = 0.01, table_rate: float = 0.6, decay: float = 1e-4) -> ToxicityModel:
    """Train on (text, label); every fifth row only calibrates."""
    model = ToxicityModel()
    label = np.array([t[1] for t in sample], dtype=np.float32)
    if len(label) == 0 or label.min() == label.max():
        return model
    words, index, ptr = read([t[0] for t in sample])
    held = np.arange(len(label)) % 5 == 4
    if not (label[~held] == 1).any() or not (label[~held] == 0).any():
        held[:] = False
    c = chunks_of(ptr)
    toxic, calm = (np.flatnonzero((label[c.doc] == k) & ~held[c.doc]) for k in (1, 0))
    draw, moment, var, t = np.random.default_rng(11), {}, {}, 0
    chosen, hard = toxic, calm
    lo, hi = c.first, c.first + c.size  # where attention pools
    if not len(toxic) or not len(calm):
        return model
    for steps in rounds:
        for _ in range(steps):
            t += 1
            own = np.concatenate([draw.choice(chosen, batch // 3), draw.choice(hard, batch // 3), draw.choice(calm, batch // 3)])
            at = c.first[own] + np.arange(int(c.size[own].max()))[:, None]
            mask = at < c.first[own] + c.size[own]
            pooled = (at >= lo[own]) & (at < hi[own])
            used, place = np.unique(index[np.where(mask, at, c.first[own])], return_inverse=True)
            own_words = words.take(used)
            g, dx = model.gradients(model.inputs(own_words)[place.reshape(at.shape)], mask, pooled, label[c.doc[own]])
            du = np.stack([np.bincount(place.ravel(), dx[..., k].ravel(), minlength=len(used)) for k in range(2 * EMBED)], axis=1).astype(np.float32)
            # the tables take plain gradient steps: a word seen once moves little, one that recurs moves far
            size = np.diff(own_words.ptr)
            np.add.at(model.p["word"], own_words.bucket, -table_rate * du[:, :EMBED])
            np.add.at(model.p["gram"], own_words.gram, -table_rate * np.repeat(du[:, EMBED:], size, axis=0))
            for k, grad in g.items():
                grad = grad + decay * model.p[k]
                moment[k] = 0.9 * moment.get(k, 0) + 0.1 * grad
                var[k] = 0.99 * var.get(k, 0) + 0.01 * grad * grad
                model.p[k] = (model.p[k] - rate * moment[k] / (1 - 0.9**t) / (np.sqrt(var[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
        top, lo, logit = worst_windows(model, words, index, ptr, c)
        hi = np.minimum(lo + WINDOW, c.first + c.size)
        order = toxic[np.lexsort((top[toxic], c.doc[toxic]))]
        chosen = order[np.append(np.diff(c.doc[order]) != 0, True)]
        hard = calm[np.argsort(-top[calm], kind="stable")[: 4 * len(chosen) + batch]]
    own = np.isfinite(logit) & (held if (label[held] == 1).any() and (label[held] == 0).any() else True)
    model.scale, model.shift = platt(logit[own].astype(float), label[own].astype(float))
    model.trained = True
    return model


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every row of docs(doc_id, text) with its score; labels, language, source and id are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text", PART):
            p = model.scores(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(returning(run), SCHEMA)


def fit_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a sample's rows (text, label), pickled."""
    sample = [pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(sample))], pa.binary())], names=["model"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    """Fit on labels(doc_id, toxic) outside the held-out fold, at most max_rows of them.

    The sample is bounded and fits in a task; the driver gets the model alone, neither texts nor the arrays of the fit.
    """
    sample = labelled_rows(docs, labels, "toxic", max_rows, folds=5).repartition(1).sortWithinPartitions(*place("_y"))
    made = sample.select("text", "_y").mapInArrow(returning(fit_in_task), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else ToxicityModel()


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    return score(docs, train(docs, labels, max_rows))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows that the model does not reject, with their columns unchanged."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text", PART):
            yield b.filter(pa.array(model.scores(b.column(at)) < 0.5))

    return docs.mapInArrow(returning(run), docs.schema)
