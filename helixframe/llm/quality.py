"""Quality rules: hashed word and character n-gram logistic regression with calibrated probabilities.

The model reads two families of hashed features: words and word pairs, and byte 3- and 4-grams.  It is trained by Adam on
a bounded sample of labelled rows, calibrated on a held-out quarter of that sample by Platt's method, and scored in Arrow
batches against a fixed threshold.  Base rules (length, repeated words) come first.

Defined results: a null or empty text has no words, fails the base rule and is not kept; repeated rows are scored alike;
with no labelled row, or one class only, the probability is the prior (0.5 if there is none), and the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textscan import Scan, covered, mix, per_doc, slices
from .training import labelled_sample

BITS = 17
MAX_TRAIN_ROWS = 3000
KEEP_AT = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Characters that count as symbols (fixed values of the contract).
SYMBOLS = "#*$%&|<>"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_U = np.uint64


def base_counts(scan: Scan) -> dict[str, np.ndarray]:
    """The counts of the base rules for every text of the scan."""
    buf, off, ptr = scan.buf, scan.off, scan.ptr
    n_words = np.diff(ptr)
    chars = per_doc(scan.inside & ((buf & 0xC0) != 0x80), off)
    symbols = per_doc(_SYMBOL[buf], off)

    breaks = np.flatnonzero(buf == 0x0A)
    starts = np.union1d(off[:-1], breaks + 1)
    starts = starts[starts < len(buf)]
    doc = np.searchsorted(off, starts, side="right") - 1
    ends = np.append(starts[1:], len(buf))
    ends = np.where(np.isin(ends - 1, breaks, assume_unique=False), ends - 1, ends)
    ends = np.maximum(np.minimum(ends, off[doc + 1]), starts)
    worded = np.searchsorted(scan.starts, starts) < np.searchsorted(scan.starts, ends)
    starts, ends, doc = starts[worded], ends[worded], doc[worded]
    key = scan.hash_spans(starts, ends) ^ mix(doc.astype(np.uint64) + _U(1))
    _, first = np.unique(key, return_index=True)
    dup_lines = np.bincount(doc, minlength=scan.n_docs) - np.bincount(doc[first], minlength=scan.n_docs)

    at, h = scan.windows(5)
    wd = scan.word_doc
    _, inverse, count = np.unique(h ^ mix(wd[at].astype(np.uint64) + _U(1)), return_inverse=True, return_counts=True)
    repeated = per_doc(covered(at[count[inverse] > 1], 5, len(scan.starts)), ptr)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated, "base_failed": failed}


def features(scan: Scan) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket of each feature, first feature of each text, end of each text's features), for each family."""
    shift = _U(64 - BITS)
    words = (scan.words >> shift).astype(np.int32)
    ptr = scan.ptr
    pair = np.zeros(max(0, len(scan.words) - 1), dtype=np.uint64)
    if len(pair):
        pair = mix(scan.words[:-1] * _U(3) + scan.words[1:])
    pairs = (pair >> shift).astype(np.int32)
    out = [(words, ptr[:-1], ptr[1:]), (pairs, ptr[:-1], np.maximum(ptr[:-1], ptr[1:] - 1))]
    b = scan.buf.astype(np.uint32)
    for n, salt in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        m = max(0, len(b) - n + 1)
        g = np.zeros(m, dtype=np.uint32)
        for j in range(n):
            g |= b[j : j + m] << np.uint32(8 * j)
        g = (g ^ (g >> np.uint32(15))) * np.uint32(salt)
        g = ((g ^ (g >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
        out.append((g.astype(np.int32), np.minimum(scan.off[:-1], m), np.minimum(np.maximum(scan.off[:-1], scan.off[1:] - n + 1), m)))
    return out


class QualityModel:
    """weights[family] holds a weight a bucket; a text's logit is the sum of the families' mean weights."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.bias, self.scale, self.shift = weights, bias, scale, shift

    def logits(self, scan: Scan) -> np.ndarray:
        out = np.full(scan.n_docs, self.bias)
        for w, (idx, a, z) in zip(self.weights, features(scan), strict=True):
            total = np.zeros(len(idx) + 1)
            np.cumsum(w[idx], out=total[1:])
            out += (total[z] - total[a]) / np.maximum(1, z - a)
        return out

    def probability(self, scan: Scan) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(scan) + self.shift, -40, 40)))


def fit(sample: list[tuple[str, int]], epochs: int = 60, rate: float = 0.6, l2: float = 1e-6) -> QualityModel:
    """Adam over the whole sample; every fourth row calibrates and is not learned from."""
    y = np.array([t[1] for t in sample], dtype=float)
    zero = np.zeros((4, 1 << BITS), dtype=np.float32)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return QualityModel(zero, float(np.log(p / (1 - p))) if len(y) else 0.0)
    parts: list[list] = [[], [], [], []]
    for lo in range(0, len(sample), 64):
        scan = Scan(pa.array([t[0] for t in sample[lo : lo + 64]], pa.string()))
        for f, (idx, a, z) in enumerate(features(scan)):
            for d in range(scan.n_docs):
                own, count = np.unique(idx[a[d] : z[d]], return_counts=True)
                parts[f].append((own, (count / max(1, z[d] - a[d])).astype(np.float32)))
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[~held])) < 2 or not held.any():
        held[:] = False
    idx = [np.concatenate([p[0] for p in part]) for part in parts]
    val = [np.concatenate([p[1] for p in part]) for part in parts]
    row = [np.repeat(np.arange(len(y)), [len(p[0]) for p in part]) for part in parts]
    w, m, v = zero.astype(np.float64), zero.astype(np.float64), zero.astype(np.float64)
    bias, weight = 0.0, np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum())) * ~held
    for step in range(1, epochs + 1):
        z = bias + sum(np.bincount(row[f], val[f] * w[f][idx[f]], minlength=len(y)) for f in range(4))
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        bias -= 0.5 * err.sum()
        for f in range(4):
            g = np.bincount(idx[f], val[f] * err[row[f]], minlength=1 << BITS) + l2 * w[f]
            m[f] = 0.9 * m[f] + 0.1 * g
            v[f] = 0.99 * v[f] + 0.01 * g * g
            w[f] -= rate * (m[f] / (1 - 0.9**step)) / (np.sqrt(v[f] / (1 - 0.99**step)) + 1e-9) * (v[f] > 0)
    z = bias + sum(np.bincount(row[f], val[f] * w[f][idx[f]], minlength=len(y)) for f in range(4))
    own = held if held.any() else np.ones(len(y), dtype=bool)
    a, c = platt(z[own], y[own])
    return QualityModel(w.astype(np.float32), bias, a, c)


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """scale and shift of a logistic fit of y on z, by Newton's method with Platt's smoothed targets and a weak prior at (1, 0)."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        s = p * (1 - p)
        g = np.array([((p - t) * z).sum() + 0.01 * (a - 1), (p - t).sum() + 0.01 * c])
        h = np.array([[(s * z * z).sum() + 0.01, (s * z).sum()], [(s * z).sum(), s.sum() + 0.01]])
        da, dc = np.clip(np.linalg.solve(h, g), -2, 2)
        a, c = max(0.05, a - da), c - dc
        if abs(da) + abs(dc) < 1e-9:
            break
    return float(a), float(c)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality_score double"


def score(docs: DataFrame, model: QualityModel, threshold: float = KEEP_AT) -> DataFrame:
    """The counts, the verdict of the base rules and the model's, for every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text"):
            scan = Scan(b.column(1))
            c = base_counts(scan)
            p = model.probability(scan)
            kept = ~c["base_failed"] & (p >= threshold)
            longs = [pa.array(c[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            yield pa.RecordBatch.from_arrays([b.column(0), *longs, pa.array(c["base_failed"]), pa.array(kept), pa.array(p)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, threshold: float = KEEP_AT) -> DataFrame:
    """Fit on labels(doc_id, quality), at most max_rows of them, and score every document."""
    return score(docs, fit(labelled_sample(docs, labels, "quality", max_rows)), threshold)
