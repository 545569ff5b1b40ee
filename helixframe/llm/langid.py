"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased and everything but letters becomes a space; 1- to 3-grams of code points are hashed into buckets.
The weights come from follow-the-regularised-leader (proximal) with elastic-net penalties, which leaves most of them
zero, and a temperature is fitted on held-out rows so that the score is a calibrated probability.

Defined results: `und` with score 0 for a null text, one without a letter, or when nothing could be learned; ties go to the
language that comes first in alphabetical order; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import slices
from .training import crc_remainder, with_room

BITS = 15
MAX_TRAIN_ROWS = 4000
ORDERS = (1, 2, 3)

_LETTER: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    return _LETTER


def char_grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For each n: (bucket of each n-gram, first of each text, end of each text); and which texts have a letter."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], dtype=np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[code]
    total = np.concatenate([[0], np.cumsum(letter)])
    code = np.where(letter, code, np.uint32(32))
    out = []
    for n in ORDERS:
        m = max(0, len(code) - n + 1)
        g = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for j in range(n):
            g ^= code[j : j + m]
            g *= np.uint32(0x01000193)
            g ^= g >> np.uint32(15)
        g = (g * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        out.append((g.astype(np.int32), np.minimum(off[:-1], m), np.minimum(np.maximum(off[:-1], off[1:] - n + 1), m)))
    return out, total[off[1:]] > total[off[:-1]]


class LanguageModel:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.table, self.bias, self.temperature = langs, table, bias, temperature

    def logits(self, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_docs: int) -> np.ndarray:
        """table already holds idf times weight, so a text's logit is the mean over its n-grams."""
        out = np.repeat(self.bias[None, :], n_docs, axis=0)
        for idx, a, z in grams:
            for k in range(len(self.langs)):
                total = np.zeros(len(idx) + 1)
                np.cumsum(self.table[k][idx], out=total[1:])
                out[:, k] += (total[z] - total[a]) / np.maximum(1, z - a)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, lettered = char_grams([t or "" for t in texts])
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        z = self.logits(grams, len(texts)) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.langs[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)], np.where(lettered, p.max(axis=1), 0.0)


def fit(sample: list[tuple[str, str]], epochs: int = 4, batch: int = 32, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-5) -> LanguageModel:
    """FTRL-proximal over mini-batches of TF-IDF rows; every fifth row only sets the temperature."""
    langs = sorted({lang for _, lang in sample})
    if not langs:
        return LanguageModel([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), 1.0)
    width = 1 << BITS
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    df = np.zeros(width)
    for lo in range(0, len(sample), 64):
        grams, _ = char_grams([t for t, _ in sample[lo : lo + 64]])
        for d in range(len(grams[0][1])):
            tf = np.zeros(width)
            for idx, a, z in grams:
                tf += np.bincount(idx[a[d] : z[d]], minlength=width) / max(1, z[d] - a[d])
            own = np.flatnonzero(tf)
            df[own] += 1
            rows.append((own, tf[own]))
    idf = np.log((len(sample) + 1) / (df + 1)) + 1
    y = np.array([langs.index(lang) for _, lang in sample])
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < len(langs):
        held[:] = False
    order = np.flatnonzero(~held)
    k = len(langs)
    z, n, w = np.zeros((width, k)), np.zeros((width, k)), np.zeros((width, k))
    bias = np.log((np.bincount(y, minlength=k) + 1) / (len(y) + k))
    bias -= bias.max()
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        for group in np.array_split(draw.permutation(order), max(1, len(order) // batch)):
            idx = np.concatenate([rows[i][0] for i in group])
            val = np.concatenate([rows[i][1] * idf[rows[i][0]] for i in group])
            row = np.repeat(np.arange(len(group)), [len(rows[i][0]) for i in group])
            logit = np.stack([bias[c] + np.bincount(row, val * w[idx, c], minlength=len(group)) for c in range(k)], axis=1)
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(group)), y[group]] -= 1
            used = np.unique(idx)
            for c in range(k):
                g = np.bincount(idx, val * p[row, c], minlength=width)[used] / len(group)
                sigma = (np.sqrt(n[used, c] + g * g) - np.sqrt(n[used, c])) / alpha
                z[used, c] += g - sigma * w[used, c]
                n[used, c] += g * g
                zc = z[used, c]
                w[used, c] = np.where(np.abs(zc) <= l1, 0.0, -(zc - np.sign(zc) * l1) / ((beta * 1e-3 + np.sqrt(n[used, c])) / alpha + l2))
    model = LanguageModel(langs, (w * idf[:, None]).T.astype(np.float32).copy(), bias, 1.0)
    calm = np.flatnonzero(held) if held.any() else order
    logit = np.stack([np.array([bias[c] + (rows[i][1] * idf[rows[i][0]] * w[rows[i][0], c]).sum() for i in calm]) for c in range(k)], axis=1)

    def loss(t: float) -> float:
        q = logit / t
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(calm)), y[calm]]).mean())

    model.temperature = min(np.exp(np.linspace(-2, 2, 81)), key=loss)
    return model


def training_sample(docs: DataFrame, max_rows: int) -> list[tuple[str, str]]:
    """At most max_rows (text, lang) whose crc32(doc_id) mod 3 is not 1: the smallest hashes of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text", F.col("lang").cast("string").alias("_lang")).where("text is not null and _lang is not null and _id is not null")
    rows = rows.where(crc_remainder("_id", 3) != 1)
    drawn = rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # ids first: only they are sorted
    return with_room(rows.join(F.broadcast(drawn.distinct()), "_id"), "_lang", max_rows)


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The predicted language of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in slices(batches, "text", 1 << 21):
            pred, p = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(p, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Fit on docs(doc_id, text, lang), at most max_rows of the rows outside the held-out fold, and predict every row."""
    return identify(docs, fit(training_sample(docs, max_rows)))
