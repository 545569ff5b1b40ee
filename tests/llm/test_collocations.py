"""Collocations against a plain count over pieces."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from helixframe.llm import collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def plain(rows, least, longest, top):
    out = []
    for lang in {"und" if r[2] is None else r[2] for r in rows}:
        f, n = Counter(), 0
        for r in rows:
            if ("und" if r[2] is None else r[2]) == lang and r[1]:
                for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), r[1])):
                    w = re.findall("[^ \t]+", piece)
                    n += len(w)
                    f.update(" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        f = {p: c for p, c in f.items() if c >= least}
        found = []
        for p, a in f.items():
            w = p.split(" ")
            if len(w) == 1 or any(100 * c >= 50 * a and f" {p} " in f" {q} " for q, c in f.items() if q.count(" ") > p.count(" ")):
                continue
            cuts = [(1000000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found.append((-score, -a, p.encode(), p, a, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out += [(lang, i + 1, p, a, left, right, n, -s) for i, (s, _, _, p, a, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(draw, n):
    words = ["Alpha", "beta", "GAMMA", "d\xe9lta", "Épsilon", "zeta", "x\xa0y", "eta-", "日本", "\x00", "it's"]
    rows = []
    for i in range(n):
        t = "".join(draw.choice(words) + draw.choice([" "] * 9 + [", ", ".", "\n", "\t ", "\x0b", "  ", "?! "]) for _ in range(draw.randrange(40)))
        rows.append((i, t, draw.choice(["en", "en", "en", "de", None, "und", ""]), "clash", i))
    return [*rows, (None, None, "en", None, None), (5, "", "de", None, 1), (6, " .,; ", "de", None, 1), *rows[:3], (7, "alpha beta " * 3000, "en", None, 1)]


@pytest.mark.parametrize("longest, block", [(3, 10**6), (4, 200), (2, 200)])
def test_equal_to_plain_counts(spark, monkeypatch, longest, block):
    monkeypatch.setattr(collocations, "BLOCK_WORDS", block)
    rows = rows_of(random.Random(longest), 160)
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA), 5, longest, 40)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 5, longest, 40)


def test_tally_keeps_no_second_copy_of_a_slice():
    """The memory of a slice's task is bounded by a few times the slice, which holds at most about SLICE_GROUPS groups."""
    draw, n, blocks = np.random.default_rng(1), 20_000, 25
    prefix, word, counts = draw.integers(0, 500, (blocks, n)), draw.integers(0, 500, (blocks, n)), draw.integers(1, 4, (blocks, n), dtype=np.int32)
    stored = np.diff(prefix, prepend=0), word, counts
    columns = [pa.array([3] * blocks), pa.array(range(blocks)), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in stored)]
    part = pa.table(columns, names=["slice", "block", "prefix", "word", "counts"])
    tracemalloc.start()
    out = collocations.tally(part, 6, True).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    f = Counter()
    for p, w, c in zip(prefix.ravel().tolist(), word.ravel().tolist(), counts.ravel().tolist(), strict=True):
        f[p, w] += c
    assert {(r["prefix"], r["word"]): r["f"] for r in out if r["block"] is None} == {k: c for k, c in f.items() if c >= 6}
    known = {r["id"]: (r["prefix"], r["word"]) for r in out if r["block"] is None}
    for r in out:
        if r["block"] is not None:
            ids = np.frombuffer(r["ids"], np.int64).tolist()
            assert all(known[i] == k if i >= 0 else f[k] < 6 for i, k in zip(ids, zip(prefix[r["block"]].tolist(), word[r["block"]].tolist(), strict=True), strict=True))
    assert most < 6 * part.nbytes and collocations.SLICE_GROUPS <= 1_000_000


def test_large_counts_stay_exact(spark):
    phrases = [("en", 1, "a", 3_000_000_019), ("en", 1, "b", 3_000_000_011), ("en", 2, "a b", 3_000_000_007)]
    got = collocations.scored(spark.createDataFrame(phrases, "lang string, words int, phrase string, f long")).collect()
    assert [r.score for r in got] == [1000000 * 3_000_000_007**2 // (3_000_000_019 * 3_000_000_011)]


def test_empty_tables(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1), (2, "one two", "en", "", 1)], SCHEMA)).count() == 0
