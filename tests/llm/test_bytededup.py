"""Byte substring dedup against brute force, and the suffix array against sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import bytededup

SCHEMA = "doc_id long, text string, row long, start string"


def plain(rows, window):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (doc, *_), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        gone = gone[:-1]
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_of(draw):
    word = lambda: "".join(draw.choice("abcdefgh é日") for _ in range(draw.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, exact = prose(120), prose(200)
    texts = [prose(draw.randrange(150)) for _ in range(12)]
    texts += [prose(20) + shared + prose(30) for _ in range(4)] + [shared[:-1] + "x"]
    texts += [exact, exact, exact[:500] + "!" + exact[501:], exact[3:], exact[: len(exact) // 2]]
    texts += ["ab" * 900, "a" * 401, "a" * 400, "a" * 399, "b" * 400, "xyz" * 50 + prose(90) + "xyz" * 150, "", None, prose(60) * 2]
    rows = [(i, t, 7, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[3], None, None), (None, None, None, None), (99, prose(3000), 1, ""), (100, prose(3000), 1, "")]


@pytest.mark.parametrize("seed, hot", [(1, 4096), (2, 1)])
def test_equal_to_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(bytededup, "HOT", hot)
    rows = rows_of(random.Random(seed))
    got = bytededup.remove_repeats(spark.createDataFrame(rows, SCHEMA), digest=True)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, bytededup.WINDOW)


def test_kept_bytes_and_empty_tables(spark):
    got = bytededup.remove_repeats(spark.createDataFrame([(1, "é" * 300, 1, ""), (2, "é" * 200, 1, "")], SCHEMA)).collect()
    assert [bytes(r.kept) for r in sorted(got)] == [b"", b""]
    assert bytededup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert bytededup.remove_repeats(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).first().n_bytes == 0


@pytest.mark.parametrize("letters, n", [(2, 300), (3, 700), (200, 900), (1, 120)])
def test_suffix_array_equals_sorting(letters, n):
    draw = np.random.default_rng(n)
    text = np.concatenate([draw.integers(1, letters + 1, n), [0]]).astype(np.uint8)
    text[draw.integers(0, n, n // 50)] = 0
    raw = text.tobytes()
    depth = 16
    got = [raw[i : i + depth] for i in bytededup.suffix_array(text, depth)]
    assert got == sorted(raw[i : i + depth] for i in range(len(raw))) and len(set(bytededup.suffix_array(text, depth).tolist())) == len(raw)
