"""Pairs within an alignment distance: rare grams against all pairs."""

import random

import pytest

from helixframe.functions import distance as D
from helixframe.operators import sequences as O


def mutated(draw, s, k):
    s = list(s)
    for _ in range(k):
        at, kind = draw.randrange(len(s)) if s else 0, draw.randrange(4)
        if kind == 0 and s:
            s[at] = draw.choice("ACGT")
        elif kind == 1 and s:
            del s[at]
        elif kind == 2:
            s.insert(at, draw.choice("ACGT"))
        else:
            s = s[2:] + list(draw.choice(["", "A", "GT"]))
    return "".join(s)


def reads(draw, n, size):
    own = ["".join(draw.choice("ACGT") for _ in range(size if draw.random() < 0.7 else draw.randrange(size))) for _ in range(n // 3)]
    own += [mutated(draw, draw.choice(own), draw.randrange(9)) for _ in range(n - len(own) - 6)]
    return [*own, own[0], own[0], "", "A", "A" * size, "AC" * (size // 2)]


def table(spark, seqs, base=0):
    return spark.createDataFrame([(base + i, s) for i, s in enumerate(seqs)], "seq_id long, seq string")


@pytest.mark.parametrize("seed, size, most, q", [(1, 60, 20, None), (2, 100, 33, None), (3, 80, 40, 5), (4, 40, 100, None), (5, 50, 0, None), (6, 30, 14, 4)])
def test_no_pair_is_lost(spark, seed, size, most, q):
    draw = random.Random(seed)
    a, b = reads(draw, 60, size), reads(draw, 40, size)
    b += [mutated(draw, s, 3) for s in a[:20]]
    flat = [(i, j) for i in range(len(a)) for j in range(len(b))]
    dist = D.alignment_distances([a[i] for i, _ in flat], [b[j] for _, j in flat])
    wanted = {(i, j, d) for (i, j), d in zip(flat, dist.tolist(), strict=True) if d <= most}
    got = [(r.i, r.j, r.dist) for r in D.near_pairs(table(spark, a), table(spark, b), most, q=q).collect()]
    assert len(got) == len(set(got)) and wanted
    assert not [(a[i], b[j], d) for i, j, d in wanted - set(got)]
    assert set(got) == wanted


def test_reads_of_one_length_do_not_all_meet(spark):
    draw = random.Random(7)
    own = ["".join(draw.choice("ACGT") for _ in range(100)) for _ in range(380)]
    own += [mutated(draw, s, 1) for s in own[:20]]
    seqs = table(spark, own)
    assert D.near_candidates(seqs, seqs, 24).count() < 4000  # of 160,000


def test_closest_equals_all_pairs(spark):
    draw = random.Random(8)
    a, b = reads(draw, 40, 50), reads(draw, 25, 50)
    got = {r.query_id: (r.dist, r.seq_id) for r in O.closest(table(spark, a), table(spark, b, 1000)).collect()}
    assert got == {1000 + j: min((D.alignment_distances([t], [s])[0], i) for i, s in enumerate(a)) for j, t in enumerate(b)}
