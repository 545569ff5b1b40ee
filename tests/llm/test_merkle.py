"""The Merkle manifest against a plain version: ragged trees, fanouts, nulls, repeated rows, tampering."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from helixframe.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(r, more=0):
    n = None if r[4] is None else r[4] + more
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h("".join(cell(v) for v in (r[0], r[3], r[2], n, r[1])))


def tree(nodes, fanout):
    """(root, a list of (place, others) for each leaf)."""
    paths, level, owner = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, at in enumerate(owner):
            run = level[at // fanout * fanout : at // fanout * fanout + fanout]
            paths[k].append((at % fanout, [x for i, x in enumerate(run) if i != at % fanout]))
        level = [h("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
        owner = [at // fanout for at in owner]
    return level[0], paths


def plain(rows, fanout):
    out, roots = [], []
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in own], fanout)
        roots.append(root)
        out.append((own, paths, root))
    top, crown = tree(roots, fanout)
    return sorted((repr((r[0], leaf(r), p + crown[k], sub, top)) for k, (own, paths, sub) in enumerate(out) for r, p in zip(own, paths, strict=True)))


def some_rows():
    rows = [(i, f"text {i} é" * (i % 5), ("en", "de", None, "", "ünd")[min(i % 9, 4)], None if i % 7 == 0 else f"s{i % 3}", None if i % 11 == 0 else i) for i in range(70)]
    return [*rows, rows[3], rows[3], (None, None, None, None, None), (None, "x", "en", "", 1)]


@pytest.mark.parametrize("fanout, levels", [(2, 1), (3, 1)])
def test_manifest_equals_plain_tree(spark, fanout, levels):
    rows = some_rows()
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout, levels=levels)
    found = sorted(repr((r.doc_id, r.leaf, [(s.at, list(s.others)) for s in r.path], r.subroot, r.root)) for r in got.collect())
    assert found == plain(rows, fanout)
    assert merkle.verify(got).where(~F.col("verified")).count() == 0


def test_tampered_rows_are_told(spark):
    rows = some_rows()
    out = merkle.tamper_check(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows) and len({r.root for r in out}) == 1
    hit = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None}
    assert hit and {r.doc_id for r in out if not r.verified} == hit
    assert all((r.folded_root == r.root) == r.verified for r in out)


def test_small_tables(spark):
    one = merkle.tamper_check(spark.createDataFrame([(1, "a", "en", "s", 1)], SCHEMA)).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("")
    assert merkle.tamper_check(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a", "en", "s", 1, 5, 6)], SCHEMA + ", pos long, root long")
    assert merkle.manifest(clash).columns == ["doc_id", "leaf", "path", "subroot", "root"]
    with pytest.raises(ValueError):
        merkle.manifest(clash, fanout=1)
