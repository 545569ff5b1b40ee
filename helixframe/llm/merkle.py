"""Merkle manifest of a dataset: a digest of every row, a tree a language, one root, and a proof for every row.

Rows are numbered by language and id without any group in one task: a range sort, counts per range, and offsets.  Every
BLOCK leaves of a tree, aligned, are one partition of the exchange.  A partition hashes its own subtree.  Then the partitions
swap subtree roots round by round (butterfly): in round r the partitions of `fanout` neighbouring subtrees of fanout^r partitions
stand in groups, one of each subtree, and each sends its subtree's root to the others of its group.  All of them hash the
common ancestor, redundantly, and so each one has the upper part of its proofs when it knows the root; nothing is sent down again.
A partition past the ragged end has no partner of its own there: the last partition answers for it.  The subroots of the languages
are the leaves of a last tree of the same kind.

A round is one shuffle of a row for each partition of the exchange and at most `fanout` messages for each; its table is written
to the shared folder.  Everything is DataFrame functions.

Defined results: a null is `-` in a leaf, so null and empty differ; null ids come first; rows with one id stand in the order of their
leaves, and equal rows are leaves of their own; a null language is a language, the first; one row is its own root, with an empty
proof; an empty table has no rows and no root; columns beyond those named are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved, small
from .shared import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCK_LEVELS = 10
_PATH = "array<struct<at:int,others:array<string>>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def joined(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def field(c: Column) -> Column:
    """`-` for a null, else UTF-8 byte count, colon and value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(changed: dict[str, Column] | None = None) -> Column:
    """The digest of a row, with other values for some of its fields if given."""
    return digest(*[field((changed or {}).get(c, F.col(c))) for c in FIELDS])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    step = lambda acc, s: F.sha2(F.concat(joined(F.slice(s["others"], F.lit(1), s["at"])), acc, joined(F.slice(s["others"], s["at"] + 1, F.size(s["others"])))), 256)
    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """All sibling digests of a path, level by level, left to right."""
    return F.flatten(F.transform(path, lambda s: s["others"]))


def step_of(members: Column, at: Column) -> Column:
    """A step of a path: where the own node stands among the members of its run, and the others."""
    return F.struct(at.cast("int").alias("at"), F.filter(members, lambda x, i: i != at).alias("others"))


def run_at(k: Column, width: int) -> Column:
    return F.floor(k / width).cast("long")


def level_above(below: str, fanout: int) -> Column:
    return F.transform(F.sequence(F.lit(0), run_at(F.size(below) - 1, fanout).cast("int")), lambda i: F.sha2(joined(F.slice(below, i * fanout + 1, F.lit(fanout))), 256))


def blocks_of(leaves: DataFrame, tree: list[str], payload: list[str], fanout: int, levels: int) -> DataFrame:
    """(tree, block, n, rows, l0, l1, ..): leaves(tree, pos, n, hash, payload) of each aligned block and all nodes of its subtree."""
    size = fanout**levels
    own = leaves.withColumn("block", run_at(F.col("pos"), size)).groupBy(*tree, "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "hash", *payload))).alias("rows"))
    own = own.withColumn("l0", F.transform("rows", lambda r: r["hash"]))
    for k in range(levels):
        own = own.withColumn(f"l{k + 1}", F.when(F.col("n") > fanout**k, level_above(f"l{k}", fanout)).otherwise(F.col(f"l{k}")))
    return own


def lower_path(at: Column, fanout: int, levels: int) -> Column:
    """The path of the at-th leaf of a block inside the block."""
    steps = []
    for k in range(levels):
        node = run_at(at, fanout**k)
        members = F.slice(f"l{k}", (run_at(node, fanout) * fanout + 1).cast("int"), F.lit(fanout))
        steps.append(F.when(F.col("n") > fanout**k, step_of(members, F.pmod(node, F.lit(fanout)))))
    return F.array_compact(F.array(*steps))


def exchanged(blocks: DataFrame, tree: list[str], fanout: int, levels: int) -> DataFrame:
    """(tree, block, root, upper): the rounds of the butterfly over blocks(tree, block, n, root)."""
    size = fanout**levels
    count = F.floor((F.col("n") - 1) / size).cast("long") + 1
    state = saved(blocks.select(*tree, "block", count.alias("blocks"), "root", F.array().cast(_PATH).alias("upper")))
    most, width = state.agg(F.max("blocks")).first()[0] or 0, 1
    while width < most:
        going = F.col("blocks") > width
        mine, low = run_at(F.col("block"), width), F.pmod("block", F.lit(width))
        first = run_at(mine, fanout) * fanout
        others = F.filter(F.sequence(first, first + fanout - 1), lambda s: (s != mine) & (s * width < F.col("blocks")))
        receivers = lambda s: F.sequence(s * width + low, F.when(F.col("block") == F.col("blocks") - 1, (s + 1) * width - 1).otherwise(s * width + low))
        to = F.filter(F.flatten(F.transform(others, receivers)), lambda b: b < F.col("blocks"))
        at = F.pmod(mine, F.lit(fanout)).cast("int")
        sent = state.where(going).select(*tree, F.explode(to).alias("block"), F.struct(at.alias("at"), "root").alias("message"))
        kept = F.struct("blocks", at.alias("at"), "root", "upper", going.alias("going"))
        own = state.select(*tree, "block", F.struct(at.alias("at"), "root").alias("message"), kept.alias("own"))
        met = own.unionByName(sent, allowMissingColumns=True).groupBy(*tree, "block").agg(F.max("own").alias("own"), F.array_sort(F.collect_list("message")).alias("run"))
        members = F.transform("run", lambda m: m["root"])
        root = F.when(F.col("own.going"), F.sha2(joined(members), 256)).otherwise(F.col("own.root"))
        upper = F.when(F.col("own.going"), F.concat("own.upper", F.array(step_of(members, F.col("own.at"))))).otherwise(F.col("own.upper"))
        state = saved(met.select(*tree, "block", F.col("own.blocks").alias("blocks"), root.alias("root"), upper.cast(_PATH).alias("upper")))
        width *= fanout
    return state


def grown(leaves: DataFrame, tree: list[str], payload: list[str], fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Of leaves(tree, pos, n, hash, payload), pos from 0 to n - 1 in every tree: (tree, payload, hash, path, root), and (tree, root)."""
    blocks = saved(blocks_of(leaves, tree, payload, fanout, levels))
    state = exchanged(blocks.select(*tree, "block", "n", F.get(f"l{levels}", F.lit(0)).alias("root")), tree, fanout, levels)
    nodes = [f"l{k}" for k in range(levels)]
    rows = blocks.join(state.select(*tree, "block", "root", "upper"), [*tree, "block"]).select(*tree, "n", "root", "upper", *nodes, F.posexplode("rows").alias("_at", "_row"))
    path = F.concat(lower_path(F.col("_at"), fanout, levels), "upper")
    return rows.select(*tree, "_row.hash", *[F.col(f"_row.{c}").alias(c) for c in payload], path.alias("path"), "root"), state.where("block = 0").select(*tree, "root")


def manifest(docs: DataFrame, keep: dict[str, Column] | None = None, fanout: int = 2, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, leaf, path, subroot, root) of every row of docs, and the columns of keep, made of docs.

    path has a step a level: the place of the node in its run, and the digests of the others.  fanout^levels leaves are a
    partition of the exchange.
    """
    if fanout < 2:
        raise ValueError("a fanout of 2 at least")
    keep = keep or {}
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", leaf().alias("hash"), *[c.alias(k) for k, c in keep.items()])
    own = saved(own.select(F.col("lang").isNotNull().alias("named"), F.coalesce("lang", F.lit("")).alias("tongue"), *[c for c in own.columns if c != "lang"]))
    payload = ["doc_id", *keep]
    rows, roots = grown(positions(own, ["named", "tongue"], ["doc_id", "hash"]), ["named", "tongue"], payload, fanout, levels)
    tops = positions(saved(roots.select(F.lit(0).alias("top"), "named", "tongue", F.col("root").alias("hash"))), ["top"], ["named", "tongue"])
    tops, _ = grown(tops, ["top"], ["named", "tongue"], fanout, levels)
    tops = saved(tops.select("named", "tongue", F.col("path").alias("_top"), F.col("root").alias("_root")))
    out = rows.join(small(tops), ["named", "tongue"])
    return out.select("doc_id", F.col("hash").alias("leaf"), F.concat("path", "_top").alias("path"), F.col("root").alias("subroot"), F.col("_root").alias("root"), *keep)


def verify(entries: DataFrame, leaf: str = "leaf") -> DataFrame:
    """entries of a manifest with folded_root and verified: whether a leaf and its path lead to the root."""
    out = entries.withColumn("folded_root", fold(F.col(leaf), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest in digests, checked against rows of which those whose crc32(doc_id) 7 divides have n_chars + 1."""
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(7)) == 0, F.lit(False))
    seen = F.when(hit, leaf({"n_chars": F.col("n_chars") + 1})).otherwise(leaf())
    rows = verify(manifest(docs, {"tampered": seen}), "tampered")
    return rows.select("doc_id", "leaf", "subroot", "root", digest(joined(siblings(F.col("path")))).alias("proof_sha256"), "folded_root", "verified")


def oracle_sql() -> str:
    """DuckDB SQL for tamper_check over the table documents, with fanout 2."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    row = lambda n: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', n, 'text'))})"
    return f"""
    WITH RECURSIVE crc AS (
      SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ), hit AS (
      SELECT d.doc_id, d.source, d.lang, d.n_chars, d.text, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) AS bad
      FROM documents d, crc
    ), leaves AS (
      SELECT doc_id, lang, leaf, tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
      FROM (SELECT doc_id, lang, {row("n_chars")} AS leaf, CASE WHEN bad THEN {row("(n_chars + 1)")} ELSE {row("n_chars")} END AS tampered FROM hit)
    ), tree AS (
      SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
      UNION ALL
      SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2
    ), subroots AS (
      SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1
    ), crown AS (
      SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroots
      UNION ALL
      SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM crown WHERE n > 1 GROUP BY level, pos // 2
    ), height AS (SELECT lang, max(level) AS height FROM tree GROUP BY lang
    ), steps AS (
      SELECT l.lang, l.pos, t.level, t.pos AS node, s.h AS other FROM leaves l JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos = l.pos >> t.level AND t.n > 1
      LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.pos = xor(t.pos, 1::BIGINT)
      UNION ALL
      SELECT l.lang, l.pos, hh.height + t.level, t.pos, s.h FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN height hh ON hh.lang IS NOT DISTINCT FROM l.lang
      JOIN crown t ON t.pos = r.pos >> t.level AND t.n > 1 LEFT JOIN crown s ON s.level = t.level AND s.pos = xor(t.pos, 1::BIGINT)
    ), proofs AS (
      SELECT lang, pos, sha256(coalesce(string_agg(other, '' ORDER BY level), '')) AS proof, max(level) + 1 AS total FROM steps GROUP BY lang, pos
    ), folded AS (
      SELECT lang, pos, 0 AS level, tampered AS h FROM leaves
      UNION ALL
      SELECT f.lang, f.pos, f.level + 1, sha256(CASE WHEN s.other IS NULL THEN f.h WHEN s.node % 2 = 0 THEN f.h || s.other ELSE s.other || f.h END)
      FROM folded f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.level = f.level
    )
    SELECT l.doc_id, l.leaf, r.h AS subroot, c.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = c.h AS verified
    FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT h FROM crown WHERE n = 1) c ON true
    LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
    JOIN folded f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos AND f.level = coalesce(p.total, 0)
    """
