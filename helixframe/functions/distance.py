"""L1, L2 and local alignment distances, and joins of pairs within a distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import saved, small
from . import near
from .sequences import kmers

MATCH, GAP = 4, 3


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def alignment_distances(a: list[str], b: list[str], textbook: bool = False, cells: int = 4_000_000) -> np.ndarray:
    """Smith-Waterman distances of pairs: 4 times the longer length less the best local score.

    Match 4, mismatch -4, gap 3.  The compared operands are the sequences without their first letter and with an end mark
    that matches itself; textbook compares the whole sequences.  Rows of the matrix run along b for a batch of pairs at once;
    gaps along a row are a running maximum.  Pairs are batched by length so that padding stays small.
    """
    out = np.zeros(len(a))
    a, b = [max(p, key=len) for p in zip(a, b, strict=True)], [min(reversed(p), key=len) for p in zip(a, b, strict=True)]
    trim = (lambda s: s) if textbook else (lambda s: s[1:] + "\0")
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * (len(a[order[to]]) + 2) <= max(cells // 64, len(a[order[to]]) + 2):
            to += 1
        own = order[at:to]
        at = to
        xs, ys = [trim(a[i]) for i in own], [trim(b[i]) for i in own]
        wide, tall = max(map(len, xs)), max(map(len, ys))
        x = np.full((len(own), wide), -1, dtype=np.int64)
        y = np.full((tall, len(own)), -2, dtype=np.int64)
        for k, (s, t) in enumerate(zip(xs, ys, strict=True)):
            x[k, : len(s)] = [ord(c) for c in s]
            y[: len(t), k] = [ord(c) for c in t]
        ramp = GAP * np.arange(1, wide + 1)
        h = np.zeros((len(own), wide + 1), dtype=np.int64)
        best = np.zeros(len(own), dtype=np.int64)
        for row in y:
            t = np.maximum(h[:, :-1] + np.where(x == row[:, None], MATCH, -MATCH), h[:, 1:] - GAP)
            np.maximum(t, 0, out=t)
            h[:, 1:] = np.maximum.accumulate(t + ramp, axis=1) - ramp
            np.maximum(best, h[:, 1:].max(axis=1, initial=0), out=best)
        longest = np.array([max(len(a[i]), len(b[i])) for i in own])
        out[own] = MATCH * longest - best
    return out


def sw_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(alignment_distances(a.tolist(), b.tolist()))


def register_sw_distance(spark: SparkSession, name: str = "sw_distance") -> None:
    """Make the distance a function of two strings in SQL."""
    spark.udf.register(name, F.pandas_udf(sw_series, "double"))


def sw_distances(pairs: DataFrame, a: str, b: str, to: str = "dist") -> DataFrame:
    """pairs with the alignment distance of columns a and b."""
    schema = T.StructType([*pairs.schema.fields, T.StructField(to, T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p[to] = alignment_distances(p[a].tolist(), p[b].tolist())
            yield p

    return pairs.mapInPandas(run, schema)


def lost_grams(most: float, q: int) -> int:
    """How many q-grams of either sequence an alignment distance of `most` can destroy.

    Let u letters of a sequence have no equal partner.  The distance is at least 4 u + 4 x + 3 g with x mismatches and g gap letters, and u
    is at least x, the gap letters of this side, and the letters left out at the ends together.  So a mismatch costs 8 and destroys q
    grams, a gap letter of this side costs 7 and destroys q, one of the other side costs 3 and destroys q - 1, a letter left out
    costs 4 and destroys 1.  The third of these destroys most for its cost.
    """
    return int(max(most, 0) * max((q - 1) / 3, q / 7, 1 / 4) + 1e-9)


def gram_length(most: float, typical: float) -> int:
    """The longest q, 3 to 12, whose loss leaves grams to sequences a tenth shorter than the typical length: the longer, the rarer."""
    return max([q for q in range(3, 13) if 1.1 * (lost_grams(most, q) + q) <= typical], default=3)


def operand_length() -> Column:
    """Letters of the compared operand: as many as the sequence has, for the end mark stands for the first one, but one at least."""
    return F.greatest(F.lit(1), F.length("seq"))


def rare_grams(seqs: DataFrame, most: float, q: int) -> DataFrame:
    """(side, id, size, token): the rarest lost_grams + 1 grams of each of seqs(side, id, seq), and none of sequences with no more grams.

    Grams are those of the compared operand, without the first letter and with an end mark; a gram that stands in a sequence for the
    second time is a token of its own.  Tokens are ordered by their number in all sequences.
    """
    loss = lost_grams(most, q)
    own = seqs.where(F.length("seq") - q + 1 > loss).select("side", "id", operand_length().alias("size"), F.explode(kmers(F.concat(F.expr("substring(seq, 2)"), F.lit("$")), q, True)).alias("gram"))
    each = own.groupBy("side", "id", "size", "gram").agg(F.count("*").alias("n"))
    tokens = each.select("side", "id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.xxhash64("gram", k))).alias("token"))
    spread = tokens.groupBy("token").agg(F.count("*").alias("spread"))
    ranked = tokens.join(spread, "token").groupBy("side", "id", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("spread", "token"))), 1, loss + 1).alias("first"))
    return ranked.select("side", "id", "size", F.explode("first.token").alias("token"))


def near_candidates(left: DataFrame, right: DataFrame, most: float, q: int | None = None) -> DataFrame:
    """(i, j), each pair once, of left(seq_id, seq) and right(seq_id, seq) that may lie within an alignment distance of `most`.

    Two sequences that lie so near and have more grams than the distance can destroy share a gram, and if each has its grams in one order,
    also one of the first lost + 1 of both (prefix filter): an equi-join on rare grams, however many sequences have one length.
    Sequences with fewer grams meet all of lengths in reach, by bands of lengths; they are at most lost + q letters long, and their
    partners most / 4 longer.
    """
    if q is None:
        q = gram_length(most, left.agg(F.avg(F.length("seq"))).first()[0] or 0)
    loss = lost_grams(most, q)
    sides = left.select(F.lit(0).alias("side"), F.col("seq_id").alias("id"), "seq").unionByName(right.select(F.lit(1).alias("side"), F.col("seq_id").alias("id"), "seq"))
    tokens = rare_grams(sides, most, q)
    side = lambda k, name: tokens.where(F.col("side") == k).select(F.col("id").alias(name), F.col("size").alias(f"{name}_size"), "token")
    close = 4 * F.abs(F.col("i_size") - F.col("j_size")) <= most
    long = side(0, "i").join(side(1, "j"), "token").where(close).select("i", "j")
    band = F.floor(operand_length() / max(1, int(most // 4) + 1)).cast("long")
    reach = loss + q - 1 + most / 4
    plain = lambda t, name, bands: t.where(F.length("seq") <= reach).select(F.col("seq_id").alias(name), operand_length().alias(f"{name}_size"), bands.alias("band"))
    short = plain(left, "i", band).join(plain(right, "j", F.explode(F.array(band - 1, band, band + 1))), "band")
    short = short.where(close).where(F.least("i_size", "j_size") - q + 1 <= loss).select("i", "j")
    return long.unionByName(short).distinct()


def in_reach(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """left(seq_id, seq) without the sequences that have no length of right in reach; stored, as a text is read once."""
    band = F.floor(operand_length() / max(1, int(most // 4) + 1)).cast("long")
    bands = right.select(F.explode(F.array(band - 1, band, band + 1)).alias("band")).distinct()
    return saved(left.select("seq_id", "seq", band.alias("band")).join(bands, "band", "left_semi").select("seq_id", "seq"))


def near_pairs(left: DataFrame, right: DataFrame, most: float, half: bool = False, q: int | None = None) -> DataFrame:
    """(i, j, a, b, dist) of the pairs within an alignment distance of `most`; with half those with i <= j only, of one table."""
    left = saved(left.select("seq_id", "seq")) if half else in_reach(left, right, most)
    right = left if half else in_reach(right, left, most)
    found = near_candidates(left, right, most, q)
    found = found.where("i <= j") if half else found
    both = found.join(left.select(F.col("seq_id").alias("i"), F.col("seq").alias("a")), "i").join(right.select(F.col("seq_id").alias("j"), F.col("seq").alias("b")), "j")
    return sw_distances(both.select("i", "j", "a", "b"), "a", "b").where(F.col("dist") <= most)


#: Points of a block of a cell, up to so many times as many in large tables; cells, at most.
BLOCK, LARGER, MOST_CELLS = 4096, 4, 1024


def block_size(n: int) -> int:
    """Points of a block.  What is shuffled grows as the square of n over it, and so it grows with n; sixteen blocks keep the tasks busy."""
    return max(BLOCK, min(LARGER * BLOCK, -(-n // 16)))


def norms(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The distances of rows of a from those of b, all of them; l2 squared."""
    if metric == "l1":
        return np.stack([np.abs(b - x).sum(axis=1) for x in a]) if len(a) else np.zeros((0, len(b)))
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return norms(a, b, metric) if metric == "l1" else np.sqrt(norms(a, b, metric))


def sample(points: DataFrame, n: int) -> np.ndarray:
    """At most n vectors by hash; they come to the driver."""
    rows = points.select("values", F.xxhash64("seq_id").alias("h"), "seq_id").orderBy("h", "seq_id").limit(n).collect()
    return np.array([r["values"] for r in rows], dtype=np.float64)


def pivots(points: DataFrame, n: int, metric: str) -> np.ndarray:
    """At most n points that lie far from each other, of a sample of 4 n."""
    own = sample(points, 4 * n)
    if not len(own):
        return own
    picked, away = [0], distances(own, own[:1], metric)[:, 0]
    while len(picked) < n and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, distances(own, own[picked[-1:]], metric)[:, 0])
    return own[picked]


def in_cells(points: DataFrame, eps: float, metric: str, cells: int | None = None, n: int | None = None) -> DataFrame:
    """points(seq_id, values) with home, the cell of the nearest pivot, and visits, the earlier cells that it may have partners in; values
    in single precision if none of them loses by it.  n is the number of points, if known.

    A point at distance r from its own pivot and d from another has a partner within eps in that cell only if d is at most the
    cell's radius + eps and at most r + 2 eps (both by the triangle inequality).  A pair of two cells is found in the earlier one, so later
    cells are not visited.
    """
    if not cells:
        n = points.count() if n is None else n
        cells = min(MOST_CELLS, -(-n // block_size(n)) or 1)
    centres = pivots(points, cells, metric)

    def nearest(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = np.stack(p["values"].to_numpy()).astype(np.float64)
        d = distances(x, centres, metric)
        home = d.argmin(axis=1)
        return x, d, home, d[np.arange(len(d)), home]

    def radii(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, _, home, r = nearest(p)
                wide = (x != x.astype(np.float32)).any(axis=1)
                yield pd.DataFrame({"home": home, "r": r, "wide": wide}).groupby("home", as_index=False).max()

    far, kind = np.full(max(1, len(centres)), -np.inf), "float"
    for row in points.mapInPandas(radii, "home long, r double, wide boolean").groupBy("home").agg(F.max("r").alias("r"), F.max("wide").alias("wide")).collect():  # one row a cell
        far[row["home"]] = row["r"]
        kind = "double" if row["wide"] else kind

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                x, d, home, r = nearest(p)
                reach = np.minimum(far + eps, (r + 2 * eps)[:, None])
                near = (d <= reach + 1e-6 * (1 + d)) & (np.arange(d.shape[1]) < home[:, None])
                yield pd.DataFrame({"seq_id": p["seq_id"], "values": list(x.astype(kind if kind == "double" else np.float32)), "home": home, "visits": [np.flatnonzero(x) for x in near]})

    return points.select("seq_id", "values").mapInPandas(visits, f"seq_id long, values array<{kind}>, home long, visits array<long>")


def cell_sizes(placed: DataFrame) -> DataFrame:
    """(cell, hosts, guests) of points in cells: at most MOST_CELLS rows.  The sum of guests over that of hosts is the number of copies of a
    point beyond its own."""
    rows = placed.select(F.explode(F.concat(F.array(F.struct(F.col("home").alias("cell"), F.lit(1).alias("own"))), F.transform("visits", lambda c: F.struct(c.alias("cell"), F.lit(0).alias("own"))))).alias("s"))
    return rows.groupBy("s.cell").agg(F.sum("s.own").alias("hosts"), F.sum(1 - F.col("s.own")).alias("guests"))


def meetings(placed: DataFrame, size: int = BLOCK) -> DataFrame:
    """(cell, lo, hi, first, seq_id, values): hosts and guests of a cell in blocks of about `size`; every two blocks of hosts, and every block of
    hosts and block of guests, meet under a key (cell, lo, hi) of their own, so no key holds more than two blocks."""
    sizes_ = cell_sizes(placed).select("cell", F.ceil(F.col("hosts") / size).cast("long").alias("hb"), F.ceil(F.col("guests") / size).cast("long").alias("gb"))
    cells = small(saved(sizes_))
    h = F.xxhash64("seq_id")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    key = lambda lo, hi, first: F.struct(lo.alias("lo"), hi.alias("hi"), first.alias("first"))
    hosts = placed.select(F.col("home").alias("cell"), "seq_id", "values").join(cells, "cell").withColumn("own", F.pmod(h, F.col("hb")))
    among = F.transform(upto(F.col("hb")), lambda b: key(F.least(F.col("own"), b), F.greatest(F.col("own"), b), F.col("own") <= b))
    with_guests = F.transform(upto(F.col("gb")), lambda g: key(F.col("own"), F.col("hb") + g, F.lit(True)))
    hosts = hosts.select("cell", "seq_id", "values", F.explode(F.concat(among, with_guests)).alias("k"))
    guests = placed.select(F.explode("visits").alias("cell"), "seq_id", "values").join(cells, "cell").withColumn("own", F.pmod(h, F.col("gb")) + F.col("hb"))
    guests = guests.select("cell", "seq_id", "values", F.explode(F.transform(upto(F.col("hb")), lambda b: key(b, F.col("own"), F.lit(False)))).alias("k"))
    return hosts.unionByName(guests).select("cell", "k.lo", "k.hi", "k.first", "seq_id", "values")


def both_ways(half: DataFrame) -> DataFrame:
    """The pairs (i, j, dist) and those turned round, i = j once."""
    turned = F.when(F.col("i") != F.col("j"), F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).otherwise(F.array(F.struct("i", "j")))
    return half.select("dist", F.explode(turned).alias("p")).select("p.i", "p.j", "dist")


PAIRS = "i long, j long, dist double"


def block_pairs(placed: DataFrame, size: int, found: Callable[[pa.Array, pa.Array], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> DataFrame:
    """(i, j, dist), both directions, of what found yields for the values of every two blocks that meet: places in both, and the distance."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = key[1].as_py() == key[2].as_py()
        own, other = near.sides(pa.Table.from_batches(batches), same)
        ids, theirs = (t["seq_id"].to_numpy() for t in (own, other))

        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for r, c, dist in found(*[t["values"].combine_chunks() for t in (own, other)]):
                yield ids[r], theirs[c], dist
                if not same:
                    yield theirs[c], ids[r], dist

        if len(ids) and len(theirs):
            yield from near.batched(parts(), ["i", "j", "dist"])

    return meetings(placed, size).groupBy("cell", "lo", "hi").applyInArrow(run, PAIRS)


def pairs_by_function(points: DataFrame, eps: float, metric: Callable[[Column, Column], Column], column: str, bound: Callable[[Column], Column] | None) -> DataFrame:
    """(i, j, dist) for a distance of two columns, which is the same in both directions.  bound maps a point to a number that differs by at
    most the distance: pairs meet by bands of it; without one, all points meet.  Either way they meet in blocks.

    On arrays of doubles, a function that consists of sums, products and the like of the elements is computed by numpy (near.program).
    """
    own = points.select("seq_id", F.col(column).alias("values")).where("values is not null")
    home, visits = F.lit(0).cast("long"), F.array().cast("array<long>")
    if bound is not None:
        home = F.floor(bound(F.col("values")) / (eps * (1 + 1e-9) or 1.0)).cast("long")
        visits = F.array(F.col("home") - 1)
    placed, names = saved(own.withColumn("home", home).withColumn("visits", visits)), ("_a", "_b")
    size = block_size(placed.count())
    tree = near.program(metric, F.col("_a"), F.col("_b"), names) if dict(own.dtypes)["values"] == "array<double>" else None
    if tree is not None:
        return block_pairs(placed, size, lambda a, b: near.by_program(tree, names, a, b, eps))
    rows = saved(meetings(placed, size))
    one = rows.where("first").select("cell", "lo", "hi", F.col("seq_id").alias("i"), F.col("values").alias("_a"))
    two = rows.where("lo = hi or not first").select("cell", "lo", "hi", F.col("seq_id").alias("j"), F.col("values").alias("_b"))
    both = one.join(two, ["cell", "lo", "hi"]).where("lo < hi or i <= j")
    return both_ways(both.select("i", "j", metric(F.col("_a"), F.col("_b")).alias("dist")).where(F.col("dist") <= eps))


def pairs_within(points: DataFrame, eps: float, metric: str | Callable[[Column, Column], Column] = "l2", column: str = "values", bound: Callable[[Column], Column] | None = None) -> DataFrame:
    """(i, j, dist), i and j of points(seq_id, values or seq), for every pair, i = j included, with dist at most eps.

    l1 and l2: points go to the cell of the nearest pivot and to those that the triangle inequality leaves (in_cells), large cells are
    split in blocks, and numpy finds the pairs of two blocks.  sw: see near_candidates.  A function of two columns: see
    pairs_by_function, of `column` and with `bound`.
    """
    if callable(metric):
        return pairs_by_function(points, eps, metric, column, bound)
    if metric == "sw":
        return both_ways(near_pairs(points, points, eps, half=True).select("i", "j", "dist"))
    points = points.where("values is not null")
    n = points.count()
    placed = saved(in_cells(points, eps, metric, n=n))
    return block_pairs(placed, block_size(n), lambda a, b: near.within(near.matrix(a), near.matrix(b), eps, metric))
