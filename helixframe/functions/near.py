"""Two blocks of vectors in numpy: the pairs within an L1 or L2 distance, and functions of two columns as programs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

#: Rows and columns of a tile of distances, pairs whose distances are made anew at once, and rows of an output batch.
ROWS, COLUMNS, AGAIN, BATCH = 64, 4096, 32_768, 65_536


def tiles(n: int, m: int, rows: int = ROWS, columns: int = COLUMNS) -> Iterator[tuple[slice, slice]]:
    for c in range(0, m, columns):
        for r in range(0, n, rows):
            yield slice(r, min(r + rows, n)), slice(c, min(c + columns, m))


def l2_candidates(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b of all pairs whose squared distance may be at most limit.

    The halves of the squares are two more dimensions of one product, so a tile is multiplied and compared, no more.  Rounding makes a
    squared distance at most a share of both squares smaller, by which they are lessened; single precision where that is little.
    """
    real = np.isfinite(a).all(axis=1)
    mean = a[real].mean(axis=0) if real.any() else 0.0
    a, b = a - mean, b - mean
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    slack = lambda kind: 2 * (a.shape[1] + 8) * float(np.finfo(kind).eps)
    most = float(aa.max(initial=0) + bb.max(initial=0))
    kind = np.float32 if slack(np.float32) * most <= 0.02 * limit else np.float64
    less = (1 - slack(kind)) / 2
    x = np.column_stack([a, -less * aa, np.full(len(a), -1.0)]).astype(kind)
    y = np.column_stack([b, np.ones(len(b)), less * bb]).astype(kind).T
    least = kind(-limit / 2 * (1 + 1e-6))
    for r, c in tiles(len(a), len(b), 256):
        at = np.flatnonzero(~(x[r] @ y[:, c] < least))  # also what is no number
        if len(at):
            i, j = np.divmod(at, c.stop - c.start)
            yield i + r.start, j + c.start


def l1_candidates(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b of all pairs whose distance may be at most limit.

    Coordinates are rounded to steps so wide that sums of differences keep within 16 bits; what the rounding takes from the rows is known
    and added to the limit.  Where steps are too coarse for the limit, in double precision.
    """
    both = np.concatenate([a, b])
    low, high = both.min(axis=0, initial=np.inf), both.max(axis=0, initial=-np.inf)
    wide = float((high - low).sum()) if len(both) else 0.0
    step = wide / 32_000
    if 0 < step * a.shape[1] <= limit / 4:
        middle, kind = (low + high) / 2, np.int16
        x, y = (np.rint((v - middle) / step) for v in (a, b))
        lost_a, lost_b = (np.abs(v - middle - s * step).sum(axis=1) for v, s in ((a, x), (b, y)))
        reach = np.minimum(np.ceil((limit + lost_a + lost_b.max(initial=0)) * (1 + 1e-9) / step) + 1, 32_767).astype(np.int16)
    else:
        x, y, kind = a, b, np.float64
        reach = np.full(len(a), limit * (1 + 1e-9) + 1e-12)
    x, y = (np.ascontiguousarray(v.T.astype(kind)) for v in (x, y))
    for r, c in tiles(len(a), len(b)):
        total, part = (np.zeros((r.stop - r.start, c.stop - c.start), kind) for _ in range(2))
        for p, q in zip(x[:, r], y[:, c], strict=True):
            np.subtract(q[None, :], p[:, None], out=part)
            np.abs(part, out=part)
            np.add(total, part, out=total)
        at = np.flatnonzero(~(total > reach[r, None]))
        if len(at):
            i, j = np.divmod(at, c.stop - c.start)
            yield i + r.start, j + c.start


def within(a: np.ndarray, b: np.ndarray, eps: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and b, and the distance, of the pairs within eps; coordinates are summed one after the other, as in SQL."""
    limit = eps if metric == "l1" else eps * eps
    if limit < 0 or not a.shape[1]:
        a, b = (a, b) if limit >= 0 else (a[:0], b[:0])
        found = ((np.repeat(i, len(b)), np.tile(np.arange(len(b)), len(i))) for i in np.split(np.arange(len(a)), range(ROWS, len(a), ROWS)) if len(i))
    else:
        found = (l1_candidates if metric == "l1" else l2_candidates)(a, b, limit)
    for i, j in found:
        for at in range(0, len(i), AGAIN):
            p, q = i[at : at + AGAIN], j[at : at + AGAIN]
            dist = np.zeros(len(p))
            diff = a[p] - b[q]
            if diff.shape[1]:
                dist = (np.abs(diff) if metric == "l1" else diff * diff).cumsum(axis=1)[:, -1]
            ok = dist <= limit
            yield p[ok], q[ok], dist[ok] if metric == "l1" else np.sqrt(dist[ok])


def matrix(values: pa.Array) -> np.ndarray:
    """Vectors of one length, in double precision."""
    sizes = np.unique(values.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[-1]} numbers")
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(values), int(sizes[0]) if len(sizes) else 0)


def by_length(values: pa.Array) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """The places of the vectors of each length, and these as columns of a matrix; None for nulls."""
    sizes = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    own = [(n, np.flatnonzero(sizes == n)) for n in np.unique(sizes)]
    return [(at, None if n < 0 else np.ascontiguousarray(matrix(values.take(pa.array(at))).T)) for n, at in own]


def sides(table: pa.Table, same: bool) -> tuple[pa.Table, pa.Table]:
    """The two blocks that meet under a key (see distance.meetings)."""
    own = table.filter(table["first"])
    return own, own if same else table.filter(pa.compute.invert(table["first"]))


def batched(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns in batches of about BATCH rows, so that a group's output is never held whole."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= BATCH:
            yield from _batch(held, names)
            held, n = [], 0
    yield from _batch(held, names)


def _batch(held: list[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    if held:
        joined = lambda c: (np.ma if any(np.ma.isMaskedArray(x) for x in c) else np).concatenate(c)
        yield pa.RecordBatch.from_arrays([pa.array(joined(c)) for c in zip(*held, strict=True)], names=names)


#: What a program may hold: all are null where an argument is, so a null may be taken for a number that is none.
OPERATIONS = {"+": np.add, "-": np.subtract, "*": np.multiply, "abs": np.abs, "sqrt": np.sqrt, "negative": np.negative}


def program(metric: Callable[[Column, Column], Column], a: Column, b: Column, names: tuple[str, str]) -> tuple | None:
    """The metric of array columns a and b, called by names, as a tree for evaluated(); None if it has a part that has no counterpart here."""
    try:
        kind, tree, used = _tree(metric(a, b)._jc.node(), {})
    except (AttributeError, LookupError):
        return None
    return tree if kind == "number" and used == set(names) else None


def _tree(node, known: dict[str, str]) -> tuple[str, tuple, set[str]]:
    what = node.getClass().getSimpleName()
    if what == "Literal":
        value = node.value()
        if type(value) is not float:
            raise LookupError(what)
        return "number", ("literal", value), set()
    if what == "UnresolvedAttribute":
        return "array", ("name", node.sql()), {node.sql()}
    if what == "UnresolvedNamedLambdaVariable":
        return known[node.name()], ("name", node.name()), set()
    if what != "UnresolvedFunction" or node.isDistinct() or node.isUserDefinedFunction():
        raise LookupError(what)
    name, arguments = node.functionName(), [node.arguments().apply(i) for i in range(node.arguments().size())]
    arrays = {"zip_with": 2, "transform": 1, "aggregate": 1}.get(name)
    if arrays is None:
        parts = [_tree(x, known) for x in arguments]
        if len(parts) != OPERATIONS[name].nin or any(kind != "number" for kind, _, _ in parts):
            raise LookupError(name)
        return "number", ("operation", name, *[t for _, t, _ in parts]), set().union(*[u for _, _, u in parts])
    own, last = [_tree(x, known) for x in arguments[:-1]], arguments[-1]
    if last.getClass().getSimpleName() != "LambdaFunction":
        raise LookupError(name)
    variables = [last.arguments().apply(i).name() for i in range(last.arguments().size())]
    wanted = ["array"] * arrays + ["number"] * (name == "aggregate")
    if [kind for kind, _, _ in own] != wanted or len(variables) != len(wanted):
        raise LookupError(name)
    kind, body, used = _tree(last.function(), known | dict.fromkeys(variables, "number"))
    if kind != "number":
        raise LookupError(name)
    return "number" if name == "aggregate" else "array", (name, variables, body, *[t for _, t, _ in own]), used.union(*[u for _, _, u in own])


def evaluated(tree: tuple, known: dict):
    """The value of a tree.  An array is its length and a function of the place; elements beyond its end are null."""
    what = tree[0]
    if what == "literal":
        return tree[1]
    if what == "name":
        return known[tree[1]]
    if what == "operation":
        return OPERATIONS[tree[1]](*[evaluated(t, known) for t in tree[2:]])
    _, variables, body, *rest = tree
    own = [evaluated(t, known) for t in rest]
    if what == "aggregate":
        (size, element), total = own
        for k in range(size):
            total = evaluated(body, known | dict(zip(variables, (total, element(k)), strict=True)))
        return total
    element = lambda k: evaluated(body, known | {v: get(k) if k < size else np.nan for v, (size, get) in zip(variables, own, strict=True)})
    return max(size for size, _ in own), element


def by_program(tree: tuple, names: tuple[str, str], a: pa.Array, b: pa.Array, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and b, and the value, of the pairs whose value is at most eps; vectors of each length for themselves."""
    for p, x in by_length(a):
        for q, y in by_length(b):
            for r, c in tiles(len(p), len(q), 16):
                sides_ = [(len(x), lambda k, r=r: x[k, r, None]), (len(y), lambda k, c=c: y[k, None, c])]
                with np.errstate(all="ignore"):
                    dist = np.broadcast_to(evaluated(tree, dict(zip(names, sides_, strict=True))), (r.stop - r.start, c.stop - c.start))
                i, j = np.nonzero(dist <= eps)
                yield p[i + r.start], q[j + c.start], dist[i, j]


def all_norms(a: pa.Array, b: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a, places in b, and a tile of the L1 and L2 distances of all of the former from all of the latter.

    Coordinates are summed one after the other, and those that one of two vectors lacks are left out, as in SQL; without any, the
    distance is null.
    """
    for p, x in by_length(a):
        for q, y in by_length(b):
            known = x is not None and y is not None and len(x) and len(y)
            for r, c in tiles(len(p), len(q), 16):
                l1, l2, part = (np.zeros((r.stop - r.start, c.stop - c.start)) for _ in range(3))
                for u, v in zip(x[:, r], y[:, c]) if known else ():  # noqa: B905
                    np.subtract(u[:, None], v[None, :], out=part)
                    np.abs(part, out=part)
                    np.add(l1, part, out=l1)
                    np.multiply(part, part, out=part)
                    np.add(l2, part, out=l2)
                yield p[r], q[c], *[d if known else np.ma.masked_all(d.shape) for d in (l1, np.sqrt(l2))]
