"""Means, covariances and principal components of vectors, and density grids of projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import saved, small


def column_means(points: DataFrame) -> DataFrame:
    return points.select(F.posexplode("values").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("mean"))


#: Features of a side of a tile; partial sums of one tile or product meet in so many groups first.
TILE, FANS = 256, 64


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The values of a batch, a row a point."""
    values = batch.column(0)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if len(values) and len(flat) % len(values):
        raise ValueError("the points have different numbers of values")
    return flat.reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def means_of(points: DataFrame) -> np.ndarray:
    """The column means, on the driver: one number a feature."""
    rows = {r["dim"]: r["mean"] for r in column_means(points).collect()}
    return np.array([rows[k] for k in range(len(rows))])


def summed(parts: DataFrame, keys: list[str], schema: str, out) -> DataFrame:
    """Partial sums(keys, fan, data), arrays of doubles as bytes, summed by (keys, fan) and then by keys: no group has more of them than
    tasks / FANS or FANS.  out makes rows of `schema` of the key values and the sum."""

    def add(group: pa.Table) -> np.ndarray:
        total = None
        for x in group.column("data"):
            own = np.frombuffer(x.as_py())
            total = own.copy() if total is None else np.add(total, own, out=total)
        return total

    def first(group: pa.Table) -> pa.Table:
        head = group.slice(0, 1).select(keys)
        return head.append_column("data", pa.array([add(group).tobytes()], pa.binary()))

    def last(group: pa.Table) -> pa.Table:
        return out(*[group.column(k)[0].as_py() for k in keys], add(group))

    fans = parts.groupBy(*keys, "fan").applyInArrow(first, ", ".join([*[f"{k} int" for k in keys], "data binary"]))
    return fans.groupBy(*keys).applyInArrow(last, schema)


def gram(points: DataFrame, centre: np.ndarray | None = None) -> DataFrame:
    """(a, b, sum), a <= b: the sums over all points of the products of features a and b, less the centre if given.

    A task adds up its points' products in memory, features squared, and hands on tiles of TILE x TILE features.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = matrix(b)
            if len(x):
                x = x - centre if centre is not None else x
                total = x.T @ x if total is None else total + x.T @ x
        fan = TaskContext.get().partitionId() % FANS
        for i in range(0, 0 if total is None else len(total), TILE):
            for j in range(i, len(total), TILE):
                data = np.ascontiguousarray(total[i : i + TILE, j : j + TILE]).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i // TILE], pa.int32()), pa.array([j // TILE], pa.int32()), pa.array([min(TILE, len(total) - i)], pa.int32()), pa.array([fan], pa.int32()), pa.array([data], pa.binary())], names=["ti", "tj", "high", "fan", "data"])

    def rows(ti: int, tj: int, high: int, data: np.ndarray) -> pa.Table:
        wide = len(data) // high
        a, b = np.repeat(np.arange(high), wide) + ti * TILE, np.tile(np.arange(wide), high) + tj * TILE
        own = a <= b
        return pa.table({"a": pa.array(a[own].astype(np.int32)), "b": pa.array(b[own].astype(np.int32)), "sum": pa.array(data[own])})

    return summed(points.select("values").mapInArrow(products, "ti int, tj int, high int, fan int, data binary"), ["ti", "tj", "high"], "a int, b int, sum double", rows)


def covariance(points: DataFrame) -> DataFrame:
    """(a, b, cov), a <= b: population covariance, from products of centred features."""
    n = points.count()
    return gram(points, means_of(points)).select("a", "b", (F.col("sum") / F.lit(float(n or 1))).alias("cov"))


def feature_correlation(points: DataFrame) -> DataFrame:
    """(a, b, correlation), a <= b: the products of features scaled to unit length, not centred; null where a feature is all 0."""
    sums = saved(gram(points))
    norm = sums.where("a = b").select("a", F.sqrt("sum").alias("norm"))
    rows = sums.join(small(norm), "a").join(small(norm.select(F.col("a").alias("b"), F.col("norm").alias("norm_b"))), "b")
    return rows.select("a", "b", F.when((F.col("norm") > 0) & (F.col("norm_b") > 0), F.col("sum") / F.col("norm") / F.col("norm_b")).alias("correlation"))


def principal_components(points: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(all eigenvalues ascending, the n leading eigenvectors as columns) of the covariance, on the driver: features squared.  For the leading
    ones alone see leading_components."""
    rows = covariance(points).collect()
    d = max((r["b"] for r in rows), default=-1) + 1
    c = np.zeros((d, d))
    for r in rows:
        c[r["a"], r["b"]] = c[r["b"], r["a"]] = r["cov"]
    values, vectors = np.linalg.eigh(c)
    return values, vectors[:, ::-1][:, :n]


def covariance_times(points: DataFrame, centre: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """The covariance times the columns of q: each task multiplies its points, and only features x columns come to the driver."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(q.shape)
        for b in batches:
            x = matrix(b)
            if len(x):
                x = x - centre
                total += x.T @ (x @ q)
        fan = TaskContext.get().partitionId() % FANS
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([fan], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["one", "fan", "data"])

    out = lambda one, data: pa.table({"data": pa.array([data.tobytes()], pa.binary())})
    rows = summed(points.select("values").mapInArrow(products, "one int, fan int, data binary"), ["one"], "data binary", out).collect()
    return np.frombuffer(rows[0]["data"]).reshape(q.shape) / n if rows else np.zeros(q.shape)


def leading_components(points: DataFrame, n: int, tolerance: float = 1e-9, most_basis: int = 240, most_rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(the n leading eigenvalues, descending, and their eigenvectors as columns) of the covariance, without the matrix.

    Block Lanczos: products of the covariance with the newest block of an orthonormal basis, a pass over the points each, extend it;
    the basis gives the best eigenvectors within it.  A full basis starts again from these.  It ends when the residuals are
    at most `tolerance` times the largest eigenvalue, or when the basis spans all features.  The driver holds features x most_basis.
    """
    points, count = saved(points.select("values")), points.count()
    centre = means_of(points) if count else np.zeros(0)
    f = len(centre)
    n = min(n, f)
    if not n:
        return np.zeros(0), np.zeros((f, 0))
    most_basis = min(f, max(most_basis, 4 * n))
    block = np.linalg.qr(np.random.default_rng(1).normal(size=(f, min(f, n + 4))))[0]
    basis, image = np.zeros((f, 0)), np.zeros((f, 0))
    for _ in range(most_rounds):
        basis, image = np.hstack([basis, block]), np.hstack([image, covariance_times(points, centre, count, block)])
        t = basis.T @ image
        values, y = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-values)
        values, y = values[order], y[:, order]
        found = basis @ y[:, :n]
        residual = image @ y[:, :n] - found * values[:n]
        if basis.shape[1] >= f or np.linalg.norm(residual, axis=0).max() <= tolerance * max(values[0], 1e-300):
            return values[:n], found
        if basis.shape[1] + block.shape[1] > most_basis and most_basis < f:
            keep = n + 4
            basis, image = basis @ y[:, :keep], image @ y[:, :keep]
        new = image[:, -block.shape[1] :] if basis.shape[1] > n + 4 else image - basis @ (basis.T @ image)
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        u, size, _ = np.linalg.svd(new, full_matrices=False)
        block = u[:, size > 1e-13 * max(values[0], 1e-300)][:, : f - basis.shape[1]]
        if not block.shape[1]:  # the basis is closed under the covariance
            return values[:n], found
    raise RuntimeError("the components did not settle")


def project(points: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(seq_id, values): the uncentred vectors times the components."""
    columns = [F.aggregate(F.zip_with("values", F.array(*[F.lit(float(x)) for x in v]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for v in vectors.T]
    return points.select("seq_id", F.array(*columns).alias("values"))


def pca(points: DataFrame, n: int) -> DataFrame:
    return project(points, leading_components(points, n)[1])


def min_max(points: DataFrame) -> DataFrame:
    return points.select(F.posexplode("values").alias("dim", "v")).groupBy("dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def density_grid(points: DataFrame, interval: float, dims: int = 2) -> DataFrame:
    """(x, y[, z], n) of every cell, empty ones too: the grid, not the points, is filled in."""
    names = ["x", "y", "z"][:dims]
    v = [F.col("values")[k] for k in range(dims)]
    bounds = points.agg(*[F.min(c).alias(f"lo{k}") for k, c in enumerate(v)], *[F.max(c).alias(f"hi{k}") for k, c in enumerate(v)])
    cell = [F.floor((c - F.col(f"lo{k}")) / interval).cast("int").alias(names[k]) for k, c in enumerate(v)]
    counts = points.join(F.broadcast(bounds)).select(*cell).groupBy(*names).agg(F.count("*").alias("n"))
    grid = bounds
    for k, name in enumerate(names):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0), F.floor((F.col(f"hi{k}") - F.col(f"lo{k}")) / interval).cast("int"))))
    return grid.select(*names).join(counts, names, "left").select(*names, F.coalesce("n", F.lit(0)).alias("n"))


def density_scaled(grid: DataFrame) -> DataFrame:
    """n rescaled to 0..255 by the largest."""
    top = grid.agg(F.max("n").alias("_top"))
    return grid.join(F.broadcast(top)).withColumn("level", F.least(F.lit(255), (F.col("n") * 255.0 / F.greatest(F.col("_top"), F.lit(1))).cast("int"))).drop("_top")


def pixels(points: DataFrame, a: int, b: int, size: int = 400) -> DataFrame:
    """(seq_id, px, py): the cell of each point in a square raster of dimensions a and b."""
    x, y = F.col("values")[a], F.col("values")[b]
    bounds = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    at = lambda v, lo, hi: F.when(F.col(hi) == F.col(lo), 0).otherwise((F.abs(v - F.col(lo)) / ((F.col(hi) - F.col(lo)) / (size - 1))).cast("int"))
    return points.join(F.broadcast(bounds)).select("seq_id", at(x, "x0", "x1").alias("px"), at(y, "y0", "y1").alias("py"))


def raster(points: DataFrame, a: int, b: int, size: int = 400) -> DataFrame:
    return pixels(points, a, b, size).select("px", "py").distinct()


def rectangle(points: DataFrame, a: int, b: int, corner: tuple[int, int], other: tuple[int, int], size: int = 400) -> DataFrame:
    """(seq_id) of the points whose pixel lies in a rectangle dragged in any direction, borders included."""
    inside = lambda c, k: F.col(c).between(min(corner[k], other[k]), max(corner[k], other[k]))
    return pixels(points, a, b, size).where(inside("px", 0) & inside("py", 1)).select("seq_id")
