"""Whitening of embeddings on an integer lattice by a randomised range finder.

Every entry c becomes the integer floor(256 c); the fit list holds each distinct vector x
once. Its size n and sums S are exact. The covariance V is never formed: a pass over all
centred rows y = x - S/n multiplies V by a block Q of d x l numbers, as sums of y (y Q)
over tasks that are added up in a tree. The range finder starts from l = components +
`oversample` random directions, makes `passes` power passes with an orthonormal basis each, and
takes the components by Rayleigh-Ritz, whose residuals |V q - e q| over the distance to
the next eigenvalue bound the error of each. If any exceeds `tolerance`, the block is expanded
to the full dimension, where Rayleigh-Ritz is exact. The driver holds d x d numbers at most.

Defined results: rows without a vector, or with a null or non-finite entry, have no result;
neither have vectors of another length than most rows have (of lengths as frequent, the longer).
Repeated rows and ids have a result each. A component without variance (all vectors equal,
or fewer vectors than dimensions) has `whitened` null, and `explained` null if no component has
any; equal eigenvalues give any orthonormal basis of their space. An empty table gives no
rows. Other columns are left out. Entries beyond a long when multiplied become its limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, arrow_map

#: Numbers of a matrix that a task holds at once, and matrices added up by one task of the tree.
AT_ONCE, TOGETHER = 2_000_000, 32


def lattice_points(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id and x of the rows whose vector is whole."""
    c = F.col(column)
    whole = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x: Column = F.transform(c, lambda v: F.floor(v.cast("double") * 256).cast("long"))
    return vectors.where(whole).select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"))


def _matrices(batch: pa.RecordBatch, at: int, d: int):
    """Pieces of a batch's vectors as (rows, matrix of longs)."""
    step = max(1, AT_ONCE // max(d, 1))
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield part, part.column(at).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and sum of each dimension, as integers of any size."""

    def run(batches):
        n, s = 0, [0] * d
        for b in batches:
            for part, x in _matrices(b, 0, d):
                n += part.num_rows
                fits = int(np.abs(x.astype(np.float64)).max(initial=0)) * part.num_rows < 1 << 60
                s = [p + int(q) for p, q in zip(s, (x if fits else x.astype(object)).sum(axis=0), strict=True)]
        yield {"dim": [-1, *range(d)], "s": pa.array([n, *s], pa.decimal128(38, 0))}

    got = {r["dim"]: int(r["s"]) for r in arrow_map(fit, run, "dim int, s decimal(38,0)").groupBy("dim").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(d)]


def summed(df: DataFrame, f, size: int) -> np.ndarray:
    """Sum of the vectors of `size` numbers that f(batches) returns in each task, added up in a tree in the order of tasks."""

    def first(batches):
        yield {"part": [TaskContext.get().partitionId()], "v": pa.array([np.asarray(f(batches), "<f8").tobytes()], pa.binary())}

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("part").to_pylist(), table.column("v").to_pylist(), strict=True))
        total = np.sum([np.frombuffer(v, "<f8") for _, v in rows], axis=0)
        return pa.table({"part": pa.array([rows[0][0] // TOGETHER], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    level, left = arrow_map(df, first, "part long, v binary"), df.rdd.getNumPartitions()
    while left > TOGETHER:
        level = level.groupBy((F.col("part") / TOGETHER).cast("long").alias("_g")).applyInArrow(lambda t: add(t), "part long, v binary")
        left = -(-left // TOGETHER)
    rows = sorted((r["part"], bytes(r["v"])) for r in level.collect())
    return np.sum([np.frombuffer(v, "<f8") for _, v in rows], axis=0) if rows else np.zeros(size)


def times_covariance(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V Q and the trace of V, by one pass over the centred rows."""
    d, width = q.shape

    def run(batches):
        product, squares = np.zeros((d, width)), 0.0
        for b in batches:
            for _, x in _matrices(b, 0, d):
                y = x - mean
                product += y.T @ (y @ q)
                squares += float(np.einsum("ij,ij->", y, y))
        return np.append(product.ravel(), squares)

    total = summed(fit, run, d * width + 1) / n
    return total[:-1].reshape(d, width), float(total[-1])


def rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, their vectors, and each one's residual over the distance to the next eigenvalue."""
    small = q.T @ vq
    e, u = np.linalg.eigh((small + small.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    residual = np.linalg.norm(vq @ u - (q @ u) * e, axis=0)
    apart = np.abs(np.diff(e))
    gap = np.minimum(np.append(apart, np.inf), np.insert(apart, 0, np.inf))
    return e, q @ u, residual / np.maximum(gap, np.finfo(float).tiny)


def principal_components(fit: DataFrame, mean: np.ndarray, n: int, k: int, oversample: int, passes: int, tolerance: float, seed: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Eigenvalues, unit eigenvectors as columns, trace of V, and the width of the block that gave them."""
    d = len(mean)
    k, rng = min(k, d), np.random.default_rng(seed)
    width = min(d, k + oversample)
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    for step in range(passes + 1):
        vq, trace = times_covariance(fit, mean, n, q)
        e, vectors, error = rayleigh_ritz(q, vq)
        if width == d or step and (error[:k] <= tolerance).all():
            break
        q = np.linalg.qr(vq)[0]
    else:
        width = d
        # the basis found so far and random directions beside it
        q = np.linalg.qr(np.hstack([vectors, rng.standard_normal((d, d - vectors.shape[1]))]))[0]
        vq, trace = times_covariance(fit, mean, n, q)
        e, vectors, _ = rayleigh_ritz(q, vq)
    vectors = vectors[:, :k] / np.linalg.norm(vectors[:, :k], axis=0)
    largest = np.abs(vectors).argmax(axis=0)
    return np.maximum(e[:k], 0.0), vectors * np.sign(vectors[largest, range(k)]), trace, width


def identity_error(fit: DataFrame, mean: np.ndarray, n: int, turn: np.ndarray) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    d, k = turn.shape

    def run(batches):
        square, line = np.zeros((k, k)), np.zeros(k)
        for b in batches:
            for _, x in _matrices(b, 0, d):
                w = (x - mean) @ turn  # rows are centred already; what rounding leaves of their mean is taken off below
                square += w.T @ w
                line += w.sum(axis=0)
        return np.append(square.ravel(), line)

    total = summed(fit, run, k * k + k) / n
    left = total[k * k :]
    return float(np.abs(total[: k * k].reshape(k, k) - np.outer(left, left) - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int] | np.ndarray:
    """Sum over dimensions of (n x - S)^2, exact."""
    bound = n * int(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0) + n
    wide = bound * bound * max(1, len(sums)) >= 1 << 62
    off = (x.astype(object) if wide else x) * n - np.array(sums, object if wide else np.int64)
    return (off * off).sum(axis=1)


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 4, oversample: int = 12, passes: int = 3, tolerance: float = 1e-12, seed: int = 11) -> DataFrame:
    """A row for each whole vector and component: exact deviation (null beyond 38 digits), whitened coordinate, share of variance."""
    spark = vectors.sparkSession
    points = lattice_points(vectors, id_column, column)
    lengths = points.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d"))
    most = lengths.first()
    if most is None or most["d"] == 0:
        return spark.createDataFrame([], RESULT)
    d = most["d"]
    points = points.where(F.size("x") == d)
    tables = Tables()
    fit = tables.cut(points.select("x").distinct(), "fit")
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])
    e, vecs, trace, _ = principal_components(fit, mean, n, components, oversample, passes, tolerance, seed)
    k = len(e)
    varied = e > max(e[0], trace / d) * d * np.finfo(float).eps
    turn = vecs[:, varied] / np.sqrt(e[varied])
    off = identity_error(fit, mean, n, turn) if varied.any() else None
    tables.clear()
    explained = [float(v / trace) if trace > 0 else None for v in e]
    at = np.flatnonzero(varied)
    limit = 10**38

    def run(batches):
        for b in batches:
            for part, x in _matrices(b, 1, d):
                rows = part.num_rows
                w = np.full((rows, k), np.nan)
                w[:, at] = (x - mean) @ turn
                far = [v if abs(v) < limit else None for v in map(int, deviations(x, n, sums))]
                yield {
                    "vec_id": part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                    "n": np.full(rows * k, n),
                    "deviation": pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(rows), k))),
                    "whitened": pa.array(w.ravel(), from_pandas=True),
                    "explained": pa.array(explained * rows, pa.float64()),
                    "identity_error": pa.array([off] * (rows * k), pa.float64()),
                }

    return arrow_map(points, run, RESULT)
