"""Whitening of embeddings by the leading components of their covariance.

Sums and centred products are made in tasks, as whole numbers, so they are exact and the same whatever the partitions.
What comes to the driver is one matrix of the vectors' dimension. It is brought to tridiagonal form by Householder
reflections; bisection by Sturm counts gives its leading eigenvalues, inverse iteration their vectors, which are made
orthogonal again inside clusters of close eigenvalues; the reflections take them back. The projection is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

#: Components that are returned, if there are as many.
COMPONENTS = 8
#: Entries become whole numbers by this scale and shift; beyond LARGEST either way they count as LARGEST.
SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**50
#: Rows that are worked on at a time.
ROWS = 4096
#: Eigenvalues closer than this share of the matrix' norm are one cluster.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the reflections' vectors (rows, unit or zero) of a symmetric matrix."""
    a, n = a.astype(np.float64).copy(), len(a)
    reflections = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1 :, k]
        scale = np.abs(x).max()
        if not scale or not np.abs(x[1:]).max():
            continue
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflections[k, k + 1 :] = v
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        column = x - 2 * v * (v @ x)
        a[k + 1 :, k] = a[k, k + 1 :] = column
    return a.diagonal().copy(), a.diagonal(1).copy(), reflections


def _larger(d: np.ndarray, e2: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues are above each of `x`: positive pivots of the matrix less x."""
    count, q = np.zeros(len(x), np.int64), np.ones(len(x))
    for i in range(len(d)):
        q = d[i] - x - (e2[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < least, -least, q)
        count += q > 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, by bisection down to neighbouring numbers."""
    radius = np.append(np.abs(e), 0) + np.append(0, np.abs(e))
    low, high = (d - radius).min(), (d + radius).max()
    norm = max(abs(low), abs(high), np.finfo(float).tiny)
    least, e2 = np.finfo(float).eps * norm * 1e-8 + np.finfo(float).tiny, e * e
    lows, highs, wanted = np.full(k, low - 1e-12 * norm), np.full(k, high + 1e-12 * norm), np.arange(1, k + 1)
    for _ in range(200):
        middle = (lows + highs) / 2
        if ((middle <= lows) | (middle >= highs)).all():
            break
        above = _larger(d, e2, middle, least) >= wanted
        lows, highs = np.where(above, middle, lows), np.where(above, highs, middle)
    return (lows + highs) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    """The tridiagonal system (T - shift) x = right, by elimination with row exchanges."""
    n = len(d)
    diagonal, upper, second, x = d - shift, np.append(e, 0.0), np.zeros(n), right.copy()
    for i in range(n - 1):
        below = e[i]
        if abs(below) > abs(diagonal[i]):  # exchange rows i and i + 1
            factor = diagonal[i] / below
            diagonal[i], upper[i], second[i], nxt, after = below, diagonal[i + 1], upper[i + 1], upper[i], upper[i + 1]
            diagonal[i + 1], upper[i + 1] = nxt - factor * upper[i], -factor * after
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(diagonal[i]) < least:
                diagonal[i] = least
            factor = below / diagonal[i]
            diagonal[i + 1] -= factor * upper[i]
            x[i + 1] -= factor * x[i]
    for i in range(n - 1, -1, -1):
        pivot = diagonal[i] if abs(diagonal[i]) >= least else np.copysign(least, diagonal[i])
        x[i] -= upper[i] * x[i + 1] if i + 1 < n else 0.0
        x[i] -= second[i] * x[i + 2] if i + 2 < n else 0.0
        x[i] /= pivot
        if abs(x[i]) > 1e250:  # only the direction counts
            x /= abs(x[i])
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of a tridiagonal matrix by inverse iteration; in a cluster each is kept orthogonal
    to those before it."""
    n, norm = len(d), max(np.abs(d).max() + 2 * (np.abs(e).max() if len(e) else 0), np.finfo(float).tiny)
    least, dice, found = np.finfo(float).eps * norm, np.random.default_rng(7), np.zeros((n, len(values)))
    first = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        x = dice.standard_normal(n)
        for _ in range(5):
            x = _solve(d, e, value, x / np.linalg.norm(x), least)
            x /= np.abs(x).max()
            for _ in range(2):
                x -= found[:, first:k] @ (found[:, first:k].T @ x)
        found[:, k] = x / np.linalg.norm(x)
    return found


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    k = min(k, len(matrix))
    scale = np.abs(matrix).max() if len(matrix) else 0.0
    if not scale:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    d, e, reflections = tridiagonal(matrix / scale)
    values = leading_values(d, e, k)
    vectors = leading_vectors(d, e, values)
    for v in reflections[::-1]:
        vectors -= 2 * np.outer(v, v @ vectors)
    return values * scale, vectors


def _matrices(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows in parts, with their vectors as whole numbers in doubles."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            entries = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
            yield part, np.clip(np.floor(SCALE * entries), -LARGEST, LARGEST)


def _whole(values: np.ndarray) -> list[int]:
    return [int(x) for x in values.reshape(-1)]


def _exact_products(centred: np.ndarray) -> np.ndarray:
    """X'X of whole numbers as Python integers. Products of doubles are exact while their sums stay below 2**53, so
    rows go through it in parts that do; rows with larger numbers are multiplied as integers."""
    largest = np.abs(centred).max(initial=1.0)
    if largest * largest >= 2.0**52:
        rows = centred.astype(object)
        for i in range(len(rows)):
            rows[i] = [int(x) for x in centred[i]]
        return rows.T @ rows
    step, total = max(1, int(2.0**53 / (largest * largest)) - 1), 0
    for start in range(0, len(centred), step):
        part = centred[start : start + step]
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


class Whitening:
    """What a fit gives: the number of vectors, their sums (Python integers of x), components, eigenvalues, trace."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        # centres of x without the shift: a whole part, and the rest, so that differences keep all their digits
        shifted = [s - SHIFT * n for s in sums]
        self.middle = np.array([float(s // n) for s in shifted]) if n else np.zeros(len(sums))
        self.rest = np.array([(s % n) / n for s in shifted]) if n else np.zeros(len(sums))
        self.projection = vectors / np.sqrt(values) if len(values) else vectors

    def project(self, unshifted: np.ndarray) -> np.ndarray:
        return ((unshifted - self.middle) - self.rest) @ self.projection


def finite_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Ids and vectors (`v`) whose entries are all there and finite and that have the most frequent length but zero
    (of equally frequent ones the greatest), and that length; 0 if there are none."""
    fit = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = rows.filter(fit).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("size")).count().filter("size > 0").orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    dimension = lengths[0]["size"] if lengths else 0
    return rows.filter(F.size("v") == dimension), dimension


def _sum_numbers(df: DataFrame, function) -> dict[tuple[int, int], int]:
    """Sums by place of the whole numbers (i, j, text) that tasks make; there are as many places as a matrix has."""
    parts = map_arrow(df, function, "i int, j int, value string")
    # a number may be longer than a decimal: it is summed in pieces of 2**30
    pieces = parts.select("i", "j", F.posexplode(F.split("value", ",")).alias("piece", "part"))
    sums = pieces.groupBy("i", "j", "piece").agg(F.sum(F.col("part").cast("decimal(20,0)")).alias("value"))
    found: dict[tuple[int, int], int] = {}
    for r in sums.collect():
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + (int(r["value"]) << 30 * r["piece"])
    return found


def _digits(value: int) -> str:
    """Pieces of 30 bits, all with the sign of `value`, the lowest first."""
    sign, value, out = -1 if value < 0 else 1, abs(value), []
    while value or not out:
        out.append(str(sign * (value & (1 << 30) - 1)))
        value >>= 30
    return ",".join(out)


def fit_whitening(vectors: DataFrame, dimension: int, components: int = COMPONENTS) -> Whitening:
    """The components of `vectors` (column `v`, all of one dimension). Two passes: sums, then products about the means.
    Components whose eigenvalue is zero, as far as doubles tell, are left out: nothing can be scaled by them."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dimension
        for _, x in _matrices(batches, dimension):
            n += len(x)
            if np.abs(x).max(initial=0.0) * len(x) < 2.0**53:
                new = _whole(x.sum(axis=0))
            else:
                new = [sum(_whole(x[:, j])) for j in range(dimension)]
            total = [a + b for a, b in zip(total, new, strict=True)]
        numbers = [n, *total]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dimension), pa.int32()), pa.array([0] * len(numbers), pa.int32()), pa.array(map(_digits, numbers))], names=["i", "j", "value"])

    found = _sum_numbers(vectors.select("v"), sums)
    n = found.get((-1, 0), 0)
    totals = [found.get((i, 0), 0) for i in range(dimension)]
    if not n:
        return Whitening(0, [0] * dimension, np.zeros(0), np.zeros((dimension, 0)), 0.0)
    middle = np.array([float(s // n) for s in totals])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, x in _matrices(batches, dimension):
            total = total + _exact_products(x - middle)
        if not isinstance(total, int):
            i, j = np.triu_indices(dimension)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([_digits(int(v)) for v in total[i, j]])], names=["i", "j", "value"])

    raw = _sum_numbers(vectors.select("v"), products)
    covariance = np.zeros((dimension, dimension))
    left = [s - n * (s // n) for s in totals]  # sums about the whole centres
    for (i, j), value in raw.items():
        covariance[i, j] = covariance[j, i] = (n * value - left[i] * left[j]) / (n * n)  # one rounding, as Python divides
    values, components_ = leading_components(covariance, components)
    trace = float(np.trace(covariance))
    usable = values > dimension * np.finfo(float).eps * max(values.max(initial=0.0), np.finfo(float).tiny)
    return Whitening(n, [s + SHIFT * n for s in totals], values[usable], components_[:, usable], trace)


def identity_error(vectors: DataFrame, dimension: int, model: Whitening) -> float:
    """The largest entry, without its sign, of the whitened vectors' covariance less the identity."""
    k = len(model.values)
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for _, x in _matrices(batches, dimension):
            z = sent.value.project(x)
            total += z.sum(axis=0)
            products += z.T @ z
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.vstack([products, total]).reshape(-1))], names=["i", "j", "value"])

    sums = np.zeros((k + 1, k))
    for r in map_arrow(vectors.select("v"), run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        sums[r["i"], r["j"]] = r["value"]
    mean = sums[k] / model.n
    return float(np.abs(sums[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def _deviations(x: np.ndarray, n: int, shifted: list[int]) -> list[int | None]:
    """Sums over dimensions of (n x - S)**2, exact; None where that is beyond a long."""
    largest = max(float(np.abs(x).max(initial=0.0)) * n, *map(abs, shifted)) * 2
    if largest * largest * x.shape[1] < 2.0**62:
        apart = x.astype(np.int64) * n - np.array(shifted, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, shifted, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row a remaining row and component: the id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained and identity_error.

    Null vectors, and those with a null, NaN or infinite entry, are dropped; so are empty ones and those of another
    length than most have. Entries beyond 2**50/1024 count as that. Repeated rows and null ids stay, each for itself;
    equal eigenvalues give some orthonormal vectors of their space, the same for all rows; components without variance
    are left out, so vectors that are all equal (or one, or none) give no rows. A deviation beyond a long is null.
    Other columns are ignored, whatever their names. The driver holds one matrix of the dimension.
    """
    vectors, dimension = finite_vectors(rows, id_col, vector_col)
    id_type = vectors.schema["id"].dataType
    names = [(id_col, id_type), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField(name, kind) for name, kind in names])
    model = fit_whitening(vectors, dimension, components) if dimension else None
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error, k = identity_error(vectors, dimension, model), len(model.values)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = sent.value
        shifted, explained = [s - SHIFT * fit.n for s in fit.sums], fit.values / fit.trace
        for part, x in _matrices(batches, dimension):
            rows_, z = len(x), fit.project(x)
            at = pa.array(np.repeat(np.arange(rows_), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(at), pa.array(np.tile(np.arange(1, k + 1), rows_), pa.int32()), pa.array(np.full(rows_ * k, fit.n)), pa.array(_deviations(x, fit.n, shifted), pa.int64()).take(at),
                 pa.array(z.reshape(-1)), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * k, error))],
                names=schema.names,
            )

    return map_arrow(vectors, run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
