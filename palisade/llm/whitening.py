"""Whitening of vectors on the leading eigenvectors of their covariance.

The covariance of the distinct vectors is summed on Spark, centred first.  Its eigenvectors
come from contour integrals (FEAST): an interval of eigenvalues is enclosed by a circle, solves
with the shifted covariance at quadrature points on it project a block of vectors onto the
eigenspace of the interval, and Rayleigh-Ritz takes the eigenpairs out of the block, until their
residuals are at rounding level.  The interval is found with inertia counts: by Sylvester's law the
positive pivots of a symmetric elimination of V - s I are the eigenvalues above s.  The same count
says how many pairs the interval must give; with too few the block grows.

What reaches the driver is bounded by the dimension: its sums and its covariance.

Edge cases: rows without a vector, or with a null, NaN or infinite entry are dropped; shorter
vectors count as filled up with zeros to the longest length; equal vectors count once in the fit and
give a row each in the result; null ids are kept; with fewer than `most` eigenvalues above
rounding level (few distinct or short vectors) there are fewer components, without any the
result is empty; entries beyond a long saturate; a deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.plans.storage import stored

MOST = 4
NODES = 8  # quadrature points on the upper half of the circle
RESULT = ("component int, n long, deviation long, whitened double, explained double, "
          "identity_error double")
_PIVOT = (1 + 17 ** 0.5) / 8


def positive_pivots(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are above zero: the signs of the pivots
    of an elimination with complete symmetric pivoting in blocks of one and two."""
    a, above = np.array(matrix, float), 0
    tiny = np.finfo(float).eps * max(1e-300, np.abs(a).max(initial=0.0))
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        one = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        i, j = divmod(int(off.argmax()), len(a))
        if max(diagonal[one], off[i, j]) <= tiny:
            break
        if diagonal[one] >= _PIVOT * off[i, j]:
            above += bool(a[one, one] > 0)
            rest = np.delete(np.arange(len(a)), one)
            column = a[rest, one]
            a = a[np.ix_(rest, rest)] - np.outer(column, column) / a[one, one]
        else:  # an indefinite block: one eigenvalue on each side
            above += 1
            rest = np.delete(np.arange(len(a)), [i, j])
            block = a[np.ix_(rest, [i, j])]
            a = a[np.ix_(rest, rest)] - block @ np.linalg.solve(a[np.ix_([i, j], [i, j])], block.T)
    return above


def _above(v: np.ndarray, s: float) -> int:
    return positive_pivots(v - s * np.eye(len(v)))


def _bracket(v: np.ndarray, number: int, top: float) -> tuple[float, float]:
    """An interval around the eigenvalue with this number from the top."""
    low, high = 0.0, top
    for _ in range(44):
        middle = (low + high) / 2
        if _above(v, middle) >= number:
            low = middle
        else:
            high = middle
    return low, high


def _projected(v: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block after the quadrature of the resolvent around [low, high]."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    total = np.zeros_like(block)
    for x, w in zip(points, weights, strict=True):
        turn = np.exp(1j * (np.pi / 2) * (1 - x))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, block.astype(complex))
        total += (w / 2) * (radius * turn * solved).real
    return total


def interval_pairs(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` eigenvalues in (low, high), falling, and their unit eigenvectors as columns."""
    d, size = len(v), min(len(v), count + max(4, count // 2))
    limit = 64 * np.finfo(float).eps * max(high, np.abs(v).max())
    while True:
        block = np.random.default_rng(5).standard_normal((d, size))
        for _ in range(30):
            q, _ = np.linalg.qr(_projected(v, block, low, high))
            values, turn = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz
            block = q @ turn
            inside = (values > low) & (values < high)
            far = np.linalg.norm(v @ block[:, inside] - block[:, inside] * values[inside], axis=0)
            if inside.sum() == count and far.max(initial=0.0) <= limit * d ** 0.5:
                order = np.flatnonzero(inside)[::-1]
                return values[order], block[:, order] / np.linalg.norm(block[:, order], axis=0)
        if size == d:
            raise RuntimeError("the contour integral misses eigenvalues that the inertia counts")
        size = min(d, 2 * size)


def leading_pairs(v: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The first eigenvalues of a covariance and their eigenvectors, as columns."""
    d = len(v)
    top = float(np.abs(v).sum(axis=1).max(initial=0.0))  # no eigenvalue is above a row sum
    if not top:
        return np.zeros(0), np.zeros((d, 0))
    v = v / top
    most = min(most, _above(v, d * np.finfo(float).eps))
    if not most:
        return np.zeros(0), np.zeros((d, 0))
    number = most
    while True:  # the interval ends in a gap, below a cluster of near-equal eigenvalues
        last, _ = _bracket(v, number, 1 + 1e-9)
        if number == d:
            low = -0.1
            break
        _, following = _bracket(v, number + 1, 1 + 1e-9)
        if last - following > 1e-7:
            low = (last + following) / 2
            break
        number = max(number + 1, _above(v, last - 1e-7))
    values, vectors = interval_pairs(v, low, _bracket(v, 1, 1 + 1e-9)[1] * 1.05 + 1e-12, number)
    vectors = vectors[:, :most]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(most)])
    return values[:most] * top, vectors * sign


def scaled(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and x, the scaled entries, of the rows with a whole vector."""
    rows = vectors.select(F.col(ident).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("vector").isNotNull() & whole).select(
        "vec_id", F.transform("vector", lambda c: F.floor(F.lit(256.0) * c)).alias("x"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column]) if len(column) else np.zeros((0, 0), np.int64)


def _sums(fit: DataFrame, width: int) -> list[int]:
    """The exact sum of every dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [0] * width
        for batch in batches:
            x = _matrix(batch["x"])
            if len(x) and int(np.abs(x.astype(float)).max(initial=0)) * len(x) >= 2 ** 62:
                x = x.astype(object)
            if len(x):
                total = [t + int(s) for t, s in zip(total, x.sum(axis=0), strict=True)]
        yield pd.DataFrame({"i": np.arange(width, dtype=np.int32), "s": [str(t) for t in total]})

    rows = fit.mapInPandas(run, "i int, s string").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row per dimension
    own = {r["i"]: int(r["s"]) for r in rows}
    return [own.get(i, 0) for i in range(width)]


def _moments(fit: DataFrame, of, size: int) -> np.ndarray:
    """The sum over rows of the outer product of of(x) with itself; size ** 2 numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                y = of(_matrix(batch["x"]))
                total += y.T @ y
        i, j = np.triu_indices(size)
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "v": total[i, j]})

    rows = fit.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((size, size))
    out[rows["i"], rows["j"]] = out[rows["j"], rows["i"]] = rows["v"]
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n x - S) ** 2 of every row."""
    most = n * int(np.abs(x.astype(float)).max(initial=0) + 1) + max(map(abs, sums), default=0)
    kind = np.int64 if most ** 2 * max(1, x.shape[1]) < 2 ** 63 else object
    far = n * x.astype(kind) - np.array(sums, kind)
    return [int(t) if t < 2 ** 63 else None for t in (far * far).sum(axis=1)]


def whitened(vectors: DataFrame, most: int = MOST, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for every remaining row of vectors and component: its id, component, n,
    deviation, whitened, explained and identity_error."""
    kind = vectors.schema[ident].dataType.simpleString()
    schema = f"vec_id string, {RESULT}"
    rows = scaled(vectors, ident, vector)
    fit = stored(rows.select("x").distinct())
    n, width = fit.agg(F.count("*"), F.max(F.size("x"))).first()
    if not width:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("vec_id", F.col("vec_id").cast(kind))

    def filled(df: DataFrame) -> DataFrame:
        return df.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))

    fit = stored(filled(fit).distinct()) if fit.where(F.size("x") < width).limit(1).count() else fit
    n = fit.count()
    sums = _sums(fit, width)
    mean = np.array([s / n for s in sums]) if n else np.zeros(width)
    cov = _moments(fit, lambda x: x - mean, width) / max(1, n)
    values, basis = leading_pairs(cov, most)
    basis = basis / np.sqrt(values)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema).withColumn("vec_id", F.col("vec_id").cast(kind))
    error = float(np.abs(_moments(fit, lambda x: (x - mean) @ basis, len(values)) / n - np.eye(len(values))).max())
    explained = values / np.trace(cov)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(values)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["x"])
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].to_numpy(object).repeat(k), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                "n": n, "deviation": pd.Series(deviations(x, n, sums), dtype="Int64").repeat(k).to_numpy(),
                "whitened": ((x - mean) @ basis).ravel(), "explained": np.tile(explained, len(x)), "identity_error": error})

    narrow = filled(rows).withColumn("vec_id", F.col("vec_id").cast("string"))  # keeps null ids whole in pandas
    return narrow.mapInPandas(run, schema).withColumn("vec_id", F.col("vec_id").cast(kind))
