"""Whitening of embeddings with a covariance by polarisation.

Vectors become whole numbers, and the fit list has each different vector once. Of every dimension, and of the sum of every pair of
dimensions, the tasks add up squares of centred values; since var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of these
variances give all covariances. Everything up to there is exact: with n vectors, sums S and the whole number c next to S/n,
n*x - S = n*(x - c) - r where r = S - n*c, so squares of the small numbers x - c are added and the remainders r are put in after.
The matrix is assembled on the driver, which holds d*d numbers for d dimensions and nothing that grows with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.store import columns, materialize, with_carried

SCALE, SHIFT = 64, 1_000_000
#: Larger entries (times SCALE) count as not finite, so that numbers fit.
LARGEST = 1 << 60
COMPONENTS = 16
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")
_BLOCK = 2048
#: Sums have two parts, so that whole numbers of any size fit decimals.
_PART = 10**18
_DIGITS = pa.decimal128(38, 0)


def quantised(vector: Column) -> Column:
    """floor(64 c) + 1,000,000 of each entry; null if the vector is null or an entry is null, not finite, or beyond LARGEST."""
    wide = vector.cast("array<double>")
    usable = F.forall(wide, lambda c: F.coalesce(F.abs(c * SCALE) < F.lit(float(LARGEST)), F.lit(False)))
    return F.when(usable, F.transform(wide, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    return np.asarray(column.flatten()).astype(np.int64, copy=False).reshape(len(column), -1)


def _safe(rows: np.ndarray, power: int) -> np.ndarray:
    """The rows as they are if a sum of powers of (twice) their entries fits 63 bits, else as Python's numbers."""
    top = int(np.abs(rows).max(initial=0))
    return rows if (2 * top) ** power * max(1, len(rows)) < 1 << 62 else rows.astype(object)


def _totals(run: Callable[[np.ndarray], np.ndarray], size: int) -> Callable:
    """For mapInArrow: the sum of what `run` gives for each block of rows, as one row a slot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros(size, object), False
        for batch in batches:
            rows = _matrix(batch.column(0)) if len(batch) else None
            for a in range(0, len(batch), _BLOCK):
                any_rows = True
                total += run(rows[a : a + _BLOCK]).astype(object)
        if any_rows:
            parts = [divmod(int(x), _PART) for x in total]
            columns = [pa.array(np.arange(size, dtype=np.int64)), *[pa.array([Decimal(p[k]) for p in parts], _DIGITS) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "high", "low"])

    return task


def _collected(fit: DataFrame, run: Callable, size: int) -> list[int]:
    """The exact totals over all rows of the fit list, one a slot: `size` rows come to the driver."""
    sums = fit.mapInArrow(_totals(run, size), "slot long, high decimal(38,0), low decimal(38,0)").groupBy("slot").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = [0] * size
    for r in sums.collect():
        out[r.slot] = int(r.high) * _PART + int(r.low)
    return out


def _counts(rows: np.ndarray) -> np.ndarray:
    """How many rows, and their sums."""
    return np.concatenate([[len(rows)], _safe(rows, 1).sum(axis=0)])


def _squares(center: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Sums of squares of each dimension and, behind it, of its sums with the later ones: dimension by dimension."""

    def run(rows: np.ndarray) -> np.ndarray:
        z, out = _safe(rows - center, 2), []
        for i in range(z.shape[1]):
            sums = z[:, i : i + 1] + z[:, i:]
            sums[:, 0] = z[:, i]
            out.append((sums * sums).sum(axis=0))
        return np.concatenate(out)

    return run


def covariance(squares: list[int], remainders: list[int], n: int) -> np.ndarray:
    """All covariances (divisor n) from sums of squares of x - c, whose sums are the remainders: exact until the last division."""
    d = len(remainders)
    starts = [i * d - i * (i - 1) // 2 for i in range(d)]
    # n * n times each variance.
    of_sum = lambda i, j: n * squares[starts[i] + j - i] - (remainders[i] + (remainders[j] if j != i else 0)) ** 2
    own = [of_sum(i, i) for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = own[i] / (n * n)
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (of_sum(i, j) - own[i] - own[j]) / (2 * n * n)
    return out


class Model:
    """Centres, remainders and weights of the components."""

    def __init__(self, n: int, sums: list[int], squares: list[int], center: list[int], most: int):
        self.n, self.center = n, np.array(center, np.int64)
        self.remainders = [s - n * c for s, c in zip(sums, center, strict=True)]
        self.rest = np.array([r / n for r in self.remainders])
        self.values, self.weights, self.explained, self.identity_error = np.zeros(0), np.zeros((len(sums), 0)), np.zeros(0), 0.0
        v = covariance(squares, self.remainders, n)
        if np.trace(v) > 0:
            values, vectors = np.linalg.eigh(v)
            values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
            alive = values > values[0] * len(sums) * np.finfo(float).eps
            self.values, self.weights = values[alive], vectors[:, alive] / np.sqrt(values[alive])
            self.explained = self.values / np.trace(v)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.center).astype(float) - self.rest) @ self.weights

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over dimensions of (n*x - S)^2; null with more than 38 digits."""
        z, r = x - self.center, max(map(abs, self.remainders), default=0)
        if (self.n * int(np.abs(z).max(initial=0)) + r) ** 2 * max(1, z.shape[1]) < 1 << 62:
            y = z * self.n - np.array(self.remainders, np.int64)
            return pa.array((y * y).sum(axis=1)).cast(_DIGITS)
        y = z.astype(object) * self.n - np.array(self.remainders, object)
        return pa.array([Decimal(int(t)) if t < 10**38 else None for t in (y * y).sum(axis=1)], _DIGITS)


def _moments(model: Model) -> Callable:
    """For mapInArrow: sums of the whitened values, and of their products, one row a slot."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.weights.shape[1]
        total = np.zeros(k + k * k)
        for batch in batches:
            if len(batch):
                w = model.whitened(_matrix(batch.column(0)))
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], ["slot", "total"])

    return task


def fit_model(fit: DataFrame, d: int, most: int = COMPONENTS) -> Model | None:
    """Fit on different vectors (x: array<long>) of d dimensions; None without a dimension.

    Components whose eigenvalue is zero up to rounding (fewer vectors than dimensions, say) can't be whitened and are left out.
    """
    if not d:
        return None
    n, *sums = _collected(fit, _counts, d + 1)
    center = [(2 * s + n) // (2 * n) for s in sums]
    squares = _collected(fit, _squares(np.array(center, np.int64)), d * (d + 1) // 2)
    model = Model(n, sums, squares, center, most)
    k = model.weights.shape[1]
    found = np.zeros(k + k * k)
    for r in fit.mapInArrow(_moments(model), "slot long, total double").groupBy("slot").agg(F.sum("total").alias("total")).collect():
        found[r.slot] = r.total / n
    mean, products = found[:k], found[k:].reshape(k, k)
    model.identity_error = float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))
    return model


def _rows(model: Model | None, carried: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.weights.shape[1] if model else 0
        for batch in batches:
            if not k or not len(batch):
                continue
            x = _matrix(batch.column(carried))
            again = pa.array(np.repeat(np.arange(len(x)), k))
            number = np.tile(np.arange(k), len(x))
            constant = [pa.array(np.full(len(number), model.n, np.int64)), model.deviations(x).take(again), pa.array(model.whitened(x).ravel())]
            last = [pa.array(model.explained[number]), pa.array(np.full(len(number), model.identity_error))]
            own = [c.take(again) for c in batch.columns[:carried]]
            names = [*batch.schema.names[:carried], "_component", "_n", "_deviation", "_whitened", "_explained", "_error"]
            yield pa.RecordBatch.from_arrays([*own, pa.array((number + 1).astype(np.int32)), *constant, *last], names)

    return run


def whiten(table: DataFrame, vector_col: str = "embedding", carry: tuple[str, ...] = ("vec_id",), most: int = COMPONENTS, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """Whiten vectors by the leading components of their covariance over the different vectors.

    Returns a row for each usable row and component (numbered from 1 by falling eigenvalue, `most` at the most): the columns in
    `carry`, component, n (different vectors), deviation (decimal; sum over dimensions of (n*x - S)^2, exact; null with more than
    38 digits), whitened, explained (the eigenvalue's share of the trace), identity_error (how far the covariance of the whitened
    different vectors, as measured, is from the identity).

    Rows whose vector is null or holds a null, an infinite or NaN entry, or one beyond LARGEST, are left out, and so are rows whose
    vector has another length than most different vectors have (of equally frequent lengths the greater counts). Repeated vectors
    count once in the fit and give rows each. Components without variance are left out: with one different vector, or all
    alike, and for an empty table, nothing is returned. Of equal eigenvalues any basis is right; it is the same for all rows. Other
    columns are ignored, whatever their names; of carried columns with the names above the results win, unless `results` gives others.
    """
    own = columns(carry)
    rows = table.select(*[c.alias(f"_c{i}") for i, c in enumerate(own.values())], quantised(F.col(f"`{vector_col}`")).alias("x")).where(F.col("x").isNotNull())
    fit = materialize(rows.select("x").distinct(), "whiten-fit")
    lengths = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 0
    model = fit_model(fit.where(F.size("x") == d), d, most)
    rows = rows.where(F.size("x") == d)
    types = "_component int, _n long, _deviation decimal(38,0), _whitened double, _explained double, _error double"
    return with_carried(rows, {c: F.col(f"_c{i}") for i, c in enumerate(own)}, [F.col("x")], _rows(model, len(own)), types, results)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `embeddings`, whitened; a deviation beyond 63 bits would be null here."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening}
