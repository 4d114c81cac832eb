"""Convolution of long series by a Fourier transform that no task holds whole.

A transform of N = P * P points (t = P * i + j) is P transforms of P points down the columns j, a turn of each value by
exp(-2 pi i j k / N), and P transforms along the rows k. Columns and rows are dealt to tasks in bands of WIDTH and exchanged as
tiles, so a task holds WIDTH * P numbers, which is WIDTH times the square root of a series' length. Series and kernel go the same
way, meet row by row, and the product comes back by the inverse of each step: n log n work and three exchanges.

Series are transformed in sizes of powers of four, each in the smallest that holds it and its kernel without wrapping round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.tables import materialize

#: Columns or rows of a band at the most.
WIDTH = 64
#: Bytes of results that go out together.
HELD = 32 << 20


def _width(p: int) -> int:
    return min(p, WIDTH)


def _tiles(matrix: np.ndarray, width: int) -> list[bytes]:
    """Bands of `width` rows of a matrix."""
    return [np.ascontiguousarray(matrix[a : a + width]).tobytes() for a in range(0, len(matrix), width)]


def _turn(p: int, columns: np.ndarray, sign: int) -> np.ndarray:
    """(k, column): the turns between the two steps of a transform."""
    return np.exp(sign * 2j * np.pi * (np.outer(np.arange(p), columns) % (p * p)) / (p * p))


def _gathered(batches: Iterator[pa.RecordBatch], keys: int, names: list[str], types: list[pa.DataType], one) -> Iterator[pa.RecordBatch]:
    """What `one` (a batch and a row's number) gives for each row, columns of equal length, behind the row's first `keys` columns:
    rows go out together, up to about HELD bytes."""
    for batch in batches:
        at, parts, held = [], [], 0
        for i in range(len(batch)):
            found = [pa.array(c, t) for c, t in zip(one(batch, i), types, strict=True)]
            at.append(np.full(len(found[0]), i))
            parts.append(found)
            held += sum(c.nbytes for c in found)
            if held > HELD or i + 1 == len(batch):
                own = [c.take(pa.array(np.concatenate(at))) for c in batch.columns[:keys]]
                yield pa.RecordBatch.from_arrays([*own, *[pa.concat_arrays([p[k] for p in parts]) for k in range(len(types))]], [*batch.schema.names[:keys], *names])
                at, parts, held = [], [], 0


def _columns(p: int, keys: int):
    """For mapInArrow over (keys, band, ts, us): a band of columns' part of the tiles of every band of rows."""
    width = _width(p)

    def one(batch: pa.RecordBatch, i: int) -> tuple:
        band = batch.column("band")[i].as_py()
        t, own = np.asarray(batch.column("ts")[i].values), np.zeros((p, width))
        own[t // p, t % p - band * width] = np.asarray(batch.column("us")[i].values)
        tiles = _tiles(np.fft.fft(own, axis=0) * _turn(p, band * width + np.arange(width), -1), width)
        return np.arange(len(tiles)), np.full(len(tiles), band), tiles

    return lambda batches: _gathered(batches, keys, ["row", "column", "tile"], [pa.int64(), pa.int64(), pa.binary()], one)


def _spectra(df: DataFrame, keys: list[str], p: int) -> DataFrame:
    """(keys, row, tiles): every band of rows before the second step, its tiles in the order of the columns."""
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in df.schema.fields if f.name in keys)
    banded = df.groupBy(*keys, F.floor(F.col("t") % p / _width(p)).alias("band")).agg(F.collect_list(F.struct("t", "u")).alias("_p"))
    banded = banded.select(*keys, "band", F.transform("_p", lambda x: x["t"]).alias("ts"), F.transform("_p", lambda x: x["u"]).alias("us"))
    tiles = banded.mapInArrow(_columns(p, len(keys)), f"{head}row long, column long, tile binary")
    packed = F.array_sort(F.collect_list(F.struct("column", "tile")))
    return tiles.groupBy(*keys, "row").agg(packed.alias("tiles"))


def _band(tiles, p: int, width: int) -> np.ndarray:
    """(rows of the band, p): tiles side by side; columns without a tile are zero."""
    out = np.zeros((width, p), complex)
    for tile in tiles:
        a = tile["column"] * width
        out[:, a : a + width] = np.frombuffer(tile["tile"], complex).reshape(width, width)
    return out


def _products(p: int, keys: int):
    """For mapInArrow over (keys, row, tiles of the series, tiles of the kernel): the product's tiles for every band of columns."""
    width = _width(p)

    def one(batch: pa.RecordBatch, i: int) -> tuple:
        first, second = (np.fft.fft(_band(batch.column(c)[i].as_py(), p, width), axis=1) for c in ("tiles", "kernel"))
        row = batch.column("row")[i].as_py()
        tiles = _tiles((np.fft.ifft(first * second, axis=1) * _turn(p, row * width + np.arange(width), 1).T).T, width)
        return np.arange(len(tiles)), np.full(len(tiles), row), tiles

    return lambda batches: _gathered(batches, keys, ["band", "row", "tile"], [pa.int64(), pa.int64(), pa.binary()], one)


def _values(p: int, keys: int):
    """For mapInArrow over (keys, band, tiles by row, n): (keys, t, y) of the columns of a band."""
    width = _width(p)

    def one(batch: pa.RecordBatch, i: int) -> tuple:
        step = np.zeros((p, width), complex)
        for tile in batch.column("tiles")[i].as_py():
            a = tile["row"] * width
            step[a : a + width] = np.frombuffer(tile["tile"], complex).reshape(width, width).T
        y = np.fft.ifft(step, axis=0).real
        t = np.arange(p)[:, None] * p + batch.column("band")[i].as_py() * width + np.arange(width)
        inside = t < batch.column("n")[i].as_py()
        return t[inside], y[inside]

    return lambda batches: _gathered(batches, keys, ["t", "y"], [pa.int64(), pa.float64()], one)


def _of_size(rows: DataFrame, kernel: DataFrame, keys: list[str], p: int) -> DataFrame:
    """The convolution of series (keys, t, u, n) with a kernel (lag, h) in transforms of p * p points."""
    head = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name in keys)
    bands = _spectra(rows.select(*keys, "t", "u"), keys, p)
    own = kernel.where(F.col("lag").between(-(p * p) // 2 + 1, p * p // 2)).select(F.pmod(F.col("lag"), F.lit(p * p)).alias("t"), F.col("h").alias("u"))
    weights = _spectra(own.groupBy("t").agg(F.sum("u").alias("u")), [], p).select(F.col("row").alias("_row"), F.col("tiles").alias("kernel"))
    both = bands.join(weights, F.col("row") == F.col("_row")).select(*keys, "row", "tiles", "kernel")
    tiles = both.mapInArrow(_products(p, len(keys)), f"{head}band long, row long, tile binary")
    packed = F.array_sort(F.collect_list(F.struct("row", "tile")))
    lengths = rows.groupBy(*keys).agg(F.first("n").alias("n"))
    columns = tiles.groupBy(*keys, "band").agg(packed.alias("tiles")).join(lengths, keys).select(*keys, "band", "tiles", "n")
    return columns.mapInArrow(_values(p, len(keys)), f"{head}t long, y double")


def convolve(rows: DataFrame, keys: list[str], t: str, u: str, kernel: DataFrame) -> DataFrame:
    """(keys, t, y): y_t is the sum of h_lag u_(t - lag) over a kernel (lag, h), for every t from 0 to each series' last.

    Positive lags look back, negative ones ahead, so a kernel with both is one of two directions. Lags are unique or added up;
    those beyond a series' length meet nothing. t is a whole number from 0; missing ones count as zero. No rows give none.
    """
    own = rows.select(*keys, F.col(t).cast("long").alias("t"), F.col(u).cast("double").alias("u"))
    sized = own.groupBy(*keys).agg((F.max("t") + 1).alias("n"))
    # 4^q points hold the series, and a kernel as long on either side, without wrapping round.
    q: Column = F.ceil(F.log2(F.col("n") * 2) / 2 - 1e-9).cast("int")
    own = materialize(own.join(sized.withColumn("q", q), keys), "conv-series")
    out = None
    for (size,) in sorted(own.select("q").distinct().collect()):
        part = _of_size(own.where(F.col("q") == size), kernel, keys, 2**size)
        out = part if out is None else out.unionByName(part)
    return own.select(*keys, "t", F.col("u").alias("y")) if out is None else out


def pole_kernel(lags: DataFrame, poles: list[tuple[complex, complex]], lag: str = "id") -> DataFrame:
    """(lag, h) of a diagonal state space model: h is the real part of the sum of c a^lag over poles (a, c), for the lags of a table."""
    total = F.lit(0.0)
    for a, c in poles:
        size, angle, weight, phase = abs(a), float(np.angle(a)), abs(c), float(np.angle(c))
        total = total + weight * F.pow(F.lit(size), F.col(lag)) * F.cos(F.col(lag) * angle + phase)
    return lags.select(F.col(lag).cast("long").alias("lag"), total.alias("h"))
