"""Signal operators on array columns: Butterworth filters, resampling, cropping, noise.

A series is one row with an array of samples. Filters carry a state from sample to sample, which array expressions can only do by
copying their output at each step, so they run over Arrow batches: all series of a batch that have one length go through the
recurrence side by side. Everything else is an expression. Nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators.series import LCG_M, draw


def butterworth(order: int, cut: float | tuple[float, float], rate: float, kind: str = "lowpass") -> np.ndarray:
    """Second-order sections (b0, b1, b2, 1, a1, a2) of a digital Butterworth filter: `lowpass`, `highpass` or `bandpass` (two
    cuts, 2 * order poles).

    The poles of the analogue prototype lie evenly on the left half of the unit circle; they are moved to the cut frequency
    (prewarped), brought to the z-plane by the bilinear transform, and paired with their conjugates. The zeros lie where nothing
    is to pass: at half the rate, at 0, or at both.
    """
    edges = np.atleast_1d(np.asarray(cut, float))
    if (edges <= 0).any() or (edges >= rate / 2).any() or len(edges) != (2 if kind == "bandpass" else 1) or kind not in ("lowpass", "highpass", "bandpass"):
        raise ValueError(f"no {kind} filter for {cut} at a rate of {rate}")
    warped = 2 * rate * np.tan(np.pi * edges / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind == "lowpass":
        poles = poles * warped[0]
    elif kind == "highpass":
        poles = warped[0] / poles
    else:
        centre, width = math.sqrt(warped[0] * warped[1]), warped[1] - warped[0]
        half = poles * width / 2
        root = np.sqrt(half * half - centre * centre)
        poles = np.concatenate([half + root, half - root])
    z_poles = (2 * rate + poles) / (2 * rate - poles)
    real = sorted((p.real for p in z_poles if abs(p.imag) < 1e-12), key=abs)
    pairs = [np.array([1.0, -2 * p.real, abs(p) ** 2]) for p in sorted(z_poles[z_poles.imag >= 1e-12], key=abs)]
    pairs = [np.poly(real[i : i + 2]) for i in range(0, len(real), 2)] + pairs
    out = []
    for a in pairs:
        b = np.poly([1.0, -1.0] if kind == "bandpass" else [-1.0 if kind == "lowpass" else 1.0] * (len(a) - 1))
        out.append([*np.pad(b, (0, 3 - len(b))), *np.pad(a, (0, 3 - len(a)))])
    sections = np.array(out)
    at = {"lowpass": 0.0, "highpass": rate / 2, "bandpass": rate / np.pi * math.atan(math.sqrt(warped[0] * warped[-1]) / (2 * rate))}[kind]
    sections[0, :3] /= abs(frequency_response(sections, np.array([at]), rate)[0])
    return sections


def frequency_response(sections: np.ndarray, at: np.ndarray, rate: float) -> np.ndarray:
    """The complex response at frequencies."""
    z = np.exp(-2j * np.pi * np.asarray(at, float) / rate)
    out = np.ones(len(z), complex)
    for b0, b1, b2, a0, a1, a2 in sections:
        out *= (b0 + b1 * z + b2 * z * z) / (a0 + a1 * z + a2 * z * z)
    return out


def gain(sections: np.ndarray, at: Column, rate: float) -> Column:
    """The size of the response at a frequency column."""
    w = at * (2 * math.pi / rate)

    def squared(a: float, b: float, c: float) -> Column:
        return F.pow(a + b * F.cos(w) + c * F.cos(2 * w), 2) + F.pow(b * F.sin(w) + c * F.sin(2 * w), 2)

    out = F.lit(1.0)
    for section in sections.tolist():
        out = out * (squared(*section[:3]) / squared(*section[3:]))
    return F.sqrt(out)


def _run(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """All rows of x (series, samples) through the sections; `state` (section, 2) times the first sample is where they start."""
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        s1 = np.zeros(len(x)) if state is None else state[k, 0] * x[:, 0]
        s2 = np.zeros(len(x)) if state is None else state[k, 1] * x[:, 0]
        y = np.empty_like(x)
        for t in range(x.shape[1]):
            u = x[:, t]
            y[:, t] = b0 * u + s1
            s1, s2 = b1 * u - a1 * y[:, t] + s2, b2 * u - a2 * y[:, t]
        x = y
    return x


def settled(sections: np.ndarray) -> np.ndarray:
    """The sections' states after a long input of ones, each relative to its own input."""
    out = np.zeros((len(sections), 2))
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        out[k] = b1 - a1 * gain + b2 - a2 * gain, b2 - a2 * gain
    return out


def _both_ways(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards, so that nothing is delayed. The ends are continued by their point reflections."""
    n = min(3 * (2 * len(sections) + 1), x.shape[1] - 1)
    head, tail = 2 * x[:, :1] - x[:, n:0:-1], 2 * x[:, -1:] - x[:, -2 : -n - 2 : -1]
    long, state = np.concatenate([head, x, tail], axis=1), settled(sections)
    once = _run(sections, long, state)[:, ::-1]
    return _run(sections, once, state)[:, ::-1][:, n : n + x.shape[1]]


def both_ways_matrix(sections: np.ndarray, n: int) -> np.ndarray:
    """(n, n) weights that do the same to series of n samples, as it is linear in them."""
    return _both_ways(sections, np.eye(n)).T


def filtered(signal: Column | str, sections: np.ndarray, both_ways: bool = False) -> Column:
    """An array<double> column through a filter, forwards or forwards and backwards. Null stays null, an empty array empty; a
    missing sample spoils what comes after it."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = [None] * len(column)
        rows_of: dict[int, list[int]] = {}
        for i, x in enumerate(column):
            if x is not None:
                rows_of.setdefault(len(x), []).append(i)
        for n, rows in rows_of.items():
            x = np.stack([np.asarray(column.iloc[i], float) for i in rows]) if n else np.zeros((len(rows), 0))
            y = x if n == 0 else _both_ways(sections, x) if both_ways and n > 1 else _run(sections, x)
            for i, own in zip(rows, y, strict=True):
                out[i] = own
        return pd.Series(out, dtype=object)

    return run(signal)


def resampled(signal: Column, rate: float, to: float, zeros: int = 16) -> Column:
    """An array<double> at another rate, floor(n * to / rate) samples long: each is a sum of the old ones around its place,
    weighted by a sinc under a Hann window of `zeros` zero crossings, with the lower of the two rates as its band."""
    scale = min(1.0, to / rate)
    half = zeros / scale
    n = F.size(signal)
    count = F.floor(n * to / rate).cast("int")

    def weight(distance: Column) -> Column:
        x = distance * (math.pi * scale)
        sinc = F.when(x == 0, 1.0).otherwise(F.sin(x) / x)
        return scale * sinc * (0.5 + 0.5 * F.cos(distance * (math.pi / half)))

    def sample(j: Column) -> Column:
        at = j * rate / float(to)
        lo = F.greatest(F.ceil(at - half).cast("int"), F.lit(0))
        hi = F.least(F.floor(at + half).cast("int"), n - 1)
        return F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda total, i: total + F.get(signal, i) * weight(at - i))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), sample)).otherwise(F.when(n >= 0, F.array().cast("array<double>")))


def cubic_matrix(n: int, to: int) -> np.ndarray:
    """(to, n) weights that rescale n samples to `to` by a cubic spline through them, with samples at the centres of equal cells
    and mirrored ends."""
    if n == 1:
        return np.ones((to, 1))
    mirror = lambda i: np.abs((i + n - 1) % (2 * n - 2) - (n - 1)) if n > 1 else i * 0
    basis = lambda d: np.where(d < 1, 2 / 3 - d * d + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0.0))

    def spread(at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), n))
        for k in range(-1, 3):
            i = np.floor(at).astype(int) + k
            np.add.at(out, (np.arange(len(at)), mirror(i)), basis(np.abs(at - i)))
        return out

    at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
    return spread(at) @ np.linalg.inv(spread(np.arange(n, dtype=float)))


def rescaled(signal: Column | str, factor: float) -> Column:
    """An array<double> rescaled to rint(n * factor) samples by a cubic spline. Null stays null."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        weights: dict[int, np.ndarray] = {}

        def one(x):
            if x is None or len(x) == 0:
                return x
            if len(x) not in weights:
                weights[len(x)] = cubic_matrix(len(x), max(1, round(len(x) * factor)))
            return weights[len(x)] @ np.asarray(x, float)

        return column.map(one)

    return run(signal)


def crop(signal: Column, size: int, start: Column) -> Column:
    """`size` samples from `start` (from 0)."""
    return F.slice(signal, start.cast("int") + 1, size)


def random_start(n: Column, size: int, *keys: Column | str, seed: int = 1) -> Column:
    """A drawn start of a crop. The last possible start is not among those drawn, unless it is the only one."""
    return draw(*keys, seed=seed) % F.greatest(n - size, F.lit(1))


def items_of(rows: DataFrame, signal: str, size: int, items: int, *keys: str, seed: int = 1) -> DataFrame:
    """`items` random crops of each record, numbered by `item`; records shorter than `size` give none."""
    each = rows.where(F.size(signal) >= size).withColumn("item", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(items - 1).cast("long"))))
    start = random_start(F.size(signal), size, *keys, "item", seed=seed)
    return each.withColumn(signal, crop(F.col(signal), size, start))


def normal(*keys: Column | str, seed: int = 1) -> Column:
    """A reproducible standard normal number from the keys, made of two drawn ones."""
    one = (draw(*keys, seed=seed) + 1) / float(LCG_M + 1)
    two = draw(*keys, seed=seed + 1) / float(LCG_M)
    return F.sqrt(-2 * F.log(one)) * F.cos(two * (2 * math.pi))


def with_noise(value: Column, scale: float, *keys: Column | str, seed: int = 1) -> Column:
    """A value with Gaussian noise; none for a scale of 0."""
    return value + scale * normal(*keys, seed=seed) if scale else value


# Transforms of the user's own


def transformed(rows: DataFrame, column: str, func: Callable[[np.ndarray], np.ndarray], kind: str | None = None) -> DataFrame:
    """`func` on each array of a column, Arrow batch by Arrow batch. Null stays null. `kind` is the type of the result."""

    @F.pandas_udf(kind or rows.schema[column].dataType.simpleString())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else func(np.asarray(x)))

    return rows.withColumn(column, run(column))


def transformed_together(rows: DataFrame, columns: list[str], func: Callable[..., tuple]) -> DataFrame:
    """`func` on several columns of a row at once (data, label, static features); it gives as many values as it gets."""
    kinds = {c: rows.schema[c].dataType for c in columns}

    @F.pandas_udf(", ".join(f"{c} {k.simpleString()}" for c, k in kinds.items()))
    def run(*values: pd.Series) -> pd.DataFrame:
        out = [func(*row) for row in zip(*values, strict=True)]
        return pd.DataFrame({c: pd.Series([x[i] for x in out], dtype=object) for i, c in enumerate(columns)})

    return rows.withColumn("_t", run(*columns)).withColumns({c: F.col("_t")[c] for c in columns}).drop("_t")


def chained(rows: DataFrame, steps: Callable[[DataFrame], DataFrame] | list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A step, or several in their order."""
    for step in [steps] if callable(steps) else steps:
        rows = rows.transform(step)
    return rows
