"""Recurrences, filters, resampling and convolution of long series: chunked equals whole."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import convolution, scans, signal

RNG = np.random.default_rng(8)


def long_rows(spark, *series):
    rows = [(k, t, float(v)) for k, x in enumerate(series) for t, v in enumerate(x)]
    return spark.createDataFrame(rows, "key int, t long, u double").repartition(3)


def arrays(df, value="y"):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.key, {})[r.t] = r[value]
    return {k: np.array([v[t] for t in sorted(v)]) for k, v in out.items()}


def naive(a, b, c, d, u):
    s, y = np.zeros(len(b), complex), []
    for x in u:
        s = (a * s if a.ndim == 1 else a @ s) + b * x
        y.append((c * s).sum().real + d * x)
    return np.array(y)


DIAGONAL = scans.StateSpace.diagonal([0.95 * np.exp(0.3j), 0.5, -0.8], [1.0, 0.5, 1j], [1 - 1j, 2.0, 1j], 0.25)
DENSE = scans.StateSpace.dense(RNG.normal(size=(4, 4)) / 4, RNG.normal(size=4), RNG.normal(size=4), -0.5)


@pytest.mark.parametrize("model", [DIAGONAL, DENSE])
@pytest.mark.parametrize("reverse", [False, True])
def test_scan_in_chunks_and_levels(spark, model, reverse):
    series = [RNG.normal(size=n) for n in (1, 63, 64, 65, 1000)]
    got = arrays(scans.linear_scan(long_rows(spark, *series), ["key"], "t", "u", model, reverse=reverse, chunk=50, fanout=3))
    for k, u in enumerate(series):
        step = -1 if reverse else 1
        assert np.allclose(got[k], naive(model.a, model.b, model.c, model.d, u[::step])[::step])


def test_one_series_is_many_tasks(spark):
    """A million steps of one key: chunks, not keys, are what tasks get."""
    rows = spark.range(1_000_000).select(F.lit(1).alias("key"), F.col("id").alias("t"), F.cos(F.col("id") * 0.01).alias("u"))
    model = scans.StateSpace.diagonal([0.999], [1.0], [1.0])
    out = scans.linear_scan(rows, ["key"], "t", "u", model, chunk=1 << 14)
    last = out.where("t = 999999").first().y
    k = np.arange(40_000)
    assert np.isclose(last, (0.999**k * np.cos((999_999 - k) * 0.01)).sum(), rtol=1e-9)
    assert out.count() == 1_000_000


def test_start_states_and_empty(spark):
    model = scans.StateSpace.diagonal([0.5], [1.0], [1.0])
    first = spark.createDataFrame([(0, [8.0, 0.0])], "key int, first array<double>")
    got = arrays(scans.linear_scan(long_rows(spark, [0.0, 0.0, 0.0], [0.0, 0.0]), ["key"], "t", "u", model, first=first, chunk=2))
    assert got[0].tolist() == [4.0, 2.0, 1.0] and got[1].tolist() == [0.0, 0.0]
    assert scans.linear_scan(long_rows(spark, [1.0]).limit(0), ["key"], "t", "u", model).count() == 0


@pytest.mark.parametrize(("sections", "both"), [(signal.butterworth(3, 2.0, 16.0), False), (signal.butterworth(3, 2.0, 16.0), True), (signal.butterworth(2, (1.0, 4.0), 16.0, "bandpass"), True), (signal.butterworth(5, 1.0, 16.0, "highpass"), True)])
def test_filters_on_chunks_equal_the_whole_array(spark, sections, both):
    series = [RNG.normal(size=n).cumsum() for n in (2, 7, 40, 500)]
    got = arrays(scans.filter_series(long_rows(spark, *series), ["key"], "t", "u", sections, both_ways=both, chunk=64))
    for k, x in enumerate(series):
        expected = signal._both_ways(sections, x[None, :])[0] if both else signal._run(sections, x[None, :])[0]
        assert np.allclose(got[k], expected, atol=1e-8)


@pytest.mark.parametrize(("rate", "to"), [(360.0, 100.0), (100.0, 250.0), (250.0, 250.0)])
def test_resampling_on_chunks_equals_the_whole_array(spark, rate, to):
    series = [RNG.normal(size=n) for n in (1, 30, 400)]
    got = arrays(scans.resample_series(long_rows(spark, *series), ["key"], "t", "u", rate, to, chunk=70))
    for k, x in enumerate(series):
        whole = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(signal.resampled(F.col("x"), rate, to)).first()[0]
        assert np.allclose(got.get(k, np.zeros(0)), whole)


def test_convolution_equals_numpy_in_both_directions(spark, monkeypatch):
    monkeypatch.setattr(convolution, "WIDTH", 4)
    series = [RNG.normal(size=n) for n in (1, 2, 5, 64, 300)]
    h = {int(k): float(v) for k, v in zip(range(-40, 200), RNG.normal(size=240), strict=True)}
    kernel = spark.createDataFrame(list(h.items()), "lag long, h double")
    got = arrays(convolution.convolve(long_rows(spark, *series), ["key"], "t", "u", kernel))
    for k, x in enumerate(series):
        expected = [sum(h.get(t - i, 0.0) * v for i, v in enumerate(x)) for t in range(len(x))]
        assert np.allclose(got[k], expected)


def test_convolution_edges(spark):
    kernel = spark.createDataFrame([(0, 1.0), (0, 1.0), (3, 5.0), (10**6, 9.0)], "lag long, h double")
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 4, 2.0)], "key int, t long, u double")
    assert np.allclose(arrays(convolution.convolve(rows, ["key"], "t", "u", kernel))[0], [2, 0, 0, 5, 4])
    assert convolution.convolve(rows.limit(0), ["key"], "t", "u", kernel).count() == 0


def test_convolution_is_the_recurrence(spark):
    poles = [(0.9 * np.exp(0.5j), 1 - 2j), (0.99, 0.5)]
    rows = long_rows(spark, RNG.normal(size=3000))
    model = scans.StateSpace.diagonal([a for a, _ in poles], [1.0, 1.0], [c for _, c in poles])
    kernel = convolution.pole_kernel(spark.range(3000), poles)
    one, two = arrays(scans.linear_scan(rows, ["key"], "t", "u", model, chunk=256))[0], arrays(convolution.convolve(rows, ["key"], "t", "u", kernel))[0]
    assert np.allclose(one, two)
