"""Filters, resampling, crops, noise and transforms of the user's own."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import sequences, signal


def arrays(spark, xs):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in enumerate(xs)], "id long, x array<double>")


def values(df, column="x"):
    return {r["id"]: r[column] for r in df.collect()}


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth_gains(order):
    low = signal.butterworth(order, 40.0, 500.0)
    f = np.array([0.0, 10.0, 40.0, 100.0, 200.0])
    # |H|^2 = 1 / (1 + (w / wc)^(2 n)) at prewarped frequencies
    ratio = np.tan(np.pi * f / 500) / np.tan(np.pi * 40 / 500)
    assert np.abs(signal.frequency_response(low, f, 500.0)) == pytest.approx(1 / np.sqrt(1 + ratio ** (2 * order)), rel=1e-6, abs=1e-9)
    high = signal.butterworth(order, 40.0, 500.0, "highpass")
    assert np.abs(signal.frequency_response(high, f[1:], 500.0)) == pytest.approx(1 / np.sqrt(1 + ratio[1:] ** (-2.0 * order)), rel=1e-6)
    band = signal.butterworth(order, (20.0, 60.0), 500.0, "bandpass")
    gains = np.abs(signal.frequency_response(band, np.array([0.0, 20.0, 60.0, 249.9]), 500.0))
    assert gains == pytest.approx([0, 2**-0.5, 2**-0.5, 0], abs=1e-3)
    for sections in (low, high, band):
        assert all((np.abs(np.roots([1, a1, a2])) < 1).all() for *_, a1, a2 in sections)


def test_no_such_filter():
    for cut, kind in ((0.0, "lowpass"), (9.0, "lowpass"), (2.0, "bandpass"), (2.0, "other")):
        with pytest.raises(ValueError, match="no "):
            signal.butterworth(2, cut, 16.0, kind)


def test_filter_equals_its_polynomials(spark):
    rng = np.random.default_rng(1)
    sections = signal.butterworth(4, (1.0, 3.0), 16.0, "bandpass")
    b, a = np.ones(1), np.ones(1)
    for s in sections:
        b, a = np.convolve(b, s[:3]), np.convolve(a, s[3:])
    xs = [rng.normal(size=n) for n in (50, 50, 7, 1)] + [[], None]
    got = values(arrays(spark, xs).withColumn("x", signal.filtered("x", sections)))
    for i, x in enumerate(xs[:4]):
        y = np.zeros(len(x))
        for t in range(len(x)):
            y[t] = sum(b[k] * x[t - k] for k in range(min(t + 1, len(b)))) - sum(a[k] * y[t - k] for k in range(1, min(t + 1, len(a))))
        assert got[i] == pytest.approx(y.tolist(), rel=1e-6, abs=1e-9)
    assert got[4] == [] and got[5] is None


def test_both_ways_delays_nothing(spark):
    t = np.arange(400)
    slow, fast = np.sin(2 * np.pi * 2 * t / 100), 0.5 * np.sin(2 * np.pi * 40 * t / 100)
    low = signal.butterworth(4, 8.0, 100.0)
    got = values(arrays(spark, [slow + fast, np.full(50, 3.0), [1.0], [], None]).withColumn("x", signal.filtered("x", low, both_ways=True)))
    assert np.abs(np.array(got[0]) - slow)[20:-20].max() < 0.01
    assert got[1] == pytest.approx([3.0] * 50) and len(got[2]) == 1 and got[3] == [] and got[4] is None


def test_resampling_keeps_a_sine(spark):
    t = np.arange(720)
    x = np.sin(2 * np.pi * 5 * t / 360)
    got = values(arrays(spark, [x, [], None, [2.0]]).withColumn("x", signal.resampled(F.col("x"), 360.0, 100.0)))
    assert len(got[0]) == 200 and np.abs(np.array(got[0]) - np.sin(2 * np.pi * 5 * np.arange(200) / 100))[20:-20].max() < 0.01
    assert got[1] == [] and got[2] is None and got[3] == []
    same = values(arrays(spark, [x[:40]]).withColumn("x", signal.resampled(F.col("x"), 10.0, 10.0)))
    assert same[0] == pytest.approx(x[:40].tolist(), abs=1e-9)
    fast = np.sin(2 * np.pi * 150 * t / 360)  # above the new rate's band
    gone = values(arrays(spark, [fast]).withColumn("x", signal.resampled(F.col("x"), 360.0, 100.0)))
    assert np.abs(np.array(gone[0]))[20:-20].max() < 0.02


def test_cubic_rescaling(spark):
    x = np.linspace(-2, 3, 60) ** 3
    assert signal.cubic_matrix(60, 60) @ x == pytest.approx(x)
    got = values(arrays(spark, [x, [1.0], None, [1.0, 1.0]]).withColumn("x", signal.rescaled("x", 2.0)))
    at = (np.arange(120) + 0.5) / 2 - 0.5
    assert np.array(got[0])[20:-20] == pytest.approx((np.linspace(-2, 3, 60)[0] + at * 5 / 59)[20:-20] ** 3, abs=1e-3)
    assert got[1] == [1.0, 1.0] and got[2] is None and got[3] == pytest.approx([1.0] * 4)


def test_crops_and_noise(spark):
    rows = arrays(spark, [range(30)] * 200 + [range(10), range(9)])
    items = signal.items_of(rows, "x", 10, 2, "id").collect()
    assert len(items) == 402 and all(r.x == [r.x[0] + k for k in range(10)] for r in items)
    starts = {int(r.x[0]) for r in items if r.id < 200}
    assert min(starts) == 0 and max(starts) == 19  # 20 would be the last one
    drawn = np.array([r.v for r in spark.range(4000).select(signal.with_noise(F.lit(1.0), 2.0, "id").alias("v")).collect()])
    assert drawn.mean() == pytest.approx(1, abs=0.15) and drawn.std() == pytest.approx(2, abs=0.1)
    assert spark.range(1).select(signal.with_noise(F.lit(1.0), 0, "id").alias("v")).first().v == 1.0


def test_own_transforms(spark):
    rows = arrays(spark, [[1, 2], None]).withColumn("label", F.lit(3.0))
    assert values(signal.transformed(rows, "x", lambda x: x * 2)) == {0: [2.0, 4.0], 1: None}
    both = signal.transformed_together(rows.where("id = 0"), ["x", "label"], lambda x, y: (x + y, y + 1)).first()
    assert (list(both.x), both.label) == ([4.0, 5.0], 4.0)
    steps = [lambda d: signal.transformed(d, "x", lambda x: x + 1), lambda d: d.where("x IS NOT NULL")]
    assert values(signal.chained(rows, steps)) == {0: [2.0, 3.0]} and values(signal.chained(rows, steps[1])) == {0: [1.0, 2.0]}


def test_numbers_sums_and_batches_in_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 3)), int(rng.integers(0, 9))) for i in rng.permutation(200)] + [(1000, None, 4)]
    df = spark.createDataFrame(rows, "id long, g long, v long").repartition(5)
    coarse = F.floor(F.col("id") / 7)
    ordered = sorted(rows)
    sums = {r.id: r.s for r in sequences.running_sums(df, ["id"], coarse, "v", "s").collect()}
    assert sums == {r[0]: sum(x[2] for x in ordered[:k]) for k, r in enumerate(ordered)}
    batch = {r.id: r.batch for r in sequences.batches(df, ["id"], coarse, 16).collect()}
    assert batch == {r[0]: k // 16 for k, r in enumerate(ordered)}
    number = {r.id: r.n for r in sequences.row_numbers(df, ["id"], coarse, "n", by=["g"]).collect()}
    assert number == {r[0]: 1 + sum(x[1] == r[1] for x in ordered[:k]) for k, r in enumerate(ordered)}


def test_time_features_of_ones_own(spark, monkeypatch):
    from seqloom.functions import columns

    monkeypatch.setattr(columns, "CALENDAR", dict(columns.CALENDAR))
    monkeypatch.setattr(columns, "BY_FREQUENCY", {k: list(v) for k, v in columns.BY_FREQUENCY.items()})
    columns.add_time_feature("quarter", F.quarter, 1, 3, ("D",))
    found = columns.time_features(F.lit("2024-07-05").cast("timestamp"), "D")
    assert spark.range(1).select(found["quarter"].alias("q")).first().q == pytest.approx(2 / 3 - 0.5)
