"""Streams out of order against the sorted table."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from seqloom.streaming import ordered

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    """60 rows of two keys, shuffled within three hours, in six files; then one row far behind that lets all of them out."""
    ordered.use_rocksdb(spark)
    rng = random.Random(2)
    rows = [(k, START + dt.timedelta(minutes=10 * i), i, float(rng.randrange(10))) for i in range(60) for k in (1, 2) if k == 1 or i % 3]
    mixed = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 12))
    schema = "key long, ts timestamp, t long, u double"
    for n, part in enumerate([*np.array_split(np.arange(len(mixed)), 6), None]):
        own = [mixed[i] for i in part] if part is not None else [(9, START + dt.timedelta(days=2), 0, 0.0)]
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    for n in range(2):  # two more, so that the watermark moves on
        spark.createDataFrame([(9, START + dt.timedelta(days=3 + n), 1 + n, 0.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"q{n}"))
    assert any(a[2] > b[2] for a, b in zip(mixed, mixed[1:], strict=False))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return source, sorted(rows)


def drain(spark, out, name, folder):
    query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).where("key < 9").collect(), query


def test_scan_out_of_order_equals_the_sorted_one(spark, stream, tmp_path):
    source, rows = stream
    got, _ = drain(spark, ordered.ordered_scan(source, 0.9, 0.5, 2.0, 0.1, late="3 hours"), "ordered", str(tmp_path))
    expected = {}
    for k in (1, 2):
        s = 0.0
        for _, _, t, u in (r for r in rows if r[0] == k):
            s = 0.9 * s + 0.5 * u
            expected[k, t] = 2 * s + 0.1 * u
    assert len(got) == len(rows) and {(r.key, r.t): r.y for r in got} == pytest.approx(expected)


@pytest.mark.parametrize(("size", "slide"), [(5, 2), (3, 7)])
def test_windows_by_count(spark, stream, tmp_path, size, slide):
    source, rows = stream
    got, _ = drain(spark, ordered.count_windows(source, size, slide, late="3 hours"), f"windows{size}", str(tmp_path))
    expected = {}
    for k in (1, 2):
        u = [r[3] for r in rows if r[0] == k]
        expected |= {(k, s): u[s : s + size] for s in range(0, len(u) - size + 1, slide)}
    assert {(r.key, r.start): r["values"] for r in got} == expected and len(got) == len(expected)


def test_idle_keys_give_their_state_back(spark, stream, tmp_path):
    source, rows = stream
    _, query = drain(spark, ordered.ordered_scan(source, 0.5, 1.0, 1.0, 0.0, late="3 hours", idle="12 hours"), "idle", str(tmp_path))
    left = [p for p in query.recentProgress if p.stateOperators]
    assert left and left[-1].stateOperators[0].numRowsTotal < max(p.stateOperators[0].numRowsTotal for p in left)


def test_windows_carry_what_they_need():
    p = ordered._Windows(4, 3, 0)
    u, carried, got = np.arange(20.0), [], {}
    for a, b in ((0, 1), (1, 2), (2, 9), (9, 9), (9, 20)):
        out, carried = p.step(np.arange(a, b), u[a:b], carried)
        got |= dict(zip(out["start"].tolist(), out["values"], strict=True))
        assert len(carried) <= 4
    assert got == {s: u[s : s + 4].tolist() for s in range(0, 17, 3)}
