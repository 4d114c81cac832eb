"""Data sources by byte ranges: many small ranges give what the whole file holds."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.sources import ranges, waveforms
from test_waveforms import pack_212


def test_arrays_in_ranges(spark, tmp_path):
    one, two = np.random.default_rng(1).normal(size=(1000, 3, 2)), np.arange(7, dtype="<i4")
    np.save(tmp_path / "a.npy", one)
    (tmp_path / "sub").mkdir()
    np.save(tmp_path / "sub" / "b.npy", two)
    df = ranges.scan_ranges(spark, "npy_ranges", str(tmp_path), range_bytes=4800)
    assert df.rdd.getNumPartitions() == 11
    rows = {(os.path.basename(r.file), r.row): r.value for r in df.collect()}
    assert len(rows) == 1007 and all(rows["a.npy", i] == one[i].ravel().tolist() for i in range(1000)) and rows["b.npy", 6] == [6.0]
    assert ranges.scan_ranges(spark, "npy_ranges", str(tmp_path), range_bytes=480).count() == 1007
    only = df.where(F.col("file") == str(tmp_path / "sub" / "b.npy"))
    assert only.count() == 7 and only.rdd.getNumPartitions() == 1


def test_a_file_beyond_a_row_is_many_tasks(spark, tmp_path):
    """A sparse file of 3 GB, larger than a binary value can be: the last range is read alone."""
    shape = (3 << 20, 128)
    with open(tmp_path / "big.npy", "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f8", "fortran_order": False, "shape": shape})
        at = f.tell()
        f.truncate(at + shape[0] * shape[1] * 8)
        f.seek(at + (shape[0] - 1) * shape[1] * 8)
        f.write(np.full(128, 5.0).tobytes())
    assert os.path.getsize(tmp_path / "big.npy") > 3 << 30
    parts = ranges.NpyRanges({"path": str(tmp_path)}).reader(spark.createDataFrame([], "file string, row long, value array<double>").schema).partitions()
    assert len(parts) == 48 and (parts[-1].first, parts[-1].last) == (47 << 16, 48 << 16)
    reader = ranges.NpyRanges({"path": str(tmp_path)}).reader(spark.createDataFrame([], "file string, row long, value array<double>").schema)
    last = list(reader.read(ranges.replace(parts[-1], first=shape[0] - 2)))[-1]
    assert last.column(2).to_pylist() == [[0.0] * 128, [5.0] * 128]


def test_arrays_are_committed_together(spark, tmp_path):
    ranges.register(spark)
    rows = spark.range(10).select(F.lit("x").alias("file"), F.col("id").alias("row"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("value")).repartition(3)
    out = str(tmp_path / "out")
    os.mkdir(out)
    for mode in ("append", "overwrite", "append"):
        rows.write.format("npy_ranges").mode(mode).save(out)
    back = ranges.scan_ranges(spark, "npy_ranges", out)
    assert sorted(r.value[0] for r in back.collect()) == sorted([float(i) for i in range(10)] * 2) and not [x for x in os.listdir(out) if x.startswith("_")]
    bad = rows.withColumn("value", F.when(F.col("row") == 7, F.raise_error(F.lit("broken")).cast("array<double>")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("npy_ranges").mode("append").save(out)
    assert back.count() == 20 and ranges.scan_ranges(spark, "npy_ranges", out).count() == 20


@pytest.mark.parametrize("form", [16, 80, 212])
@pytest.mark.parametrize("leads", [1, 2, 3])
def test_waveforms_in_ranges(spark, tmp_path, form, leads):
    rng = np.random.default_rng(form + leads)
    x = rng.integers(-100, 100, (101, leads))
    flat = x.ravel().tolist()
    (tmp_path / "r.dat").write_bytes({16: lambda: x.astype("<i2").tobytes(), 80: lambda: bytes(v + 128 for v in flat), 212: lambda: pack_212(flat)}[form]())
    (tmp_path / "r.hea").write_text(f"r {leads} 360 101\n" + "".join(f"r.dat {form} 50(3)/mV 12 0 0 0 0 L{k}\n" for k in range(leads)))
    whole = {(r.lead, t): v for r in waveforms.scan_records(spark, str(tmp_path)).collect() for t, v in enumerate(r.signal)}
    for size in (24, 1 << 20):
        got = {(r.lead, r.t): r.value for r in ranges.scan_ranges(spark, "waveform_ranges", str(tmp_path), range_bytes=size).collect()}
        assert got == whole
    one = ranges.scan_ranges(spark, "waveform_ranges", str(tmp_path), leads="L0")
    assert one.count() == 101 and {r.name for r in one.select("name").distinct().collect()} == {"L0"}
    assert ranges.scan_ranges(spark, "waveform_ranges", str(tmp_path), records="other").count() == 0
    assert ranges.scan_ranges(spark, "waveform_ranges", str(tmp_path)).where("record = 'r' and lead = 0").count() == 101


def holter(samples, rate, resolution):
    head = bytearray(522)
    head[:8] = b"ISHNE1.0"
    struct.pack_into("<iiii", head, 10, 0, len(samples), 522, 522)
    struct.pack_into("<h", head, 156, samples.shape[1])
    struct.pack_into("<12h", head, 206, *resolution, *[0] * (12 - len(resolution)))
    struct.pack_into("<h", head, 272, rate)
    return bytes(head) + samples.astype("<i2").tobytes()


def test_holter_in_ranges(spark, tmp_path):
    x = np.random.default_rng(4).integers(-3000, 3000, (500, 3))
    (tmp_path / "p1.ecg").write_bytes(holter(x, 200, [2500, 1000, 500]))
    (tmp_path / "p2.ECG").write_bytes(holter(x[:5], 128, [1000, 1000, 1000]))
    for size in (600, 1 << 20):
        rows = ranges.scan_ranges(spark, "holter_ranges", str(tmp_path), range_bytes=size).collect()
        got = {(r.record, r.lead, r.t): r.value for r in rows}
        assert len(rows) == len(got) == 1515 and got["p1", 0, 7] == pytest.approx(x[7, 0] * 0.0025) and got["p1", 2, 499] == pytest.approx(x[499, 2] * 0.0005)
        assert {r.rate for r in rows} == {200.0, 128.0}
    assert ranges.scan_ranges(spark, "holter_ranges", str(tmp_path), records="p2", leads="1").count() == 5
    (tmp_path / "bad.ecg").write_bytes(b"x" * 600)
    with pytest.raises(Exception, match="no such header"):
        ranges.scan_ranges(spark, "holter_ranges", str(tmp_path)).count()
    with pytest.raises(Exception, match="nothing"):
        ranges.scan_ranges(spark, "npy_ranges", str(tmp_path / "nothing")).count()
