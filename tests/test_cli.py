"""Commands over small trace files."""

from __future__ import annotations

import json

import numpy as np
import pytest

from seqloom import cli
from seqloom.operators.neural import TraceDenoiser
from seqloom.operators.sequences import encode
from seqloom.sources import ranges, traces


@pytest.fixture
def file(tmp_path):
    path = tmp_path / "in.txt"
    path.write_text("\n".join(",".join(str((i * j) % 7) for j in range(30)) for i in [*range(40), 3, 3]))
    return str(path)


def test_windows_and_batches(spark, file, tmp_path):
    cli.main(["windows", file, str(tmp_path / "w"), "--length", "10", "--stride", "20"])
    assert traces.scan(spark, str(tmp_path / "w"), strict=True).count() == 84
    cli.main(["batches", file, str(tmp_path / "b"), "--size", "5", "--epochs", "2", "--seed", "4"])
    rows = spark.read.parquet(str(tmp_path / "b")).collect()
    per = [sorted((r.batch, r.slot, tuple(r.seq)) for r in rows if r.epoch == e) for e in (0, 1)]
    assert all(len(p) == 42 and len({x[:2] for x in p}) == 42 for p in per)
    assert sorted(x[2] for x in per[0]) == sorted(x[2] for x in per[1]) and [x[2] for x in per[0]] != [x[2] for x in per[1]]
    cli.main(["batches", file, str(tmp_path / "c"), "--size", "5", "--in-order"])
    rows = sorted((r.batch, r.slot, ",".join(map(str, r.seq))) for r in spark.read.parquet(str(tmp_path / "c")).collect())
    assert [x[2] for x in rows] == sorted(x[2] for x in rows)


@pytest.mark.parametrize("kind", ["rm", "mnr", "bm"])
def test_masks(spark, file, tmp_path, kind):
    cli.main(["mask", file, str(tmp_path / "m"), "--kind", kind, "--k", "10"])
    gone: dict = {}
    for r in spark.read.parquet(str(tmp_path / "m")).where("keep = 0").collect():
        gone.setdefault(r.id, []).append(r.t)
    assert len(gone) == 42 and all(len(x) == 10 for x in gone.values())
    segments = {tuple(sorted(x)) for x in gone.values()}
    assert len(segments) == (1 if kind == "bm" else 3) if kind != "rm" else len(segments) > 3
    assert kind == "rm" or all(s == tuple(range(s[0], s[0] + 10)) for s in segments)


def test_generation_with_weights(spark, file, tmp_path):
    net = TraceDenoiser.initial(d_model=4, layers=1, steps=5, seed=2)
    (tmp_path / "net.npz").write_bytes(net.saved())
    again = TraceDenoiser.load(net.saved())
    x = np.random.default_rng(1).normal(size=(2, 6))
    assert np.allclose(net(x, np.array([0, 4])), again(x, np.array([0, 4])))
    broken = TraceDenoiser(5, 4, {**net.weights, "out": np.zeros((3, 1))}, 1)
    with pytest.raises(ValueError, match="no weight out"):
        TraceDenoiser.load(broken.saved())
    for form in ("text", "npy"):
        cli.main(["generate", file, str(tmp_path / form), "--samples", "6", "--length", "9", "--weights", str(tmp_path / "net.npz"), "--format", form])
    text = sorted(tuple(r.seq) for r in traces.scan(spark, str(tmp_path / "text"), strict=True).collect())
    arrays = sorted(tuple(map(int, r.value)) for r in ranges.scan_ranges(spark, "npy_ranges", str(tmp_path / "npy")).collect())
    assert text == arrays and len(text) == 6 and {len(x) for x in text} == {9}
    cli.main(["compare", "--generated", str(tmp_path / "text"), "--real", file, "--output", str(tmp_path / "r")])
    report = json.loads(spark.read.text(str(tmp_path / "r")).first().value)
    assert report["n_generated"] == 54 and report["distinct_real"] == 7 and report["distinct_both"] == report["distinct_generated"]


def test_large_vocabularies_are_joined(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "?"]), (2, []), (3, None), (4, ["c"])], "i int, seq array<string>")
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "e string, id int")
    few, many = ({r.i: r.seq for r in encode(rows, words, "e", most).collect()} for most in (3, 2))
    assert many == {1: [0, 1, 0, None], 2: [], 3: None, 4: [2]} == few
