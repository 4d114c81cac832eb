"""Round trips of sources and sinks, the command line, and streams against their batch twins."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import cli
from seqloom.functions.register import register
from seqloom.plans import fixtures as fx
from seqloom.sources import arrays, traces
from seqloom.streaming import stateful

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    for app, lines in (("one", ["1,2,3", "2,3,4", "bad,1", ""]), ("two", ["3,3,3"])):
        folder = tmp_path / app / "sequence_length_3"
        folder.mkdir(parents=True)
        (folder / "training").write_text("\n".join(lines))
        (folder / "testing").write_text("9,9,9")
    return tmp_path


def test_scan_tree(spark, tree):
    got = sorted((r.app, r.length, r.split, tuple(r.seq)) for r in traces.scan_tree(spark, str(tree)).collect())
    assert got == [("one", 3, "training", (1, 2, 3)), ("one", 3, "training", (2, 3, 4)), ("two", 3, "training", (3, 3, 3))]


def test_vocabulary_of_files(spark, tree):
    got = {r.event: r.id for r in traces.vocabulary_of(traces.scan_tree(spark, str(tree))).collect()}
    assert got == {3: 0, 2: 1, 1: 2, 4: 3}


def test_strict_scan_fails_on_a_bad_line(spark, tree):
    path = str(tree / "one" / "sequence_length_3" / "training")
    assert traces.scan(spark, path, 3).count() == 2
    with pytest.raises(Exception, match="not a trace line"):
        traces.scan(spark, path, strict=True).collect()
    with pytest.raises(ValueError, match="no valid sequences"):
        traces.require_rows(traces.scan(spark, path, 99), path)


def test_text_round_trip(spark, tmp_path):
    rows = fx.trace(spark, SF).select("seq")
    traces.write_text(rows, str(tmp_path / "t"))
    back = traces.scan(spark, str(tmp_path / "t"), strict=True)
    assert sorted(map(tuple, (r.seq for r in back.collect()))) == sorted(map(tuple, (r.seq for r in rows.collect())))


def test_npy_round_trip(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(3, 2, 2))
    got = sorted((r.row, tuple(r.value)) for r in arrays.scan_npy(spark, str(tmp_path)).collect())
    assert got == [(0, (0.0, 1.0, 2.0, 3.0)), (1, (4.0, 5.0, 6.0, 7.0)), (2, (8.0, 9.0, 10.0, 11.0))]
    packed = arrays.pack_npy(arrays.scan_npy(spark, str(tmp_path)), ["path"], "row", "value").first()
    import io

    assert np.load(io.BytesIO(packed.npy)).shape == (3, 4)


def test_csv_and_bundle(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,name\n1,a\n2,b\n")
    rows = arrays.scan_csv(spark, str(tmp_path / "x.csv"), "id int, name string")
    arrays.save_bundle(rows, rows.select("id"), rows.agg(F.count("*").alias("n")), str(tmp_path / "b"))
    a, b, s = arrays.load_bundle(spark, str(tmp_path / "b"))
    assert a.count() == 2 and b.count() == 2 and s.first().n == 2


def test_built_once(spark, tmp_path):
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    for again in (False, False, True):
        assert arrays.read_or_build(spark, str(tmp_path / "r"), build, again).count() == 3
    assert len(calls) == 2


def test_binary_extension_point(spark, tmp_path):
    (tmp_path / "r.dat").write_bytes(bytes([1, 2, 3]))
    got = arrays.scan_binary(spark, str(tmp_path), "*.dat", lambda b: [(i, x) for i, x in enumerate(b)], "at long, value long").collect()
    assert sorted((r.at, r.value) for r in got) == [(0, 1), (1, 2), (2, 3)]


def test_latest_checkpoint_and_config(spark):
    names = spark.createDataFrame([("3.pkl",), ("10.pkl",), ("best.pkl",), ("x.txt",)], "name string")
    assert arrays.latest_checkpoint(names, F.col("name")).first().n == 10
    assert arrays.latest_checkpoint(names.limit(0), F.col("name")).first().n == -1
    with pytest.raises(ValueError, match="gen_config"):
        arrays.read_config('{"diffusion_config": {}, "train_config": {}, "trainset_config": {}}')
    assert traces.experiment_path(200, 0.0001, 0.02) == "T200_beta00.0001_betaT0.02"


def test_stats_report(spark, tmp_path):
    df = spark.createDataFrame([([1, 2, 2],), ([2],)], "seq array<int>")
    traces.write_stats(df, str(tmp_path / "s"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "s")).collect())
    assert "sequences 2" in text and "event 2: 3 (75.00%)" in text


def test_command_line(spark, tree, capsys):
    one = str(tree / "one" / "sequence_length_3" / "training")
    cli.main(["evaluate", "--generated", one, "--real", one, "--output", str(tree / "e")])
    report = json.loads(spark.read.text(str(tree / "e")).first().value)
    assert report["mean_accuracy"] == 1.0 and report["perfect_rate"] == 1.0 and report["kl"] == 0.0
    cli.main(["generate", one, str(tree / "g"), "--samples", "5", "--length", "8"])
    rows = traces.scan(spark, str(tree / "g"), strict=True).collect()
    assert len(rows) == 5 and {x for r in rows for x in r.seq} <= {1, 2, 3, 4}
    cli.main(["vocabulary", str(tree), str(tree / "v")])
    cli.main(["stats", one, str(tree / "s")])
    assert os.path.isdir(tree / "v") and os.path.isdir(tree / "s")


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("SELECT lcs_length(array(1, 2, 3), array(2, 3)) AS n, rouge_l(array(1, 2), array(2)) AS r, quantize(2.5D) AS q").first()
    assert (r.n, r.r, r.q) == (2, 0.5, 2)


def _stream(spark, df, folder, order, parts=3):
    """A file stream over a frame written in parts."""
    rows = df.orderBy(order).toPandas()
    for i, part in enumerate(np.array_split(np.arange(len(rows)), parts)):
        spark.createDataFrame(rows.iloc[part], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(spark, out, name, folder, mode="append"):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def test_stream_of_counts(spark, tmp_path):
    events = fx.table(spark, SF, "events").select("ts", "user_id", "event_type", "value")
    batch = {(r.start, r.event_type): r.n for r in stateful.tumbling_counts(events, "1 day").collect()}
    stream = stateful.tumbling_counts(_stream(spark, events, str(tmp_path / "in"), "ts"), "1 day")
    got = {(r.start, r.event_type): r.n for r in _drain(spark, stream, "counts", str(tmp_path), "complete").collect()}
    assert got == batch
    assert stateful.session_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_stream_of_scans_and_pools(spark, tmp_path):
    rows = fx.series(spark, SF).where("ch = 0 AND vec_id < 5").select(F.col("vec_id").alias("key"), "t", F.col("value").alias("u"))
    stream = _stream(spark, rows, str(tmp_path / "in"), "t")
    got = {(r.key, r.t): r.y for r in _drain(spark, stateful.recurrent_scan(stream, 0.9, 0.5, 2.0, 0.1), "scan", str(tmp_path / "a")).collect()}
    for key, own in rows.toPandas().sort_values("t").groupby("key"):
        s = 0.0
        for t, u in zip(own["t"], own["u"], strict=True):
            s = 0.9 * s + 0.5 * u
            assert got[key, t] == pytest.approx(2 * s + 0.1 * u)
    pooled = _drain(spark, stateful.down_pool(stream, 4), "pool", str(tmp_path / "b"))
    back = {(r.key, r.t): r.u for r in stateful.up_pool(pooled).collect()}
    assert back == {(r.key, r.t): r.u for r in rows.collect()}


def test_stream_of_bests(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, float((i * 7) % 11), i) for i in range(60)], "k long, loss double, i long")
    progress = stateful.Progress()
    spark.streams.addListener(progress)
    try:
        got = _drain(spark, stateful.running_best(_stream(spark, rows, str(tmp_path / "in"), "i"), "k", "loss"), "bests", str(tmp_path), "complete").collect()
    finally:
        spark.streams.removeListener(progress)
    assert {(r.k, r.best, r.n) for r in got} == {(r.k, r.best, r.n) for r in stateful.running_best(rows, "k", "loss").collect()}


def test_results_and_logs(spark, tmp_path):
    from seqloom.operators import networks
    from seqloom.sources import arrays

    one = spark.range(3)
    counts = {r.part: r.n for r in arrays.save_results(one, one.limit(2), one.limit(0), str(tmp_path / "r")).collect()}
    assert counts == {"samples": 3, "targets": 2, "masks": 0}
    arrays.log_metrics(spark, str(tmp_path / "log"), 1, loss=0.5, rate=2)
    arrays.log_metrics(spark, str(tmp_path / "log"), 2, loss=0.25)
    assert sorted(map(tuple, arrays.read_log(spark, str(tmp_path / "log")).collect())) == [(1, "loss", 0.5), (1, "rate", 2.0), (2, "loss", 0.25)]
    net = networks.GatedImputer(2, hidden=4, layers=1)
    assert networks.parameter_count(net) == 2 * 4 + 4 * 4 + 4 * 2 + 4 * 4 + 3 * 4 * 8 + 4 * 8 + 4 * 4 + 4 * 4
