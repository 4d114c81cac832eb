"""Table functions and named aggregates: SQL calls against the DataFrame operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seqloom.functions.tables import register_tables
from seqloom.operators import records, sequences
from seqloom.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    register_tables(spark)
    fx.trace(spark, SF).createOrReplaceTempView("traces")
    fx.ann(spark, SF).createOrReplaceTempView("marks")
    spark.createDataFrame([(1, 40), (2, 7), (3, 0), (4, None), (5, 16)], "id int, n int").createOrReplaceTempView("sizes")
    return spark


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_windows(views):
    got = views.sql("SELECT t.user_id, w.* FROM traces t, LATERAL sliding_windows(t.seq, 20, 5) w")
    assert rows(got, "user_id", "st", "seq") == rows(fx.win(views, SF), "user_id", "st", "seq")
    words = views.sql("SELECT * FROM sliding_windows(array('a', 'b', 'c'), 2)")
    assert rows(words, "st", "seq") == [(0, ["a", "b"]), (1, ["b", "c"])] and words.schema["seq"].dataType.simpleString() == "array<string>"
    assert views.sql("SELECT * FROM sliding_windows(CAST(NULL AS ARRAY<INT>), 2, 1)").count() == 0


def test_chunks(views):
    got = views.sql("SELECT s.id, c.* FROM sizes s, LATERAL stride_chunks(s.n, 16, 12, 8, 1) c")
    expected = sequences.stride_chunks(views.table("sizes").where("n IS NOT NULL"), "n", 16, stride=12, least=8, copies=1)
    assert rows(got, "id", "start", "end", "copy") == rows(expected, "id", "start", "end", "copy")
    whole = views.sql("SELECT s.id, c.* FROM sizes s, LATERAL stride_chunks(s.n, 0) c")
    assert rows(whole, "id", "start", "end") == [(1, 0, 40), (2, 0, 7), (5, 0, 16)]


def test_segments(views):
    got = views.sql("SELECT * FROM segments_of(TABLE(marks), 'user_id', 'sample', 'symbol', 100000)")
    expected = records.segments(views.table("marks"), "user_id", "sample", "symbol", F.lit(100000))
    assert rows(got, "user_id", "start", "end", "label") == rows(expected, "user_id", "start", "end", "symbol")
    assert got.schema["user_id"].dataType == views.table("marks").schema["user_id"].dataType


def test_arguments_are_checked_before_anything_runs(views):
    for bad, why in (("sliding_windows(3, 2)", "takes an array"), ("sliding_windows(array(1), 0)", "at least 1"), ("stride_chunks(5, -1)", "at least 0"), ("segments_of(TABLE(marks), 'user_id', 'none', 'symbol', 5)", "no column 'none'")):
        with pytest.raises(Exception, match=why):
            views.sql(f"SELECT * FROM {bad}").schema  # noqa: B018


def test_named_aggregates(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (1, 5.0, 0), (1, 9.0, 0), (2, 4.0, 1)], "k int, s double, t int")
    of = lambda how: {r.k: r.s for r in records.aggregate_predictions(df, "k", "s", "t", how).collect()}
    assert (of("mean")[1], of("max")[1], of("min")[1], of("median")[1], of("sum")[1]) == (5.0, 9.0, 1.0, 5.0, 15.0)
    records.add_aggregate("spread", lambda c: F.max(c) - F.min(c))
    try:
        assert of("spread") == {1: 8.0, 2: 0.0} and of(lambda c: F.avg(c) * 2)[2] == 8.0
    finally:
        del records.AGGREGATES["spread"]
    with pytest.raises(ValueError, match="no aggregate 'mode'"):
        of("mode")
