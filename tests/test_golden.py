"""Values worked out by hand, and properties."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import columns as c
from seqloom.operators import neural, records, sequences, series, similarity, stratify


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def lcs_table(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_rounding_is_half_to_even(spark):
    assert list(one(spark, *[c.quantize(F.lit(x)).alias(str(i)) for i, x in enumerate((0.5, 1.5, 2.5, -0.5))])) == [0, 2, 2, 0]


def test_nearest_takes_the_lower_of_two(spark):
    assert one(spark, c.nearest(F.lit(3), F.array(F.lit(2), F.lit(4))))[0] == 2


def test_lower_median_and_interpolated_quantile(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    r = df.selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x) AS a", "percentile(x, 0.5) AS b").first()
    assert (r.a, r.b) == (2.0, 2.5)


def test_array_split_against_fixed_size():
    assert [len(x) for x in np.array_split(np.arange(10), 3)] == [4, 3, 3]


def test_array_split_bounds(spark):
    n, parts = F.lit(10).cast("long"), F.lit(3).cast("long")
    got = [tuple(one(spark, *c.array_split_bounds(n, parts, F.lit(i).cast("long")))) for i in range(3)]
    assert got == [(0, 4), (4, 7), (7, 10)]


def test_divergence_skips_what_one_side_lacks(spark):
    p = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "x string, p double")
    q = spark.createDataFrame([("a", 1.0)], "x string, q double")
    kl = p.join(q, "x").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))).first()[0]
    assert kl == pytest.approx(0.5 * math.log(0.5))


def test_common_subsequence_by_hand():
    assert similarity.lcs_long([ord(x) for x in "ABCBDAB"], [ord(x) for x in "BDCABA"]) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=80), st.lists(st.integers(0, 4), max_size=80))
def test_common_subsequence_equals_the_table(a, b):
    assert similarity.lcs_long(a, b) == lcs_table(a, b)
    assert similarity.lcs_long(a, a) == len(a)


def test_common_subsequence_in_expressions(spark):
    rnd = random.Random(3)
    pairs = [([rnd.randint(1, 5) for _ in range(rnd.randint(1, 50))], [rnd.randint(1, 5) for _ in range(rnd.randint(0, 50))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a array<int>, b array<int>").withColumn("m", c.lcs_masks(F.col("a")))
    got = df.select("a", "b", c.lcs_length(F.col("m"), F.size("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == lcs_table(r.a, r.b) for r in got)


def test_recall_of_empty_sequences(spark):
    empty, some = F.array().cast("array<int>"), F.array(F.lit(1))
    assert one(spark, c.rouge_recall(F.lit(0), empty, empty))[0] == 1.0
    assert one(spark, c.rouge_recall(F.lit(0), empty, some))[0] == 0.0


def test_accuracy_of_different_lengths_is_zero(spark):
    assert one(spark, c.positional_accuracy(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1))))[0] == 0.0


def test_best_match_is_independent_and_floored(spark):
    real = spark.createDataFrame([([1, 2, 3, 4],), ([4, 1, 2, 3],)], "seq array<int>")
    query = spark.createDataFrame([(0, [1, 2, 3, 5]), (1, [9, 9, 9, 9])], "id int, seq array<int>")
    got = {r.id: (r.accuracy, r.rouge_l) for r in similarity.best_match(query, real).collect()}
    assert got == {0: (0.75, 0.75), 1: (0.0, 0.0)}
    assert similarity.best_match(query, real.limit(0)).agg(F.max("accuracy")).first()[0] == 0.0


def test_best_match_beyond_a_word(spark):
    rnd = random.Random(1)
    a, b = [rnd.randint(1, 9) for _ in range(100)], [rnd.randint(1, 9) for _ in range(100)]
    r = similarity.best_match(spark.createDataFrame([(a,)], "seq array<int>"), spark.createDataFrame([(b,)], "seq array<int>")).first()
    assert r.rouge_l == pytest.approx(lcs_table(a, b) / 100)


def test_scale_there_and_back(spark):
    x, lo, hi = F.lit(0.3), F.lit(-2.0), F.lit(5.0)
    assert one(spark, c.minmax(c.denormalize(x, lo, hi), lo, hi))[0] == pytest.approx(0.3)
    assert one(spark, c.minmax(x, lo, lo))[0] == 0.0
    assert one(spark, c.denormalize(x, lo, lo))[0] == 0.3


def test_lenient_and_strict_lines(spark):
    df = spark.createDataFrame([("1,2,3",), (" 4, 5 ",), ("6,x",), ("",)], "line string")
    assert [r.seq for r in sequences.parse_lenient(df, "line").collect()] == [[1, 2, 3], [4, 5]]
    assert [r.seq for r in sequences.parse_lenient(df, "line", 3).collect()] == [[1, 2, 3]]
    with pytest.raises(Exception, match="not a trace line"):
        sequences.parse_strict(df, "line").collect()


def test_row_numbers_without_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(7)
    got = sequences.row_numbers(df, ["id"], F.floor(F.col("id") / 100)).collect()
    assert all(r.rn == r.id + 1 for r in got)


def test_packing_rolls_over(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate((5, 6, 3, 4))], "id int, n int")
    got = [(r.file, r.start) for r in series.pack(df, ["id"], "n", 10).orderBy("id").collect()]
    assert got == [(0, 0), (0, 5), (1, 0), (1, 3)]
    assert {r.file for r in series.pack(df, ["id"], "n", 0).collect()} == {0}


def test_masks_remove_what_they_should(spark):
    rows = spark.range(3).selectExpr("id AS vec_id", "explode(sequence(0L, 1L)) AS ch").selectExpr("*", "explode(sequence(0L, 9L)) AS t")
    missing = lambda df: {r[2] for r in df.groupBy("vec_id", "ch").agg(F.sum(1 - F.col("keep"))).collect()}
    assert missing(series.mask_random(rows, 4)) == {4}
    assert missing(series.mask_segment(rows, 10, 3)) <= {1, 3}
    assert missing(series.mask_array_split(rows, 10, 3)) <= {3, 4}
    shared = series.mask_segment(rows, 10, 3, shared=True)
    assert shared.groupBy("vec_id", "t").agg(F.count_distinct("keep").alias("k")).agg(F.max("k")).first()[0] == 1


def test_folds_keep_groups_together(spark):
    rows = spark.createDataFrame([(f"g{i % 20}", [["a"], ["b"], ["a", "b"]][i % 3]) for i in range(200)], "g string, l array<string>")
    got = stratify.stratified_folds(rows, "g", "l", [0.5, 0.5]).collect()
    assert len(got) == 20 and len({r.g for r in got}) == 20
    assert {r.fold for r in got} == {0, 1} and abs(sum(r.fold for r in got) - 10) <= 2


def test_folds_spread_a_rare_label():
    labels = [[0]] * 8 + [[1]] * 2
    folds = stratify.assign(labels, [1] * 10, [0.5, 0.5])
    assert sorted(folds[8:]) == [0, 1] and sum(folds[:8]) == 4


def test_delineation(spark):
    marks = [(1, i * 10, s) for i, s in enumerate("(p)(N)t)(t")]
    df = spark.createDataFrame(marks, "user_id long, sample long, symbol string")
    got = sorted((r.start, r.end, r.kind) for r in stratify.delineate(df).collect())
    assert got == [(0, 20, "p"), (30, 50, "N"), (60, 70, "t"), (80, 90, "t")]


def test_asof_takes_the_last_known_mark(spark):
    marks = spark.createDataFrame([(1, 5, "a"), (1, 8, "x"), (1, 9, "b")], "k int, t int, label string")
    probes = spark.createDataFrame([(1, t) for t in (4, 5, 8, 20)], "k int, t int")
    got = {r.t: r.label for r in records.asof_label(marks, probes, "k", "t", "label", "unk", ["x"]).collect()}
    assert got == {4: "unk", 5: "a", 8: "unk", 20: "b"}


def test_targets_must_agree(spark):
    df = spark.createDataFrame([(1, 0.5, 0), (1, 0.7, 1)], "id int, score double, target int")
    with pytest.raises(Exception, match="targets disagree"):
        records.aggregate_predictions(df, "id", "score", "target").collect()


def test_time_feature_names():
    assert set(c.BY_FREQUENCY["H"]) == {"hour", "weekday", "day", "dayofyear"}
    with pytest.raises(ValueError, match="no time features"):
        c.time_features(None, "7X")


def test_gelu_close_to_exact(spark):
    xs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = one(spark, *[c.gelu(F.lit(x)).alias(str(i)) for i, x in enumerate(xs)])
    assert list(got) == pytest.approx([0.5 * x * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=1e-6)


def test_kernel_equals_the_recurrence():
    a, b = neural.hippo_legs(8)
    da, db = neural.bilinear(a, b, 0.01)
    cvec = np.linspace(-1, 1, 8)
    k = neural.krylov_kernel(da, db, cvec, 50)
    u, s, out = np.sin(np.arange(50)), np.zeros(8), []
    for x in u:
        s = da @ s + db * x
        out.append(cvec @ s)
    assert np.allclose(neural.fft_conv(u, k), out, atol=1e-8)


def test_samples_do_not_depend_on_their_neighbours():
    net = neural.TraceDenoiser.initial(8, 1, 10, 0)
    gens = lambda ids: [np.random.default_rng([1, i]) for i in ids]
    assert np.allclose(neural.sample(net, 3, 6, gens([0, 1, 2]))[1], neural.sample(net, 1, 6, gens([1]))[0])


def test_imputation_keeps_what_is_known():
    net = neural.TraceDenoiser.initial(8, 1, 10, 0)
    values, keep = np.arange(12.0).reshape(2, 6) / 12, np.array([[1, 0, 1, 1, 0, 1]] * 2)
    out = neural.impute(net, values, keep, [np.random.default_rng(i) for i in range(2)])
    assert np.allclose(out[keep == 1], values[keep == 1]) and not np.allclose(out, values)
