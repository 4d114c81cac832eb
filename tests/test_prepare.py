"""Steps of preparations."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from seqloom.operators import prepare
from seqloom.operators.signal import chained


def test_steps(spark):
    rows = spark.createDataFrame(
        [(1, 7, "a", 1.0, [1.0, 2.0], 1), (2, 7, "b", math.nan, [1.0], 2), (3, 8, "a", 2.0, [math.nan], None), (4, 8, "c", 3.0, [3.0, 4.0, 5.0], 2), (5, None, "a", 4.0, None, 1)],
        "id long, g long, d string, v double, x array<double>, label int",
    )
    of = lambda df: sorted(r.id for r in df.collect())
    assert of(chained(rows, prepare.first_of_each("g", "id"))) == [1, 3, 5]
    assert of(chained(rows, prepare.at_most_of_each("g", 1, "id"))) == [1, 3, 5]
    assert of(chained(rows, prepare.complete("v", "x"))) == [1, 4]
    assert of(chained(rows, prepare.only_datasets("d", ["a", "c"]))) == [1, 3, 4, 5]
    other = spark.createDataFrame([(7, "x")], "g long, more string")
    assert of(chained(rows, prepare.matched_only(other, "g"))) == [1, 2]
    got = {r.id: r for r in chained(rows, [prepare.zero_based("label"), prepare.aliased("g", {7: 70}), prepare.unit("v", 0.001), prepare.unit("x", 2.0), prepare.at_most_long("x", 2), prepare.labels_of_part("label", F.col("d") == "a")]).collect()}
    assert (got[1].label, got[2].label, got[1].g, got[4].v, got[4].x, got[5].x) == (0, None, 70, 0.003, [6.0, 8.0], None)
    folds = chained(rows, [prepare.folds_within("d", "id", 2)]).collect()
    assert sorted(r.fold for r in folds if r.d == "a") == [0, 0, 1]
    names = chained(rows.withColumn("l", F.array(F.lit("p"), F.lit("q"), F.lit("r"), F.lit("p"))), prepare.merged_names("l", prepare.merged(["q", "p"]))).first()
    assert names.l == ["q|p", "r"]
    assert chained(rows, prepare.composite_labels("l", F.col("d"), F.lit(None).cast("string"))).first().l == ["a"]


def test_recipes_want_all_arguments(spark):
    assert all(callable(getattr(prepare, s)) for steps in prepare.RECIPES.values() for s in steps)
    with pytest.raises(ValueError, match="unit"):
        prepare.recipe("two label columns", composite_labels=("l",), supported=("k", "l", 1), folds_within=("d", "k", 2))
