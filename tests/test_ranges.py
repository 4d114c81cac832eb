"""Operators in the order of a key: cut into small ranges they give what they give whole, and what plain Python gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import ranges, records, sequences, series, stratify

HUGE = 1 << 40


@pytest.fixture(scope="module")
def marks(spark):
    rng = random.Random(6)
    rows = [(0, t, rng.choice("abg")) for t in rng.sample(range(3000), 400)] + [(k, t, rng.choice("abg")) for k in range(1, 6) for t in rng.sample(range(50), rng.randrange(1, 9))]
    rows += [(7, 5, "a"), (8, 10**12, "b"), (8, -(10**12), "g"), (8, 3, "a")]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, at long, label string").repartition(3)


def both(df):
    return sorted(map(tuple, df.collect()), key=repr)


def per_key(marks):
    out: dict = {}
    for k, at, label in marks.collect():
        out.setdefault(k, []).append((at, label))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("most", [1, 3, 50, HUGE])
def test_ranges_do_not_change_results(spark, marks, most):
    of = per_key(marks)
    probes = marks.select("k", (F.col("at") + 1).alias("at")).unionByName(marks.select("k", (F.col("at") - 1).alias("at"))).distinct()
    expected = []
    for k, at in map(tuple, probes.collect()):
        before = [label for t, label in of[k] if t <= at]
        expected.append((k, at, "none" if not before or before[-1] == "g" else before[-1]))
    assert both(records.asof_label(marks, probes, "k", "at", "label", "none", ["g"], most)) == sorted(expected, key=repr)

    got = both(records.segments(marks, "k", "at", "label", F.lit(10**13), most))
    assert got == sorted(((k, a, b, x) for k, v in of.items() for (a, x), b in zip(v, [*[t for t, _ in v[1:]], 10**13 + 1], strict=True)), key=repr)

    parts = records.segments(marks, "k", "at", "label", F.lit(10**13)).cache()
    got = both(records.segment_filter(parts, "k", "label", "g", 5, most).select("k", "start", "number"))
    numbered = [(k, s, i, e) for k in of for i, (_, s, e, x) in enumerate(sorted(p for p in map(tuple, parts.collect()) if p[0] == k and p[3] != "g"))]
    assert got == sorted(((k, s, i) for k, s, i, e in numbered if e - s >= 5), key=repr)

    got = both(records.gap_relabel(marks, "k", "at", "label", "g", {("a", "b"): "ab", ("b", "b"): "bb"}, most).select("k", "at", "label"))
    named = []
    for k, v in of.items():
        for i, (t, x) in enumerate(v):
            pair = (v[i - 1][1] if i else None, v[i + 1][1] if i + 1 < len(v) else None)
            named.append((k, t, {("a", "b"): "ab", ("b", "b"): "bb"}.get(pair, x) if x == "g" else x))
    assert got == sorted(named, key=repr)

    runs = []
    for k, v in of.items():
        own = [t for t, _ in v]
        first = own[0]
        for a, b in zip(own, [*own[1:], None], strict=True):
            if b != a + 1:
                runs.append((k, first, a))
                first = b
    assert both(sequences.islands(marks, "k", "at", most)) == sorted(runs, key=repr)


def test_a_key_of_most_rows_is_many_ranges(spark):
    rows = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id").alias("at")).unionByName(spark.range(10).select(F.lit(2).alias("k"), F.col("id").alias("at")))
    n = {r.k: (r.n, r.most) for r in ranges.ranged(rows, "k", "at", 1000).groupBy("k", "_range").count().groupBy("k").agg(F.count("*").alias("n"), F.max("count").alias("most")).collect()}
    assert n == {1: (200, 1000), 2: (1, 10)}


def test_edges_and_weights(spark, marks):
    of = per_key(marks)
    expected = []
    for k, v in of.items():
        real = [i for i, (_, x) in enumerate(v) if x != "g"]
        expected += [(k, *v[i]) for i in range(real[0], real[-1] + 1)] if real else []
    assert both(records.edge_trim(marks, "k", "at", "label", "g").select("k", "at", "label")) == sorted(expected, key=repr)
    rows = spark.createDataFrame([("a", 2.0), ("a", 6.0), ("b", 4.0), (None, 1.0)], "c string, n double")
    got = {(r.c, r.n): r.weight for r in records.sampling_weights(rows, "c", "n", F.lit(1.0)).collect()}
    assert got == {("a", 2.0): 1.0, ("a", 6.0): 3.0, ("b", 4.0): 4.0, (None, 1.0): 4.0}


def test_many_labels_are_joined(spark):
    rows = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["z"]), (3, []), (4, None), (5, ["y", None, "x"])], "i int, l array<string>")
    few = records.label_support(rows, "i", "l", 2, most=10).select("i", F.coalesce("kept", F.array()).alias("kept"))
    many = records.label_support(rows, "i", "l", 2, most=1).select("i", F.coalesce("kept", F.array()).alias("kept"))
    assert both(many) == [(1, ["x", "y", "x"]), (2, []), (3, []), (4, []), (5, ["y", "x"])] == both(few)


# Packing


def naive_pack(sizes, most):
    out, file, end = [], 0, 0
    for n in sizes:
        if most and end > most:
            file, end = file + 1, 0
        out.append((file, end, n))
        end += n
    return out


@pytest.mark.parametrize("most", [0, 1, 7, 30, 10_000])
def test_packs_roll(spark, monkeypatch, most):
    monkeypatch.setattr(ranges, "MOST", 8)
    rng = random.Random(most)
    sizes = [rng.choice([0, 0, 1, 2, 5, 9, 40]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n int").repartition(3)
    got = [tuple(r)[1:] for r in sorted(series.pack(df, ["i"], "n", most, F.floor(F.col("i") / 10)).collect())]
    assert got == naive_pack(sizes, most)
    assert series.pack(df.limit(0), ["i"], "n", most, F.floor(F.col("i") / 10)).count() == 0


# Shuffled order


@pytest.mark.parametrize("n", [1, 2, 3, 10, 99, 100, 101, 5000])
def test_positions_are_a_permutation(spark, n):
    at = [[r[0] for r in spark.range(n).orderBy("id").select(series.shuffled_position(F.col("id"), n, seed)).collect()] for seed in (1, 2)]
    assert all(sorted(x) == list(range(n)) for x in at)
    if n > 50:
        moved = [abs(a - b) for a, b in enumerate(at[0])]
        assert at[0] != at[1] and sum(moved) / n > n / 5  # a random order moves a third of n on average


def test_batches_have_each_row_once(spark):
    rows = spark.range(103)
    out = series.shuffled_batches(rows, ["id"], F.floor(F.col("id") / 20), 10, seed=3)
    assert sorted(r.id for r in out.collect()) == list(range(103))
    sizes = {r.batch: r["count"] for r in out.groupBy("batch").count().collect()}
    assert sizes == {i: 10 if i < 10 else 3 for i in range(11)}
    assert out.select("batch", "slot").distinct().count() == 103


def waves_in_order(marks):
    """Marks of a key read one after another."""
    at, symbol, out, i = [x[0] for x in marks], [x[1] for x in marks], [], 0
    peak = lambda j: j < len(at) and symbol[j] not in ("(", ")", None)
    closing = lambda j: j < len(at) and symbol[j] == ")"
    while i < len(at):
        if symbol[i] == "(" and peak(i + 1):
            step = 3 if closing(i + 2) else 2
            out.append((at[i], at[i + step - 1], symbol[i + 1]))
        elif peak(i):
            step = 2 if closing(i + 1) else 1
            out.append((at[i], at[i + step - 1], symbol[i]))
        else:
            step = 1
        i += step
    return out


@pytest.mark.parametrize("most", [1, 3, HUGE])
def test_waves_need_no_order(spark, most):
    """Also without a key, a place or a symbol, with an empty symbol, and without a task that holds a key's marks."""
    rng = random.Random(8)
    of = {k: [(t, rng.choice(["(", ")", "N", "p", "", None])) for t in sorted(rng.sample(range(900), n))] for k, n in [(1, 300), (2, 40), (3, 1), (None, 30)]}
    of[4] = [(7, "("), (9, "N"), (None, ")")]
    df = spark.createDataFrame([(k, t, s) for k, v in of.items() for t, s in v], "user_id long, sample long, symbol string").repartition(3)
    out = stratify.delineate(df, most)
    assert both(out) == sorted(((k, *w) for k, v in of.items() for w in waves_in_order(v)), key=repr)
    assert "Pandas" not in out._jdf.queryExecution().toString() and out.columns == ["user_id", "start", "end", "kind"]
