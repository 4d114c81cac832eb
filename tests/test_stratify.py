"""Folds over many groups are one assignment."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from seqloom.operators import stratify


def test_rare_labels_are_balanced_over_many_groups(spark):
    # Four groups in 30,000 have the rare label, more groups than were ever assigned together before.
    n, rare = 30_000, [7, 9_001, 17_003, 29_999]
    rows = spark.range(n).select(F.col("id").alias("g"), F.when(F.col("id").isin(rare), F.array(F.lit("rare"))).otherwise(F.array(F.lit("common"))).alias("l"))
    got = {r.g: r.fold for r in stratify.stratified_folds(rows, "g", "l", [0.25] * 4).collect()}
    assert len(got) == n and sorted(got[g] for g in rare) == [0, 1, 2, 3]
    want = stratify.assign([[1 if g in rare else 0] for g in range(n)], [1] * n, [0.25] * 4)
    # As many of each kind in each fold as the assignment one by one gives.
    assert Counter((f, g in rare) for g, f in got.items()) == Counter((f, g in rare) for g, f in enumerate(want))


def test_shares_of_profiles_are_rounded_down_and_the_rest_is_assigned(spark):
    rnd = random.Random(7)
    ratios = [0.8, 0.1, 0.1]
    groups = [(g, [rnd.choice("ab"), *(["c"] if rnd.random() < 0.1 else [])], rnd.choice([1, 1, 1, 3])) for g in range(700)]
    rows = spark.createDataFrame([(g, own) for g, own, n in groups for _ in range(n)] + [(None, ["a"]), (999, None), (998, [])], "g int, l array<string>")
    for batch in (100_000, 3):
        found = stratify.stratified_folds(rows, "g", "l", ratios, seed=2, batch=batch).collect()
        fold = {r.g: r.fold for r in found}
        assert len(found) == len(fold) == 702 and None not in fold
        profile = {g: (tuple(own), n) for g, own, n in groups} | {999: ((), 1), 998: ((), 1)}
        m, n = Counter(profile.values()), Counter((profile[g], f) for g, f in fold.items())
        for p, total in m.items():
            low = [int(total * r + 1e-9) for r in ratios]
            assert all(low[f] <= n[p, f] <= low[f] + total - sum(low) for f in range(3))
        if batch > 3:
            for label in "abc":
                total = [sum(k * p[1] for (p, f), k in n.items() if f == i and label in p[0]) for i in range(3)]
                assert all(abs(t - r * sum(total)) <= 4 for t, r in zip(total, ratios, strict=True))


def test_no_task_holds_all_groups(spark):
    """What is assigned one by one is what rounding leaves, whatever the number of groups."""
    rows = spark.range(200_000).select(F.col("id").alias("g"), F.array((F.col("id") % 3).cast("string")).alias("l"))
    out = stratify.stratified_folds(rows, "g", "l", [0.3, 0.7])
    assert {r.fold: r["count"] for r in out.groupBy("fold").count().collect()} == {0: 60_000, 1: 140_000}


def test_folds_do_not_depend_on_unused_label_numbers():
    rnd = random.Random(3)
    labels = [[rnd.randrange(5) for _ in range(rnd.randint(0, 4))] for _ in range(60)]
    folds = stratify.assign(labels, [1] * 60, [0.5, 0.3, 0.2], seed=1)
    assert sorted(set(folds)) == [0, 1, 2] and folds == stratify.assign([[2 * x for x in own] for own in labels], [1] * 60, [0.5, 0.3, 0.2], seed=1)
