"""Stratified folds for rows with several labels, whole groups at a time.

Groups with the same rows, label by label (a profile), are alike to the assignment. So each fold gets its whole share of every
profile, rounded down, and which groups these are follows from a drawn number within the profile: a count and a comparison, with
no order among groups. Only what the rounding leaves, fewer groups of a profile than there are folds, goes through the sequential
rule, where each choice changes what the folds still need. Should that be more than BATCH groups, they are dealt to batches that
balance themselves, so no task holds more, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import ranges
from seqloom.operators.sequences import row_numbers
from seqloom.tables import materialize


def assign(labels: list[list[int]], sizes: list[int], ratios: list[float], seed: int = 0) -> list[int]:
    """`assign_counts` where the label ids of each group are listed with repetition."""
    return assign_counts([np.unique(np.array(x, np.int64), return_counts=True) for x in labels], sizes, ratios, seed)


def assign_counts(labels: list[tuple[np.ndarray, np.ndarray]], sizes: list[int], ratios: list[float], seed: int = 0, wants: np.ndarray | None = None) -> list[int]:
    """A fold for each group of `sizes` rows, whose rows have labels: (ids, how often each) for every group. `wants` (group, fold) says
    how much of a group each fold is due, if that is not the ratios.

    While labels are left: take the rarest one; its groups, those with most of it first, go one by one to the fold that wants
    most of the label, then most rows, then by a draw. Groups without labels go where most rows are wanted.
    """
    rng = np.random.default_rng(seed)
    own = labels
    n_labels = 1 + max((int(ids.max()) for ids, _ in own if len(ids)), default=-1)
    left = np.zeros(n_labels, np.int64)
    members: list[list[tuple[int, int]]] = [[] for _ in range(n_labels)]
    for g, (ids, times) in enumerate(own):
        left[ids] += times
        for x, k in zip(ids.tolist(), times.tolist(), strict=True):
            members[x].append((-k, -g))
    due = np.tile(np.array(ratios, np.float64), (len(own), 1)) if wants is None else wants
    want = np.zeros((len(ratios), n_labels))
    for g, (ids, times) in enumerate(own):
        want[:, ids] += np.outer(due[g], times)
    want_rows = np.array(sizes, np.float64) @ due if len(own) else np.zeros(len(ratios))
    fold = np.full(len(labels), -1)

    def put(g: int, score: np.ndarray) -> None:
        best = np.flatnonzero(score == score.max())
        best = best[want_rows[best] == want_rows[best].max()]
        f = int(best[0] if len(best) == 1 else rng.choice(best))
        fold[g] = f
        ids, times = own[g]
        want[f, ids] -= times
        left[ids] -= times
        want_rows[f] -= sizes[g]

    while True:
        open_ = np.flatnonzero(left > 0)
        if not len(open_):
            break
        label = int(open_[np.argmin(left[open_])])
        for _, g in sorted(members[label]):
            if fold[-g] < 0:
                put(-g, want[:, label])
    for g in np.flatnonzero(fold < 0).tolist():
        put(g, want_rows)
    return fold.tolist()


#: Groups that one task assigns by the sequential rule.
BATCH = 100_000
_RANGES = 4096


def profiles(rows: DataFrame, group: str, labels: str) -> DataFrame:
    """(group_, names, times, n): how many rows each group has, and its labels in order with how often each occurs. Groups with a
    null name are left out."""
    flat = rows.where(F.col(group).isNotNull()).select(F.col(group).alias("group_"), F.col(labels).cast("array<string>").alias("_labels"))
    # A group is a row of counts, one for each of its labels, however many rows it has.
    each = flat.select("group_", F.explode("_labels").alias("_label")).where(F.col("_label").isNotNull()).groupBy("group_", "_label").agg(F.count("*").alias("_times"))
    own = each.groupBy(F.col("group_").alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_label", "_times"))).alias("_p"))
    per = flat.groupBy("group_").agg(F.count("*").alias("n")).join(own, F.col("group_") == F.col("_g"), "left")
    pick = lambda c, kind: F.coalesce(F.transform("_p", lambda x: x[c]), F.array().cast(kind))
    return per.select("group_", pick("_label", "array<string>").alias("names"), pick("_times", "array<long>").alias("times"), "n")


def stratified_folds(rows: DataFrame, group: str, labels: str, ratios: list[float], seed: int = 0, batch: int = BATCH) -> DataFrame:
    """(group, fold) for rows with a group and an array of labels. Groups with a null name are left out.

    Of the m groups of a profile, fold f gets floor(m * ratio) by number; the others are assigned one by one to the folds that
    still want most of their labels, at most about `batch` of them in a task.
    """
    drawn = F.xxhash64("group_", F.lit(seed))
    own = profiles(rows, group, labels)
    same = ["names", "times", "n"]
    m = own.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.count("*").alias("m"))
    numbered = row_numbers(own.withColumn("_draw", drawn), ["_draw", "group_"], F.shiftright("_draw", 64 - _RANGES.bit_length() + 1), "_no", by=same)
    numbered = numbered.join(m, [F.col(c) == F.col(f"_{c}") for c in same]).drop("_draw", *[f"_{c}" for c in same])
    # A ratio such as 0.1 is a little more than a tenth; the product must not be taken for a little less than a whole number.
    quotas = [F.floor(F.col("m") * r + 1e-9) for r in ratios]
    ends, fold = [], F.lit(0).cast("long")
    for q in quotas:
        ends.append(q if not ends else ends[-1] + q)
    for e in ends[:-1]:
        fold = fold + (F.col("_no") > e).cast("long")
    left = F.col("m") - ends[-1]
    wants = F.array(*[(F.col("m") * r - q) / left for r, q in zip(ratios, quotas, strict=True)])
    numbered = materialize(numbered.select("group_", *same, F.when(F.col("_no") <= ends[-1], fold).alias("fold"), F.when(left > 0, wants).alias("wants")), "fold-numbers")
    rest = numbered.where(F.col("fold").isNull())
    parts = max(1, -(-rest.count() // batch))
    kind = numbered.schema["group_"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group_").reset_index(drop=True)
        some = [(list(a), list(b)) for a, b in zip(pdf["names"], pdf["times"], strict=True)]
        number = {x: i for i, x in enumerate(sorted({x for names, _ in some for x in names}))}
        ids = [(np.array([number[x] for x in names], np.int64), np.array(times, np.int64)) for names, times in some]
        due = np.array(pdf["wants"].tolist(), float)
        return pd.DataFrame({"group_": pdf["group_"], "fold": np.array(assign_counts(ids, pdf["n"].tolist(), ratios, seed, due), np.int64)})

    dealt = rest.withColumn("batch", F.pmod(F.xxhash64("group_"), F.lit(parts)))
    assigned = dealt.groupBy("batch").applyInPandas(run, f"group_ {kind}, fold long")
    return numbered.where(F.col("fold").isNotNull()).select("group_", "fold").unionByName(assigned).withColumnRenamed("group_", group)


def delineate(rows: DataFrame, most: int = ranges.MOST) -> DataFrame:
    """(user_id, start, end, kind) waves from annotation symbols: an opening mark, a peak and a closing mark make a wave; a peak
    without an opening or closing mark begins or ends at itself.

    An opening mark is never part of the wave before it, and a closing mark behind a peak always is of that peak's wave. So each peak
    is one wave, and the marks next to it tell its ends: nothing is read in order. A mark without a place is its key's last."""
    mark = F.struct("sample", "symbol")
    own = rows.select("user_id", "sample", "symbol", F.coalesce("sample", F.lit(1 << 62)).alias("_at"), mark.alias("_mark"))
    own = materialize(ranges.ranged(own, "user_id", "_at", most), "marks")
    own = ranges.neighbour(ranges.neighbour(own, "user_id", "_at", "_mark", "_before"), "user_id", "_at", "_mark", "_after", forwards=False)
    end = lambda side, symbol: F.when(F.col(side)["symbol"] == symbol, F.col(side)["sample"]).otherwise(F.col("sample"))
    peaks = own.where(~F.col("symbol").isin("(", ")"))
    return peaks.select("user_id", end("_before", "(").alias("start"), end("_after", ")").alias("end"), F.col("symbol").alias("kind"))
