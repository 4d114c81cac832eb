"""Operators on multivariate series in tall form (key columns, t, ch, value): masks, scaling, metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.columns import array_split_bounds
from seqloom.operators import ranges
from seqloom.operators.sequences import row_numbers, running_sums
from seqloom.tables import discard, materialize

#: A linear congruential step, small enough to stay exact in 64-bit integers; the same arithmetic works in any SQL engine.
LCG_A, LCG_B, LCG_M = 1103515245, 12345, 2147483647


def draw(*keys: Column | str, seed: int = 1) -> Column:
    """A reproducible pseudo-random integer in [0, LCG_M) from the keys, whatever the partitioning."""
    h = F.lit(seed).cast("long")
    for k in keys:
        c = F.col(k) if isinstance(k, str) else k
        h = ((h + c.cast("long")) % LCG_M * LCG_A + LCG_B) % LCG_M
    return h


def draw_sql(*keys: str, seed: int = 1) -> str:
    """The same expression as SQL text."""
    h = f"CAST({seed} AS BIGINT)"
    for k in keys:
        h = f"((({h} + {k}) % {LCG_M}) * {LCG_A} + {LCG_B}) % {LCG_M}"
    return h


def mask_random(rows: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """`keep` = 0 at exactly k positions of each channel of each series."""
    order = Window.partitionBy("vec_id", "ch").orderBy(draw("vec_id", "ch", "t", seed=seed), "t")
    return rows.withColumn("keep", (F.row_number().over(order) > k).cast("int"))


def mask_segment(rows: DataFrame, length: int, size: int, shared: bool = False, seed: int = 1) -> DataFrame:
    """`keep` = 0 in one segment of `size` positions (the last one may be shorter), drawn for each channel, or, if `shared`,
    once for all channels of a series."""
    segments = -(-length // size)
    which = draw("vec_id", *([] if shared else ["ch"]), seed=seed) % segments
    return rows.withColumn("keep", (F.floor(F.col("t") / size) != which).cast("int"))


def mask_array_split(rows: DataFrame, length: int, parts: int, shared: bool = False, seed: int = 1) -> DataFrame:
    """`keep` = 0 in one of `parts` nearly equal parts."""
    which = draw("vec_id", *([] if shared else ["ch"]), seed=seed) % parts
    start, end = array_split_bounds(F.lit(length).cast("long"), F.lit(parts).cast("long"), which)
    return rows.withColumn("keep", (~((F.col("t") >= start) & (F.col("t") < end))).cast("int"))


def mask_ratio(rows: DataFrame, observed: Column, ratio: float, seed: int = 1) -> DataFrame:
    """`keep` = 0 at int(n * ratio) of the n observed cells of each series; cells that are not observed are 0 too."""
    own = rows.withColumn("_o", observed.cast("int"))
    order = Window.partitionBy("vec_id", "_o").orderBy(draw("vec_id", "t", "ch", seed=seed), "t", "ch")
    n = F.count("*").over(Window.partitionBy("vec_id", "_o"))
    gone = F.row_number().over(order) <= F.floor(n * ratio)
    return own.withColumn("keep", F.when((F.col("_o") == 1) & ~gone, 1).otherwise(0)).drop("_o")


def standardize(rows: DataFrame, value: str, fit: Column, by: list[str] | None = None) -> DataFrame:
    """`mean`, `std` (population; 1 where it is 0) of the rows for which `fit` holds, and `scaled`."""
    by = by or []
    stats = rows.where(fit).groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_s"))
    stats = stats.withColumn("std", F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_s")
    both = rows.join(stats, by) if by else rows.crossJoin(F.broadcast(stats))  # one row of statistics
    return both.withColumn("scaled", (F.col(value) - F.col("mean")) / F.col("std"))


def pinball(target: Column, forecast: Column, q: Column | float) -> Column:
    """Twice the quantile loss of one cell."""
    return 2 * F.abs((forecast - target) * (F.when(target <= forecast, 1.0).otherwise(0.0) - q))


def alpha_bar(schedule: DataFrame) -> DataFrame:
    """A schedule (t, beta) with alpha, alpha_bar and the one before it (1 at the first step). A schedule is short."""
    bar = F.exp(F.sum(F.log(1 - F.col("beta"))).over(Window.orderBy("t")))
    out = schedule.withColumn("alpha", 1 - F.col("beta")).withColumn("alpha_bar", bar)
    return out.withColumn("alpha_bar_prev", F.lag("alpha_bar", 1, 1.0).over(Window.orderBy("t")))


def sigma(schedule: DataFrame) -> DataFrame:
    """The posterior's standard deviation: sqrt(beta (1 - previous alpha_bar) / (1 - alpha_bar)), and sqrt(beta) at step 0."""
    post = F.col("beta") * (1 - F.col("alpha_bar_prev")) / (1 - F.col("alpha_bar"))
    return alpha_bar(schedule).withColumn("sigma", F.sqrt(F.when(F.col("t") == 0, F.col("beta")).otherwise(post)))


def add_noise(x: Column, bar: Column, noise: Column) -> Column:
    """Forward noising."""
    return F.sqrt(bar) * x + F.sqrt(1 - bar) * noise


def reverse_mean(x: Column, alpha: Column, bar: Column, noise: Column) -> Column:
    """The mean of a reverse step that predicts the noise."""
    return (x - (1 - alpha) / F.sqrt(1 - bar) * noise) / F.sqrt(alpha)


def pack(sizes: DataFrame, order: list[str], size: str, most: int, coarse: Column | None = None) -> DataFrame:
    """Offsets of arrays packed one behind the other into files: (order, file, start, length) for each, a new file once the running end
    of the current one is over `most` (0: a single file). `order` are unique keys, `coarse` is as for `sequences.row_numbers`
    (without it, the first key is a number and its ranges are as wide as `ranges.MOST`).

    Where a file ends depends on where the one before it ended. So each array learns which one would begin the next file if it began
    one itself (`_successors`), and the arrays that do begin one are those on the way from the first: the way is doubled each round,
    so the rounds are the logarithm of the number of files. Nothing passes through one task.
    """
    own = sizes.select(*order, F.col(size).cast("long").alias("length"))
    coarse = F.floor(F.col(order[0]) / ranges.MOST) if coarse is None else coarse
    own = running_sums(row_numbers(own, order, coarse, "_no"), order, coarse, "length", "_at")
    own = materialize(own.withColumn("_i", F.col("_no") - 1).drop("_no"), "pack-arrays")
    if not most:
        return own.select(*order, F.lit(0).cast("long").alias("file"), F.col("_at").alias("start"), "length")
    jump = materialize(_successors(own, most), "pack-next")
    begins = materialize(own.where(F.col("_i") == 0).select("_i"), "pack-begins")
    while True:
        reached = begins.join(jump, "_i").select(F.col("_next").alias("_i"))
        again = jump.select(F.col("_i").alias("_from"), F.col("_next").alias("_to"))
        after = materialize(jump.join(again, F.col("_next") == F.col("_from")).select("_i", F.col("_to").alias("_next")), "pack-next")
        reached = materialize(begins.unionByName(reached), "pack-begins")
        done = reached.count() == begins.count()
        for used in (jump, begins):
            discard(used)
        jump, begins = after, reached
        if done:
            break
    flagged = own.join(begins.withColumn("_new", F.lit(1)), "_i", "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    numbered = running_sums(flagged, ["_i"], F.floor(F.col("_i") / ranges.MOST), "_new", "_files")
    numbered = materialize(numbered.withColumn("file", F.col("_files") + F.col("_new") - 1), "pack-files")
    first = numbered.where("_new = 1").select(F.col("file").alias("_f"), F.col("_at").alias("_first"))
    return numbered.join(first, F.col("file") == F.col("_f")).select(*order, "file", (F.col("_at") - F.col("_first")).alias("start"), "length")


def _successors(own: DataFrame, most: int) -> DataFrame:
    """(_i, _next): for arrays (_i, _at) in order, the first one that lies more than `most` behind each; without one, no row.

    Both sides are merged within ranges of the offset; where a range has no such array, the first of the next range that has any is it.
    """
    size = own.agg(F.count("*").alias("n"), F.max("_at").alias("top")).first()
    width = max(most + 1, -(-((size.top or 0) + 1) * ranges.MOST // max(1, size.n)))
    marks = own.select(F.col("_at").alias("_v"), F.lit(0).alias("_kind"), F.col("_i").alias("_mark"), "_i")
    probes = own.select((F.col("_at") + most).alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_mark"), "_i")
    both = marks.unionByName(probes).withColumn("_range", F.floor(F.col("_v") / width))
    # From behind: what comes before a probe lies behind it, and the last of these is the nearest.
    order = [F.desc("_v"), F.desc("_kind"), F.desc("_i")]
    inside = F.last("_mark", ignorenulls=True).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    table = both.groupBy("_range").agg(F.min("_mark").alias("_first"))
    behind = F.last("_first", ignorenulls=True).over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1))
    table = table.select(F.col("_range").alias("_r"), behind.alias("_behind"))
    out = both.withColumn("_inside", inside).where("_kind = 1").join(table, F.col("_range") == F.col("_r"))
    return out.select("_i", F.coalesce("_inside", "_behind").alias("_next")).where(F.col("_next").isNotNull())


# Shuffled order

SHUFFLE_ROUNDS, SHUFFLE_WALK = 4, 64


def _mixed(x: Column, key: int) -> Column:
    t = (x + key) % LCG_M
    return (t * t % LCG_M * LCG_A + LCG_B) % LCG_M


def shuffled_position(i: Column, n: int, seed: int = 0) -> Column:
    """Where number i (from 0) of n stands in an order drawn by `seed`: a permutation that is computed row by row, with nothing sorted.

    A Feistel network over pairs (i % a, i / a) with a = ceil(sqrt(n)) permutes a few more numbers than n; what lands beyond is
    sent through again until it is below n. A number is beyond with a chance of 1 / sqrt(n), so SHUFFLE_WALK passes are never used
    up where they are fewer than the numbers beyond; should they be, it is an error and not a wrong order.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def network(x: Column) -> Column:
        left, right = x % a, F.floor(x / a)
        for k in range(SHUFFLE_ROUNDS):
            if k % 2 == 0:
                left = (left + _mixed(right, shuffle_key(seed, k))) % a
            else:
                right = (right + _mixed(left, shuffle_key(seed, k))) % b
        return right * a + left

    walk = F.sequence(F.lit(1), F.lit(max(1, min(a * b - n, SHUFFLE_WALK))))
    out = F.aggregate(walk, network(i.cast("long")), lambda x, _: F.when(x < n, x).otherwise(network(x)))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("the walk was too short")).cast("long"))


def shuffle_key(seed: int, k: int) -> int:
    """The key of round k."""
    return (seed * 1_000_003 + (k + 1) * 7_919) % LCG_M


def shuffled_batches(rows: DataFrame, order: list[str], coarse: Column, size: int, seed: int) -> DataFrame:
    """`batch` and `slot`: rows in an order drawn by `seed` (one for each epoch), cut into batches of `size`; the last may be smaller.
    `order` and `coarse` are as for `sequences.row_numbers`, which numbers the rows before they are permuted."""
    own = row_numbers(rows, order, coarse, "_no")
    at = shuffled_position(F.col("_no") - 1, rows.count(), seed)
    return own.withColumn("_at", at).withColumns({"batch": F.floor(F.col("_at") / size), "slot": F.col("_at") % size}).drop("_no", "_at")
