"""Rows of a key in order, where one key may have most of the rows.

Each key's span is cut into ranges of about `most` rows (by its own extent and count), so that a long key is many tasks. What a
row needs from before or after its range comes from the table of ranges, which is shorter by a factor of `most`: a range's
first or last value is carried over the empty ones to its neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, where they lie evenly.
MOST = 1 << 16
RANGE = "_range"


def ranged(rows: DataFrame, key: str, at: str, most: int = MOST) -> DataFrame:
    """The rows with the number of their range, which does not fall along `at` (a whole number) within a key."""
    n, lo, hi = F.count("*"), F.min(at), F.max(at)
    width = F.greatest(F.lit(1).cast("long"), F.ceil((hi - lo + 1) / n * most))
    spans = rows.groupBy(F.col(key).alias("_k")).agg(lo.alias("_lo"), width.alias("_width"))
    return rows.join(spans, F.col(key).eqNullSafe(F.col("_k"))).withColumn(RANGE, F.floor((F.col(at) - F.col("_lo")) / F.col("_width"))).drop("_k", "_lo", "_width")


def _in_range(key: str) -> Window:
    return Window.partitionBy(key, RANGE)


def carried(rows: DataFrame, key: str, value: Column, forwards: bool = True, name: str = "_carried") -> DataFrame:
    """Ranged rows with `value`, an aggregate over a range that may be null, of the nearest range before (or behind) theirs that has one."""
    table = rows.groupBy(key, RANGE).agg(value.alias("_v"))
    order = F.col(RANGE) if forwards else F.col(RANGE).desc()
    near = F.last("_v", ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    table = table.select(F.col(key).alias("_k"), F.col(RANGE).alias("_r"), near.alias(name))
    return rows.join(table, F.col(key).eqNullSafe(F.col("_k")) & (F.col(RANGE) == F.col("_r"))).drop("_k", "_r")


def last_known(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Ranged rows with the latest value that is not null, at the row or before it in the order (the first of which made the ranges)."""
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    inside = F.last(value, ignorenulls=True).over(_in_range(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return carried(rows, key, last).withColumn(name, F.coalesce(inside, "_carried")).drop("_carried")


def neighbour(rows: DataFrame, key: str, at: str, value: str, name: str, forwards: bool = True) -> DataFrame:
    """Ranged rows with `value` of the row before (or behind) them by unique `at`."""
    pick = F.max_by if forwards else F.min_by
    inside = _in_range(key).orderBy(at if forwards else F.col(at).desc())
    out = carried(rows, key, pick(F.struct(value), at), forwards)
    near = F.lag(F.struct(value)).over(inside)
    return out.withColumn(name, F.coalesce(near, "_carried")[value]).drop("_carried")
