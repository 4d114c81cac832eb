"""Operators on record tables: labels, as-of labelling, segments, statistics, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import ranges
from seqloom.operators.sequences import row_numbers
from seqloom.operators.series import LCG_M, draw
from seqloom.tables import materialize


#: Supported labels that go to every row as one array; of more, each row's are looked up by a join.
ARRAY_LABELS = 1000


def label_support(rows: DataFrame, key: str, labels: str, least: int, most: int = ARRAY_LABELS) -> DataFrame:
    """`kept`: the labels, in order, that occur at least `least` times over all rows, and `itos`: all kept labels, sorted (null if they
    are more than `most`). Support is aggregated before anything is joined."""
    support = materialize(rows.select(F.explode(labels).alias("_l")).groupBy("_l").agg(F.count("*").alias("_n")).where(F.col("_n") >= least), "label-support")
    if support.limit(most + 1).count() <= most:
        names = support.agg(F.array_sort(F.collect_list("_l")).alias("itos"))
        return rows.crossJoin(F.broadcast(names)).withColumn("kept", F.filter(labels, lambda x: F.array_contains("itos", x)))
    own = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "label-rows")
    each = own.select("_row", F.posexplode(labels).alias("_i", "_l")).join(support.select("_l"), "_l")
    kept = each.groupBy(F.col("_row").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("_i", "_l"))).alias("_kept"))
    none = F.lit(None).cast(rows.schema[labels].dataType)
    out = own.join(kept, F.col("_row") == F.col("_of"), "left").withColumn("itos", none)
    some = F.coalesce(F.transform("_kept", lambda x: x["_l"]), F.slice(labels, 1, 0))
    return out.withColumn("kept", some).drop("_row", "_of", "_kept")


def asof_label(marks: DataFrame, probes: DataFrame, key: str, at: str, label: str, default: str, unknown: list[str], most: int = ranges.MOST) -> DataFrame:
    """Each probe with the label of the latest mark at or before it; `default` before the first mark, and from a mark whose
    label is among `unknown`. Marks and probes are merged by a sort within ranges of a key's time; of several marks at one time
    the last one by label counts."""
    known = F.when(F.col(label).isin(unknown), default).otherwise(F.col(label)) if unknown else F.col(label)
    a = marks.select(key, at, F.lit(0).alias("_kind"), known.alias("_label"))
    b = probes.select(key, at, F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_label"))
    both = ranges.last_known(ranges.ranged(a.unionByName(b), key, at, most), key, [at, "_kind", "_label"], "_label", "_last")
    return both.where("_kind = 1").select(key, at, F.coalesce("_last", F.lit(default)).alias(label))


def segments(marks: DataFrame, key: str, at: str, label: str, length: Column, most: int = ranges.MOST) -> DataFrame:
    """(key, start, end, label): from each change point to the next, the last one to the record's length plus one."""
    end = (length + 1).alias("_end")
    own = ranges.ranged(marks.select(key, at, label, end), key, at, most)
    out = ranges.neighbour(own, key, at, at, "_next", forwards=False)
    return out.select(key, F.col(at).alias("start"), F.coalesce("_next", "_end").alias("end"), label)


def segment_filter(parts: DataFrame, key: str, label: str, unknown: str, least: int, most: int = ranges.MOST) -> DataFrame:
    """Segments without the unknown label, numbered per key, then those of at least `least`; numbers count the short ones."""
    known = ranges.ranged(parts.where(F.col(label) != unknown), key, "start", most)
    known = row_numbers(known, ["start"], F.col(ranges.RANGE), "_no", by=[key]).withColumn("number", F.col("_no") - 1).drop("_no", ranges.RANGE)
    return known.where((F.col("end") - F.col("start") > 0) & (F.col("end") - F.col("start") >= least))


def gap_relabel(runs: DataFrame, key: str, at: str, label: str, gap: str, names: dict[tuple[str, str], str], most: int = ranges.MOST) -> DataFrame:
    """Gaps between two known neighbours get the name for that pair of labels; gaps at an edge and unnamed pairs stay."""
    own = ranges.ranged(runs, key, at, most)
    own = ranges.neighbour(ranges.neighbour(own, key, at, label, "_before"), key, at, label, "_after", forwards=False)
    out = F.col(label)
    for (a, b), name in names.items():
        out = F.when((F.col(label) == gap) & (F.col("_before") == a) & (F.col("_after") == b), name).otherwise(out)
    return own.withColumn(label, out).drop("_before", "_after", ranges.RANGE)


def edge_trim(rows: DataFrame, key: str, at: str, label: str, background: str) -> DataFrame:
    """Rows from the first to the last that is not background. The two ends are aggregated, not gathered."""
    real = F.when(F.col(label) != background, F.col(at))
    ends = rows.groupBy(F.col(key).alias("_k")).agg(F.min(real).alias("_lo"), F.max(real).alias("_hi"))
    return rows.join(ends, F.col(key).eqNullSafe(F.col("_k")) & F.col(at).between(F.col("_lo"), F.col("_hi"))).drop("_k", "_lo", "_hi")


def kfold(rows: DataFrame, key: str, label: str, folds: int, seed: int = 1) -> DataFrame:
    """`fold`: within each label, unique keys in a drawn order are dealt round robin. A label's rows are numbered in 4,096
    ranges of the draw, so no label comes to one task."""
    drawn = draw(key, seed=seed)
    numbered = row_numbers(rows, [drawn, key], F.floor(drawn / (LCG_M // 4096)), "_number", by=[label])
    return numbered.withColumn("fold", ((F.col("_number") - 1) % folds).cast("long")).drop("_number")


def sampling_weights(rows: DataFrame, label: str, length: str, weights: Column) -> DataFrame:
    """Class weight times the row's share of its class's total length, relative to the least. A class is one row of totals, whatever
    its size; the least comes from these rows."""
    own = rows.withColumn("_w", weights * F.col(length))
    totals = own.groupBy(F.col(label).alias("_l")).agg(F.sum(length).alias("_total"), F.min("_w").alias("_least"))
    least = totals.agg(F.min(F.col("_least") / F.col("_total")).alias("_min"))
    out = own.join(totals, F.col(label).eqNullSafe(F.col("_l"))).crossJoin(F.broadcast(least))  # one row
    return out.withColumn("weight", F.col("_w") / F.col("_total") / F.col("_min")).drop("_w", "_l", "_total", "_least", "_min")


#: Aggregates by name. `add_aggregate` puts in more.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "median": F.median,
    "sum": F.sum,
}


def add_aggregate(name: str, function: Callable[[Column], Column]) -> None:
    """An aggregate of the user's own: a function of a column to an aggregated one, or a grouped-aggregate pandas UDF."""
    AGGREGATES[name] = function


def aggregate_predictions(rows: DataFrame, key: str, score: str, target: str, how: str | Callable[[Column], Column] = "mean") -> DataFrame:
    """One score for each source row, by an aggregate's name or the aggregate itself; its parts must agree on the target."""
    if isinstance(how, str) and how not in AGGREGATES:
        raise ValueError(f"no aggregate {how!r}; there are {', '.join(sorted(AGGREGATES))}")
    pick = AGGREGATES[how] if isinstance(how, str) else how
    out = rows.groupBy(key).agg(pick(F.col(score)).alias(score), F.min(target).alias(target), F.max(target).alias("_hi"))
    agreed = F.when(F.col(target) == F.col("_hi"), F.col(target)).otherwise(F.raise_error(F.lit("targets disagree")).cast(rows.schema[target].dataType))
    return out.select(key, score, agreed.alias(target))
