"""Operators on event traces: collecting, vocabularies, windows, chunks and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import ranges
from seqloom.tables import materialize


def vocabulary(events: DataFrame, event: str, base: int = 0) -> DataFrame:
    """(event, id): ids by falling count, ties by the event. Only the aggregated table, as long as the vocabulary, is sorted."""
    counts = events.groupBy(event).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.orderBy(F.desc("_n"), event)) - 1 + base
    return counts.select(event, rank.cast("int").alias("id"))


def collect_traces(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, seq): the values of each key in order. One shuffle; the sort is within each key's array."""
    packed = F.array_sort(F.collect_list(F.struct(*order, value)))
    return events.groupBy(key).agg(packed.alias("_p")).select(key, F.transform("_p", lambda x: x[value]).alias("seq"))


def parse_lenient(lines: DataFrame, line: str, length: int | None = None) -> DataFrame:
    """Rows with `seq`: blank lines and lines with a token that is no integer are dropped, and so are those shorter than
    `length`; longer ones are cut to it."""
    tokens = F.transform(F.split(F.trim(F.col(line)), ","), lambda x: F.trim(x).try_cast("int"))
    out = lines.where(F.trim(F.col(line)) != "").withColumn("seq", tokens).where(~F.exists("seq", lambda x: x.isNull()))
    return out if length is None else prefix_truncate(out, length)


def parse_strict(lines: DataFrame, line: str) -> DataFrame:
    """Rows with `seq`; a blank line or a token that is no integer is an error."""
    tokens = F.transform(F.split(F.trim(F.col(line)), ","), lambda x: F.trim(x).try_cast("int"))
    bad = F.exists(tokens, lambda x: x.isNull())
    return lines.withColumn("seq", F.when(bad, F.raise_error(F.concat(F.lit("not a trace line: "), F.col(line))).cast("array<int>")).otherwise(tokens))


def prefix_truncate(traces: DataFrame, length: int) -> DataFrame:
    """Sequences of at least `length` values, cut to it."""
    return traces.where(F.size("seq") >= length).withColumn("seq", F.slice("seq", 1, length))


def sliding_windows(traces: DataFrame, length: int, stride: int) -> DataFrame:
    """Windows of `length` every `stride` positions; `st` is the start from 0. A generator per row, no shuffle."""
    starts = F.sequence(F.lit(0).cast("long"), (F.size("seq") - length).cast("long"), F.lit(stride).cast("long"))
    own = traces.where(F.size("seq") >= length).withColumn("st", F.explode(starts))
    return own.withColumn("seq", F.slice("seq", (F.col("st") + 1).cast("int"), length))


def stride_chunks(records: DataFrame, size: str, chunk: int, stride: int | None = None, least: int = 0, start: int = 0, copies: int = 0) -> DataFrame:
    """(start, end, copy) chunks of records of `size` values: starts every `stride` (default: the chunk), the last ones cut at
    the record's end, chunks shorter than `least` left out; chunk 0 means the whole record. Lengths never grow with the
    start, so leaving out short ones is the same as stopping at the first."""
    n = F.col(size).cast("long")
    if chunk == 0:
        out = records.withColumn("start", F.lit(start).cast("long")).withColumn("end", n)
    else:
        step = stride or chunk
        last = F.greatest(n - 1, F.lit(start).cast("long"))
        out = records.where(n > start).withColumn("start", F.explode(F.sequence(F.lit(start).cast("long"), last, F.lit(step).cast("long"))))
        out = out.withColumn("end", F.least(F.col("start") + chunk, n))
    out = out.where((F.col("end") - F.col("start") >= least) & (F.col("end") > F.col("start")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))


def batches(rows: DataFrame, order: list[str], coarse: Column, size: int) -> DataFrame:
    """`batch`: number (from 0) of the contiguous batch of `size` rows in the order of unique keys; the last one may be smaller.
    `coarse` is as for `row_numbers`."""
    numbered = row_numbers(rows, order, coarse, "_number")
    return numbered.withColumn("batch", F.floor((F.col("_number") - 1) / size)).drop("_number")


#: Entries of a vocabulary that goes to every row as one map; of a larger one, events are looked up by a join.
MAP_ENTRIES = 10_000


def encode(traces: DataFrame, vocabulary_: DataFrame, event: str, most: int = MAP_ENTRIES) -> DataFrame:
    """Sequences of events as sequences of ids; events that the vocabulary lacks become null. A vocabulary of at most `most` entries
    is one row with a map; a larger one meets the events, one by one, by a join, and sequences are put together again."""
    if vocabulary_.limit(most + 1).count() <= most:
        lookup = vocabulary_.agg(F.map_from_entries(F.collect_list(F.struct(event, "id"))).alias("_map"))
        return traces.crossJoin(F.broadcast(lookup)).withColumn("seq", F.transform("seq", lambda x: F.element_at("_map", x))).drop("_map")
    own = materialize(traces.withColumn("_row", F.monotonically_increasing_id()), "encode-traces")
    each = own.select("_row", F.posexplode("seq").alias("_i", "_e"))
    each = each.join(vocabulary_.select(F.col(event).alias("_event"), F.col("id").alias("_id")), F.col("_e") == F.col("_event"), "left")
    back = each.groupBy(F.col("_row").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("_i", "_id"))).alias("_p"))
    kind = f"array<{vocabulary_.schema['id'].dataType.simpleString()}>"
    empty = F.when(F.col("seq").isNotNull(), F.array().cast(kind))
    out = own.join(back, F.col("_row") == F.col("_of"), "left").withColumn("seq", F.coalesce(F.transform("_p", lambda x: x["_id"]), empty))
    return out.drop("_row", "_of", "_p")


def islands(rows: DataFrame, key: str, position: str, most: int = ranges.MOST) -> DataFrame:
    """(key, first, last) runs of consecutive positions."""
    numbered = row_numbers(ranges.ranged(rows.select(key, position), key, position, most), [position], F.col(ranges.RANGE), "_no", by=[key])
    group = F.col(position) - F.col("_no")
    return numbered.withColumn("_g", group).groupBy(key, "_g").agg(F.min(position).alias("first"), F.max(position).alias("last")).drop("_g")


def row_numbers(rows: DataFrame, order: list[str | Column], coarse: Column, name: str = "rn", by: list[str] | None = None) -> DataFrame:
    """Numbers (from 1) of all rows, or of those that share `by`, in the order of unique keys, without bringing them to one task.

    `coarse` is an expression that does not fall along the order (a day, a range of ids). Rows are numbered within each of its
    values, and the counts of the values before it are added; only the table of counts is sorted in one place.
    """
    by = by or []
    own, before = _before(rows, coarse, by, F.count("*"))
    number = F.row_number().over(Window.partitionBy(*by, "_coarse").orderBy(*order))
    out = _with_before(own.withColumn("_rn", number), before, by)
    return out.withColumn(name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_coarse", "_rn", "_before")


def running_sums(rows: DataFrame, order: list[str | Column], coarse: Column, value: str, name: str) -> DataFrame:
    """The sum of `value` (whole numbers) over all rows before each one in the order of unique keys; `coarse` is as for
    `row_numbers`."""
    own, before = _before(rows, coarse, [], F.sum(value))
    inside = F.sum(value).over(Window.partitionBy("_coarse").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = _with_before(own.withColumn("_sum", F.coalesce(inside, F.lit(0))), before, [])
    return out.withColumn(name, (F.col("_sum") + F.col("_before")).cast("long")).drop("_coarse", "_sum", "_before")


def _before(rows: DataFrame, coarse: Column, by: list[str], what: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with `_coarse`, and the aggregate of all rows with lower values of it."""
    own = rows.withColumn("_coarse", coarse)
    table = own.groupBy(*by, "_coarse").agg(what.alias("_n"))
    sum_before = F.sum("_n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1))
    return own, table.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_coarse").alias("_c"), F.coalesce(sum_before, F.lit(0)).alias("_before"))


def _with_before(own: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    on = F.col("_coarse").eqNullSafe(F.col("_c"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return own.join(before, on).drop("_c", *[f"_by_{c}" for c in by])
