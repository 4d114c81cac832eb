"""Intermediate tables (see `seqloom.tables`), and columns that are carried through operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.tables import discard, materialize, shared_dir

__all__ = ["added_up", "columns", "discard", "fresh", "materialize", "shared_dir", "with_carried"]


def with_carried(df: DataFrame, carry: dict[str, Column], more: list[Column], run: Callable, schema: str, results: tuple[str, ...]) -> DataFrame:
    """`run` over Arrow batches of the carried columns and of `more`; it gives the carried ones first and then `schema`. Inside
    all have names of their own, so none can clash; after, the carried ones have theirs again and what `run` added is called
    `results`. A carried column with the name of a result (case does not count) makes way for it."""
    kept = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(carry.values())], *[c.alias(f"_x{i}") for i, c in enumerate(more)])
    types = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in kept.schema.fields[: len(carry)])
    out, taken = kept.mapInArrow(run, types + schema), {x.lower() for x in results}
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c.lower() not in taken]
    return out.select(*own, *[F.col(c).alias(name) for c, name in zip(out.columns[len(carry) :], results, strict=True)])


def columns(names: tuple[str, ...]) -> dict[str, Column]:
    """Columns by their names, whatever characters these have."""
    return {c: F.col(f"`{c}`") for c in names}


def fresh(taken: list[str], *names: str) -> tuple[str, ...]:
    """The names, each with underscores before it until no column is called so (case does not count, as in Spark)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return tuple(out)


#: Tasks whose sums one task adds up.
FAN_IN = 256


def added_up(pieces: DataFrame, n: int, run: Callable) -> DataFrame:
    """One row a piece from the rows (piece, sums) of all tasks; `run`, for mapInArrow, adds up the pieces that a task has got. With many
    tasks it goes in levels, FAN_IN to one, so that no task reads what all tasks have made."""
    schema, tasks = pieces.schema, pieces.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        dealt = pieces.withColumn("_group", F.spark_partition_id() % tasks).repartition(n * tasks, "piece", "_group")
        pieces = dealt.drop("_group").mapInArrow(run, schema)
    # Each of the exchange's partitions holds whole pieces, so every piece arrives once.
    return pieces.repartition(n, "piece").mapInArrow(run, schema)
