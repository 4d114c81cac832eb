"""Steps that the preparation of record tables is made of, and recipes that chain them.

Each step takes and returns a DataFrame of records, so a preparation is `chained(records, steps)`. Steps that need the rest of a
group use one aggregate or a bounded window of that group, and join back on its key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators import records
from seqloom.operators.series import draw

Step = Callable[[DataFrame], DataFrame]


def first_of_each(group: str, *order: str) -> Step:
    """The first record of each group in the order of unique keys. One aggregate; records of a null group are one group."""

    def run(rows: DataFrame) -> DataFrame:
        every = F.struct(*order, F.struct(*rows.columns).alias("_row"))
        return rows.groupBy(F.col(group).alias("_g")).agg(F.min(every)["_row"].alias("_row")).select("_row.*")

    return run


def at_most_of_each(group: str, most: int, *order: str) -> Step:
    """The first `most` records of each group; every task keeps no more of a group before they meet."""

    def run(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")

    return run


def matched_only(other: DataFrame, key: str) -> Step:
    """Records with a row in another table, with its columns; the others go."""
    return lambda rows: rows.join(other, key)


def only_datasets(column: str, names: list[str]) -> Step:
    """Records of some source tables."""
    return lambda rows: rows.where(F.col(column).isin(names))


def _each(test: Callable[[Column, str], Column], kind: str) -> Callable[[Column], Column]:
    return lambda x: test(x, kind)


def complete(*columns: str) -> Step:
    """Records without a null or NaN in the columns; of arrays, without one in any place."""

    def run(rows: DataFrame) -> DataFrame:
        def is_bad(x: Column, kind: str) -> Column:
            return x.isNull() | F.isnan(x) if kind in ("double", "float") else x.isNull()

        bad = F.lit(False)
        for c in columns:
            kind = rows.schema[c].dataType.simpleString()
            inside = kind.removeprefix("array<").removesuffix(">")
            bad = bad | (is_bad(F.col(c), kind) if inside == kind else F.col(c).isNull() | F.coalesce(F.exists(c, _each(is_bad, inside)), F.lit(False)))
        return rows.where(~bad)

    return run


def composite_labels(name: str, *parts: Column) -> Step:
    """An array of labels from several columns; null parts are left out."""
    return lambda rows: rows.withColumn(name, F.array_compact(F.array(*parts)))


def labels_of_part(labels: str, part: Column) -> Step:
    """Labels become null outside the part (rows of validation and test keep their place without them)."""
    return lambda rows: rows.withColumn(labels, F.when(part, F.col(labels)))


def zero_based(*columns: str) -> Step:
    """Labels counted from 1 counted from 0; null stays null."""
    return lambda rows: rows.withColumns({c: F.col(c) - 1 for c in columns})


def aliased(column: str, same: dict) -> Step:
    """Ids that mean the same one."""
    out = F.col(column)
    for old, new in same.items():
        out = F.when(F.col(column) == old, F.lit(new)).otherwise(out)
    return lambda rows: rows.withColumn(column, out)


def unit(column: str, factor: float) -> Step:
    """A number, or each of an array, in another unit."""

    def run(rows: DataFrame) -> DataFrame:
        many = rows.schema[column].dataType.simpleString().startswith("array<")
        return rows.withColumn(column, F.transform(column, lambda x: x * factor) if many else F.col(column) * factor)

    return run


def supported(key: str, labels: str, least: int) -> Step:
    """Labels that occur often enough, in `kept`, and their names in `itos`."""
    return lambda rows: records.label_support(rows, key, labels, least)


def folds_within(dataset: str, key: str, folds: int, seed: int = 1) -> Step:
    """Folds dealt round robin within each source table."""
    return lambda rows: records.kfold(rows, key, dataset, folds, seed)


def folds_of_groups(group: str, folds: int, seed: int = 1) -> Step:
    """Folds drawn for groups with a number, so that all records of a group share one."""
    return lambda rows: rows.withColumn("fold", draw(group, seed=seed) % folds)


def only_folds(*which: int) -> Step:
    return lambda rows: rows.where(F.col("fold").isin(list(which)))


def at_most_long(column: str, most: int) -> Step:
    """Arrays cut to their first `most` values."""
    return lambda rows: rows.withColumn(column, F.slice(column, 1, most))


def merged_names(labels: str, names: dict[str, str]) -> Step:
    """Labels that are taken together get one name (`a|b`); each name comes once, in the order of its first label."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return lambda rows: rows.withColumn(labels, F.array_distinct(F.transform(labels, lambda x: F.coalesce(table[x], x))))


def merged(*groups: list[str]) -> dict[str, str]:
    """Names for groups of labels, for `merged_names`."""
    return {x: "|".join(g) for g in groups for x in g}


#: Which steps, in which order, each kind of collection needs; columns as in the scans of this package.
RECIPES: dict[str, list[str]] = {
    "diagnoses with first records": ["aliased", "complete", "composite_labels", "first_of_each", "folds_within"],
    "labels in optional columns": ["matched_only", "zero_based", "composite_labels", "labels_of_part", "folds_within"],
    "statements with likelihoods": ["composite_labels", "supported", "folds_of_groups"],
    "long recordings of patients": ["complete", "at_most_long", "matched_only", "folds_of_groups"],
    "several collections": ["only_datasets", "complete", "supported", "folds_within"],
    "two label columns": ["composite_labels", "unit", "supported", "folds_within"],
    "flags of several readers": ["matched_only", "composite_labels", "at_most_long", "folds_within"],
    "exams with many records": ["at_most_of_each", "matched_only", "composite_labels", "folds_of_groups", "only_folds"],
    "annotated recordings": ["aliased", "merged_names", "supported", "folds_of_groups"],
}


def recipe(kind: str, **arguments: tuple) -> list[Step]:
    """The steps of a kind of collection with the arguments of each; a step without arguments is an error that names it."""
    missing = [s for s in RECIPES[kind] if s not in arguments]
    if missing:
        raise ValueError(f"no arguments for {', '.join(missing)}")
    return [globals()[s](*arguments[s]) for s in RECIPES[kind]]
