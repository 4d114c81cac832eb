"""One parameterised preparation of record tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.operators import records
from seqloom.operators.sequences import row_numbers
from seqloom.operators.series import LCG_M, draw


@dataclass
class RecordPipeline:
    """Clean, filter labels by support and encode them, give folds to whole groups, and standardise a size within each fold."""

    key: str
    group: str
    labels: str
    size: str
    least_support: int = 10
    least_size: int = 1
    folds: int = 10
    seed: int = 1

    def __call__(self, rows: DataFrame, group_number: Column) -> DataFrame:
        """All columns of `rows` that are clean, with itos, kept, ids, fold and z. `group_number` is a number for the group."""
        counted = records.label_support(rows, self.key, self.labels, self.least_support)
        clean = counted.where(F.col(self.size) >= self.least_size)
        coded = clean.withColumn("ids", F.transform("kept", lambda x: F.array_position("itos", x) - 1))
        groups = rows.select(F.col(self.group).alias("_g"), group_number.alias("_n")).distinct()
        drawn = draw("_n", seed=self.seed)
        groups = row_numbers(groups, [drawn, "_n"], F.floor(drawn / (LCG_M // 4096)), "_number")
        groups = groups.select("_g", ((F.col("_number") - 1) % self.folds).cast("long").alias("fold"))
        out = coded.join(groups, F.col(self.group) == F.col("_g")).drop("_g")
        stats = out.groupBy(F.col("fold").alias("_f")).agg(F.avg(self.size).alias("_mean"), F.stddev_pop(self.size).alias("_std"))
        out = out.join(F.broadcast(stats), F.col("fold") == F.col("_f"))  # a row for each of `folds` folds
        return out.withColumn("z", (F.col(self.size) - F.col("_mean")) / (F.col("_std") + 1e-8)).drop("_f", "_mean", "_std")
