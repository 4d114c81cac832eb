"""SQL names for the sequence functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.operators.similarity import lcs_long


def register(spark: SparkSession) -> None:
    """`lcs_length(a, b)`, `rouge_l(a, b)` and `quantize(x)` for use in SQL; sequences of any length, in Arrow batches."""

    @F.pandas_udf("long")
    def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else lcs_long(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")

    @F.pandas_udf("double")
    def rouge_l(a: pd.Series, b: pd.Series) -> pd.Series:
        score = lambda x, y: lcs_long(list(x), list(y)) / len(x) if len(x) else float(len(y) == 0)
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("int")
    def quantize(x: pd.Series) -> pd.Series:
        return x.round().astype("Int32")

    for name, f in (("lcs_length", lcs_length), ("rouge_l", rouge_l), ("quantize", quantize)):
        spark.udf.register(name, f)
