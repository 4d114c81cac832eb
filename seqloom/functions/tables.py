"""Table functions for SQL: one record becomes many chunks, windows or segments.

    SELECT t.user_id, w.* FROM traces t, LATERAL sliding_windows(t.seq, 20, 5) w
    SELECT r.id, c.* FROM records r, LATERAL stride_chunks(r.n, 16, 12, 8, 1) c
    SELECT * FROM segments_of(TABLE(marks), 'user_id', 'sample', 'symbol', 1000)

Each says in `analyze` what it returns for the types it gets, and refuses arguments that make no sense before anything runs.
`segments_of` takes a whole table: it asks Spark to partition it by the key and to sort it by time, and keeps one mark at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


def _whole(argument: AnalyzeArgument | None, name: str, least: int) -> int | None:
    """A constant whole number not below `least`; None where it is not there or not constant."""
    if argument is None or not argument.isConstantExpression:
        return None
    if not isinstance(argument.value, int) or argument.value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}, not {argument.value!r}")
    return argument.value


@udtf
class SlidingWindows:
    """(st, seq): windows of `length` elements every `stride` (default 1) of an array of any type; null and shorter arrays have none."""

    @staticmethod
    def analyze(seq: AnalyzeArgument, length: AnalyzeArgument, stride: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(seq.dataType, ArrayType):
            raise ValueError("sliding_windows takes an array")
        _whole(length, "length", 1)
        _whole(stride, "stride", 1)
        return AnalyzeResult(StructType().add("st", LongType()).add("seq", seq.dataType))

    def eval(self, seq: list | None, length: int, stride: int = 1) -> Iterator[tuple]:
        if seq is not None:
            for st in range(0, len(seq) - length + 1, stride):
                yield st, seq[st : st + length]


@udtf
class StrideChunks:
    """(start, end, copy): chunks of a record of `n` values, as `operators.sequences.stride_chunks` gives them."""

    @staticmethod
    def analyze(n: AnalyzeArgument, chunk: AnalyzeArgument, stride: AnalyzeArgument | None = None, least: AnalyzeArgument | None = None, copies: AnalyzeArgument | None = None) -> AnalyzeResult:
        _whole(chunk, "chunk", 0)
        _whole(stride, "stride", 0)
        return AnalyzeResult(StructType().add("start", LongType()).add("end", LongType()).add("copy", IntegerType()))

    def eval(self, n: int | None, chunk: int, stride: int = 0, least: int = 0, copies: int = 0) -> Iterator[tuple]:
        starts = [0] if chunk == 0 else range(0, n or 0, stride or chunk)
        for start in starts:
            end = (n or 0) if chunk == 0 else min(start + chunk, n or 0)
            if end > start and end - start >= least:
                for copy in range(copies + 1):
                    yield start, end, copy


@udtf
class SegmentsOf:
    """(key, start, end, label) of a table of marks: from each mark to the next of its key, the last one to `length` + 1. The key is
    the column's value as it is; marks at one time make an empty segment."""

    def __init__(self) -> None:
        self.mark: tuple | None = None

    @staticmethod
    def analyze(marks: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, label: AnalyzeArgument, length: AnalyzeArgument) -> AnalyzeResult:
        names: dict[str, Any] = {f.name: f.dataType for f in marks.dataType.fields} if marks.isTable else {}
        missing = [c.value for c in (key, at, label) if c.value not in names]
        if missing:
            raise ValueError(f"no column {missing[0]!r} in the table of marks")
        schema = StructType().add(key.value, names[key.value]).add("start", LongType()).add("end", LongType()).add("label", names[label.value])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(at.value)])

    def eval(self, row: Any, key: str, at: str, label: str, length: int) -> Iterator[tuple]:
        if self.mark is not None:
            yield self.mark[0], self.mark[1], row[at], self.mark[2]
        self.mark, self.end = (row[key], row[at], row[label]), length + 1

    def terminate(self) -> Iterator[tuple]:
        if self.mark is not None:
            yield self.mark[0], self.mark[1], self.end, self.mark[2]


TABLES = {"sliding_windows": SlidingWindows, "stride_chunks": StrideChunks, "segments_of": SegmentsOf}


def register_tables(spark: SparkSession) -> None:
    """The table functions under their names."""
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
