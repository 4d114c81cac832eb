"""Scans and sinks of trace text files laid out as <root>/<app>/sequence_length_<L>/<split>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import sequences


def scan(spark: SparkSession, path: str, length: int | None = None, strict: bool = False) -> DataFrame:
    """Sequences of one file or folder, with `path` and `seq`. Lenient: lines that are blank, hold a token that is no integer
    or are shorter than `length` drop out. Strict: they are an error (lengths are not looked at)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    parsed = sequences.parse_strict(lines, "line") if strict else sequences.parse_lenient(lines, "line", length)
    return parsed.select("path", "seq")


def require_rows(traces: DataFrame, what: str) -> DataFrame:
    """The same frame; ValueError if it has no rows. This runs a job that stops at the first row."""
    if traces.isEmpty():
        raise ValueError(f"no valid sequences in {what}")
    return traces


def scan_tree(spark: SparkSession, root: str, name: str = "training", length: int | None = None) -> DataFrame:
    """All files called `name` below a folder, with app, length and split from their path; files that cannot be read are
    skipped. Filters on these columns only skip rows, not files; give a deeper root to read less."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("ignoreCorruptFiles", True)
    lines = reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    part = lambda i: F.regexp_extract("path", r"([^/]+)/sequence_length_([0-9]+)/([^/]+)$", i)
    parsed = sequences.parse_lenient(lines, "line", length)
    return parsed.select(F.nullif(part(1), F.lit("")).alias("app"), part(2).try_cast("int").alias("length"), F.nullif(part(3), F.lit("")).alias("split"), "path", "seq")


def vocabulary_of(traces: DataFrame) -> DataFrame:
    """(event, id): ids from 0 by falling count over all sequences."""
    return sequences.vocabulary(traces.select(F.explode("seq").alias("event")), "event")


def write_text(traces: DataFrame, path: str) -> None:
    """One line for each sequence, its values joined by commas."""
    traces.select(F.array_join(F.col("seq").cast("array<string>"), ",")).write.mode("overwrite").text(path)


def write_stats(traces: DataFrame, path: str, top: int = 10) -> None:
    """A short report in plain text: counts, lengths, range of values and the commonest ones."""
    n = F.size("seq")
    stats = traces.agg(F.count("*").alias("rows"), F.sum(n).alias("total"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(F.array_min("seq")).alias("least"), F.max(F.array_max("seq")).alias("most"))
    head = stats.select(F.lit(0).alias("o"), F.format_string("sequences %d\nevents %d\nlength %d to %d, mean %.2f, std %.2f\nvalues %d to %d", *stats.columns).alias("line"))
    counts = traces.select(F.explode("seq").alias("event")).groupBy("event").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event").limit(top)
    whole = stats.select("total")
    body = counts.crossJoin(F.broadcast(whole)).select((F.row_number().over(_by_count())).alias("o"), F.format_string("event %d: %d (%.2f%%)", "event", "n", 100.0 * F.col("n") / F.col("total")).alias("line"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("o").select("line").write.mode("overwrite").text(path)


def _by_count():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("n"), "event")  # over `top` rows


def experiment_path(steps: int, first: float, last: float) -> str:
    """The folder name of a run with a given schedule."""
    return f"T{steps}_beta0{first}_betaT{last}"
