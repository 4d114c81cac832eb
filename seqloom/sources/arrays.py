"""Scans and sinks of .npy arrays, record bundles and JSON reports."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, value) of the arrays in .npy files: one row for each index of the first axis, its values flattened. Files
    are decoded on the executors, wherever Spark can read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                data = np.atleast_1d(data).reshape(len(np.atleast_1d(data)), -1).astype(np.float64)
                for a in range(0, len(data), 4096):
                    part = data[a : a + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(a, a + len(part))), pa.array(list(part), pa.list_(pa.float64()))], ["path", "row", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(run, "path string, row long, value array<double>")


def pack_npy(rows: DataFrame, group: list[str], order: str, value: str, name: str = "npy") -> DataFrame:
    """One .npy file (as bytes) for each group: the arrays of its rows stacked in order. A group must fit one task."""
    packed = rows.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(len(group)).to_pylist():
                buffer = io.BytesIO()
                np.save(buffer, np.array([x[value] for x in own]), allow_pickle=False)
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(group)], pa.array(out, pa.binary())], [*group, name])

    types = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)
    return packed.mapInArrow(run, f"{types}, {name} binary")


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


def scan_binary(spark: SparkSession, path: str, glob: str, decode: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """Records of any binary format: `decode` turns one file's bytes into rows. This is the extension point for signal and
    annotation formats whose readers are not installed."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = decode(bytes(content))
                yield pd.DataFrame([(name, *r) for r in rows], columns=["path", *names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def save_bundle(records: DataFrame, labels: DataFrame, stats: DataFrame, path: str) -> None:
    """A record table, its label names (id, name) and statistics side by side."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    labels.write.mode("overwrite").json(f"{path}/labels")
    stats.write.mode("overwrite").json(f"{path}/stats")


def load_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `save_bundle` wrote."""
    return spark.read.parquet(f"{path}/records"), spark.read.json(f"{path}/labels"), spark.read.json(f"{path}/stats")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at `path`, built and written first if it is missing or `again` is set."""
    if again or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json_report(one_row: DataFrame, path: str) -> None:
    """One row of metrics as a line of JSON."""
    one_row.select(F.to_json(F.struct(*one_row.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def save_results(samples: DataFrame, targets: DataFrame, masks: DataFrame, path: str) -> DataFrame:
    """What an evaluation leaves: samples, targets and masks side by side, and how many rows each has."""
    for name, rows in (("samples", samples), ("targets", targets), ("masks", masks)):
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = samples.sparkSession
    counts = [spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name in ("samples", "targets", "masks")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def log_metrics(spark: SparkSession, path: str, step: int, **metrics: float) -> None:
    """One more line of JSON in a log of metrics; `read_log` gives them back. Names are free, steps may repeat."""
    row = spark.createDataFrame([(step, {k: float(v) for k, v in metrics.items()})], "step long, metrics map<string,double>")
    row.coalesce(1).write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(step, name, value) of all that `log_metrics` wrote."""
    return spark.read.schema("step long, metrics map<string,double>").json(path).select("step", F.explode("metrics").alias("name", "value"))


def latest_checkpoint(names: DataFrame, name: Column) -> DataFrame:
    """The largest number among files called <number>.pkl, -1 if there is none."""
    return names.agg(F.coalesce(F.max(F.regexp_extract(name, r"^(.+)\.pkl$", 1).try_cast("int")), F.lit(-1)).alias("n"))


def read_config(text: str, sections: tuple[str, ...] = ("diffusion_config", "train_config", "trainset_config", "gen_config")) -> dict:
    """A configuration from JSON; missing sections are an error that names them."""
    config = json.loads(text)
    missing = [s for s in sections if s not in config]
    if missing:
        raise ValueError(f"configuration without {', '.join(missing)}")
    return config
