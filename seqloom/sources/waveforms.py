"""Physiological records: a text header beside binary signal files, and binary annotation files.

Files are read by Spark's binary source; the parts of a record meet by a shuffle on its name, and each record is decoded by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of the annotation format and their symbols.
SYMBOLS = {
    1: "N", 2: "L", 3: "R", 4: "a", 5: "V", 6: "F", 7: "J", 8: "A", 9: "S", 10: "E", 11: "j", 12: "/", 13: "Q", 14: "~", 16: "|", 18: "s", 19: "T", 20: "*", 21: "D",
    22: '"', 23: "=", 24: "p", 25: "B", 26: "^", 27: "t", 28: "+", 29: "u", 30: "?", 31: "!", 32: "[", 33: "]", 34: "e", 35: "n", 36: "@", 37: "x", 38: "f", 39: "(", 40: ")", 41: "r",
}
_SKIP, _NUM, _SUB, _CHN, _AUX = 59, 60, 61, 62, 63


@dataclass
class Lead:
    """A signal line of a header."""

    file: str
    format: int
    gain: float
    baseline: float
    unit: str
    name: str


def read_header(text: str) -> tuple[float, int | None, list[Lead], list[str]]:
    """(rate, samples of a lead or None, leads, comments) of a header."""
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    comments = [x[1:].strip() for x in lines if x.startswith("#")]
    lines = [x for x in lines if not x.startswith("#")]
    if not lines:
        raise ValueError("an empty header")
    first = lines[0].split()
    n = int(first[1])
    rate = float(re.split(r"[/(]", first[2])[0]) if len(first) > 2 else 250.0
    samples = int(first[3]) if len(first) > 3 and int(first[3]) else None
    leads = []
    for line in lines[1 : 1 + n]:
        part = line.split(None, 8)
        form = re.match(r"\d+", part[1])
        if form is None or form[0] != part[1]:
            raise ValueError(f"signal format {part[1]!r} is not read")
        m = re.match(r"([-+0-9.eE]+)(?:\(([-+0-9]+)\))?(?:/(\S+))?", part[2] if len(part) > 2 else "200")
        zero = float(part[4]) if len(part) > 4 else 0.0
        leads.append(Lead(part[0], int(form[0]), float(m[1]) or 200.0, float(m[2]) if m[2] else zero, m[3] or "mV", part[8] if len(part) > 8 else ""))
    if len(leads) != n:
        raise ValueError(f"{n} leads announced, {len(leads)} described")
    return rate, samples, leads, comments


def read_samples(data: bytes, form: int) -> np.ndarray:
    """The numbers of a signal file in format 16, 212 or 80; NaN where one is marked as missing."""
    raw = np.frombuffer(data, np.uint8)
    if form == 16:
        out, missing = np.frombuffer(data[: len(data) // 2 * 2], "<i2").astype(np.float64), -(1 << 15)
    elif form == 80:
        out, missing = raw.astype(np.float64) - 128, None
    elif form == 212:
        raw = np.pad(raw, (0, -len(raw) % 3)).astype(np.int64).reshape(-1, 3)
        both = np.stack([raw[:, 0] | (raw[:, 1] & 15) << 8, raw[:, 2] | (raw[:, 1] >> 4) << 8], axis=1).reshape(-1)
        both = both[: len(data) * 2 // 3]
        out, missing = np.where(both > 2047, both - 4096, both).astype(np.float64), -2048
    else:
        raise ValueError(f"signal format {form} is not read")
    return out if missing is None else np.where(out == missing, np.nan, out)


def read_annotations(data: bytes) -> list[tuple[int, str, str]]:
    """(sample, symbol, text) of an annotation file."""
    out: list[tuple[int, str, str]] = []
    at, sample = 0, 0
    while at + 2 <= len(data):
        word = int.from_bytes(data[at : at + 2], "little")
        at += 2
        code, low = word >> 10, word & 1023
        if code == 0 and low == 0:
            break
        if code == _SKIP:
            high, rest = (int.from_bytes(data[at + i : at + i + 2], "little") for i in (0, 2))
            step = high << 16 | rest
            sample += step - (1 << 32) if step >= 1 << 31 else step
            at += 4
        elif code == _AUX:
            if out:
                out[-1] = (*out[-1][:2], data[at : at + low].decode("latin-1").rstrip("\0"))
            at += low + low % 2
        elif code not in (_NUM, _SUB, _CHN):
            sample += low
            out.append((sample, SYMBOLS.get(code, ""), ""))
    return out


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, rate, lead, name, unit, signal, comments): a row for each lead of each record below `path`. A record is a header
    (.hea) and the signal files (.dat) that it names, in the same folder; a missing file is an error, a missing sample null."""
    heads = _files(spark, path, "*.hea")
    lines = F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != ""))
    named = F.array_distinct(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: F.split(F.trim(x), r"\s+")[0]))
    head = heads.select("folder", F.regexp_replace("file", r"\.hea$", "").alias("record"), F.decode("content", "UTF-8").alias("header"), F.explode(named).alias("file"))
    data = _files(spark, path, "*.dat")
    both = head.join(data, ["folder", "file"], "left").groupBy("folder", "record", "header").agg(F.collect_list(F.struct("file", "content")).alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for record, header, data in zip(pdf["record"], pdf["header"], pdf["data"], strict=True):
                rate, samples, leads, comments = read_header(header)
                content = {x["file"]: x["content"] for x in data}
                rows = []
                for file in dict.fromkeys(x.file for x in leads):
                    own = [(i, x) for i, x in enumerate(leads) if x.file == file]
                    if content.get(file) is None:
                        raise ValueError(f"record {record} has no {file}")
                    flat = read_samples(bytes(content[file]), own[0][1].format)
                    flat = flat[: len(flat) // len(own) * len(own)].reshape(-1, len(own))[:samples]
                    rows += [(record, rate, i, x.name, x.unit, (flat[:, k] - x.baseline) / x.gain, comments) for k, (i, x) in enumerate(own)]
                yield pd.DataFrame(rows, columns=["record", "rate", "lead", "name", "unit", "signal", "comments"])

    return both.select("record", "header", "data").mapInPandas(run, "record string, rate double, lead int, name string, unit string, signal array<double>, comments array<string>")


def scan_annotations(spark: SparkSession, path: str, extension: str = "atr") -> DataFrame:
    """(record, sample, symbol, aux): a row for each annotation of the files with the extension below `path`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(file.rpartition(".")[0], *x) for file, content in zip(pdf["file"], pdf["content"], strict=True) for x in read_annotations(bytes(content))]
            yield pd.DataFrame(rows, columns=["record", "sample", "symbol", "aux"])

    return _files(spark, path, f"*.{extension}").select("file", "content").mapInPandas(run, "record string, sample long, symbol string, aux string")
