"""Readers of large binary files as Spark data sources: byte ranges are planned, so one file is many tasks, and only the columns and
records that are asked for are read.

    spark.dataSource.register(NpyRanges)
    spark.read.format("npy_ranges").option("path", ...).load()

Three formats: `npy_ranges` (arrays, one row an index of the first axis), `waveform_ranges` (header, signal files in formats 16, 80
and 212, one row a sample of a lead) and `holter_ranges` (a header of fixed fields and 16-bit samples). The options `path` (a file, or
a folder that is walked), `range_bytes`, `records` and `leads` (names or numbers separated by commas) say what to read. Filters on
`file`, `record` or `lead` for equality (or membership) are pushed into the plan, so files that can't match are not opened.

Files are opened by the machines that read them, so the path must be on storage that all of them mount; for other stores there are
the scans of whole files.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from seqloom.sources.waveforms import read_header, read_samples

RANGE_BYTES = 64 << 20
#: Rows of an Arrow batch.
ROWS = 65_536


def found(path: str, suffix: str) -> list[str]:
    """The files below a path (or the file itself), in order; what begins with _ or . is not there yet."""
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    out = []
    for folder, folders, names in os.walk(path):
        folders[:] = [x for x in folders if not x.startswith(("_", "."))]
        out += [os.path.join(folder, name) for name in names if name.lower().endswith(suffix) and not name.startswith(("_", "."))]
    return sorted(out)


@dataclass
class Range(InputPartition):
    """Rows [first, last) of a file; what else a reader must know of it is in `more`."""

    file: str
    first: int
    last: int
    more: tuple = ()

    def __post_init__(self) -> None:
        super().__init__(0)


class Wanted:
    """Values that a column may have: None stands for all."""

    def __init__(self, options: dict, **names: str) -> None:
        self.of: dict[str, set | None] = {c: {x.strip() for x in options[o].split(",")} if options.get(o) else None for c, o in names.items()}

    def push(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take in filters on these columns. All are still applied by Spark to what is read: this only saves reading."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.of:
                values = {str(v) for v in ([f.value] if isinstance(f, EqualTo) else f.value)}
                own = self.of[f.attribute[0]]
                self.of[f.attribute[0]] = values if own is None else own & values
            yield f

    def has(self, column: str, value: object) -> bool:
        return self.of[column] is None or str(value) in self.of[column]


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, **names: str) -> None:
        self.names = [f.name for f in schema.fields]
        self.options, self.wanted = dict(options), Wanted(options, **names)
        self.bytes = max(1, int(options.get("range_bytes", RANGE_BYTES)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return self.wanted.push(filters)

    def cut(self, file: str, rows: int, row_bytes: int, *more: object) -> list[Range]:
        step = max(1, self.bytes // max(1, row_bytes))
        return [Range(file, a, min(a + step, rows), more) for a in range(0, rows, step)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        """Without ranges Spark asks for the rows of none."""
        return iter(()) if part is None else self.rows(part)

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def batch(self, values: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values[n] for n in self.names], self.names)


def _repeated(value: object, n: int, kind: pa.DataType) -> pa.Array:
    return pa.array([value], kind).take(pa.array(np.zeros(n, np.int64)))


# Arrays


def npy_header(file: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """(type, shape, where the data begin) of an array in row order."""
    with open(file, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, fortran, kind = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
        if fortran and len(shape) > 1:
            raise ValueError(f"{file} is in column order")
        if kind.hasobject:
            raise ValueError(f"{file} holds objects")
        return kind, shape or (1,), f.tell()


class _NpyReader(_Reader):
    def partitions(self) -> Sequence[Range]:
        out: list[Range] = []
        for file in found(self.options["path"], ".npy"):
            if self.wanted.has("file", file):
                kind, shape, at = npy_header(file)
                out += self.cut(file, shape[0], kind.itemsize * int(np.prod(shape[1:], dtype=np.int64)), kind.str, shape[1:], at)
        return out

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        kind, inner, at = part.more
        width = int(np.prod(inner, dtype=np.int64))
        with open(part.file, "rb") as f:
            f.seek(at + part.first * width * np.dtype(kind).itemsize)
            for a in range(part.first, part.last, step := max(1, ROWS // max(1, width))):
                n = min(step, part.last - a)
                flat = np.frombuffer(f.read(n * width * np.dtype(kind).itemsize), kind).astype(np.float64)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                yield self.batch({"file": _repeated(part.file, n, pa.string()), "row": pa.array(np.arange(a, a + n)), "value": pa.ListArray.from_arrays(offsets, pa.array(flat))})


class NpyRanges(DataSource):
    """(file, row, value) of .npy arrays; an array of any size is as many tasks as it has ranges. Also writes: rows (file, row,
    value) of numbered parts become `<path>/part-*.npy`, which are there together once all tasks have ended, or not at all."""

    @classmethod
    def name(cls) -> str:
        return "npy_ranges"

    def schema(self) -> str:
        return "file string, row long, value array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _NpyReader(schema, self.options, file="files")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _NpyWriter(schema, self.options, overwrite)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _NpyWriter(DataSourceArrowWriter):
    """Every task writes files of its own into a folder of the job that readers do not see; the commit moves them out of it, an abort
    removes it (what a task that is still running writes there later stays unseen)."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].removeprefix("file://"), overwrite
        self.job = uuid.uuid4().hex
        self.pending = f"{self.path}/_pending-{self.job}"
        self.at = [f.name for f in schema.fields].index("value")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.pending, exist_ok=True)
        rows: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for x in batch.column(self.at):
                rows.setdefault(len(x.values), []).append(np.asarray(x.values, float))
        files = []
        for width, own in sorted(rows.items()):
            files.append(f"part-{task.partitionId():05d}-{width}-{task.taskAttemptId()}-{self.job[:8]}.npy")
            np.save(f"{self.pending}/{files[-1]}", np.stack(own), allow_pickle=False)
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        before = found(self.path, ".npy") if self.overwrite else []
        for m in messages:
            for name in m.files if m else []:
                os.replace(f"{self.pending}/{name}", f"{self.path}/{name}")
        for file in before:
            os.remove(file)
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


# Records with a text header


#: Samples that a group of bytes holds, and its bytes.
_GROUPS = {16: (1, 2), 80: (1, 1), 212: (2, 3)}


class _WaveformReader(_Reader):
    def partitions(self) -> Sequence[Range]:
        out: list[Range] = []
        for head in found(self.options["path"], ".hea"):
            record = os.path.basename(head)[:-4]
            if not self.wanted.has("record", record):
                continue
            with open(head, encoding="utf-8") as f:
                rate, samples, leads, _ = read_header(f.read())
            for file in dict.fromkeys(x.file for x in leads):
                own = [(i, x) for i, x in enumerate(leads) if x.file == file]
                kept = [(k, i, x.name, x.unit, x.gain, x.baseline) for k, (i, x) in enumerate(own) if self.wanted.has("lead", x.name) or self.wanted.has("lead", i)]
                if not kept:
                    continue
                full = os.path.join(os.path.dirname(head), file)
                values, size = _GROUPS[own[0][1].format]
                n = os.path.getsize(full) * values // size // len(own)
                frame = len(own) * size if values == 1 else len(own) * size // values or 1
                for r in self.cut(full, n if samples is None else min(n, samples), frame, record, rate, own[0][1].format, len(own), tuple(kept)):
                    # Ranges of format 212 begin with a pair.
                    out.append(r)
        return _even(out)

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        record, rate, form, channels, kept = part.more
        values, size = _GROUPS[form]
        with open(part.file, "rb") as f:
            for a in range(part.first, part.last, step := max(2, ROWS // channels // 2 * 2)):
                n = min(step, part.last - a)
                lo, hi = a * channels, (a + n) * channels
                f.seek(lo // values * size)
                flat = read_samples(f.read(-(-hi // values) * size - lo // values * size), form)[lo % values :][: hi - lo].reshape(-1, channels)
                for k, lead, name, unit, gain, baseline in kept:
                    x, m = (flat[:, k] - baseline) / gain, len(flat)
                    both = {"record": _repeated(record, m, pa.string()), "rate": _repeated(rate, m, pa.float64()), "lead": _repeated(lead, m, pa.int32()), "name": _repeated(name, m, pa.string()), "unit": _repeated(unit, m, pa.string())}
                    yield self.batch(both | {"t": pa.array(np.arange(a, a + m)), "value": pa.array(x, mask=np.isnan(x))})


def _even(parts: list[Range]) -> list[Range]:
    """The ranges with borders at even numbers, so that none begins inside a pair of samples."""
    out = []
    for r in parts:
        first = r.first + r.first % 2
        last = r.last + r.last % 2 if any(o.file == r.file and o.first == r.last for o in parts) else r.last
        if first < last:
            out.append(replace(r, first=first, last=last))
    return out


class WaveformRanges(DataSource):
    """(record, rate, lead, name, unit, t, value): a row for each sample of each lead, null where one is marked as missing."""

    @classmethod
    def name(cls) -> str:
        return "waveform_ranges"

    def schema(self) -> str:
        return "record string, rate double, lead int, name string, unit string, t long, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _WaveformReader(schema, self.options, record="records", lead="leads")


# Long recordings with a header of fixed fields


def holter_header(file: str) -> tuple[dict, int]:
    """(rate, leads, resolutions in nV, samples of a lead) and where the data begin.

    Fixed values of the format: eight letters, a checksum, then at byte 10 the variable block's length, the samples, the variable
    block's place and the data's place, and from byte 156 the number of leads, their twelve specifications, qualities and
    resolutions, and, at byte 272, the rate.
    """
    with open(file, "rb") as f:
        head = f.read(512)
    if head[:8] not in (b"ISHNE1.0", b"ANN  1.0"):
        raise ValueError(f"{file} has no such header")
    _, samples, _, at = struct.unpack_from("<iiii", head, 10)
    (leads,) = struct.unpack_from("<h", head, 156)
    names, resolutions = struct.unpack_from("<12h", head, 158), struct.unpack_from("<12h", head, 206)
    (rate,) = struct.unpack_from("<h", head, 272)
    if not 1 <= leads <= 12:
        raise ValueError(f"{file} announces {leads} leads")
    return {"rate": float(rate), "leads": leads, "codes": names[:leads], "resolution": resolutions[:leads], "samples": samples}, at


class _HolterReader(_Reader):
    def partitions(self) -> Sequence[Range]:
        out: list[Range] = []
        for file in found(self.options["path"], ".ecg"):
            record = os.path.basename(file).rpartition(".")[0]
            if self.wanted.has("record", record):
                head, at = holter_header(file)
                n = (os.path.getsize(file) - at) // (2 * head["leads"])
                kept = tuple(k for k in range(head["leads"]) if self.wanted.has("lead", k))
                out += self.cut(file, n, 2 * head["leads"], record, head["rate"], head["leads"], head["resolution"], kept, at)
        return out

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        record, rate, leads, resolution, kept, at = part.more
        with open(part.file, "rb") as f:
            f.seek(at + part.first * 2 * leads)
            for a in range(part.first, part.last, step := max(1, ROWS // leads)):
                n = min(step, part.last - a)
                flat = np.frombuffer(f.read(n * 2 * leads), "<i2").reshape(-1, leads)
                for k in kept:
                    x = flat[:, k] * (resolution[k] / 1e6)
                    yield self.batch({"record": _repeated(record, n, pa.string()), "rate": _repeated(rate, n, pa.float64()), "lead": _repeated(k, n, pa.int32()), "t": pa.array(np.arange(a, a + n)), "value": pa.array(x)})


class HolterRanges(DataSource):
    """(record, rate, lead, t, value in mV) of 16-bit recordings of up to twelve leads."""

    @classmethod
    def name(cls) -> str:
        return "holter_ranges"

    def schema(self) -> str:
        return "record string, rate double, lead int, t long, value double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _HolterReader(schema, self.options, record="records", lead="leads")


def register(spark: SparkSession) -> None:
    """The three formats by name, with filters pushed into their plans."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (NpyRanges, WaveformRanges, HolterRanges):
        spark.dataSource.register(source)


def scan_ranges(spark: SparkSession, kind: str, path: str, **options: object) -> DataFrame:
    """A format by its name."""
    register(spark)
    return spark.read.format(kind).options(path=path, **{k: str(v) for k, v in options.items()}).load()
