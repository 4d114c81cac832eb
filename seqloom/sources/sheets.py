"""Spreadsheets (.xlsx): a zip archive of XML, read row by row with the standard library."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch.
ROWS = 4096


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(z: zipfile.ZipFile) -> list[str]:
    """The shared strings: every text of an item put together, phonetic hints left out."""
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _name(e.tag) == "si":
                for hint in [x for x in e if _name(x.tag) == "rPh"]:
                    e.remove(hint)
                out.append("".join(x.text or "" for x in e.iter() if _name(x.tag) == "t"))
                e.clear()
    return out


def sheets_of(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path in the archive) of the sheets in their order."""
    target = {}
    for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
        target[e.get("Id")] = posixpath.normpath(posixpath.join("xl", e.get("Target", ""))) if not e.get("Target", "").startswith("/") else e.get("Target", "")[1:]
    out = []
    for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if _name(e.tag) == "sheet":
            out.append((e.get("name", ""), target[next(v for k, v in e.attrib.items() if _name(k) == "id")]))
    return out


def column_of(reference: str) -> int:
    """The number (from 0) of a cell's column: A, B, ... Z, AA, ..."""
    n = 0
    for x in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(x) - 64
    return n - 1


def read_rows(data: bytes, sheet: str | int = 0) -> Iterator[list[str | None]]:
    """The rows of a sheet (by name or number) as texts; empty cells, empty rows between others and errors are None. Numbers are as
    written in the file; truth values are TRUE and FALSE; of formulas the last result counts."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        texts, sheets = _texts(z), sheets_of(z)
        at = [path for i, (name, path) in enumerate(sheets) if sheet in (name, i)]
        if not at:
            raise ValueError(f"no sheet {sheet!r}; there are {', '.join(n for n, _ in sheets)}")
        number = 0
        with z.open(at[0]) as f:
            for _, e in ElementTree.iterparse(f):
                if _name(e.tag) != "row":
                    continue
                own = int(e.get("r", number + 1))
                for _ in range(own - number - 1):
                    yield []
                number, row = own, []
                for c in (x for x in e if _name(x.tag) == "c"):
                    k = column_of(c.get("r")) if c.get("r") else len(row)
                    row += [None] * (k + 1 - len(row))
                    kind, value = c.get("t", "n"), next((x.text for x in c if _name(x.tag) == "v"), None)
                    if kind == "inlineStr":
                        value = "".join(x.text or "" for x in c.iter() if _name(x.tag) == "t")
                    elif kind == "s" and value is not None:
                        value = texts[int(value)]
                    elif kind == "b" and value is not None:
                        value = "TRUE" if value == "1" else "FALSE"
                    row[k] = None if kind == "e" else value
                yield row
                e.clear()


def scan_xlsx(spark: SparkSession, path: str, schema: str, sheet: str | int = 0, header: int = 0) -> DataFrame:
    """The rows of the spreadsheets below `path`: `file`, `row` (the number from 1 in the sheet), and the columns of `schema`, found by
    their names in the row `header` (from 0) and cast to their types (what can't be cast is null).

    A missing column is an error that names it; rows without any value are left out. A file is one task's.
    """
    fields = [c.strip().rsplit(None, 1) for c in schema.split(",")]
    names = [n for n, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, out = None, []
                for i, row in enumerate(read_rows(content.as_py(), sheet)):
                    if i == header:
                        found = {str(x).strip(): k for k, x in enumerate(row) if x is not None}
                        missing = [n for n in names if n not in found]
                        if missing:
                            raise ValueError(f"{file} has no column {missing[0]!r}")
                        at = [found[n] for n in names]
                    elif at is not None and any(x is not None for x in row):
                        out.append((file, i + 1, *(row[k] if k < len(row) else None for k in at)))
                    if len(out) == ROWS:
                        yield _batch(out, names)
                        out = []
                if out:
                    yield _batch(out, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    text = ", ".join(f"`{n}` string" for n in names)
    rows = files.select("path", "content").mapInArrow(run, f"file string, row long, {text}")
    return rows.select("file", "row", *[_cast(n, kind).alias(n) for n, kind in fields])


def _cast(name: str, kind: str):
    c = F.col(f"`{name}`")
    # Whole numbers may be written with a point or an exponent.
    return c.try_cast("double").try_cast(kind) if kind.lower() in ("int", "integer", "long", "bigint", "short", "tinyint") else c.try_cast(kind)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * len(names)]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["file", "row", *names])
