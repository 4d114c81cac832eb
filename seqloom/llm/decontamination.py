"""Benchmark decontamination by Wu-Manber multi-pattern search.

Both sides are brought to the same form: A-Z lowered, words of letters, digits and non-ASCII bytes, one blank between words and
around the text. The patterns are the windows of ten words of all benchmark items (a shorter item is one window). They are
searched for as byte strings: a shift table over blocks of bytes says how far the search may jump, a block with shift zero
selects, by the hash of the pattern's ending block, a bucket of patterns, and a direct comparison confirms each occurrence.
Because a pattern begins and ends with a blank, a match is a match of whole words.

The benchmark is the side that is broadcast. Its size is checked first: its different windows are dealt to blocks whose search
tables take about TABLES bytes, whatever the length of an item and however many items are alike. With one block, the usual case, documents are read once and never shuffled. With more, the texts are
written once under a number for each row, every block is searched in a job of its own, which writes the rows with hits only, and
the hits are put together by those numbers; driver and workers hold the tables of one block at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.store import columns, materialize, with_carried

#: Words of a window.
WORDS = 10
#: Bytes of the search tables of a block (of a single larger item: as many as it needs), and how many a byte of patterns takes.
TABLES, TABLES_PER_BYTE = 256 << 20, 14
RESULTS = ("n_words", "n_hit", "n_items", "item_ids", "runs")


def _form_table() -> bytes:
    out = bytearray(b" " * 256)
    for b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
        out[b] = b
    for b in range(0x41, 0x5B):
        out[b] = b + 0x20
    return bytes(out)


_FORM = _form_table()


def words_of(text: str | None) -> list[bytes]:
    """The words of the common form; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FORM).split()


def windows_of(words: list[bytes]) -> list[bytes]:
    """The windows of an item as byte strings framed by blanks."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + WORDS]) + b" " for i in range(max(1, len(words) - WORDS + 1))]


class WuManber:
    """Search for many byte strings at once.

    The strings are grouped by length classes (one pattern much shorter than the rest would shorten all jumps); each class has
    a block size fit for the number of its patterns, a shift table and buckets by ending block.
    """

    def __init__(self, patterns: list[bytes]) -> None:
        by_class: dict[int, list[int]] = defaultdict(list)
        for i, p in enumerate(patterns):
            by_class[max(1, len(p)).bit_length()].append(i)
        self.patterns = patterns
        self.classes = [self._tables(own) for _, own in sorted(by_class.items())]

    def _tables(self, own: list[int]) -> tuple[int, int, dict[bytes, int], dict[bytes, list[int]]]:
        least = min(len(self.patterns[i]) for i in own)
        want = 2  # 26 letters say log2(26) bits each; blocks must be rarer than the patterns' blocks are many
        while 12 ** (want // 2) < 8 * least * len(own) and want < 16:
            want += 1
        size = max(1, min(want, least // 2))
        shift: dict[bytes, int] = {}
        buckets: dict[bytes, list[int]] = defaultdict(list)
        for i in own:
            p = self.patterns[i]
            for end in range(size, least + 1):
                block, jump = p[end - size : end], least - end
                if jump < shift.get(block, least):
                    shift[block] = jump
            buckets[p[least - size : least]].append(i)
        return least, size, shift, dict(buckets)

    def find(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(start, number of the pattern) of all occurrences."""
        n = len(text)
        for least, size, shift, buckets in self.classes:
            jump_of, free = shift.get, least - size + 1
            at = least
            while at <= n:
                block = text[at - size : at]
                jump = jump_of(block, free)
                if jump:
                    at += jump
                    continue
                start = at - least
                for i in buckets[block]:
                    if text.startswith(self.patterns[i], start):
                        yield start, i
                at += 1


class Benchmark:
    """The patterns of a block of items, the search tables over them and the items that each belongs to."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        self._own((w, item) for item, text in items for w in windows_of(words_of(text)))

    @classmethod
    def of_windows(cls, pairs: Iterable[tuple[bytes, int | None]]) -> Benchmark:
        """The same from (window, item) pairs."""
        out = cls.__new__(cls)
        out._own(pairs)
        return out

    def _own(self, pairs: Iterable[tuple[bytes, int | None]]) -> None:
        owners: dict[bytes, set[int]] = defaultdict(set)
        for w, item in pairs:
            owners[w].update(() if item is None else (item,))
        patterns = sorted(owners)
        self.items = [sorted(owners[p]) for p in patterns]
        self.lengths = [p.count(b" ") - 1 for p in patterns]
        self.search = WuManber(patterns)

    def judge(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words; [first, last) runs of words inside occurrences, in order and apart; items that occur."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" " if words else b""
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        found = sorted(self.search.find(line))
        before, at = 0, 0
        for start, i in found:
            before += line.count(b" ", at, start)  # blanks before the match: the number of its first word
            at = start
            items.update(self.items[i])
            first, last = before, before + self.lengths[i]
            if runs and first <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
            else:
                runs.append((first, last))
        return len(words), runs, items


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1), strict=True):
            own = sorted(set(windows_of(words_of(text.as_py()))))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([item.as_py()] * len(own), pa.int64())], ["window", "item_id"])


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", tables: int = TABLES) -> list[DataFrame]:
    """The benchmark's (window, item_id) pairs in parts whose search tables have about `tables` bytes: a sum over sizes decides, not
    the driver. Windows are dealt by their own hash, so a long item is spread out, equal items count once, and items without an
    id are dealt too. (A window that very many items have still takes 64 bytes for each of them.)"""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = F.octet_length("text").cast("long")
    total = (rows.select("text").distinct().agg(F.sum(size)).first()[0] or 0) * WORDS * TABLES_PER_BYTE
    windows = rows.mapInArrow(_item_windows, "window binary, item_id long").distinct()
    n = max(1, -(-2 * int(total) // tables)) if total > tables else 1
    if n > 1:
        windows = materialize(windows, "leak-windows")
    n = max(n, -(-windows.count() * 64 // tables))
    return [windows] if n == 1 else [windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i) for i in range(n)]


_RUNS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_TYPES = "_words long, _runs array<struct<first:long,last:long>>, _items array<string>"


def _search(shipped, carried: int, hits_only: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            words, runs, items = [], [], []
            for value in batch.column(carried):
                n, r, i = own.judge(value.as_py())
                words.append(n)
                runs.append([{"first": a, "last": b} for a, b in r])
                items.append(sorted(map(str, i)))
            columns = [*batch.columns[:carried], pa.array(words, pa.int64()), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:carried], "_words", "_runs", "_items"])
            yield out.filter(pa.array([bool(r) for r in runs])) if hits_only else out

    return run


def _merge_hits(carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, runs, items = [], [], []
            for text, r, i in zip(batch.column(carried), batch.column(carried + 1).to_pylist(), batch.column(carried + 2).to_pylist(), strict=True):
                words.append(len(words_of(text.as_py())))
                runs.append([{"first": a, "last": b} for a, b in _merged([(x["first"], x["last"]) for part in r or () for x in part])])
                items.append(sorted({x for part in i or () for x in part}))
            columns = [*batch.columns[:carried], pa.array(words, pa.int64()), pa.array(runs, _RUNS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:carried], "_words", "_runs", "_items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), tables: int = TABLES, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """Search whole texts for windows of benchmark items.

    Returns one row for each row (repeated rows stay repeated): the columns in `carry` as they are, n_words, n_hit (words
    inside an occurrence), n_items and item_ids (items with an occurring window, sorted as strings), runs ([first, last) word
    numbers of what is hit). A null or wordless text has no words and no hits; null items and items without words have no
    windows. Items with a null id are searched like the others, but not listed; items that share an id count as one. An empty
    benchmark hits nothing, an empty table gives none. Texts of any length are searched as a whole, in one pass. Other columns are ignored, whatever their names; of carried columns with
    the names above the results win, unless `results` gives others to these five.
    """
    spark, own = docs.sparkSession, columns(carry)
    parts = blocks_of(benchmark, tables=tables)

    def ship(part: DataFrame):
        return spark.sparkContext.broadcast(Benchmark.of_windows((bytes(r[0]), r[1]) for r in part.collect()))  # bounded by `tables`

    found = ("_words", "_runs", "_items")
    inner = {f"_c{i}": c for i, c in enumerate(own.values())}
    if len(parts) == 1:
        out = with_carried(docs, inner, [F.col(f"`{text_col}`").cast("string")], _search(ship(parts[0]), len(own)), _TYPES, found)
    else:
        texts = docs.select(*[c.alias(name) for name, c in inner.items()], F.col(f"`{text_col}`").cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"))
        texts = materialize(texts, "leak-texts")
        hits = None
        for part in parts:
            shipped = ship(part)
            of = materialize(texts.select("_row", "_text").mapInArrow(_search(shipped, 1, hits_only=True), f"_row long, {_TYPES}"), "leak-hits")
            shipped.destroy()
            hits = of if hits is None else hits.unionByName(of)
        hits = hits.groupBy(F.col("_row").alias("_of")).agg(F.collect_list("_runs").alias("_some_runs"), F.collect_list("_items").alias("_some_items"))  # one of each block at most
        both = texts.join(hits, F.col("_row") == F.col("_of"), "left")
        more = [F.col(c) for c in ("_text", "_some_runs", "_some_items")]
        out = with_carried(both, {c: F.col(c) for c in inner}, more, _merge_hits(len(own)), _TYPES, found)
    hit = F.aggregate("_runs", F.lit(0).cast("long"), lambda total, r: total + r["last"] - r["first"])
    taken = {x.lower() for x in results}
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(own) if c.lower() not in taken]
    values = [F.col("_words"), hit, F.size("_items").cast("long"), F.col("_items"), F.col("_runs")]
    return out.select(*kept, *[c.alias(name) for c, name in zip(values, results, strict=True)])


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` against all of `benchmark`."""
    out = decontaminate(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op8_decontamination": f"""
        WITH d AS (SELECT doc_id, coalesce({_SQL_WORDS.format("text")}, []) AS w FROM documents),
        b AS (SELECT item_id, coalesce({_SQL_WORDS.format("text")}, []) AS w FROM benchmark),
        pattern AS (
            SELECT DISTINCT item_id, least({WORDS}, len(w)) AS k, array_to_string(w[i : i + least({WORDS}, len(w)) - 1], ' ') AS p
            FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - {WORDS - 2}))) AS i FROM b WHERE len(w) > 0)),
        size AS (SELECT DISTINCT k FROM pattern),
        place AS (
            SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS p
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, size WHERE len(w) >= k)),
        hit AS (SELECT doc_id, i, k, item_id FROM place JOIN pattern USING (k, p)),
        word AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
        item AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS s FROM hit GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(word.n, 0) AS n_hit, CAST(coalesce(len(item.s), 0) AS BIGINT) AS n_items,
               sha256(coalesce(array_to_string(item.s, ','), '')) AS items_sha256, word.n IS NOT NULL AS contaminated
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
    """
}
QUERIES = {"op8_decontamination": op8_decontamination}
