"""Bounded training samples, drawn by a hash of the row's key so that every run and every layout gives the same rows.

Only classifiers learn from samples. Each caller passes its bound as a parameter, and rows are features (bounded numbers of
hashed buckets or pooled vectors), never whole texts, when they reach the driver.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.store import materialize


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def python_fold(doc_id: int | None, folds: int) -> int:
    """The same outside Spark."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


#: Rows of all classes together, about; every class keeps one at least.
TOTAL_ROWS = 6000
#: Classes whose counts may be broadcast.
BROADCAST_ROWS = 10_000


def bounded(keyed: DataFrame, key: str, group: str, most: int, total: int = TOTAL_ROWS) -> DataFrame:
    """About `most` rows, and never more than twice as many, of each value of `group` that is not null, by a hash of `key`. Where
    there are so many values that this would be more than about `total` rows, each gets an equal share of these, and at least one row:
    none is left out.

    Rows of (key, group) and perhaps other columns; rows that repeat a key and a group count as one, with the least of each
    other column. The share that is kept of each value follows from its number of rows, counted first, so one scan beside
    the count draws for all values. What is left is about the bound; its ranks (by the hash, then by key) hold it exactly.
    """
    known = keyed.where(F.col(group).isNotNull())
    counts = materialize(known.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_rows")), "sample-classes")
    classes = counts.count()
    share = max(1, min(most, total // max(1, classes)))
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_003)) / 1_000_003.0
    # So small a share may draw no row of a class: some more are drawn, and ranks then hold the bound.
    drawn_of = share if share > 32 else 4 * share + 32
    counts = F.broadcast(counts) if classes <= BROADCAST_ROWS else counts
    drawn = known.join(counts, F.col(group) == F.col("_group")).where(spread * F.col("_rows") < drawn_of)
    rest = [F.min(c).alias(c) for c in keyed.columns if c not in (key, group)]
    once = drawn.groupBy(key, group).agg(*rest) if rest else drawn.select(key, group).distinct()
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.col(key)), key))
    return once.withColumn("_rank", rank).where(F.col("_rank") <= 2 * share).select(keyed.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of about `most` documents of each label, outside the fold that is held out.

    The highest of several labels of an id counts, and the least of several texts. The sampled labels have a bound (twice `most`
    rows of each of few classes), so they are broadcast.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(bounded(own, "doc_id", "label", most)), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
