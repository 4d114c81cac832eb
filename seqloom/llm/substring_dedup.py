"""Substring dedup by seeds and extensions.

A window is LENGTH consecutive words. A word is removed if a window that covers it also starts anywhere else, in the same text
or another.

Seeds: of all runs of SEED words in a window, winnowing selects the one with the least hash, so equal windows select equal
seeds, and neighbouring windows mostly the same one. A seed that occurs at one place only settles all windows that selected it:
they are unique. Documents meet on the seeds that are left (a join on the seed's hash, not of all words).

Extension: around each place of a shared seed, the text is extended both ways to every window that selected it, and an
extension counts as a match if the same LENGTH words are found from another place (128-bit hashes, compared by the least and
the greatest place of each, so a group of any size is reduced before it is shuffled and no pairs are formed). Matches that
follow each other merge to runs, whose words go (a run may be made of repeats with several partners).

Texts that are equal as a whole need no seeds: they are classes of one key, of which a single member takes part; all words of
such a text are removed if it has a window at all.

Scale: rows that are shuffled are a seed per about 14 words, the windows around shared seeds, and the texts, twice (to join
what was found). Hot seeds and windows are pre-aggregated; the joins back to their places are plain equi-joins that adaptive
execution splits. Each step is written to the shared folder, so a lost executor costs its tasks only.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.store import discard, materialize, with_carried
from seqloom.llm.textkernels import document_words, mix64, signed, slices, sliding_min, text_buffer, unsigned, window_hashes

LENGTH, SEED = 35, 8
RESULTS = ("n_words", "n_removed", "kept_text", "repeats")
#: Keys of texts that a task remembers, to let only the first of equal ones through.
REMEMBER = 500_000


class _First:
    """True the first time that a task meets a key, as far as it remembers."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, key: int) -> bool:
        if key in self.seen:
            return False
        if len(self.seen) < REMEMBER:
            self.seen.add(key)
        return True


def _selected(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """The hash of the seed that each window selects."""
    return sliding_min(window_hashes(words, seed), length - seed + 1)


def _seeds(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _First()
        for batch in batches:
            keys, (data, off) = batch.column(0).to_pylist(), text_buffer(batch.column(1))
            for a, b in slices(off):
                words, _, _, bounds = document_words(data, off[a : b + 1])
                h, k, twice = [], [], []
                for j in range(b - a):
                    own = words[bounds[j] : bounds[j + 1]]
                    if len(own) < length or not first(keys[a + j]):
                        continue
                    chosen = _selected(own, length, seed)
                    grams = window_hashes(own, seed)
                    u = np.unique(chosen)
                    places = np.sort(grams[np.isin(grams, u)])
                    count = np.searchsorted(places, u, "right") - np.searchsorted(places, u, "left")
                    h.append(u)
                    k.append(np.full(len(u), keys[a + j], np.int64))
                    twice.append(count > 1)
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(h))), pa.array(np.concatenate(k)), pa.array(np.concatenate(twice))], ["seed", "key", "twice"])

    return run


def _windows(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = _First()
        for batch in batches:
            keys, (data, off) = batch.column(0).to_pylist(), text_buffer(batch.column(1))
            shared = batch.column(2)
            for a, b in slices(off):
                words, _, _, bounds = document_words(data, off[a : b + 1])
                one, two, k, at = [], [], [], []
                for j in range(b - a):
                    if not first(keys[a + j]):
                        continue
                    own = words[bounds[j] : bounds[j + 1]]
                    alive = unsigned(np.asarray(shared[a + j].values))
                    starts = np.flatnonzero(np.isin(_selected(own, length, seed), alive))
                    one.append(window_hashes(own, length)[starts])
                    two.append(window_hashes(own, length, second=True)[starts])
                    k.append(np.full(len(starts), keys[a + j], np.int64))
                    at.append(starts.astype(np.int32))
                if one:
                    one, two, k, at = map(np.concatenate, (one, two, k, at))
                    place = signed(mix64(unsigned(k) ^ mix64(at.astype(np.uint64) + np.uint64(1))))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(one)), pa.array(signed(two)), pa.array(k), pa.array(at), pa.array(place)], ["w1", "w2", "key", "at", "place"])

    return run


def _covered(starts: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of `starts`."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _removal(length: int, carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            text, starts, copies = batch.columns[carried:]
            n_words, n_removed, kept, repeats = [], [], [], []
            for j in range(batch.num_rows):
                words = (text[j].as_py() or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                gone = np.zeros(n, bool)
                if n >= length:
                    if (copies[j].as_py() or 0) > 1:
                        gone[:] = True
                    elif starts[j].is_valid:
                        gone = _covered(np.asarray(starts[j].values).astype(np.int64), n, length)
                n_words.append(n)
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(compress(words, (~gone).tolist()) if n_removed[-1] else words).decode("utf-8", "surrogatepass"))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                repeats.append([{"first": a, "last": b} for a, b in edge.reshape(-1, 2).tolist()])
            out = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(repeats, span)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:carried], *out], [*batch.schema.names[:carried], "_words", "_removed", "_kept", "_repeats"])

    return run


def substring_dedup(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), length: int = LENGTH, seed: int = SEED, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """Remove all words of windows that occur more than once.

    Returns one row for each row of `docs`: the columns in `carry` as they are, n_words, n_removed, kept_text (the words that
    stay, joined by one blank), and repeats (the runs that are removed, as [first, last) word numbers; adjoining repeats are
    one run). Words are runs of anything but ASCII white space. A long text takes eight bytes a word while it is hashed. A null text has no words and an empty kept_text; a text of fewer than `length`
    words keeps them all. Rows with equal texts, repeated rows included, are repeats of each other. An empty table gives none.
    Ids may be null or repeated: nothing is joined on them. Other columns are ignored, whatever their names; of carried columns
    with the names above the results win, unless `results` gives others to these four.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)], F.xxhash64(text).alias("_key"), text.alias("_text"))
    texts = keyed.select("_key", "_text")

    seeds = materialize(texts.mapInArrow(_seeds(length, seed), "seed long, key long, twice boolean"), "repeat-seeds")
    places = seeds.groupBy("seed").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("twice").alias("twice"))
    shared = places.where((F.col("a") != F.col("b")) | F.col("twice")).select("seed")
    # Written first, so that the join has an exchange on either side and adaptive execution can split a hot seed.
    shared = materialize(shared, "repeat-shared-seeds")
    alive = seeds.join(shared, "seed", "left_semi").groupBy("key").agg(F.collect_set("seed").alias("seeds"))
    alive = materialize(alive, "repeat-shared")
    discard(seeds)
    discard(shared)

    at = texts.join(alive, F.col("_key") == F.col("key")).select("_key", "_text", "seeds")
    windows = materialize(at.mapInArrow(_windows(length, seed), "w1 long, w2 long, key long, at int, place long"), "repeat-windows")
    discard(alive)
    ends = windows.groupBy("w1", "w2").agg(F.min("place").alias("a"), F.max("place").alias("b"))
    again = materialize(ends.where(F.col("a") != F.col("b")).select("w1", "w2"), "repeat-again")  # for the same reason
    starts = windows.select("w1", "w2", "key", "at").join(again, ["w1", "w2"], "left_semi").groupBy("key").agg(F.collect_set("at").alias("starts"))
    equal = texts.groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)
    found = starts.join(equal, "key", "full_outer").select("key", F.col("starts").alias("_starts"), F.col("copies").alias("_copies"))
    found = materialize(found, "repeat-found")
    discard(windows)
    discard(again)

    both = keyed.join(found, F.col("_key") == F.col("key"), "left")
    types = "_words long, _removed long, _kept string, _repeats array<struct<first:long,last:long>>"
    own = {c: F.col(f"_c{i}") for i, c in enumerate(carry)}
    return with_carried(both, own, [F.col(c) for c in ("_text", "_starts", "_copies")], _removal(length, len(carry)), types, results)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every whole text of `documents`."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op6_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        place AS (
            SELECT doc_id, i, md5(array_to_string(w[i : i + {LENGTH - 1}], ' ')) AS p
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH - 2})) AS i FROM d WHERE len(w) >= {LENGTH})),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY p) AS n FROM place) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {LENGTH})) AS j FROM again),
        word AS (SELECT doc_id, j, w[j] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t
            FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """
}
QUERIES = {"op6_substring_dedup": op6_substring_dedup}
