"""Quality from random-indexing word vectors and a small network.

Word vectors: each word has a fixed sparse index vector of a few +1 and -1, drawn from its hash. The vector of a word is the sum
of the index vectors of the words around it in all documents (random indexing), scaled to unit length. Words are hashed into
BUCKETS, whose sums every task adds up before they are added together; words of a bucket with fewer than LEAST occurrences share
a vector with all words of the same shape (case, digits, or the mark they consist of). A word that repeats the one before it
counts as the word "repeated". Sums are whole numbers, so they do not depend on partitions.

A document is the mean and the standard deviation of the vectors of all its words. A network of two layers in numpy gives the
logit, and a temperature set on rows kept out of the training makes probabilities of it; only these two learn from a bounded
sample of labelled documents. Scoring is one pass without a shuffle; the broadcast model has a fixed number of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.samples import fold, labelled_texts
from seqloom.llm.store import added_up
from seqloom.llm.textkernels import SLICE_BYTES, byte_class, mix64, slices, span_hashes, text_buffer

DIM, NONZERO, WINDOW, HIDDEN = 24, 4, 2, 16
#: Buckets of words, how often one must occur, and the rows of words and shapes that travel together.
BUCKETS, LEAST, SHAPES, PIECE = 1 << 16, 8, 2048, 2048
#: At most about so many rows of each class are learned from.
TRAIN_ROWS = 1500
#: From this probability on a document is predicted to be of quality.
THRESHOLD = 0.3

_LETTER = byte_class([(0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
_DIGIT = byte_class([(0x30, 0x39)])
_UPPER = byte_class([(0x41, 0x5A)])
_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: 0 white space, 1 letters, 2 digits, 3 other marks.
_KIND = np.where(_SPACE, 0, np.where(_LETTER, 1, np.where(_DIGIT, 2, 3))).astype(np.uint8)
_REPEATED = np.uint64(1)
_SHAPES = np.uint64(16)
#: Words whose contexts are added up at once.
PART = 1 << 17


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the word, hash of its shape, documents' offsets) of the runs of letters, of digits and of other marks."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    kind = _KIND[data[lo:hi]]
    change = np.zeros(hi - lo + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets - lo] = True
    at = np.flatnonzero(change)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] != 0 if len(starts) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    upper = np.zeros(hi - lo + 1, np.int64)
    np.cumsum(_UPPER[data[lo:hi]], out=upper[1:])
    capitals = upper[ends] - upper[starts]
    first = data[lo:hi][starts].astype(np.int64)
    size = ends - starts
    case = np.where(capitals == 0, 0, np.where((capitals > 1) & (2 * capitals > size), 2, np.where(capitals == 1, 1, 3)))
    k = kind[starts].astype(np.int64)
    shape = np.where(k == 1, case, np.where(k == 2, 4, 8 + first * 4 + np.minimum(size, 3)))
    own = span_hashes(data, starts + lo, ends + lo)
    bounds = np.searchsorted(starts + lo, offsets, "left")
    same = np.zeros(len(own), bool)
    if len(own) > 1:
        same[1:] = (own[1:] == own[:-1]) & (k[1:] == 1)
        inner = bounds[1:-1]
        same[inner[inner < len(own)]] = False
    own[same] = _REPEATED
    return own, shape.astype(np.uint64) + _SHAPES, bounds


def index_vectors(words: np.ndarray) -> np.ndarray:
    """The sparse index vectors: NONZERO places of DIM hold +1 or -1, all from the word's hash."""
    out = np.zeros((len(words), DIM), np.float32)
    rows = np.arange(len(words))
    for j in range(NONZERO):
        with np.errstate(over="ignore"):
            h = mix64(words + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15))
        np.add.at(out, (rows, (h % np.uint64(DIM)).astype(np.int64)), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).astype(np.float32))
    return out


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (mix64(words) >> np.uint64(48)).astype(np.int64)


def shape_row(shape: np.ndarray) -> np.ndarray:
    return np.minimum((shape - _SHAPES).astype(np.int64), SHAPES - 1)


@dataclass
class QualityModel:
    """Which buckets of words have a vector, the vectors (of buckets, then of shapes), the network's layers and the temperature."""

    known: np.ndarray
    vectors: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def rows_of(self, own: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """The row of each word's vector: its bucket's, else its shape's (zeros for one that never occurred)."""
        bucket = bucket_of(own)
        return np.where(self.known[bucket], bucket, BUCKETS + shape_row(shape))

    def pool(self, own: np.ndarray, shape: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean and standard deviation of the word vectors of each document."""
        out = np.zeros((len(bounds) - 1, 2 * DIM))
        row = self.rows_of(own, shape)
        for j, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                n = np.bincount(row[a:b], minlength=len(self.vectors)) if b - a > 4 * len(self.vectors) else None
                if n is None:
                    v = self.vectors[row[a:b]].astype(np.float64)
                    mean, square = v.mean(axis=0), (v * v).mean(axis=0)
                else:
                    mean, square = n @ self.vectors / (b - a), n @ (self.vectors.astype(np.float64) ** 2) / (b - a)
                out[j, :DIM], out[j, DIM:] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
        return out

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        middle, spread, w1, b1, w2, b2 = self.layers
        return np.maximum((pooled - middle) / spread @ w1 + b1, 0) @ w2 + b2[0]

    def score(self, pooled: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logit(pooled) / self.temperature, -40, 40)))


def training_features(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """(labels, pooled vectors) of (doc_id, text, label) rows, in the order of their ids. Texts are pooled on the executors, so
    the driver gets 2 * DIM numbers a row."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            out = [x.astype("<f8").tobytes() for a, b in slices(off) for x in own.pool(*words_of(data, off[a : b + 1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "label", "pooled"])

    got = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, pooled binary").collect()
    got.sort(key=lambda r: r[0])
    shipped.destroy()
    return np.array([r[1] for r in got], np.float64), np.array([np.frombuffer(r[2], "<f8") for r in got]).reshape(-1, 2 * DIM)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of context vectors and numbers of occurrences (last column), of buckets and of shapes, in pieces."""
    columns = np.zeros((DIM + 1, BUCKETS + SHAPES))
    for batch in batches:
        data, off = text_buffer(batch.column(0))
        for a, b in slices(off):
            own, shape, bounds = words_of(data, off[a : b + 1])
            document = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            # A part of the words at a time, with the words around it.
            for at in range(0, len(own), PART):
                lo, hi = max(0, at - WINDOW), min(len(own), at + PART + WINDOW)
                different, which = np.unique(own[lo:hi], return_inverse=True)
                v, doc = index_vectors(different).astype(np.int8)[which], document[lo:hi]
                around = np.zeros((hi - lo, DIM), np.int8)
                for d in range(1, WINDOW + 1):
                    same = (doc[d:] == doc[:-d])[:, None]
                    around[d:] += v[:-d] * same
                    around[:-d] += v[d:] * same
                end = min(len(own), at + PART)
                around = np.ascontiguousarray(around[at - lo : end - lo].T)
                for first, size, row in ((0, BUCKETS, bucket_of(own[at:end])), (BUCKETS, SHAPES, shape_row(shape[at:end]))):
                    into = columns[:, first : first + size]
                    for d in range(DIM):
                        into[d] += np.bincount(row, weights=around[d], minlength=size)
                    into[DIM] += np.bincount(row, minlength=size)
    total = columns.T.astype("<i8")
    for i in range(0, len(total), PIECE):
        if total[i : i + PIECE, DIM].any():
            packed = zlib.compress(total[i : i + PIECE].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i // PIECE], pa.int32()), pa.array([packed], pa.binary())], ["piece", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the pieces that a task has got."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(zlib.decompress(packed.as_py()), "<i8")
            total[piece] = total[piece] + own if piece in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["piece", "sums"])


def word_vectors(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets have a vector, and the unit vectors of buckets and shapes, from the column `text` of all rows. The driver
    gets the sums of all tasks: BUCKETS + SHAPES rows, whatever the corpus."""
    total = np.zeros((BUCKETS + SHAPES, DIM + 1), np.int64)
    pieces = texts.select("text").mapInArrow(_context_sums, "piece int, sums binary")
    for piece, packed in added_up(pieces, len(total) // PIECE, _added).collect():
        total[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(zlib.decompress(packed), "<i8").reshape(-1, DIM + 1)
    sums = total[:, :DIM].astype(np.float64)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return total[:BUCKETS, DIM] >= LEAST, (sums / np.maximum(norm, 1e-9)).astype(np.float32)


def untrained(known: np.ndarray, vectors: np.ndarray) -> QualityModel:
    """Word vectors with a network that says one half to all."""
    return QualityModel(known, vectors, [np.zeros(2 * DIM), np.ones(2 * DIM), np.zeros((2 * DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)], 1.0)


def train(model: QualityModel, y: np.ndarray, x: np.ndarray, rounds: int = 600, rate: float = 0.01, seed: int = 11) -> QualityModel:
    """The network by Adam on whole batches over pooled vectors x, then the temperature. With one class only, or no rows, the
    score is that class's (or one half) for all documents."""
    if not len(y) or y.min() == y.max():
        model.layers[5][0] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = (order[: len(y) // 5], order[len(y) // 5 :]) if len(y) >= 20 else (order, order)
    middle, spread = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    p = [rng.normal(0, (2 * DIM) ** -0.5, (2 * DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z, t = (x[fit] - middle) / spread, y[fit]
    for k in range(1, rounds + 1):
        pre = z @ p[0] + p[1]
        hid = np.maximum(pre, 0)
        g = (1.0 / (1.0 + np.exp(-np.clip(hid @ p[2] + p[3][0], -40, 40))) - t) / len(t)
        back = np.outer(g, p[2]) * (pre > 0)
        grads = [z.T @ back + 1e-4 * p[0], back.sum(axis=0), hid.T @ g + 1e-4 * p[2], np.array([g.sum()])]
        for a, m, v, d in zip(p, first, second, grads, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            a -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model.layers = [middle, spread, *p]
    logit = model.logit(x[held])
    grid = np.geomspace(0.2, 20, 100)
    loss = [np.mean(np.logaddexp(0, np.where(y[held] == 1, -logit, logit) / q)) for q in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Word vectors from all documents; the network from labelled ones outside the fold that is held out, at most about
    `train_rows` of each class.

    The sampled labels (bounded) are broadcast, so the documents are read twice and not shuffled. A document with several
    labels counts with the highest one; of rows that share an id, the least text counts.
    """
    model = untrained(*word_vectors(docs.select(F.col("text").cast("string").alias("text"))))
    return train(model, *training_features(labelled_texts(docs, labels, label, train_rows), model))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts.

    Returns one row for each row (repeated rows stay repeated): doc_id, score (0 to 1), predicted (1 from THRESHOLD on). A null
    text scores as an empty one, whose pooled vector is zero. An empty table gives none. Long texts are pooled in parts, so
    memory does not grow with them; a score that ties with THRESHOLD is predicted 1. Other columns are ignored, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            score = np.zeros(batch.num_rows)
            for a, b in slices(off):
                score[a:b] = own.score(own.pool(*words_of(data, off[a : b + 1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return kept.mapInArrow(run, "doc_id long, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of `documents`."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, fit_model(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality": op10_quality}
