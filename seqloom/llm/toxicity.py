"""Toxicity by a character n-gram linear classifier over naive Bayes log-count ratios.

Features are the presence of hashed character n-grams. For each, the ratio of its smoothed share among toxic rows to that among
the others is taken, and its logarithm scales the feature (Wang and Manning's combination of naive Bayes with a linear
classifier). A logistic regression over the scaled features is fitted by full-batch gradient descent with momentum on a bounded
sample of labelled rows. Scoring adds up one weight for each distinct n-gram of the whole text, in one pass without a shuffle;
the broadcast model is a vector of 2**BITS weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.ngram_features import ngram_buckets, pieces, plain
from seqloom.llm.samples import fold, labelled_texts
from seqloom.llm.textkernels import slices, text_buffer

BITS, ORDERS = 19, (3, 4, 5)
#: At most about so many rows of each class are learned from. So many buckets of a row are sent as numbers; the rest of them as bits.
TRAIN_ROWS, ROW_BUCKETS = 2000, 1 << 15
#: Bytes whose n-grams are held at once.
SLICE = 1 << 20
#: An n-gram in fewer rows of the sample is no feature.
LEAST_ROWS = 4


@dataclass
class ToxicityModel:
    """A weight for each bucket (the ratio times the classifier's weight) and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(sums + self.bias, -40, 40)))


def _distinct(data: np.ndarray, offsets: np.ndarray, last: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each document between `offsets`; `last` is scratch space of 2**BITS places. A text longer than a
    slice comes in parts, and its buckets are bounded by their number."""
    for a, b in slices(offsets, SLICE):
        text, own = plain(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        parts = pieces(text, SLICE) if b == a + 1 else []
        if len(parts) > 1:
            found = [_once(np.concatenate([ngram_buckets(text[lo:hi], np.array([0, hi - lo]), n, BITS)[0] for n in ORDERS]), last) for lo, hi in parts]
            yield np.unique(np.concatenate(found))
            continue
        found = [ngram_buckets(text, own, n, BITS) for n in ORDERS]
        for j in range(b - a):
            yield _once(np.concatenate([bucket[bounds[j] : bounds[j + 1]] for bucket, bounds in found]), last)


def _once(buckets: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Each bucket once; the scratch space needs no clearing."""
    at = np.arange(len(buckets))
    last[buckets] = at
    return buckets[last[buckets] == at]


class Features(list):
    """(label, distinct buckets) of each row, and in `rest` what rows of more than ROW_BUCKETS have beyond these, as (row's place, bits):
    2**BITS bits, however long the text is."""

    def __init__(self, rows, rest=()):
        super().__init__(rows)
        self.rest = list(rest)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row's place, buckets): each bucket of a row occurs once in all its parts."""
        for i, (_, buckets) in enumerate(self):
            yield i, buckets
        for i, bits in self.rest:
            yield i, np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))


def _bits(buckets: np.ndarray) -> bytes:
    out = np.zeros(1 << BITS, np.uint8)
    out[buckets] = 1
    return np.packbits(out).tobytes()


def training_features(rows: DataFrame) -> Features:
    """All features of (doc_id, text, label) rows, in the order of their ids; computed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            out = [np.sort(x) if len(x) > ROW_BUCKETS else x for x in _distinct(data, off, last)]
            first = pa.array([x[:ROW_BUCKETS].astype("<i4").tobytes() for x in out], pa.binary())
            rest = pa.array([_bits(x[ROW_BUCKETS:]) if len(x) > ROW_BUCKETS else None for x in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), first, rest], ["doc_id", "label", "bucket", "rest"])

    got = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, bucket binary, rest binary").collect()
    got.sort(key=lambda r: (r[0] is not None, r[0], bytes(r[2]), bytes(r[3] or b"")))
    return Features(((r[1], np.frombuffer(r[2], "<i4")) for r in got), ((i, r[3]) for i, r in enumerate(got) if r[3] is not None))


def train(rows: Features, rounds: int = 200, rate: float = 0.5, penalty: float = 1e-4, smooth: float = 1.0) -> ToxicityModel:
    """Log-count ratios, then the logistic regression. Without rows of both classes the score is the share of toxic rows."""
    size = 1 << BITS
    y = np.array([r[0] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(np.zeros(size, np.float32), 4.0 if len(y) and y[0] else -4.0)
    total, toxic = np.zeros(size), np.zeros(size)
    for i, buckets in rows.parts():
        total[buckets] += 1
        if y[i]:
            toxic[buckets] += 1
    other = total - toxic
    ratio = np.log((toxic + smooth) / (y.sum() + 2 * smooth)) - np.log((other + smooth) / (len(y) - y.sum() + 2 * smooth))
    ratio[total < LEAST_ROWS] = 0.0
    ratio[np.abs(ratio) < 0.7] = 0.0  # neither class's
    kept = [(i, b[ratio[b] != 0]) for i, b in rows.parts()]
    every, row = np.concatenate([b for _, b in kept]).astype(np.int64), np.repeat([i for i, _ in kept], [len(b) for _, b in kept])
    value = ratio[every]
    scale = 1.0 / max(1.0, float(np.sqrt(np.bincount(row, weights=value * value, minlength=len(y)).mean())))
    value = value * scale
    w, b, vw, vb = np.zeros(size), 0.0, np.zeros(size), 0.0
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        z = np.bincount(row, weights=value * w[every], minlength=len(y)) + b
        g = balance * (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        gw = np.bincount(every, weights=value * g[row], minlength=size) + penalty * w
        vw, vb = 0.9 * vw - rate * gw * 4, 0.9 * vb - rate * g.sum()
        w, b = w + vw, b + vb
    return ToxicityModel((w * ratio * scale).astype(np.float32), float(b))


def fit_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Learn from labelled documents outside the fold that is held out, at most about `train_rows` of each class.

    The sampled labels (bounded) are broadcast, so the documents are read once and not shuffled. A document with several
    labels counts with the highest one; of rows that share an id, the least text counts.
    """
    return train(training_features(labelled_texts(docs, labels, label, train_rows)))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts.

    Returns one row for each row (repeated rows stay repeated): doc_id, score (0 to 1), predicted (1 from 0.5 on). A null text
    scores as an empty one, which has the score of the bias alone. An empty table gives none. Long texts are scored in
    parts; a score of exactly 0.5 is predicted 1. Other columns are ignored, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        last = np.zeros(1 << BITS, np.int64)
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            score = own.score(np.array([own.weights[x].sum(dtype=np.float64) for x in _distinct(data, off, last)], np.float64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return kept.mapInArrow(run, "doc_id long, score double, predicted int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of `documents`."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, fit_model(docs, labels))
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
