"""Language identification from averaged hashed subword embeddings.

Model: the character n-grams of all words of a text are hashed to buckets, each bucket has an embedding, a text is the mean of
its n-grams' embeddings, and a linear softmax over it gives the languages. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows. A part of that sample, kept out of the training,
sets a temperature (probabilities mean what they say) and the confidence below which a prediction is rejected.

Prediction: since the mean and the softmax's input are both linear, the trained model collapses to one row of logits for each
bucket. Predicting is a lookup and a sum over all n-grams of the whole text, in one pass without a shuffle. The broadcast model
has 2**BITS rows of as many numbers as languages, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.ngram_features import ngram_buckets, pieces, plain
from seqloom.llm.samples import bounded, fold
from seqloom.llm.store import columns, with_carried
from seqloom.llm.textkernels import slices, text_buffer

BITS, ORDERS, DIM = 15, (1, 2, 3, 4), 16
#: At most about so many rows of each language are learned from (and of all languages together, `samples.TOTAL_ROWS`); of a row,
#: as many of its most frequent buckets, so that what reaches the driver is bounded in bytes.
TRAIN_ROWS, ROW_BUCKETS = 500, 16_384
#: Bytes whose n-grams are held at once.
SLICE = 1 << 18
#: At least this share of rightly predicted calibration rows is kept by the rejection.
KEEP = 0.999


@dataclass
class LanguageModel:
    """Logits of each bucket (already over the temperature), bias, languages, and the confidence that is needed."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    threshold: float

    def sums(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(summed logits, number of n-grams) of the documents between `offsets` of plain() bytes."""
        docs = len(offsets) - 1
        total, count = np.zeros((docs, len(self.languages))), np.zeros(docs)
        for n in ORDERS:
            bucket, bounds = ngram_buckets(text, offsets, n, BITS)
            some = np.flatnonzero(np.diff(bounds))
            if len(some):
                total[some] += np.add.reduceat(self.logits[bucket], bounds[:-1][some], axis=0, dtype=np.float64)
                count += np.diff(bounds)
        return total, count

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, confidence) of the documents between `offsets`. A text longer than a slice comes in parts."""
        total, count = np.zeros((len(offsets) - 1, len(self.languages))), np.zeros(len(offsets) - 1)
        for a, b in slices(offsets, SLICE):
            text, own = plain(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            if b - a > 1:
                total[a:b], count[a:b] = self.sums(text, own)
                continue
            for lo, hi in pieces(text, SLICE):
                t, c = self.sums(text[lo:hi], np.array([0, hi - lo]))
                total[a] += t[0]
                count[a] += c[0]
        p = _softmax(total / np.maximum(count, 1)[:, None] + self.bias)
        return p.argmax(axis=1), p.max(axis=1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text's plain() bytes, and how often each occurs."""
    total = np.zeros(1 << BITS, np.int64)
    for lo, hi in pieces(text, SLICE):
        for n in ORDERS:
            total += np.bincount(ngram_buckets(text[lo:hi], np.array([0, hi - lo]), n, BITS)[0], minlength=1 << BITS)
    found = np.flatnonzero(total)
    if len(found) > ROW_BUCKETS:
        found = np.sort(found[np.argsort(-total[found], kind="stable")[:ROW_BUCKETS]])
    return found, total[found]


def training_features(rows: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(label, buckets, counts) of (doc_id, text, label) rows, in the order of their ids; computed on the executors. A row has
    at most ROW_BUCKETS buckets, however long its text is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            out = [_counts(plain(data[a:b])) for a, b in zip(off, off[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([x[0].astype("<i4").tobytes() for x in out], pa.binary()), pa.array([x[1].astype("<i4").tobytes() for x in out], pa.binary())], ["doc_id", "label", "bucket", "n"])

    got = rows.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label string, bucket binary, n binary").collect()
    got.sort(key=lambda r: (r[0] is not None, r[0], bytes(r[2])))
    return [(r[1], np.frombuffer(r[2], "<i4"), np.frombuffer(r[3], "<i4").astype(np.float32)) for r in got]


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, batch: int = 16, rate: float = 20.0, seed: int = 7) -> LanguageModel:
    """Fit embeddings and softmax by stochastic gradient descent, then calibrate. Without rows the model rejects everything."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    used = [(languages.index(y), b, c / c.sum()) for y, b, c in rows if len(b)]
    order = rng.permutation(len(used))
    held = max(1, len(used) // 5) if len(used) >= 10 else 0
    fit, calibrate = [used[i] for i in order[held:]], [used[i] for i in order[:held]] or used
    emb = rng.normal(0, 1.0 / DIM, (1 << BITS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 1.0 / DIM, (DIM, len(languages))).astype(np.float32), np.zeros(len(languages))
    steps, done = epochs * max(1, -(-len(fit) // batch)), 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(fit))
        for a in range(0, len(fit), batch):
            own = [fit[i] for i in shuffled[a : a + batch]]
            step = rate * (1 - done / steps)
            done += 1
            mean = np.stack([c @ emb[b] for _, b, c in own])
            p = _softmax(mean @ w + bias)
            p[np.arange(len(own)), [y for y, _, _ in own]] -= 1
            p /= len(own)
            back = p @ w.T
            w -= (step * 0.05) * (mean.T @ p).astype(np.float32)
            bias -= step * 0.05 * p.sum(axis=0)
            for (_, b, c), g in zip(own, back, strict=True):
                emb[b] -= step * np.outer(c, g).astype(np.float32)
    logits = emb @ w
    z = np.stack([c @ logits[b] for _, b, c in calibrate]) + bias
    y = np.array([y for y, _, _ in calibrate])
    grid = np.geomspace(0.2, 20, 120)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = _softmax(z / t)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    threshold = float(right[int((1 - KEEP) * len(right))]) * 0.95 if len(right) else 1.0
    return LanguageModel(languages, (logits / t).astype(np.float32), bias / t, min(threshold, 0.5))


def fit_model(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from the documents (doc_id, text, lang) with a language outside the fold that is held out, at most about
    `train_rows` of each language."""
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label"))
    return train(training_features(bounded(labelled.where(fold("doc_id", 4) != 2), "doc_id", "label", train_rows).where(F.col("text").isNotNull())))


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), results: tuple[str, ...] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Predict the language of whole texts.

    Returns one row for each row (repeated rows stay repeated): the columns in `carry` as they are, lang_pred, score (the
    confidence, 0 to 1), rejected. A null text, or one without a letter, is `und` with score 0 and is rejected; so is every
    row if the model knows no language. An empty table gives none. Long texts are summed in parts. Of equally
    probable languages the first by name is predicted. Other columns are ignored, whatever their names; of carried
    columns with the names above the results win, unless `results` gives other names to lang_pred, score and rejected.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            at = len(carry)
            data, off = text_buffer(batch.column(at))
            n = batch.num_rows
            known = np.array(batch.column(at + 1).to_pylist(), bool) & bool(own.languages)
            lang, score = own.predict(data, off) if own.languages else (np.zeros(n, np.int64), np.zeros(n))
            names = [own.languages[i] if k else "und" for i, k in zip(lang.tolist(), known.tolist(), strict=True)]
            score = np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < own.threshold))], [*batch.schema.names[:at], "_lang", "_score", "_rejected"])

    text = F.col(text_col).cast("string")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return with_carried(docs, columns(carry), [text, letter], run, "_lang string, _score double, _rejected boolean", results)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fit_model(docs))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op5_language_id": op5_language_id}
