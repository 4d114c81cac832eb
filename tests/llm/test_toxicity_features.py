"""Training features of long texts are whole."""

from __future__ import annotations

import random

import numpy as np

from seqloom.llm import ngram_features, toxicity


def test_no_bucket_of_a_long_text_is_left_out(spark):
    rng = random.Random(2)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60_000)), "short", None]
    rows = spark.createDataFrame([(i, x, i % 2) for i, x in enumerate(texts)], "doc_id long, text string, label int").where("text IS NOT NULL")
    found: dict = {}
    for i, buckets in toxicity.training_features(rows).parts():
        found.setdefault(i, []).extend(buckets.tolist())
    for i, got in found.items():
        text = ngram_features.plain(np.frombuffer(texts[i].encode(), np.uint8))
        want = {int(b) for n in toxicity.ORDERS for b in ngram_features.ngram_buckets(text, np.array([0, len(text)]), n, toxicity.BITS)[0]}
        assert len(got) == len(want) and set(got) == want
    assert len(found[0]) > 2 * toxicity.ROW_BUCKETS


def test_parts_of_rows_train_as_whole_rows(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 2, np.unique(rng.integers(0, 400, 150) + 200 * (i % 2)).astype(np.int32)) for i in range(40)]
    whole = toxicity.train(toxicity.Features(rows), rounds=20)
    parts = toxicity.train(toxicity.Features([(y, b[:50]) for y, b in rows], [(i, toxicity._bits(b[50:])) for i, (_, b) in enumerate(rows)]), rounds=20)
    assert np.abs(whole.weights).max() > 0 and np.allclose(whole.weights, parts.weights, atol=1e-6) and abs(whole.bias - parts.bias) < 1e-9
