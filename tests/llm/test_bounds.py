"""What is bounded stays bounded, and nothing is left out for it."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from seqloom.llm import decontamination, jaccard_join, language_id, quality, samples, store, token_codec, toxicity


def test_every_class_is_learned(spark):
    """More classes than rows in all: each keeps a row."""
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), (F.col("id") % 1500).cast("string")).alias("label"))
    rows = rows.unionByName(spark.range(100_000, 120_000).select(F.col("id").alias("doc_id"), F.lit("l7").alias("label")))
    for total in (3000, 100):
        n = Counter(r.label for r in samples.bounded(rows, "doc_id", "label", 500, total).collect())
        assert len(n) == 1500 and max(n.values()) <= 2 * max(1, total // 1500)


def test_rare_languages_are_predicted(spark):
    texts = [(i, "".join(chr(0x4E00 + 40 * (i % 1200) + j) for j in range(30)), f"x{i % 1200}") for i in range(2400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    found = samples.bounded(docs.select("doc_id", "text", F.col("lang").alias("label")), "doc_id", "label", 500)
    assert len({r.label for r in found.collect()}) == 1200
    small = docs.where("doc_id % 1200 < 6")
    model = language_id.fit_model(small.unionByName(small.withColumn("doc_id", F.col("doc_id") + 10_000)))
    assert len(model.languages) == 6


def test_rows_of_features_are_bounded(spark):
    rng = random.Random(1)
    long = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(60_000))
    rows = spark.createDataFrame([(1, long, "zh"), (2, "short", "en")], "doc_id long, text string, label string")
    sizes = [len(b) for _, b, _ in language_id.training_features(rows)]
    assert sizes[0] == language_id.ROW_BUCKETS and sizes[1] < 30
    rows = rows.withColumn("label", F.col("doc_id").cast("int") - 1)
    sizes = [len(b) for _, b in toxicity.training_features(rows)]
    assert sizes[0] == toxicity.ROW_BUCKETS and sizes[1] < 30


def test_the_memo_keeps_no_long_pieces():
    codec = token_codec.Codec(*token_codec.public_vocabulary())
    codec.encode_batch(["ab" * 100_000, "word word"])
    assert max(map(len, codec.memo)) <= token_codec.MEMO_LENGTH


def test_equal_and_long_items_are_dealt(spark):
    rng = random.Random(2)
    same = " ".join(f"s{i}" for i in range(40))
    long = " ".join(f"l{rng.randrange(10**6)}" for _ in range(3000))
    items = [(i, same) for i in range(500)] + [(1000, long), (None, "a b c"), (1001, None), (1002, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = decontamination.blocks_of(bench, tables=200_000)
    sizes = [b.count() for b in blocks]
    assert len(blocks) > 10 and min(sizes) > 0 and max(sizes) < 0.3 * sum(sizes)
    assert len(decontamination.blocks_of(spark.createDataFrame([(i, same) for i in range(500)], "item_id long, text string"), tables=1 << 20)) == 1
    docs = spark.createDataFrame([(1, f"x {same} y"), (2, " ".join(long.split()[50:70])), (3, "z a b c z"), (4, "clean")], "doc_id long, text string")
    one, many = (sorted(map(str, decontamination.decontaminate(docs, bench, tables=t).collect())) for t in (decontamination.TABLES, 200_000))
    assert one == many
    n = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.decontaminate(docs, bench, tables=200_000).collect()}
    assert n == {1: (40, 500), 2: (20, 1), 3: (3, 0), 4: (0, 0)}


def test_blocks_are_dealt_by_load(spark):
    """Whole blocks, and no task gets more than its share and the rest of one block."""
    rng = random.Random(5)
    sizes = {rng.randrange(-(2**63), 2**63): rng.choice([1, 2, 500, 512]) for _ in range(60)}
    work = spark.createDataFrame([(of, i) for of, n in sizes.items() for i in range(n)], "of long, set_key long").repartition(3)
    dealt, tasks = jaccard_join._by_load(work)
    rows = dealt.groupBy("_task", "of").count().collect()
    assert {r.of: r["count"] for r in rows} == sizes and len(rows) == len(sizes)
    loads = Counter()
    for r in rows:
        loads[r._task] += r["count"]
    assert max(loads) < tasks and max(loads.values()) <= 4 * jaccard_join.BLOCK and len(loads) > 0.8 * tasks
    empty, one = jaccard_join._by_load(work.limit(0))
    assert empty.count() == 0 and one == 1


def test_counts_are_added_in_levels(spark, monkeypatch):
    texts = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(30))) for i in range(300)], "doc_id long, text string").repartition(20)
    once = quality.word_vectors(texts)
    monkeypatch.setattr(store, "FAN_IN", 3)
    again = quality.word_vectors(texts)
    assert (once[0] == again[0]).all() and (once[1] == again[1]).all() and once[0].any()
    rows = texts.select(F.col("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(jaccard_join._classes, "doc_id long, key long, n long, set_key long, piece int, counts binary")
    pieces = rows.where("piece IS NOT NULL").select("piece", "counts")
    levels = {r.piece: bytes(r.counts) for r in store.added_up(pieces, 4, jaccard_join._added).collect()}
    monkeypatch.setattr(store, "FAN_IN", 1000)
    assert levels == {r.piece: bytes(r.counts) for r in store.added_up(pieces, 4, jaccard_join._added).collect()} and len(levels) == 32
