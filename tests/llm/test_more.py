"""More of the text operators: larger inputs, plain-Python twins of what numpy does, and the edges of the pipeline."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from oracle import SF, database, same
from pyspark.sql import functions as F
from test_operators import EDGES, clashing, frame, ids, naive_components, naive_rule, naive_url

from seqloom.llm import decontamination, jaccard_join, language_id, license_scan, media_columns, ngram_features, quality, samples, store, substring_dedup, token_codec, toxicity, url_filter

# 1


def test_known_digests_may_repeat(spark):
    docs = spark.createDataFrame([(1, "Some Licence"), (1, "x\nsome license!"), (None, None)], "doc_id long, text string")
    own = license_scan.known_digests(spark, [("A", "some license")])
    known = own.unionByName(own).unionByName(own.withColumn("license_id", F.lit("B"))).unionByName(own.withColumn("license_id", F.lit(None).cast("string")))
    got = sorted((r.license_id or "", r.n_license_lines, r.line_licenses) for r in license_scan.license_scan(docs, known).collect())
    assert got == [("", 0, ""), ("", 1, "A"), ("A", 1, "A")]


def test_more_digests_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 3)
    known = license_scan.known_digests(spark, [(f"L{i}", f"text number {i}") for i in range(20)])
    docs = spark.createDataFrame([(i, f"Text, number {i}") for i in range(30)], "doc_id long, text string")
    assert {r.doc_id: r.license_id for r in license_scan.license_scan(docs, known).collect()} == {i: f"L{i}" if i < 20 else None for i in range(30)}


def test_license_behind_comment_marks(spark):
    mit = next(t for i, t in license_scan.NOTICES if i == "MIT" and "\n" in t)
    text = "\n".join(f"# {x}" for x in ["MIT License", "", "Copyright (c) 2020 X", "All rights reserved.", "", *mit.split("\n")])
    assert license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().license_id == "MIT"


def test_sql_and_operator_agree_where_whole_texts_match(spark, tmp_path):
    texts = [t for _, t in license_scan.known_texts()] + [license_scan._CUT[0][1], None, "", "v.2 licence"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = license_scan.op1_license_scan(spark, str(tmp_path))
    assert out.where("license_id IS NOT NULL").count() == len(texts) - 4
    same(out, db, license_scan.ORACLE_SQL["op1_license_scan"])


# 2


def test_query_equals_plain_rules_on_pages(spark):
    db = database()
    urls = dict(db.sql("SELECT page_id, url FROM pages").fetchall())
    for r in url_filter.op2_url_filter(spark, SF).collect():
        host, path = naive_url(urls[r.page_id])
        rule = naive_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]) and (rule is None or r.verdict == rule[0])


def test_rules_of_any_number_and_as_a_table(spark, monkeypatch):
    rnd = random.Random(3)
    hosts = [".".join(rnd.choices(["a", "bb", "c"], k=rnd.randint(1, 4))) for _ in range(60)]
    urls = [f"http://{h}/{rnd.choice(['', 'x', 'xy/z', 'y'])}" for h in hosts] + [None, "none", "http:///x"]
    rules = [(rnd.choice(["allow", "block"]), f"{'.'.join(rnd.choices(['a', 'bb', 'c'], k=rnd.randint(1, 3)))}{rnd.choice(['', '/', '/x', '/xy'])}") for _ in range(40)]
    rules = list({r: (v, r) for v, r in rules}.values())
    parts = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    host, path = url_filter.host_and_path(F.col("url"))
    parts = parts.withColumns({"host": host, "path": path})
    want = {r.page_id: r._best for r in url_filter.with_best_rule(parts, rules).collect()}
    monkeypatch.setattr(url_filter, "AS_EXPRESSIONS", 0)
    table = spark.createDataFrame(rules, "verdict string, rule string")
    for own in (rules, table):
        assert {r.page_id: r._best for r in url_filter.with_best_rule(parts, own).collect()} == want
    assert sum(x is not None for x in want.values()) > 20


def test_repeated_pages(spark):
    rows = [(1, "http://a.org/es/", "<a href=//b.io>"), (1, "http://a.org/es/", "<a href=//b.io>"), (1, "http://b.io/", "x" * 200_000), (None, None, None)]
    got = url_filter.filter_urls(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id or 0, r.host, r.verdict) for r in got) == [(0, "", "allow"), (1, "a.org", "block"), (1, "a.org", "block"), (1, "b.io", "allow")]


# 3


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full(kind, *parts, flags=0, version=0):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def fragmented():
    none = struct.pack(">I", 0)
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stts", none), full(b"stsc", none), full(b"stsz", none, none), full(b"stco", none))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 9)), mdia)
    moov = box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">IIIII", 9, 1, 40, 5, 0x10000))))
    out = box(b"ftyp", b"isom") + moov
    payload = [b"KEYFR", b"delta", b"delt2", b"Key"]
    tfhd = full(b"tfhd", struct.pack(">I", 9), flags=0x20000)
    trun = lambda at: full(b"trun", struct.pack(">IiI", 3, at, 0x2000000), flags=0x5)
    size = len(box(b"moof", box(b"traf", tfhd, trun(0))))
    out += box(b"moof", box(b"traf", tfhd, trun(size + 8))) + box(b"mdat", *payload[:3])
    own = full(b"trun", struct.pack(">IIIII", 1, 0, 25, 3, 0), flags=0x701)
    size = len(box(b"moof", box(b"traf", tfhd, own)))
    own = full(b"trun", struct.pack(">IiIII", 1, size + 8, 25, 3, 0), flags=0x701)
    return out + box(b"moof", box(b"traf", tfhd, own)) + box(b"mdat", payload[3]), payload


def test_fragmented_files():
    data, payload = fragmented()
    (track,) = media_columns.parse(data)
    assert (track.codec, track.kind, track.timescale, track.duration) == ("avc1", "vide", 1000, 3 * 40 + 25)
    assert [data[a : a + n] for a, n in zip(track.starts, track.sizes, strict=True)] == payload
    assert [data[a:b] for a, b in track.keyframes()] == [b"KEYFR", b"Key"]
    for cut in range(len(data)):
        try:
            media_columns.parse(data[:cut])
        except media_columns.MediaError:
            pass


def test_a_broken_track_leaves_the_others(spark):
    data, _ = fragmented()
    bad = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 4)), box(b"mdia"))
    at = data.index(b"trak") - 4
    moov = data.index(b"moov") - 4
    grown = struct.pack(">I", struct.unpack_from(">I", data, moov)[0] + len(bad))
    both = data[:moov] + grown + data[moov + 4 : at] + bad + data[at:]
    got = media_columns.media_columns(spark.createDataFrame([(1, both), (2, None), (3, b"")], "id long, data binary"), "id", "data").collect()
    by = {r.id: r for r in got}
    assert len(by[1].tracks) == 1 and by[1].error.startswith("track 4:") and by[2].error is None and by[3].error


def test_stored_texts_of_the_query(spark):
    texts = dict(database().sql("SELECT doc_id, text FROM documents").fetchall())
    got = media_columns.op3_media_columns(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = media_columns.wrap(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and payload in media
    assert media_columns.store_texts(frame(spark).limit(0)).count() == 0 and ids(media_columns.store_texts(frame(spark)).collect()) == ids(EDGES)


# 4


def test_query_equals_the_library_on_documents(spark):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(database().sql("SELECT doc_id, text FROM documents").fetchall())
    for r in token_codec.op4_bpe_codec(spark, SF).collect():
        want = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    ranks, pattern = token_codec.public_vocabulary()
    assert token_codec.token_digests(frame(spark).limit(0), ranks, pattern).count() == 0


# 5, 7, 10: one score at a time, in plain Python


def plain_text(text):
    raw = bytearray((text or "").encode())
    for i, b in enumerate(raw):
        if i and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E and b != 0x97:
            raw[i] += 0x20
        elif 0x41 <= b <= 0x5A:
            raw[i] += 0x20
        elif b < 0x80 and not 0x61 <= b <= 0x7A:
            raw[i] = 0x20
    return bytes(raw)


def buckets_of(text, orders, bits):
    framed, out = b" " + plain_text(text) + b" ", []
    for n in orders:
        for i in range(len(framed) - n + 1):
            gram = framed[i : i + n]
            if b" " in gram[1:-1] or not gram.strip():
                continue
            h = 0
            for j, b in enumerate(gram):
                h = ((h ^ b) * int(ngram_features._SEEDS[j % len(ngram_features._SEEDS)])) & 0xFFFFFFFF
                h ^= h >> 15
            h = (h * 0x2C1B3C6D) & 0xFFFFFFFF
            h ^= h >> 12
            h = (h + n * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 16
            h = (h * 0x297A2D39) & 0xFFFFFFFF
            out.append(h >> (32 - bits))
    return out


TEXTS = ["", None, "Ein Satz, über Äpfel!", "word", "1 2 3", "the quick brown fox " * 30, "naïve café ÀÉÖ " * 5]


def test_language_scores_in_plain_python(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SLICE", 100)  # so that long texts come in parts
    model = language_id.fit_model(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in language_id.identify(docs, model).collect():
        found = buckets_of(TEXTS[r.doc_id], language_id.ORDERS, language_id.BITS)
        if not any(c.isalpha() for c in TEXTS[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        z = [sum(float(model.logits[b, k]) for b in found) / len(found) + float(model.bias[k]) for k in range(len(model.languages))]
        e = np.exp(np.array(z) - max(z))
        assert r.lang_pred == model.languages[int(np.argmax(z))] and r.score == pytest.approx(float(e.max() / e.sum()), rel=1e-9)
    assert language_id.identify(frame(spark).limit(0), model).count() == 0


def test_toxicity_scores_in_plain_python(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SLICE", 100)
    model = toxicity.fit_model(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in toxicity.score_toxicity(docs, model).collect():
        found = set(buckets_of(TEXTS[r.doc_id], toxicity.ORDERS, toxicity.BITS))
        z = sum(float(model.weights[b]) for b in found) + model.bias
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6) and r.predicted == int(r.score >= 0.5)
    assert toxicity.score_toxicity(frame(spark).limit(0), model).count() == 0


def test_quality_scores_in_plain_python(spark):
    import re

    model = quality.fit_model(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in quality.score_quality(docs, model).collect():
        raw = (TEXTS[r.doc_id] or "").encode()
        words = [m[0] for m in re.finditer(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", raw)]
        data = np.frombuffer(raw, np.uint8)
        own, shape, _ = quality.words_of(data, np.array([0, len(raw)]))
        assert len(own) == len(words)
        v = [[float(x) for x in model.vectors[i]] for i in model.rows_of(own, shape)]
        mean = [sum(x) / len(v) for x in zip(*v, strict=True)] or [0.0] * quality.DIM
        spread = [max(0.0, sum(a * a for a in x) / len(v) - m * m) ** 0.5 for x, m in zip(zip(*v, strict=True), mean, strict=False)] or [0.0] * quality.DIM
        middle, scale, w1, b1, w2, b2 = model.layers
        x = [(a - m) / s for a, m, s in zip(mean + spread, middle, scale, strict=True)]
        hidden = [max(0.0, sum(a * w for a, w in zip(x, col, strict=True)) + b) for col, b in zip(w1.T, b1, strict=True)]
        z = (sum(h * w for h, w in zip(hidden, w2, strict=True)) + b2[0]) / model.temperature
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4, abs=1e-9) and r.predicted == int(r.score >= quality.THRESHOLD)
    assert quality.score_quality(frame(spark).limit(0), model).count() == 0


def test_samples_are_bounded_whatever_repeats(spark):
    rows = [(i % 50, "a" if i % 3 else "b", f"t{i}") for i in range(3000)] + [(7, "a", "t")] * 500 + [(1, None, "x"), (None, "a", "y")]
    keyed = spark.createDataFrame(rows, "doc_id long, label string, text string")
    a, b = (samples.bounded(keyed.repartition(n), "doc_id", "label", 10).collect() for n in (1, 7))
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    assert all(sum(r.label == x for r in a) <= 20 for x in "ab") and {r.label for r in a} <= {"a", "b"}
    assert samples.bounded(keyed.limit(0), "doc_id", "label", 10).count() == 0


# 8


def test_a_hundred_blocks_equal_one(spark):
    rnd = random.Random(1)
    items = [(i if i % 9 else None, " ".join(f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(1, 30)))) for i in range(150)]
    texts = [" ".join([f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(0, 20))] + items[rnd.randrange(150)][1].split() * rnd.randint(0, 2)) for _ in range(200)]
    docs = clashing(spark.createDataFrame([*enumerate(texts), (7, texts[7]), (None, None)], "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    few = 2 * sum(len(t) for _, t in items) * decontamination.WORDS * decontamination.TABLES_PER_BYTE // 12
    assert len(decontamination.blocks_of(bench, tables=few)) >= 12
    one, many = (sorted(map(str, decontamination.decontaminate(docs, bench, carry=("doc_id", "n"), tables=t).collect())) for t in (decontamination.TABLES, few))
    assert one == many
    plan = decontamination.decontaminate(docs, bench, tables=few)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


# 9


def test_linked_sets_share_a_cell():
    rng = np.random.default_rng(1)
    linked = 0
    for t in range(3000):
        n = int(rng.integers(1, 60 if t % 2 else 400))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        k = max(1, n // 8)
        b = np.unique(np.concatenate([a[int(rng.integers(0, k + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, k + 1))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            linked += 1
            assert len(np.intersect1d(jaccard_join.cells(a, 80, 100), jaccard_join.cells(b, 80, 100)))
    assert linked > 1000


def test_overlaps_and_forests():
    rng = np.random.default_rng(2)
    for _ in range(40):
        k = int(rng.integers(2, 40))
        rows = [np.unique(rng.integers(0, 200, int(rng.integers(0, 60))).astype(np.uint64)) for _ in range(k)]
        want = np.array([[len(np.intersect1d(x, y)) if i != j else 0 for j, y in enumerate(rows)] for i, x in enumerate(rows)])
        assert (jaccard_join.overlaps(rows) == want).all() and (jaccard_join.overlaps(rows[: k // 2], rows[k // 2 :]) == want[: k // 2, k // 2 :]).all()
        good = rng.random((k, k + 3)) < 0.05
        i, j = jaccard_join.forest(good)
        assert good[i, j].all()

        def parts(pairs, k=k):
            label = list(range(2 * k + 3))
            for a, b in pairs:
                old, new = label[int(a)], label[int(b) + k]
                label = [new if x == old else x for x in label]
            first = {}
            return [first.setdefault(x, n) for n, x in enumerate(label)]

        assert parts(zip(i, j, strict=True)) == parts(zip(*np.nonzero(good), strict=True))


def passages(n, seed):
    rnd = random.Random(seed)
    common = [" ".join(f"p{k}w{rnd.randint(0, 999)}" for _ in range(40)) for k in range(24)]
    return [(i, " ".join(common[k] for k in rnd.sample(range(24), 5))) for i in range(n)]


def test_common_passages(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)  # so that the passages' n-grams are frequent ones
    rows = passages(150, 4)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), links=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(naive_components(rows))


def test_cells_of_common_passages_are_rarely_shared():
    # Any two of these texts have a passage in common with a chance of 70 %, and so an n-gram in any prefix. Cells bring far fewer
    # together, and the rows of their groups grow with the texts, not with their pairs.
    sizes = []
    for n in (400, 800):
        sets = [jaccard_join.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for _, t in passages(n, 5)]
        found = np.concatenate([jaccard_join.cells(x, 80, 100) for x in sets])
        _, often = np.unique(found, return_counts=True)
        sizes.append((often[often > 1].sum(), (often.astype(float) ** 2).sum() / n**2))
    assert sizes[1][0] < 2.6 * sizes[0][0]


# The pipeline


def test_pipeline_edges(spark):
    import corpus_pipeline

    more = ("score", "rejected", "lang_pred", "n_words", "n_removed", "kept_text", "repeats", "n_hit", "n_items", "item_ids", "runs", "LANG_PRED", "a.b")
    docs = frame(spark)
    for c in more:
        docs = docs.withColumn(c, F.lit("mine")) if c.lower() not in {x.lower() for x in docs.columns} else docs
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == docs.columns, name
            kept = out.collect()
            assert all(r["rejected"] == "mine" and r["a.b"] == "mine" for r in kept)
            if name in ("substring_dedup", "decontamination"):
                assert ids(kept) == ids(rows.collect())
        assert corpus_pipeline.encode(spark, rows, SF).count() == rows.count()


def test_names_are_fresh():
    assert store.fresh(["a", "_A", "b"], "a", "c", "C") == ("__a", "c", "_C")


def test_a_cluster_must_name_its_folder(spark):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        store.shared_dir(Session())


def test_repeats_are_maximal_runs(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, f"a b {shared} c"), (2, f"{shared} d"), (3, "nothing here")]
    got = {r.doc_id: [(x["first"], x["last"]) for x in r.repeats] for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(2, 52)], 2: [(0, 50)], 3: []}
