"""The text operators against SQL, brute force, round trips and held-out rows; and their defined results at the edges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import SF, database, same
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import (
    components,
    decontamination,
    jaccard_join,
    language_id,
    license_scan,
    media_columns,
    quality,
    registry,
    samples,
    store,
    substring_dedup,
    textkernels,
    token_codec,
    toxicity,
    url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty, blank, no letters, one word, repeated rows, a repeated id, a long text, extra columns with names of results.
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "!!! 123 ???", None, "a", 11),
    (5, "word", "en", None, 4),
    (6, "The same row. " * 20, "en", "a", 1),
    (6, "The same row. " * 20, "en", "a", 1),
    (7, "Another text with this id.", "fr", "b", 1),
    (7, "A second text with this id.", "fr", "b", 1),
    (None, "a row without an id", "en", "b", 1),
    (8, " ".join(f"w{i % 977}x{i}" for i in range(60_000)), "de", "c", 1),
    (9, "İSTANBUL ß 𝒜🙂 'S don't\x00\x1f end", "de", "c", 1),
]
CLASHES = ("key", "n", "score", "n_words", "license_id", "host", "node", "set_key", "seed", "label", "_id", "_text", "component_id", "predicted")


def frame(spark, rows=EDGES):
    return clashing(spark.createDataFrame(rows, DOCS))


def clashing(df):
    """With more columns, named as the operators name theirs."""
    return df.withColumns({c: F.lit(7) for c in CLASHES if c not in df.columns})


def ids(rows):
    return Counter(r[0] for r in rows)


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, db, name):
    same(registry.queries()[name](spark, SF), db, registry.oracle_sql()[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))


# Kernels


def test_words_and_hashes_match_python():
    texts = ["a bb  ccc\n", "", "bb", "é\tbb ccc a", " "]
    data, off = textkernels.text_buffer(__import__("pyarrow").array([*texts, None]))
    words, starts, ends, bounds = textkernels.document_words(data, off)
    raw = [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] == [t.encode().split() for t in texts] + [[]]
    same_hash = defaultdict(set)
    for w, h in zip(raw, words.tolist(), strict=True):
        same_hash[w].add(h)
    assert all(len(v) == 1 for v in same_hash.values()) and len({next(iter(v)) for v in same_hash.values()}) == len(same_hash)


def test_windows_do_not_depend_on_where_they_stand():
    words = np.arange(200_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = np.concatenate([words, words[:1000]])
    h = textkernels.window_hashes(twice, 35)
    assert (h[:900] == h[200_000 : 200_900]).all() and len(np.unique(h[:200_000])) == 200_000
    assert (textkernels.sliding_min(h[:500], 28) == [h[i : i + 28].min() for i in range(473)]).all()


# 1


def test_license_forms(spark):
    rows = [(1, "Copyright (c) 2019 Someone\n\nReleased under the M.I.T. Licence!"), (2, "RELEASED   under the MIT license"), (3, "x\nLicensed under CC BY-NC 4.0.\ny"), (4, "no"), (5, None), (6, "")]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].license_id == "MIT" and got[3].license_id is None
    assert (got[3].n_license_lines, got[3].line_licenses) == (1, "CC-BY-NC-4.0")
    assert got[5].license_digest is None and got[6].license_digest == hashlib.sha256(b"").hexdigest() and got[6].license_id is None
    whole = next(t for i, t in license_scan.NOTICES if i == "ISC")
    mine = whole.upper().replace(",", ";").replace("\n\n", "\n  \n")
    assert license_scan.license_scan(spark.createDataFrame([(1, "Copyright 2020 X\n" + mine)], "doc_id long, text string")).first().license_id == "ISC"


def test_whole_license_texts(spark):
    from pathlib import Path

    cut = next(t for i, t in license_scan.NOTICES if i == "Unlicense")
    mit = next(t for i, t in license_scan.NOTICES if i == "MIT" and "\n" in t)
    rows = [("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + mit), (None, cut), (None, mit[:-200])]
    rows += [(i, body) for i, body, _ in license_scan.TEXTS]
    there = Path("/usr/share/common-licenses")
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3"), ("MPL-2.0", "MPL-2.0")):
        if (there / file).exists():
            rows.append((name, (there / file).read_text()))
    got = license_scan.license_scan(spark.createDataFrame([(j, t) for j, (_, t) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == {j: i for j, (i, _) in enumerate(rows)}


def test_license_edges(spark):
    assert ids(license_scan.license_scan(frame(spark)).collect()) == ids(EDGES)
    assert license_scan.license_scan(frame(spark).limit(0)).count() == 0


# 2


def naive_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def naive_rule(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        of, _, under = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + under) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return best


def test_url_rules(spark):
    urls = [None, "", "nothing", "http://", "HTTPS://A.Example.COM/en/7?x", "http://example.com/en/8#y", "http://notexample.com/en/7", "ftp://x.net/de/9", "http://example.net/de/81", "http://a.example.net/de/8/", "http://x.org/es/?q", "http://x.org?u=http://y.com/en/", "http://x.org#/es/", "a://b://c.com/en/"]
    rows = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("html", F.lit(None).cast("string")))
    got = {r.page_id: r for r in url_filter.filter_urls(rows).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = naive_url(u)
        rule = naive_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule[1]), u
        assert rule is None or got[i].verdict == rule[0]
    assert url_filter.filter_urls(rows.limit(0)).count() == 0


def dense_scores(n, edges, seed):
    """Personalised PageRank as one linear system; a host without a way on leads back to the seeds."""
    start = np.array(seed, float) / sum(seed)
    move = np.zeros((n, n))
    for a, b, w in edges:
        move[a, b] += w
    whole = move.sum(axis=1)
    move = np.where(whole[:, None] > 0, move / np.maximum(whole, 1e-300)[:, None], start[None, :])
    return np.linalg.solve(np.eye(n) - url_filter.DAMPING * move.T, (1 - url_filter.DAMPING) * start)


def test_propagation_equals_a_dense_solution(spark):
    rnd = random.Random(5)
    n = 400
    edges = [(a, b, float(rnd.randint(1, 5))) for a in range(n) for b in rnd.sample(range(n), 3) if a != b and a % 7]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    good, bad = [0.0] * n, [0.0] * n
    good[0], good[1], bad[1], bad[5] = 2.0, 1.0, 1.0, 3.0
    e = spark.createDataFrame([(f"h{a}", f"h{b}", w) for a, b, w in edges], "src string, dst string, weight double")
    s = spark.createDataFrame([(f"h{i}", good[i], bad[i]) for i in (0, 1, 5)], "host string, trust double, distrust double")
    got = {int(r.host[1:]): r for r in url_filter.propagate(e, s).collect()}
    trust, distrust = dense_scores(n, edges, good), dense_scores(n, [(b, a, w) for a, b, w in edges], bad)
    for i in range(n):
        mine = (got[i].trust, got[i].distrust) if i in got else (0.0, 0.0)
        assert mine == (pytest.approx(trust[i], rel=1e-4, abs=1e-12), pytest.approx(distrust[i], rel=1e-4, abs=1e-12))


def test_links_carry_trust_and_distrust(spark):
    page = lambda i, url, *links: (i, url, "".join(f'<a class=x HREF="{x}">' for x in links))
    rows = [page(1, "http://good.net/de/1", "//near.io/x"), page(2, "http://near.io/"), page(3, "http://linker.io/", "https://bad.org/q", "/own"), page(4, "http://bad.org/es/1"), page(5, "http://far.io/")]
    got = {r.page_id: (r.verdict, r.rule) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("allow", "net/de/"), 2: ("allow", None), 3: ("block", None), 4: ("block", "org/es/"), 5: ("allow", None)}


def test_propagation_reaches_all_hosts_however_small_their_scores(spark):
    # A way of 30 links to a bad host that is one of a billion pages' seeds: no score on it comes near 1e-6.
    n, many = 30, 1e9
    edges = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0) for i in range(n)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([(f"h{n}", 0.0, 1.0), ("else", 0.0, many)], "host string, trust double, distrust double")
    got = {r.host: r.distrust for r in url_filter.propagate(edges, seeds).collect()}
    d = url_filter.DAMPING
    raw = {"else": (1 - d) * many / (many + 1)} | {f"h{i}": (1 - d) * d ** (n - i) / (many + 1) for i in range(n + 1)}
    assert got == {h: pytest.approx(x / sum(raw.values()), rel=1e-9, abs=0) for h, x in raw.items()}


def test_propagation_settles_on_cycles(spark):
    ring = [(f"h{i}", f"h{(i + 1) % 6}", 1.0) for i in range(6)] + [("h5", "in", 1.0)]
    edges = spark.createDataFrame(ring, "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r.host: r.trust for r in url_filter.propagate(edges, seeds).collect()}
    d = url_filter.DAMPING
    first = (1 - d) / (1 - d**6 / 2)
    want = {f"h{i}": first * d**i for i in range(6)} | {"in": first * d**6 / 2}
    assert got == {h: pytest.approx(v / sum(want.values()), rel=1e-5, abs=0) for h, v in want.items()}


# 3


def test_containers_round_trip():
    for n in (64, 128, 64 * 257, 64 * 1024 + 64):
        payload = random.Random(n).randbytes(n)
        media = media_columns.wrap(payload)
        (track,) = media_columns.parse(media)
        assert media_columns.read_back(media, track) == payload
        assert (track.codec, track.kind, len(track.sizes), track.seconds) == ("raw ", "soun", n // 64, n / 8000)
        keys = track.keyframes()
        assert len(keys) == -(-(n // 64) // media_columns.GROUP) and all(b - a == 64 for a, b in keys.tolist())
    with pytest.raises(ValueError):
        media_columns.wrap(b"x" * 63)


def test_damaged_containers_are_errors():
    media = media_columns.wrap(bytes(range(64)) * 40)
    rnd = random.Random(2)
    for _ in range(300):
        broken = bytearray(media)
        for _ in range(rnd.randint(1, 4)):
            broken[rnd.randrange(len(broken))] = rnd.randrange(256)
        cut = bytes(broken[: rnd.randrange(len(broken) + 1)])
        for data in (bytes(broken), cut):
            try:
                media_columns.parse(data)
            except media_columns.MediaError:
                pass


def test_stored_texts(spark):
    got = media_columns.store_texts(frame(spark)).collect()
    assert ids(got) == ids(EDGES)
    texts = defaultdict(set)
    for i, t, *_ in EDGES:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        texts[i].add((len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in texts[r.doc_id]
    assert len({r.media_sha256 for r in got if r.n_bytes == 0}) == 1


def test_media_table(spark):
    good = media_columns.wrap(bytes(128))
    df = spark.createDataFrame([(1, good), (2, b""), (3, b"\0\0\0\x09mooo"), (4, None)], "k int, data binary").withColumn("error", F.lit("mine"))
    got = {r.k: r for r in media_columns.media_columns(df, "k", "data").collect()}
    assert got[1].error is None and got[1].tracks[0].n_samples == 2 and got[1].tracks[0].keyframes[0].end - got[1].tracks[0].keyframes[0].start == 64
    assert got[2].tracks is None and got[2].error and got[3].error and got[4].error is None and got[4].tracks is None


# 4


@pytest.fixture(scope="module")
def codec():
    return token_codec.Codec(*token_codec.public_vocabulary())


def test_codec_equals_the_library(codec, spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=codec.pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(4)
    parts = ["'", "'s", "'ll", "re", "ve", " ", "  ", "\n", "\t ", "a", "é", "straße", "12", "٣", "!", "…", "\u3000", "\xa0", "𝒜", "🙂", "the", "ing", "<|endoftext|>"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(4000)] + [t or "" for _, t, *_ in EDGES if len(t or "") < 10_000]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for text, got in zip(texts, codec.encode_batch(texts), strict=True):
        assert got.tolist() == library.encode_ordinary(text), text
        assert codec.decode(got) == text.encode()


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.hash.slot_key.tolist()) == list(range(len(codec.keys)))
    assert codec.hash.candidates(codec.keys).tolist() == list(range(len(codec.keys)))
    few = token_codec.PerfectHash([b"a", b"bc", b"d"])
    assert few.candidates([b"d", b"a"]).tolist() == [2, 0]


def test_another_pattern(codec):
    own = token_codec.Codec(codec.ranks, r"\S+|\s+")
    assert own.decode(own.encode("ab cd  e")) == b"ab cd  e"
    with pytest.raises(ValueError, match="leaves out"):
        token_codec.Codec(codec.ranks, r"\S+").encode("ab cd")


def test_codec_table(spark, codec):
    got = token_codec.token_digests(frame(spark), codec.ranks, codec.pattern, with_ids=True).collect()
    assert ids(got) == ids(EDGES) and all(r.matches for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and by[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[5].decoded_sha256 == hashlib.sha256(b"word").hexdigest() and list(by[5].ids) == codec.encode("word").tolist()


# 5, 7, 10


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


def test_languages_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = language_id.op5_language_id(spark, sf).join(docs, "doc_id").toPandas()
    assert got["held_out"].tolist() == [samples.python_fold(i, 4) == 2 for i in got["doc_id"]]
    assert (got["lang"] == got["lang_pred"])[got["held_out"]].mean() > 0.97
    assert got["score"].between(0, 1).all() and got["rejected"].mean() < 0.02


def test_language_edges(spark):
    docs = frame(spark)
    model = language_id.fit_model(spark.read.parquet(f"{SF}/documents.parquet"))
    got = language_id.identify(docs, model, carry=("doc_id", "source", "_text")).collect()
    assert ids(got) == ids(EDGES)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score, by[i].rejected) for i in (1, 2, 3, 4)] == [("und", 0.0, True)] * 4
    assert by[5].lang_pred in model.languages
    none = language_id.fit_model(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, none).collect()} == {"und"}


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.75)])
def test_classifiers_on_held_out_rows(spark, module, label, least):
    sf = "/root/testdata/sf0.01"
    (query,) = module.QUERIES.values()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = query(spark, sf)
    got = out.join(labels, "doc_id").toPandas()
    assert out.count() == 1000 and got["score"].between(0, 1).all()
    assert got["held_out"].tolist() == [samples.python_fold(i, 5) == 0 for i in got["doc_id"]]
    held = got[got["held_out"]]
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least


@pytest.mark.parametrize(("module", "score"), [(quality, quality.score_quality), (toxicity, toxicity.score_toxicity)])
def test_classifier_edges(spark, module, score):
    docs = frame(spark)
    labels = spark.createDataFrame([(5, 1, 1), (5, 0, 0), (7, 0, 0), (9, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.where("doc_id = 7")):
        got = score(docs, module.fit_model(docs, known)).collect()
        assert ids(got) == ids(EDGES) and all(0 <= r.score <= 1 for r in got)
        by = {r.doc_id: r.score for r in got}
        assert by[1] == by[2]


def test_learning_does_not_look_at_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(samples.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit_model(docs, labels), toxicity.fit_model(docs, other)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_word_vectors_come_from_all_documents(spark):
    # No labelled document has these words; those that occur often have vectors of their own, whatever the partitions.
    rows = [(i, " ".join(f"w{'abcdefgh'[j % 8]}{'xyz'[i % 3]} word" for j in range(40))) for i in range(30)]
    docs = spark.createDataFrame([*rows, (99, None), (100, "labelled text")], "doc_id long, text string")
    labels = spark.createDataFrame([(100, 1)], "doc_id long, quality int")
    a, b = (quality.fit_model(docs.repartition(n), labels) for n in (1, 5))
    own = quality.words_of(*textkernels.text_buffer(__import__("pyarrow").array([rows[0][1]])))[0]
    at = quality.bucket_of(own)
    assert a.known[at].all() and (np.linalg.norm(a.vectors[at], axis=1) > 0.99).all()
    assert (a.known == b.known).all() and (a.vectors == b.vectors).all()
    few, _, _ = quality.words_of(*textkernels.text_buffer(__import__("pyarrow").array(["labelled"])))
    assert not a.known[quality.bucket_of(few)].any()


# 6


def naive_repeats(texts, length):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append(b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode())
    return out


def test_repeats_equal_brute_force(spark):
    rnd = random.Random(6)
    passages = [[rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(30, 60))] for _ in range(4)]
    texts = []
    for _ in range(70):
        w = [rnd.choice("abcdefgh") + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 2)):
            p, at = rnd.choice(passages), rnd.randint(0, len(w))
            a = rnd.randint(0, 8)
            w[at:at] = p[a : a + rnd.randint(20, 60)]
        texts.append(" ".join(w))
    texts += [texts[3], texts[3] + "\n", "x " * 80, "y z " * 40, None, "", passages[0][0]]
    rows = list(enumerate(texts))
    for length, seed in ((35, 8), (12, 3)):
        got = dict((r.doc_id, r) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), length=length, seed=seed).collect())
        want = naive_repeats(texts, length)
        for i, t in rows:
            assert got[i].kept_text == want[i], i
            assert got[i].n_words == len((t or "").split()) and got[i].n_removed == got[i].n_words - len(want[i].split())


def test_repeat_edges(spark):
    got = substring_dedup.substring_dedup(frame(spark), carry=("doc_id", "key", "text", "_text")).collect()
    assert ids(got) == ids(EDGES)
    by = {r.doc_id: r for r in got}
    assert by[6].n_removed == 60 and by[1].kept_text == "" and by[8].n_removed == 0
    assert substring_dedup.substring_dedup(frame(spark).limit(0)).count() == 0


# 8


def naive_hits(text, items):
    words = decontamination.words_of(text)
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = decontamination.words_of(t)
        k = min(decontamination.WORDS, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit[j : j + k] = [True] * k
                    found.add(item)
    return len(words), sum(hit), sorted(map(str, found))


def test_hits_equal_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["ab", "a", "ba", "abab", "b"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 3, 9, 10, 11, 14])))) for i in range(12)] + [(50, None), (51, "..."), (None, "ab a"), (10, "zz ZZ, zz")]
    texts = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(60)] + [(t or "")[:400] for _, t, *_ in EDGES] + [None, "ZZ-zz zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("runs", F.lit(1))
    for tables in (decontamination.TABLES, 12_000):
        for r in decontamination.decontaminate(docs, bench, tables=tables).collect():
            n, hit, found = naive_hits(texts[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.item_ids) == (n, hit, [x for x in found if x != "None"]), texts[r.doc_id]
    assert len(decontamination.blocks_of(bench, tables=12_000)) > 1


def test_items_without_an_id_are_searched(spark, tmp_path):
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "clean"), (3, "named item here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, passage), (4, "named item")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.op8_decontamination(spark, str(tmp_path)).collect()}
    assert got == {1: (12, 0, True), 2: (0, 0, False), 3: (2, 1, True)}
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [2]


def test_search_finds_all_occurrences():
    rnd = random.Random(9)
    patterns = sorted({bytes(rnd.choices(b"ab", k=rnd.randint(1, 12))) for _ in range(40)})
    search = decontamination.WuManber(patterns)
    for _ in range(100):
        text = bytes(rnd.choices(b"abc", k=rnd.randint(0, 60)))
        want = {(i, j) for j, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i)}
        found = list(search.find(text))
        assert set(found) == want and len(found) == len(want)


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "the same row")], "item_id long, text string")
    got = decontamination.decontaminate(frame(spark), bench, carry=("doc_id", "key", "_text")).collect()
    assert ids(got) == ids(EDGES)
    by = {r.doc_id: r for r in got}
    assert (by[6].n_words, by[6].n_hit, by[6].item_ids) == (60, 60, ["1"]) and by[1].n_words == 0
    assert {r.n_hit for r in decontamination.decontaminate(frame(spark), bench.limit(0)).collect()} == {0}
    assert decontamination.decontaminate(frame(spark).limit(0), bench).count() == 0


# 9


def naive_components(rows):
    sets = []
    for _, t in rows:
        raw = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(raw[i : i + 5]) for i in range(max(1, len(raw) - 4))} if raw else set())
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return [(doc, len(sets[i]), min((d for d in least[root(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def near_copies(seed, groups=6):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 40))
    common = [word() for _ in range(20)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([1, 4, 5, 6, 40, 90]))]
        for _ in range(rnd.randint(1, 12)):
            own = list(base)
            for _ in range(rnd.randint(0, 3)):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join((common if rnd.random() < 0.3 else []) + own))
    return texts


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        texts = [*near_copies(seed, 14), None, "", "  ", "One Two", "one two", "one two three"]
        rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(naive_components(rows))


@pytest.mark.parametrize("block", [256, 3])
def test_all_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = near_copies(7, 12)
    rows = [*enumerate([*texts, *texts[:9], None, ""])]
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = [sum(j != i and bool(x & y) and 100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), links=True).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == list(enumerate(n)) and max(n) > 4
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(naive_components(rows))


def test_small_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = list(enumerate(near_copies(3, 10)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(naive_components(rows))


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(1, 400)], rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)])) for _ in range(80)]
    n = np.array([len(x) for x in sets], np.float64)
    may = jaccard_join.may_link([jaccard_join.bitmap(x) for x in sets], [jaccard_join.bitmap(x) for x in sets], n, n, 80, 100)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            both = len(np.intersect1d(x, y))
            assert may[i, j] or 100 * both < 80 * (len(x) + len(y) - both)
    assert may.sum() < 0.5 * may.size


def test_join_edges(spark):
    got = jaccard_join.jaccard_components(frame(spark)).collect()
    assert ids(got) == ids(EDGES)
    by = {r.doc_id: r for r in got}
    assert (by[1].n_shingles, by[1].component_id) == (0, 1) and by[6].component_id == 6 and by[None].component_id is None
    assert jaccard_join.jaccard_components(frame(spark).limit(0)).count() == 0


def test_one_of_each_component_stays(spark):
    kept = jaccard_join.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    assert ids(kept.collect()) == ids({(r[0], r[1]): r for r in EDGES}.values())
    rows = list(enumerate(near_copies(5)))
    got = {r.doc_id for r in jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {c for _, _, c in naive_components(rows)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (500, 501)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# The folder and the pipeline


def test_tables_go_to_the_named_folder(spark):
    table = store.materialize(spark.range(3), "probe")
    assert table.count() == 3 and table._seqloom_path.startswith(store.shared_dir(spark))
    store.discard(table)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = store.materialize(stage(spark, seen[-1], SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and isinstance(out.schema["text"].dataType, T.StringType)
        seen.append(out)
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in seen[:-1]]
    assert set(texts[1]) <= set(before) and len(texts[1]) >= 0.98 * len(before)
    assert set(texts[2]) == {c for _, _, c in naive_components(sorted(texts[1].items()))}
    order = sorted(texts[2])
    want = dict(zip(order, naive_repeats([texts[2][i] for i in order], 35), strict=True))
    assert {i: " ".join(texts[3][i].split()) for i in order} == {i: " ".join(want[i].split()) for i in order}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    search = decontamination.Benchmark(items)
    assert set(texts[4]) == {i for i, t in texts[3].items() if not search.judge(t)[1]}
    last = {r.doc_id: r for r in seen[5].collect()}
    assert set(last) == set(texts[4]) and all(r.matches for r in last.values())
    assert all(r.decoded_sha256 == hashlib.sha256(texts[4][i].encode()).hexdigest() for i, r in last.items())


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SF).count() > 100
