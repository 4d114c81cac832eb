"""Exact dedup, whitening and spelling variants against brute force; and their defined results at the edges."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F
from test_operators import DOCS, EDGES, clashing, frame

from seqloom.llm import exact_dedup, spelling, whitening

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11


def naive_groups(rows):
    """(id, keep_id, group_size, sha) of each row, and how many rows of each text are kept."""
    norm = [(r[0], (r[1] or "").translate(LOWER)) for r in rows]
    sizes, last = Counter(t for _, t in norm), {}
    for i, t in norm:
        last[t] = i if t not in last or last[t] is None or (i is not None and i > last[t]) else last[t]
    return Counter((i, last[t], sizes[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


@pytest.mark.parametrize("bits", [128, 20, 2, 0])
def test_groups_equal_brute_force(spark, bits):
    """With few bits every digest stands for many contents, and contents decide."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["Alpha", "beta", "Gamma,", "delta.", "eine", "grüne", "x"]) for _ in range(6000))
    rows = [*EDGES, (20, long, "en", "a", 1), (21, long.upper(), "en", "a", 1), (22, long + " ", "en", "a", 1), (23, "x" + long, "en", "a", 1), (24, long.swapcase(), "en", "a", 1)]
    rows += [(100 + i, long[: 3000 + i % 3], "en", "a", 1) for i in range(30)]
    rows += [(300 + i, "字" * (20_000 + i % 2), "zh", "a", 1) for i in range(4)]
    got = exact_dedup.exact_dedup(frame(spark, rows), digest_bits=bits).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == naive_groups(rows)
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in got}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_chunks_are_the_text_and_cuts_are_local(spark):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000))
    rows = [(1, text), (2, "one more word " + text), (3, ""), (4, "字" * 9000), (5, "a\n" * 600), (6, text[:10_000] + " a few words put in " + text[10_000:])]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string").select("i", exact_dedup.chunks_of(F.col("t")).alias("c")).collect()}
    assert all("".join(got[i]) == t for i, t in rows) and got[3] == []
    assert max(len(c) for c in got[1]) < exact_dedup.MOST and max(len(c) for c in got[4]) == exact_dedup.MOST
    assert len(set(got[1]) - set(got[2])) < 12 and len(set(got[1]) - set(got[6])) < 12 and len(got[1]) > 25


def test_dedup_runs_without_python(spark):
    out = exact_dedup.exact_dedup(frame(spark))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().toString())


def test_dedup_edges(spark):
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    out = exact_dedup.exact_dedup(frame(spark), carry=("source", "n", "text"), results=("a", "b", "c", "d"))
    assert out.columns == ["source", "n", "text", "a", "b", "c", "d"] and out.count() == len(EDGES)
    assert exact_dedup.exact_dedup(frame(spark), carry=("doc_id", "lang", "n")).columns == ["doc_id", "lang", "n", *exact_dedup.RESULTS]
    one = exact_dedup.exact_dedup(spark.createDataFrame([(5, "a"), (5, "A"), (5, "a")], "doc_id long, text string")).collect()
    assert [r.group_size for r in one] == [3, 3, 3] and sum(r.kept for r in one) == 1
    nulls = exact_dedup.exact_dedup(spark.createDataFrame([(None, "a"), (1, "A"), (None, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in nulls) == [(0, 2, False), (0, 2, True), (1, 2, False), (1, 2, True)]


# 12


def naive_whitening(vectors, most=16):
    """From Python's whole numbers; the covariance by centred products."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), object)
    n, s = len(fit), fit.sum(axis=0)
    y = n * fit - s
    v = np.array([[int((y[:, i] * y[:, j]).sum()) / n**3 for j in range(y.shape[1])] for i in range(y.shape[1])])
    values, w = np.linalg.eigh(v)
    values, w = values[::-1][:most], w[:, ::-1][:, :most]
    white = np.array((n * x - s) / n, float) @ w / np.sqrt(values)
    return n, ((n * x - s) ** 2).sum(axis=1), white, values / np.trace(v)


def by_row(rows):
    out = defaultdict(dict)
    for r in rows:
        out[r.vec_id][r.component] = r
    return out


def test_whitening_equals_brute_force(spark):
    got = by_row(whitening.op12_embedding_whitening(spark, SF).collect())
    table = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    n, deviation, white, explained = naive_whitening([v for _, v in table])
    assert sorted(got) == [i for i, _ in table] and all(sorted(r) == list(range(1, 17)) for r in got.values())
    found = np.array([[got[i][k].whitened for k in range(1, 17)] for i, _ in table])
    signs = np.sign((found * white).sum(axis=0))
    assert np.abs(found - white * signs).max() < 1e-6
    assert [got[i][1].deviation for i, _ in table] == deviation.tolist() and {r.n for rows in got.values() for r in rows.values()} == {n}
    assert np.allclose([got[table[0][0]][k].explained for k in range(1, 17)], explained, rtol=1e-9)
    errors = {r.identity_error for rows in got.values() for r in rows.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9


VECTORS = "vec_id long, embedding array<float>, label int"


def test_unusable_and_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=3).round(3).tolist(), 1) for i in range(40)]
    bad = [(100, None, 1), (101, [1.0, None, 2.0], 1), (102, [1.0, float("nan"), 2.0], 1), (103, [float("inf"), 1.0, 2.0], 1), (104, [1.0, 2.0], 1), (105, [], 1), (106, [1e30, 0.0, 0.0], 1)]
    again = [(200 + i, good[0][1], 1) for i in range(30)] + [good[1], good[1], (None, good[2][1], 1)]
    rows = good + bad + again
    random.Random(1).shuffle(rows)
    out = whitening.whiten(clashing(spark.createDataFrame(rows, VECTORS)).repartition(3), carry=("vec_id", "score"))
    got = out.collect()
    usable = [r for r in rows if r in good or r in again]
    assert out.columns == ["vec_id", "score", *whitening.RESULTS]
    assert Counter(r.vec_id for r in got) == Counter({i: 3 * k for i, k in Counter(r[0] for r in usable).items()})
    n, deviation, white, explained = naive_whitening([r[1] for r in usable])
    mine = by_row(got)
    assert n == 40 and mine[0][1].n == 40
    for (i, *_), d, w in zip(usable, deviation, white, strict=True):
        assert mine[i][2].deviation == d and np.allclose([abs(mine[i][k].whitened) for k in (1, 2, 3)], np.abs(w))
    assert np.isclose(sum(mine[0][k].explained for k in (1, 2, 3)), 1)


def test_large_entries_stay_exact(spark):
    """Numbers beyond 63 bits inside: the sums go on with Python's."""
    rows = [(1, [1e15, 3.5, -2.0]), (2, [-1e15, 2.5, 8.0]), (3, [5e14, 1e9, 1.0]), (4, [5e14, 1e9, 4e6]), (5, [0.0, 0.0, 0.0])]
    got = by_row(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    n, deviation, _, explained = naive_whitening([v for _, v in rows])
    assert [int(got[i][1].deviation) for i, _ in rows] == deviation.tolist() and np.isclose(got[1][1].explained, explained[0])
    assert got[1][1].identity_error < 1e-4


def test_without_variance_or_rows(spark):
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(i, [1.0, 2.0], 1) for i in range(5)], [(1, [], 1), (2, [], 1)]):
        out = whitening.whiten(spark.createDataFrame(rows, VECTORS))
        assert out.columns == ["vec_id", *whitening.RESULTS] and out.count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], 1) for i in range(9)], VECTORS)).collect()
    assert {r.component for r in flat} == {1} and np.isclose(flat[0].explained, 1)
    assert {r.component for r in whitening.whiten(spark.createDataFrame([(i, [float(i), float(i * i)], 1) for i in range(9)], VECTORS), most=1).collect()} == {1}


def test_polarisation_is_exact():
    rng = np.random.default_rng(9)
    x = rng.integers(-(10**9), 10**9, (50, 5)) + 10**12
    n, s = len(x), [int(t) for t in x.sum(axis=0)]
    center = [(2 * t + n) // (2 * n) for t in s]
    squares = whitening._squares(np.array(center, np.int64))(x).tolist()
    v = whitening.covariance(squares, [t - n * c for t, c in zip(s, center, strict=True)], n)
    y = n * x.astype(object) - np.array(s, object)
    assert v.tolist() == [[int((y[:, i] * y[:, j]).sum()) / n**3 for j in range(5)] for i in range(5)]


# 13


def naive_words(rows, damage=199):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += len(w) >= 6
    return {w: n for w, n in out.items() if n >= 5}


def near(a, b):
    """An empty word is near to none."""
    if not a or not b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive_variants(words, ratio=5):
    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(close[w]), words[form[w]] if form[w] is not None else None))
    return out


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len({r.word for r in rows})
    return set(map(tuple, rows))


def invented(seed=4, size=120):
    rng = random.Random(seed)
    out = {}
    for _ in range(size):
        w = "".join(rng.choices("abcdeéÿ", k=rng.randint(1, 8)))
        out[w] = rng.choice([1, 5, 5, 7, 30, 200, 5000])
        for _ in range(4):
            i = rng.randrange(len(w))
            out.setdefault(rng.choice([w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "a" + w[i + 1 :]]), rng.choice([1, 1, 2, 40]))
    return out


@pytest.mark.parametrize("round_bytes", [64 << 20, 1])
def test_variants_equal_brute_force(spark, round_bytes, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS_A_TASK", 100)
    words = invented()
    words[""] = 3
    table = clashing(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert found(spelling.spelling_variants(table, round_bytes=round_bytes)) == naive_variants(words)


def test_chains_of_forms_are_followed(spark):
    words = {"abcdefgh"[:k] + "z" * (k < 8): 6**k for k in range(1, 9)}
    words |= {"mm" + "a" * k: 7**k for k in range(1, 11)}
    got = found(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == naive_variants(words) and {r[2] for r in got if r[0] == "mma"} == {"mm" + "a" * 10}


def test_ties_take_the_first_in_code_point_order(spark):
    words = {"kitten": 5, "kittens": 50, "kitteny": 50, "mitten": 50, "kittën": 50, "\U0001f600kitten": 50}
    got = {r[0]: r for r in found(spelling.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n long")))}
    assert got["kitten"][1:] == ("kittens", "kittens", 5, 5, 50) and set(map(tuple, got.values())) == naive_variants(words)


def test_query_words_equal_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    for damage in (199, 3, None):
        got = {r.word: r.n for r in spelling.vocabulary(spark.read.parquet(f"{SF}/documents.parquet"), damage=damage).collect()}
        assert got == naive_words(rows, damage)
    words = naive_words(rows)
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    assert found(spelling.op13_spelling_variants(spark, SF)) == naive_variants(words)


def test_word_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!!"), (None, "ABCDEFG×abc÷ZÀÿxyz " * 5), (4, "x" * 300_000), (4, "Straße, İstanbul naïve " * 6), (4, "Straße, İstanbul naïve " * 6)]
    got = {r.word: r.n for r in spelling.vocabulary(clashing(spark.createDataFrame(rows, "doc_id long, text string")), damage=2).collect()}
    assert got == naive_words(rows, 2)
    empty = spark.createDataFrame([], DOCS)
    assert spelling.spelling_variants(spelling.vocabulary(empty, damage=199)).count() == 0
    same = spark.createDataFrame([("abcdef", 3), ("abcdef", 4), (None, 9), ("abcdeg", 35)], "word string, n long")
    assert found(spelling.spelling_variants(same)) == {("abcdef", "abcdeg", "abcdeg", 7, 1, 35), ("abcdeg", None, "abcdeg", 35, 1, None)}
    long = spark.createDataFrame([("ab" * 2000, 9), ("ab" * 2000 + "c", 90), ("bb" + "ab" * 1999, 9)], "word string, n long")
    assert {(len(r[0]), r[4]) for r in found(spelling.spelling_variants(long))} == {(4000, 2), (4001, 1), (4000, 1)}
    with pytest.raises(ValueError):
        spelling.spelling_variants(same, ratio=1)


def test_filters_lose_nothing_and_let_little_through():
    rng = np.random.default_rng(2)
    own, other = (rng.integers(0, 1 << 64, 50_000, dtype=np.uint64) for _ in range(2))
    blocks = spelling.blocks_of(len(own))
    bits = spelling.built(spelling.block_at(own, blocks).astype(np.int64), own, blocks)
    filters = spelling.Filters({7: (blocks, 0, bits)})
    assert len(filters.probe(7, own)) == len(own) and len(filters.probe(7, other)) < 0.005 * len(other) and len(filters.probe(8, own)) == 0


def test_edits_are_generated_once():
    alphabet = np.frombuffer("abcd".encode("utf-32-le"), np.uint32)
    words = ["".join(w) for w in itertools.product("abcd", repeat=3)]
    seen = Counter()
    for row, edits in spelling.probed_edits(spelling.code_points(words), alphabet, lambda _, hashes: np.arange(len(hashes))):
        seen.update((words[r], e) for r, e in zip(row.tolist(), spelling.strings(edits), strict=True))
    expected = {(w, v) for w in words for v in (*words, *{w[:i] + w[i + 1 :] for w in words for i in range(3)}) if near(w, v) and (len(v) < len(w) or v > w)}
    assert set(seen) == expected and set(seen.values()) == {1}


def test_rounds_cover_all_pieces():
    sizes = {6: 1000, 7: 10, 8: 257}
    for most in (1, 3 * spelling.PIECE * 32, 1 << 30):
        pieces = [(length, p) for own in spelling.filter_rounds(sizes, most) for length, a, b in own for p in range(a, b)]
        assert sorted(pieces) == [(length, p) for length, n in sizes.items() for p in range(-(-n // spelling.PIECE))]
