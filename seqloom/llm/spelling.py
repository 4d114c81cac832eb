"""Spelling variants of words: neighbours at one edit, found through Bloom filters.

The vocabulary lies in blocked Bloom filters, one for each word length. Each word's edits are generated as arrays of hashes (a
polynomial over code points: an edit changes a hash by a term or two, so no string is made) and probed against the filter of the
length they have; only those that it lets through become strings, and an exact join with the vocabulary removes what it let
through wrongly. Being near is symmetric, so a word generates only its deletions and its replacements by letters that come later:
each pair of near words is generated once, by one of the two.

The filters are broadcast. They take BITS a word, and a round broadcasts ROUND_BYTES of them at most, so a vocabulary of any size is
searched, in as many rounds as it takes. They are built in pieces of PIECE blocks on the executors, in even groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.store import discard, materialize
from seqloom.llm.textkernels import mix64, signed, unsigned

LETTERS, LEAST_LENGTH, LEAST_COUNT, RATIO = "A-Za-zÀ-ÿ", 6, 5, 5
#: Every so many words of documents are damaged in the query.
DAMAGE = 199
#: Bits a word; lanes of 32 bits in a block; blocks in a piece; bytes of filters in a round.
BITS, LANES, PIECE, ROUND_BYTES = 16, 8, 256, 64 << 20
#: Words of a task that generates edits.
WORDS_A_TASK = 8192
_CHUNK = 2048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MULT = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_MULT, -1, 1 << 64))


# Words


def damaged(word: Column, doc_id: Column, every: int = DAMAGE) -> Column:
    """The word; where `every` divides the CRC-32 h of `<doc_id>:<word>`, without its code point h % length."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(every)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None) -> DataFrame:
    """(word, n) of the words of at least LEAST_LENGTH code points and LEAST_COUNT occurrences over all texts.

    Words are maximal runs of LETTERS with A-Z lowered; shorter runs can't become such words and are not taken out of the
    text. With `damage`, one word in so many loses a letter (see `damaged`; a null id counts as empty). Null texts have no words;
    a long text gives a row for each word; repeated rows count again. Counts are combined before they are shuffled.
    """
    runs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("_run"))
    word = F.translate("_run", _UPPER, _LOWER)
    word = word if damage is None else damaged(word, F.col("_id"), damage)
    return runs.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


# Hashes and edits


def code_points(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def strings(points: np.ndarray) -> list[str]:
    width, text = points.shape[1], np.ascontiguousarray(points, np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + width] for i in range(0, len(text), width)] if width else [""] * len(points)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULT, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def terms(points: np.ndarray) -> np.ndarray:
    """What each letter adds to its word's hash."""
    return mix64(points.astype(np.uint64) + np.uint64(1)) * _powers(points.shape[1])


def word_hashes(points: np.ndarray) -> np.ndarray:
    return mix64(terms(points).sum(axis=1, dtype=np.uint64))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, rows of code points) of the words of each length."""
    lengths = np.array(list(map(len, words)), np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for a in range(0, len(at), _CHUNK):
            part = at[a : a + _CHUNK]
            yield part, code_points([words[i] for i in part])


Probe = Callable[[int, np.ndarray], np.ndarray]


def probed_edits(points: np.ndarray, alphabet: np.ndarray, probe: Probe) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code points of the edit) of the edits that the probe (length, hashes) lets through: each deletion once (of equal
    neighbours the last one goes), each replacement by a later letter of the sorted alphabet."""
    m, length = points.shape
    each = terms(points)
    before = np.zeros((m, length + 1), np.uint64)
    np.cumsum(each, axis=1, out=before[:, 1:])
    whole, powers = before[:, -1], _powers(length)
    letters = mix64(alphabet.astype(np.uint64) + np.uint64(1))
    for i in range(length):
        last = np.flatnonzero(points[:, i] != points[:, i + 1]) if i + 1 < length else np.arange(m)
        found = last[probe(length - 1, mix64(before[last, i] + (whole[last] - before[last, i + 1]) * _BACK))]
        if len(found):
            yield found, np.delete(points[found], i, axis=1)
        row, letter = np.nonzero(alphabet[None, :] > points[:, i : i + 1])
        ok = probe(length, mix64((whole - each[:, i])[row] + letters[letter] * powers[i]))
        row, letter = row[ok], letter[ok]
        if len(row):
            changed = points[row].copy()
            changed[:, i] = alphabet[letter]
            yield row, changed


# Filters


def blocks_of(n: int) -> int:
    """Blocks of the filter of n words."""
    return -(-n * BITS // (32 * LANES))


def block_at(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def _lane_bits(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a lane that stands for the hash; `hashes` have been mixed again."""
    return np.uint32(1) << ((hashes >> np.uint64(5 * lane)) & np.uint64(31)).astype(np.uint32)


def built(blocks: np.ndarray, hashes: np.ndarray, size: int) -> np.ndarray:
    """Blocks in which the hashes are set, one bit a lane."""
    out, more = np.zeros((size, LANES), np.uint32), mix64(hashes ^ np.uint64(_MULT))
    for lane in range(LANES):
        np.bitwise_or.at(out[:, lane], blocks, _lane_bits(more, lane))
    return out


class Filters:
    """The blocks of a round: for each length the number of blocks of its filter, the first one here, and those here."""

    def __init__(self, parts: dict[int, tuple[int, int, np.ndarray]]):
        self.parts = parts

    def probe(self, length: int, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be of words; those whose block belongs to another round are not."""
        if length not in self.parts or not len(hashes):
            return np.zeros(0, np.int64)
        blocks, first, own = self.parts[length]
        block = block_at(hashes, blocks).astype(np.int64) - first
        at = np.flatnonzero((block >= 0) & (block < len(own)))
        block, more = block[at], mix64(hashes[at] ^ np.uint64(_MULT))
        for lane in range(LANES):
            ok = np.flatnonzero(own[block, lane] & _lane_bits(more, lane))
            at, block, more = at[ok], block[ok], more[ok]
        return at


def _hashed(sizes: dict[int, int]) -> Callable:
    """For mapInArrow: (word) becomes the piece of its filter, its block there, and its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, points in by_length(batch.column(0).to_pylist()):
                length, hashes = points.shape[1], word_hashes(points)
                block = block_at(hashes, sizes[length]).astype(np.int64)
                columns = [np.full(len(at), length, np.int32), (block // PIECE).astype(np.int32), (block % PIECE).astype(np.int32), signed(hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "piece", "block", "hash"])

    return run


def _piece(group: pa.Table) -> pa.Table:
    """The blocks of one piece, as bytes."""
    hashes, block = (np.asarray(group.column(c).combine_chunks()) for c in ("hash", "block"))
    bits = built(block.astype(np.int64), unsigned(hashes), PIECE).tobytes()
    return pa.table([group.column("length").slice(0, 1), group.column("piece").slice(0, 1), pa.array([bits], pa.binary())], ["length", "piece", "bits"])


def filter_rounds(sizes: dict[int, int], most: int = ROUND_BYTES) -> list[list[tuple[int, int, int]]]:
    """The pieces (length, first, behind the last) of each round; sizes: blocks of each length."""
    room, rounds, full = max(1, most // (PIECE * LANES * 4)), [[]], 0
    for length, blocks in sorted(sizes.items()):
        a, n = 0, -(-blocks // PIECE)
        while a < n:
            if full == room:
                rounds.append([])
                full = 0
            b = min(n, a + room - full)
            rounds[-1].append((length, a, b))
            full, a = full + b - a, b
    return rounds


def _gathered(pieces: DataFrame, sizes: dict[int, int], own: list[tuple[int, int, int]]) -> Filters:
    """The filters of a round, on the driver: no more bytes than the round's bound."""
    parts = {length: (sizes[length], a * PIECE, np.zeros(((b - a) * PIECE, LANES), np.uint32)) for length, a, b in own}
    wanted = F.lit(False)
    for length, a, b in own:
        wanted |= (F.col("length") == length) & F.col("piece").between(a, b - 1)
    for r in pieces.where(wanted).toLocalIterator():
        _, first, blocks = parts[r.length]
        blocks[r.piece * PIECE - first : (r.piece + 1) * PIECE - first] = np.frombuffer(r.bits, np.uint32).reshape(PIECE, LANES)
    return Filters(parts)


# Near words


def _candidates(shipped, alphabet: np.ndarray) -> Callable:
    """For mapInArrow: (word, n) and the edits of it that the filters let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shipped.value
        for batch in batches:
            for at, points in by_length(batch.column(0).to_pylist()):
                for row, edits in probed_edits(points, alphabet, filters.probe):
                    own = [c.take(pa.array(at[row])) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(strings(edits), pa.string())], ["word", "n", "near"])

    return run


def near_words(words: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, near, near_n) for all pairs of different words (word, n: unique words) that one inserted, deleted or replaced code
    point turns into each other, each pair from both sides.

    The alphabet is that of the words; work grows with words times alphabet. No words, no rows.
    """
    spark = words.sparkSession
    counts = {r.length: r.n for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    sizes = {length: blocks_of(n) for length, n in counts.items() if length}
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where(F.col("letter") != "").distinct().collect()
    alphabet = np.array(sorted(ord(r.letter) for r in letters), np.uint32)
    hashed = words.select("word").where(F.col("word") != "").mapInArrow(_hashed(sizes), "length int, piece int, block int, hash long")
    pieces = materialize(hashed.groupBy("length", "piece").applyInArrow(_piece, "length int, piece int, bits binary"), "spell-pieces")
    tasks = -(-sum(counts.values()) // WORDS_A_TASK)
    spread = words.select("word", "n").repartition(max(1, tasks))
    found = None
    for own in filter_rounds(sizes, round_bytes):
        shipped = spark.sparkContext.broadcast(_gathered(pieces, sizes, own))
        part = materialize(spread.mapInArrow(_candidates(shipped, alphabet), "word string, n long, near string"), "spell-candidates")
        shipped.destroy()
        found = part if found is None else found.unionByName(part)
    discard(pieces)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = found.join(known, "near").select("word", "n", "near", "near_n")
    flip = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return pairs.select(flip.alias("_p")).select("_p.*")


def roots(links: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form; each word once, no cycles) end. Each round follows the links of links, so the
    rounds are the logarithm of the longest chain."""
    at = materialize(links.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        on = at.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = materialize(at.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spell-roots")
        moved = not after.where("moved").isEmpty()
        discard(at)
        at = after
        if not moved:
            return at.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = RATIO, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Group the spellings of a vocabulary (word: string, n: long; null words are left out, of repeated ones the counts are added).

    Returns one row for each word: word, form (its near word of largest n, of equal ones the first in code-point order, if that n is
    at least `ratio` times the word's; else null), root (where forms lead; the word itself without one), n, n_near (number of near
    words), form_n. Words are near if one inserted, deleted or replaced code point makes them equal. An empty vocabulary gives
    an empty table; very long words have as many edits as letters times alphabet and are treated like others; an empty word is near to
    none. Other columns are ignored. A ratio above 1 is needed, so that forms can't go round in a circle.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = materialize(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spell-words")
    none = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    every = near_words(words, round_bytes).unionByName(none)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))))
    out = every.groupBy("word").agg(F.max("n").alias("n"), F.count("near").alias("n_near"), best.alias("best"))
    led = -F.col("best.less") >= ratio * F.col("n")
    out = out.select("word", "n", "n_near", F.when(led, F.col("best.form")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"))
    out = materialize(out, "spell-forms")
    ends = roots(out.where(F.col("form").isNotNull()))
    out = out.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of whole `documents`, of which one in 199 loses a letter."""
    return spelling_variants(vocabulary(spark.read.parquet(f"{sf_dir}/documents.parquet"), damage=DAMAGE))


_SQL_CRC_STEP = "xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)"
ORACLE_SQL = {
    "op13_spelling_variants": rf"""
        WITH RECURSIVE table_step AS (
            SELECT i AS place, 0 AS k, i AS c FROM range(256) AS r(i)
            UNION ALL SELECT place, k + 1, {_SQL_CRC_STEP} FROM table_step WHERE k < 8),
        crc AS MATERIALIZED (SELECT list(c ORDER BY place) AS t FROM table_step WHERE k = 8),
        run AS (
            SELECT id, w, count(*) AS n
            FROM (SELECT doc_id AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[{LETTERS}]+')) AS w FROM documents)
            GROUP BY ALL),
        byte AS (
            SELECT w, n, flatten([CASE WHEN x < 128 THEN [x] ELSE [192 + (x >> 6), 128 + (x & 63)] END
                                  FOR x IN [CAST(unicode(y) AS BIGINT) FOR y IN string_split(coalesce(CAST(id AS VARCHAR), '') || ':' || w, '')]]) AS b
            FROM run),
        hashed AS (
            SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1]))) AS h FROM byte, crc),
        word AS (
            SELECT w AS word, sum(n)::BIGINT AS n
            FROM (SELECT CASE WHEN h % {DAMAGE} = 0 THEN w[1 : CAST(h % length(w) AS INTEGER)] || w[CAST(h % length(w) AS INTEGER) + 2 :] ELSE w END AS w, n FROM hashed)
            WHERE length(w) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
        cut AS (SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
        pair AS (
            SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word FROM cut c JOIN word w ON w.word = c.s
            UNION SELECT w.word, c.word FROM cut c JOIN word w ON w.word = c.s),
        best AS (
            SELECT p.word, p.near, b.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
                   row_number() OVER (PARTITION BY p.word ORDER BY b.n DESC, p.near) AS k
            FROM pair p JOIN word b ON b.word = p.near),
        formed AS (
            SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near END AS form,
                   CASE WHEN b.near_n >= {RATIO} * w.n THEN b.near_n END AS form_n
            FROM word w LEFT JOIN best b ON b.word = w.word AND b.k = 1),
        walk AS (
            SELECT word, word AS node FROM formed
            UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.node WHERE f.form IS NOT NULL),
        ended AS (SELECT k.word, k.node AS root FROM walk k JOIN formed f ON f.word = k.node WHERE f.form IS NULL)
        SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ended e USING (word)
    """
}
QUERIES = {"op13_spelling_variants": op13_spelling_variants}
