"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary (hash and displace: every key has a slot of its own, and there are as
many slots as keys): a whole pre-token that is itself a vocabulary entry is resolved by one probe and one comparison. Tier two,
for the rest, merges bytes: the bytes of the pre-token form a linked list, candidate merges wait in a heap by rank and then
position, and a merge that one of its ends has lost meanwhile is skipped when it comes up.

Vocabulary and pattern are parameters; nothing is trained here. The vocabulary is read by the driver, bounded by
MAX_VOCABULARY, and broadcast. The operator is one pass without a shuffle; a task keeps a bounded memo of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.textkernels import mix64, slices, span_hashes, text_buffer

MAX_VOCABULARY = 1_000_000
#: Pre-tokens whose ids a worker keeps, and their characters at the most, so that what it keeps is bounded in bytes; when they are
#: more, those not met since the last time are let go. Only speed depends on it.
MEMO, MEMO_LENGTH = 300_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks from a file of base64 tokens and ranks, one pair a line."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens: too many to broadcast")
    return ranks


class PerfectHash:
    """A minimal perfect hash of distinct byte strings, built by hash and displace.

    Keys are dealt to buckets of about four. From the fullest buckets down, a displacement is sought for each that sends all its
    keys to free slots; a bucket of one key gets a free slot directly, held as a negative number.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        self.buckets = max(1, (n + 3) // 4)
        self.displace = np.zeros(self.buckets, np.int64)
        self.slot_key = np.zeros(n, np.int64)  # index of the key in each slot
        h = self._hash(keys)
        if len(np.unique(h)) != n:
            raise ValueError("keys are repeated")
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(counts) - counts
        free = np.ones(n, bool)
        for c in range(int(counts.max()), 1, -1):
            pending = np.flatnonzero(counts == c)
            keys_of = order[first[pending][:, None] + np.arange(c)]
            d = 0
            while len(pending):
                at = self._slot(h[keys_of], np.uint64(d))
                good = free[at].all(axis=1)
                s = np.sort(at, axis=1)
                good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                claim = np.full(n, -1, np.int64)  # of several buckets that want a slot in this round one gets it
                rows = np.flatnonzero(good)
                claim[at[rows]] = rows[:, None]
                rows = rows[(claim[at[rows]] == rows[:, None]).all(axis=1)]
                free[at[rows]] = False
                self.displace[pending[rows]] = d
                self.slot_key[at[rows]] = keys_of[rows]
                left = np.ones(len(pending), bool)
                left[rows] = False
                pending, keys_of, d = pending[left], keys_of[left], d + 1
        singles, slots = np.flatnonzero(counts == 1), np.flatnonzero(free)
        self.displace[singles] = -slots - 1
        self.slot_key[slots] = order[first[singles]]

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        ends = np.cumsum(lengths)
        return span_hashes(np.frombuffer(b"".join(keys), np.uint8), ends - lengths, ends)

    def _slot(self, h: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(h + displacement * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For each string the index of the only key that it can be."""
        h = self._hash(keys)
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(d < 0, -d - 1, self._slot(h, np.maximum(d, 0).astype(np.uint64)))
        return self.slot_key[slot]


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: lowest rank first, leftmost among equals."""
    n, get = len(piece), ranks.get
    after = list(range(1, n + 2))  # start of the next part; also the end of this one
    before = list(range(-1, n))
    rank_at = [-1] * n  # of the part that starts here merged with the next one
    heap = []
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            rank_at[i] = rank
            heap.append(rank * n + i)
    heapq.heapify(heap)
    while heap:
        rank, left = divmod(heapq.heappop(heap), n)
        if rank_at[left] != rank:
            continue
        right = after[left]
        end = after[left] = after[right]
        rank_at[left] = rank_at[right] = -1
        if end < n:
            before[end] = left
            rank = get(piece[left : after[end]])
            if rank is not None:
                rank_at[left] = rank
                heapq.heappush(heap, rank * n + left)
        prev = before[left]
        if prev >= 0:
            rank = get(piece[prev:end])
            rank_at[prev] = -1
            if rank is not None:
                rank_at[prev] = rank
                heapq.heappush(heap, rank * n + prev)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


# Fixed value: the pattern that `split_by_class` implements.
CLASS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


def character_classes() -> bytes:
    """The class of each code point, as the regex library has it."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    return out.tobytes()


def class_bounds(code: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the pieces that findall(CLASS_PATTERN, text) gives begin, and the length; `code` holds the text's code points.

    A run of letters, numbers or others takes one blank before it; of other white space before a run the last character is
    a piece of its own (unless it is that blank) and the rest another; an apostrophe that begins a piece goes with a
    following s, t, m, d, re, ve or ll.
    """
    if not len(code):
        return np.zeros(1, np.int64)
    kind = classes[code]
    n = len(code)
    starts = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    space = kind[starts] == _SPACE
    length = np.diff(np.append(starts, n))
    last = starts + length - 1
    inner = space & (last < n - 1)  # white space with something behind it
    blank = inner & (code[last] == 32)
    # A run of one blank gives up its start, a longer one has a cut before its last character; after a blank there is none.
    cut = np.zeros(n, bool)
    cut[starts] = True
    cut[last[inner & (length > 1)]] = True
    cut[last[blank] + 1] = False
    if (code == 39).any():
        quote = np.flatnonzero((code == 39) & cut)
        quote = quote[quote + 1 < n]
        one, two = code[quote + 1], code[np.minimum(quote + 2, n - 1)]
        two = np.where(quote + 2 < n, two, 0)
        short = np.isin(one, (115, 116, 109, 100))  # s t m d
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # re ve ll
        for at, size in ((quote[short], 2), (quote[long & ~short], 3)):
            cut[at + 1] = False
            behind = at + size
            behind = behind[behind < n]
            joined = kind[behind] == _LETTER
            cut[behind[joined]] = True
    return np.append(np.flatnonzero(cut), n)


class Codec:
    """Encoder and decoder for one vocabulary. Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"bytes without a token: {missing[:5]}")
        self.ranks, self.pattern = ranks, pattern
        self.keys = list(ranks)
        self.ids = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.hash = PerfectHash(self.keys)
        self.classes = character_classes() if pattern == CLASS_PATTERN else None
        self._rest()

    def _rest(self) -> None:
        self.find = regex.compile(self.pattern).finditer
        self.table = None if self.classes is None else np.frombuffer(self.classes, np.uint8)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        size = int(self.ids.max()) + 1
        token = [b""] * size
        for k, i in zip(self.keys, self.ids.tolist(), strict=True):
            token[i] = k
        self.length = np.fromiter(map(len, token), np.int64, size)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(token), np.uint8)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("ranks", "pattern", "keys", "ids", "hash", "classes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._rest()

    def resolve(self, pieces: list[str]) -> list[bytes]:
        """The ids of pre-tokens: of whole ones by the perfect hash, of the others by merging. The memo keeps them."""
        get, old = self.memo.get, self.older.get
        out = [get(p) for p in pieces]
        new = [k for k, x in enumerate(out) if x is None]
        if len(self.memo) + len(new) > MEMO:
            self.memo, self.older = {}, self.memo
            old = self.older.get
        missing = []
        for k in new:
            out[k] = old(pieces[k])
            if out[k] is None:
                missing.append(k)
        if missing:
            raw = [pieces[k].encode("utf-8", "surrogatepass") for k in missing]
            for k, data, c in zip(missing, raw, self.hash.candidates(raw).tolist(), strict=True):
                ids = [int(self.ids[c])] if self.keys[c] == data else merge_bytes(data, self.ranks)
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
        self.memo.update((pieces[k], out[k]) for k in new if len(pieces[k]) <= MEMO_LENGTH)
        return out

    def bounds(self, text: str, code: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens in a text, and its length. What the pattern leaves out would be no pre-token."""
        if self.table is not None:
            return class_bounds(code, self.table)
        spans = [m.span() for m in self.find(text)]
        if [0, *(b for _, b in spans)] != [*(a for a, _ in spans), len(text)]:
            raise ValueError("the pattern leaves out a part of the text")
        return np.array([0, *(b for _, b in spans)], np.int64)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Pre-tokens that occur several times in the batch are resolved once."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        starts, ends, counts, base = [], [], [], 0
        for t, code in zip(texts, codes, strict=True):
            at = self.bounds(t, code) + base
            starts.append(at[:-1])
            ends.append(at[1:])
            counts.append(len(at) - 1)
            base += len(code)
        start, end = np.concatenate(starts), np.concatenate(ends)
        if not len(start):
            return [np.zeros(0, np.uint32) for _ in texts]
        _, first, which = np.unique(span_hashes(np.concatenate(codes), start, end), return_index=True, return_inverse=True)
        line = "".join(texts)
        known = self.resolve([line[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        flat = np.frombuffer(b"".join(known), "<u4")
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        offset = np.cumsum(length) - length
        own = length[which]
        behind = np.cumsum(own)
        ids = flat[np.repeat(offset[which] - (behind - own), own) + np.arange(behind[-1])]
        cut = np.append(0, behind)[np.cumsum([0, *counts])]
        out = [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        # Equal hashes of different pre-tokens would show in the decoded bytes; such a text is encoded piece by piece.
        for k, t in enumerate(texts):
            if self.decode(out[k]) != t.encode("utf-8", "surrogatepass"):
                at = self.bounds(t, codes[k]).tolist()
                out[k] = np.frombuffer(b"".join(self.resolve([t[a:b] for a, b in zip(at, at[1:], strict=False)])), "<u4")
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text."""
        return self.encode_batch([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        if not len(ids):
            return b""
        length = self.length[ids]
        behind = np.cumsum(length)
        return self.bytes[np.repeat(self.offset[ids] - (behind - length), length) + np.arange(behind[-1])].tobytes()


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids again, and return digests of both.

    Returns one row for each row (repeated rows stay repeated): doc_id, n_tokens, ids_sha256 (over little-endian unsigned
    32-bit ids), decoded_sha256 (over the decoded bytes), n_bytes, `matches` (the decoded bytes equal the text's), and with
    `with_ids` the ids themselves as array<int>. A null text counts as empty: no tokens, the digests of nothing. An empty
    table gives none. A text of any length is encoded as a whole and takes memory in proportion to it; a single pre-token of n bytes is
    merged in n log n steps. Of equally ranked merges the leftmost goes first. Other columns are ignored, whatever their names.
    """
    codec = docs.sparkSession.sparkContext.broadcast(Codec(ranks, pattern))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "matches", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec_ = codec.value
        for batch in batches:
            cols: list[list] = [[] for _ in names[1:]]
            _, off = text_buffer(batch.column(1))
            for a, b in slices(off):
                texts = [x or "" for x in batch.column(1).slice(a, b - a).to_pylist()]
                for text, ids in zip(texts, codec_.encode_batch(texts), strict=True):
                    back, raw = codec_.decode(ids), text.encode("utf-8", "surrogatepass")
                    row = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest(), len(raw), raw == back]
                    for col, x in zip(cols, row + [ids.astype("<i4")] * with_ids, strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names)

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return kept.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, matches boolean" + ", ids array<int>" * with_ids)


def public_vocabulary() -> tuple[dict[bytes, int], str]:
    """The installed public vocabulary for many languages, and its pattern."""
    import public_tokenizers

    return read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`, encoded and decoded."""
    ranks, pattern = public_vocabulary()
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, pattern)


QUERIES = {"op4_bpe_codec": op4_bpe_codec}
