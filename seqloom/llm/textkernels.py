"""Vectorised kernels over UTF-8 buffers, shared by the text operators.

Arrow hands a batch of texts over as one byte buffer with offsets. These kernels find words and hash words, word windows and
byte n-grams for a whole slice of that buffer with numpy, so no Python object is made per word. All hashes are 64-bit
polynomial hashes (odd multiplier, arithmetic modulo 2**64) followed by a finalising mix.

Memory: `slices` cuts a batch into runs of whole documents of about SLICE_BYTES, and `word_hashes` works on chunks of that size
inside a longer document, so the scratch space does not grow with the length of a text (only the hashes themselves do, with
eight bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_WORD_MULT = np.uint64(0xD1342543DE82EF95)
_WORD_MULT2 = np.uint64(0xAF251AF3B0F025B5)


def _inverse(odd: np.uint64) -> np.uint64:
    return np.uint64(pow(int(odd), -1, 1 << 64))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(mult: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mult**0..n-1 and their inverses; the tables are kept up to a slice's size, longer ones are made for the call."""
    have = _POWERS.get(int(mult))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16) if n <= SLICE_BYTES else n
        with np.errstate(over="ignore"):
            up = np.full(size, mult, np.uint64)
            down = np.full(size, _inverse(mult), np.uint64)
            up[0] = down[0] = 1
            np.multiply.accumulate(up, out=up)
            np.multiply.accumulate(down, out=down)
        have = (up, down)
        if size <= SLICE_BYTES:
            _POWERS[int(mult)] = have
    return have[0][:n], have[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (shift, multiply, shift, multiply, shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans that holds for the bytes in the given closed ranges."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes of a word where words are runs of anything but ASCII white space.
NOT_SPACE = ~byte_class([(0x20, 0x20), (0x09, 0x0D)])


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of documents of at most `most` bytes together; a longer document comes alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (positions in `data`) of the words of documents that lie between `offsets`."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    inside = table[data[lo:hi]]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > lo) & (inner < hi)] - lo
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first) + lo, np.flatnonzero(last) + 1 + lo


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; the spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _powers(_MULT, hi - lo + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            s, e = starts[a:b] - lo, ends[a:b] - lo
            out[a:b] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        a = b
    return out


def document_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of the documents between `offsets`, and the n + 1 offsets of documents into these."""
    starts, ends = word_spans(data, offsets, table)
    return span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, offsets, "left")


def window_hashes(words: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """The hash of each k words that follow each other; `second` takes an independent multiplier."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mult = _WORD_MULT2 if second else _WORD_MULT
    out = np.empty(n, np.uint64)
    step = max(SLICE_BYTES // 8, 2 * k)
    with np.errstate(over="ignore"):
        for a in range(0, n, step):
            b = min(a + step, n)
            up, down = _powers(mult, b - a + k)
            sums = np.zeros(b - a + k, np.uint64)
            np.cumsum(words[a : b + k - 1] * up[: b - a + k - 1], out=sums[1:])
            out[a:b] = mix64((sums[k : k + b - a] - sums[: b - a]) * down[: b - a] + np.uint64(k))
    return out


def inside_documents(bounds: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows of k words lie in one document, given the documents' offsets into the words."""
    ok = np.ones(max(n, 0), bool)
    for j in range(1, k):
        cut = bounds[1:-1] - j
        cut = cut[(cut >= 0) & (cut < n)]
        ok[cut] = False
    return ok


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values that follow each other."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    best, have = values, 1
    while have * 2 <= width:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    rest = width - have
    return np.minimum(best[:n], best[rest : rest + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.int64).view(np.uint64)
