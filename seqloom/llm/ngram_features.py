"""Hashed character n-grams of whole texts, found for a slice of the Arrow buffer at a time."""

from __future__ import annotations

import numpy as np

_SEEDS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0xD3A2646D))


def _table() -> np.ndarray:
    """Bytes as letters see them: A-Z become lower case, other ASCII than letters becomes a blank, the rest stays."""
    out = np.full(256, 0x20, np.uint8)
    out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


LETTERS = _table()


def plain(data: np.ndarray) -> np.ndarray:
    """The bytes with lower-case letters and blanks only (Latin-1 capitals in UTF-8 are lowered too)."""
    out = LETTERS[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def ngram_buckets(text: np.ndarray, offsets: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, documents' offsets into them) of the n-grams of one order that lie within a word or touch its edges.

    `text` holds plain() bytes of the documents between `offsets`, which start at 0. Documents are framed by blanks, and an
    n-gram with a blank inside (not at an end) does not count, nor one of blanks only.
    """
    docs = len(offsets) - 1
    framed = np.full(len(text) + docs + 1, 0x20, np.uint8)
    lengths = np.diff(offsets)
    shift = np.repeat(np.arange(1, docs + 1), lengths)
    framed[np.arange(len(text)) + shift] = text
    m = len(framed) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(docs + 1, np.int64)
    letter = framed != 0x20
    ok = np.ones(m, bool)
    for j in range(1, n - 1):
        ok &= letter[j : j + m]
    ok &= letter[:m] | letter[n - 1 : n - 1 + m]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint32)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ framed[at + j]) * _SEEDS[j % len(_SEEDS)]
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        h += np.uint32(n) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x297A2D39)
    bucket = (h >> np.uint32(32 - bits)).astype(np.int64)
    return bucket, np.searchsorted(at, offsets + np.arange(docs + 1), "left")


def pieces(text: np.ndarray, most: int) -> list[tuple[int, int]]:
    """plain() bytes of one text cut at blanks into parts of about `most` bytes. No n-gram has a blank inside, so the n-grams of
    the parts are those of the text. A part without a blank stays whole."""
    out, a = [], 0
    while len(text) - a > most:
        blank = np.flatnonzero(text[a + 1 : a + most] == 0x20)
        if not len(blank):
            blank = np.flatnonzero(text[a + most :] == 0x20)[:1] + most - 1
        if not len(blank):
            break
        b = a + 1 + int(blank[-1])
        out.append((a, b))
        a = b
    return [*out, (a, len(text))]
