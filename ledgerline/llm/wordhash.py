"""Vectorised word splitting and hashing over Arrow string buffers.

A batch's texts are one UTF-8 byte array. A 256-entry table tells word bytes from others, a second one folds A-Z to a-z;
words, their hashes and shingles come from numpy passes over that array, with no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
#: Bytes of text that are worked on at once; a single longer document is taken alone.
CHUNK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(excluded: bytes) -> np.ndarray:
    """True for the bytes of words: all but the excluded ones."""
    table = np.ones(256, dtype=bool)
    table[list(excluded)] = False
    return table


#: Words are runs of [^\x20\x09-\x0D]
SPACE_SPLIT = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
ALNUM_SPLIT = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; x is uint64, arithmetic wraps."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * GOLD)
_powers = np.ones(1, dtype=U)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.empty(max(n, 64), dtype=U)
        out[0] = 1
        out[1:] = GOLD
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and the last ends; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACE_SPLIT) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the documents data[off[i]:off[i+1]], and where each document's words begin (and the last end)."""
    low = LOWER[data]
    inside = table[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < len(low)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    doc_words = np.searchsorted(starts, off)
    out = np.empty(len(starts), dtype=U)
    if not len(starts):
        return out, doc_words
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    length = np.diff(np.append(first, len(at)))
    i = 0
    while i < len(starts):  # some words at a time, for bounded memory
        j = max(i + 1, int(np.searchsorted(first, first[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, len(starts))
        a, b = first[i], first[j] if j < len(starts) else len(at)
        pos = np.arange(b - a) - np.repeat(first[i:j] - a, length[i:j])
        out[i:j] = np.add.reduceat(BYTE_VALUES[low[at[a:b]]] * powers(int(length[i:j].max()))[pos], first[i:j] - a)
        i = j
    return mix(out + length.astype(U) * GOLD), doc_words


def ngrams(h: np.ndarray, m: int) -> np.ndarray:
    """Hash of each run of m hashes; shorter than h by m - 1."""
    if len(h) < m:
        return np.empty(0, dtype=U)
    acc = np.zeros(len(h) - m + 1, dtype=U)
    for j in range(m):
        acc = acc * U(0xD6E8FEB86659FD93) + mix(h[j : len(h) - m + 1 + j] + U(j))
    return mix(acc + U(m))


def shingle_set(h: np.ndarray, m: int) -> np.ndarray:
    """Sorted distinct hashes of the m-word shingles of one document; of fewer words, the whole sequence as one."""
    if not len(h):
        return np.empty(0, dtype=U)
    return np.unique(ngrams(h, min(m, len(h))))


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first byte and length of each word, and where each document's words begin (and the last end)."""
    low = LOWER[data]
    inside = table[low]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = off[:-1][off[:-1] < len(low)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    stops = ~inside
    stops[edges] = True
    stops = np.append(np.flatnonzero(stops), len(low))
    length = stops[np.searchsorted(stops, starts, side="right")] - starts
    return low, starts, length, np.searchsorted(starts, off)


def prefix_hashes(low: np.ndarray, starts: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have at least size bytes, and the hash of their first size bytes."""
    at = np.flatnonzero(length >= size)
    acc = np.zeros(len(at), dtype=U)
    p = powers(size)
    for j in range(size):
        acc += BYTE_VALUES[low[starts[at] + j]] * p[j]
    return at, mix(acc + U(size))
