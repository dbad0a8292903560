"""Words, shingles and hashes of Arrow text, computed on the raw bytes with numpy.

Texts stay in their Arrow buffers; no Python string is made for a word.  Hashes
are 64-bit and the same in every process.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes that are hashed at once, unless one word is longer
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte: is it a separator; a random number; the same with A-Z as a-z."""
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    rand = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    low = rand.copy()
    low[65:91] = rand[97:123]
    return gap, rand, low


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    back = pow(_BASE, -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, b, np.uint64)])) for b in (_BASE, back))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each text begins (one entry more than texts); null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each text the number of words before it."""
    gap = tables()[0][data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    before = np.ones(n, bool)
    after = np.ones(n, bool)
    if n:
        before[1:] = gap[:-1]
        after[:-1] = gap[1:]
    begin = np.flatnonzero(~gap & (before | edge[:-1]))
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, at)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of each word's bytes."""
    rand = tables()[2 if lower else 1]
    up, down = powers()
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        first = begin[i]
        j = max(i + 1, int(np.searchsorted(end, first + BLOCK, "right")))
        part = data[first : end[j - 1]]
        if len(part) <= BLOCK:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(rand[part] * up[: len(part)], dtype=np.uint64)])
            b, e = begin[i:j] - first, end[i:j] - first
            out[i:j] = (total[e] - total[b]) * down[b] + (e - b).astype(np.uint64)
        else:  # one giant word: chain the hashes of its blocks
            h = 0
            for k in range(0, len(part), BLOCK):
                piece = part[k : k + BLOCK]
                h = (h * 0x100000001B3 + int(np.sum(rand[piece] * up[: len(piece)], dtype=np.uint64))) & _MASK
            out[i] = np.uint64((h + len(part)) & _MASK)
        i = j
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of so many words in each text, and where each text's begin.

    A text with fewer words has one shingle, its whole sequence; without words, none.
    """
    counts = np.diff(first)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    which = np.repeat(np.arange(len(counts)), n)
    at = first[:-1][which] + (np.arange(begin[-1]) - begin[:-1][which])
    stop = np.minimum(at + width, first[1:][which])
    total = np.zeros(len(at), np.uint64)
    factor = 1
    for k in range(width):
        pos = at + k
        inside = pos < stop
        total += np.where(inside, hashes[np.minimum(pos, max(0, len(hashes) - 1))] * np.uint64(factor), np.uint64(0)) if len(hashes) else np.uint64(0)
        factor = factor * 0xD1342543DE82EF95 & _MASK
    return mix(total + (stop - at).astype(np.uint64)), begin


def sequence_hashes(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's whole word sequence (0 and 0 for none)."""
    counts = np.diff(first)
    which = np.repeat(np.arange(len(counts)), counts)
    place = (np.arange(len(hashes)) - first[:-1][which] + 1).astype(np.uint64)
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        terms = mix(hashes + place * np.uint64(seed))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        out.append(mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64)))
    return out[0], out[1]
