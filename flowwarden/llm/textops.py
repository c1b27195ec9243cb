"""Hashes of words and word shingles of many texts at once, on byte arrays.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as a-z.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_SPAN = 64
#: A random number for each byte at each place of a word; a word's hash is their sum, mixed.
_PLACES = _RANDOM.integers(0, 1 << 63, size=_SPAN * 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ORDER = _RANDOM.integers(0, 1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(
    texts: list[bytes | None], lower: bool = True, between: np.ndarray = _IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words; for each text the place of its first word (one place more than texts); the words' first
    bytes in the texts joined by line feeds; and these joined texts. `between` tells the bytes that are in no word, among
    them the line feed."""
    data = np.frombuffer(b"\n".join([t or b"" for t in texts] + [b""]), np.uint8)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    space = between[data]
    inner = ~space
    first = inner.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds, starts, data
    at = np.flatnonzero(inner)
    head = np.flatnonzero(first[at])  # where words begin among the bytes of words
    length = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, length)
    byte = data[at]
    if lower:
        byte = _LOWER[byte]
    value = _PLACES[(place & (_SPAN - 1)) * 256 + byte]
    if length.max() > _SPAN:
        value = value * ((place // _SPAN).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    return mix64(np.add.reduceat(value, head) + length.astype(np.uint64)), bounds, starts, data


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the place of its first word (one place more than texts)."""
    return words_of(texts, lower)[:2]


def shingle_sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles, one text after the other, and the texts' bounds.

    Fewer than k words make one shingle, the whole sequence; no words, none.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(out_bounds[-1], np.uint64)
    long = np.flatnonzero(counts >= k)
    if len(long):
        whole = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            whole += words[j : len(words) - k + 1 + j] * ORDER[j]
        whole = mix64(whole)
    for i in np.flatnonzero(n):
        a, b = out_bounds[i], out_bounds[i + 1]
        if counts[i] >= k:
            out[a:b] = whole[bounds[i] : bounds[i] + n[i]]
            out[a:b].sort()
        else:
            part = words[bounds[i] : bounds[i + 1]]
            out[a] = mix64(np.array([(part * ORDER[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))]))[0]
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[out_bounds[:-1][n > 0]] = True
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], kept_before[out_bounds]


def per_text(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """ufunc over each text's values; `empty` for texts without any."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[full])
    return out
