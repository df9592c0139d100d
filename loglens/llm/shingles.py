"""Word shingles of many texts at once, hashed to 64 bits with numpy.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.
Only byte operations are used, so the cost a byte is the same for all texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(0x5EED)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    codes = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
    codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


CODES = _byte_codes()
BASE = np.uint64(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(1 << 16)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = _powers(max(n, 2 * len(_POWERS)))
    return _POWERS[:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts in order, and the number of words of each text."""
    texts = texts.cast(pa.large_string()).fill_null("") if texts.null_count else texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]  # a text's first byte starts a word
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    stops = np.flatnonzero(ends) + 1
    # sum of code * BASE**(place in the word): Horner's scheme over all words by place
    place = np.arange(len(data), dtype=np.int64)
    word = np.cumsum(begins) - 1
    place -= starts[np.maximum(word, 0)] if len(starts) else 0
    terms = np.where(inside, CODES[data] * powers(int(place.max()) + 1)[np.maximum(place, 0)], np.uint64(0))
    sums = np.add.reduceat(terms, starts) if len(starts) else np.zeros(0, np.uint64)
    counts = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return mix(sums + (stops - starts).astype(np.uint64) * _ODD), counts.astype(np.int64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words; of all of them where there are fewer."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = mix(out * _ODD + words[i : i + n])
    return out + np.uint64(min(size, len(words)))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, counts = word_hashes(texts)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    # all at once where no shingle may go over a border: those that do are not taken
    whole = shingle_hashes(words, size) if len(words) >= size else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        out.append(np.unique(whole[a : b - size + 1] if b - a >= size else shingle_hashes(words[a:b], size)))
    return out
