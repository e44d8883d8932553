"""Word hashes of a text, computed for all its words at once."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_SEGMENT = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (a one-to-one map)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(33)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(n + 1, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base & _MASK, np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def _segment_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(len(data) + 2, bool)
    np.take(_WORD, data, out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = _power_tables(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.take(_LETTER, data, out=sums[1:])
    sums[1:] *= up[: len(data)]
    np.cumsum(sums[1:], out=sums[1:])
    value = (sums[ends] - sums[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts


def words_and_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the first byte of each word of UTF-8 bytes, white space being ASCII's.

    Texts go through in segments that fit a processor's cache, cut at white space.
    """
    parts, places, start = [], [], 0
    while start < len(data):
        end = min(start + _SEGMENT, len(data))
        while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        hashes, starts = _segment_hashes(np.frombuffer(data, np.uint8, end - start, start))
        parts.append(hashes)
        places.append(starts + start)
        start = end
    return (np.concatenate(parts), np.concatenate(places)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def word_hashes(data: bytes) -> np.ndarray:
    """The hashes of `words_and_starts`."""
    return words_and_starts(data)[0]


_STEPS = [np.uint64(((2 * i + 1) * 0xC2B2AE3D27D4EB4F + (i << 40)) & _MASK | 1) for i in range(64)]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of `width` words; empty where there are fewer words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total += mix(words[i : i + n] * _STEPS[i] + np.uint64(i))
    return mix(total)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, letters A to Z in lower case.

    A text with fewer words than `width` is one shingle, one without words has none.
    """
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words
