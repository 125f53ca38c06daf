"""Words of many texts at once: places, hashes and shapes in numpy."""

from __future__ import annotations

import numpy as np

from .common import LOWER_BYTES

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_fold = np.frombuffer(LOWER_BYTES, np.uint8)
#: Character classes for word shapes: lower, upper, digit, byte of a longer character, and each sign itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[128:] = 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _grown(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE & _MASK, np.uint64)])
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE, np.uint64)])


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word of the texts in ``data``."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    first[edges] |= solid[edges]
    last[edges - 1] |= solid[edges - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(bounds, start, "right") - 1


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[start:end] for each span, from running sums."""
    _grown(len(codes) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[codes] * _powers[: len(codes)])]
    return mixed((sums[end] - sums[start]) * _inverses[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    return span_hashes(_fold[data] if fold else data, start, end)


def shape_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of word shapes: runs of one character class count once, so length does not matter."""
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    place = np.r_[0, np.cumsum(keep)]
    return span_hashes(kind[keep], place[start], place[end])


def pairs_within(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring values of one text, and their text numbers."""
    if len(values) < 2:
        return values[:0], text[:0]
    same = text[1:] == text[:-1]
    both = mixed(values[:-1][same] * np.uint64(0xC2B2AE3D27D4EB4F) + values[1:][same])
    return both, text[1:][same]
