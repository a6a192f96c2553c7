"""Hashed character n-grams of words, for whole texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = np.uint32(0x01000193)
_SPACE = 32
CHUNK_WORDS = 50_000        # words taken at once, so that a long text needs no more memory


def chunks(words: list[str]) -> Iterator[list[str]]:
    for at in range(0, len(words), CHUNK_WORDS):
        yield words[at : at + CHUNK_WORDS]


def codes_of(words: list[str]) -> np.ndarray:
    """Code points of the words with one space before, between and behind them."""
    return np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x85EBCA6B)
    return h ^ (h >> np.uint32(13))


def gram_hashes(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` characters of a word with the spaces at its ends, and the words' numbers."""
    n = len(codes) - size + 1
    if n < 1:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    spaces = np.cumsum(codes == _SPACE)
    if size == 1:
        whole = codes != _SPACE
    else:
        whole = spaces[size - 2 : size - 2 + n] == spaces[:n]
    h = np.full(n, size, np.uint32)
    for k in range(size):
        h = h * _STEP + codes[k : k + n].astype(np.uint32)
    return _mixed(h[whole]), spaces[:n][whole] - 1


def word_hashes(codes: np.ndarray) -> np.ndarray:
    """One hash for each word."""
    space = codes == _SPACE
    begins = np.flatnonzero(space)[:-1]
    if not len(begins):
        return np.empty(0, np.uint32)
    number = np.cumsum(space) - 1
    number[-1] = len(begins) - 1
    place = np.arange(len(codes)) - begins[number]
    powers = np.cumprod(np.full(int(place.max()) + 1, _STEP, np.uint32), dtype=np.uint32)
    values = np.where(space, np.uint32(0), codes.astype(np.uint32) * powers[place])
    return _mixed(np.add.reduceat(values, begins, dtype=np.uint32))
