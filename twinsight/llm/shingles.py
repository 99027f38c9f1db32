"""Hashes of words and word windows, and of sets of them, inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from twinsight.llm.text import worker_state

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word; frequent words are looked up."""
    table = worker_state("word_hashes", _WordTable)
    return np.fromiter(map(table.__getitem__, words), "uint64", len(words))


class _WordTable(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000 and len(word) <= 64:  # bounds memory; other words are hashed each time
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every window of ``length`` words; none if there are fewer words.

    A window of even length is hashed as the pair of its halves.
    """
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, "uint64")
    if length == 1:
        return hashes
    if length % 2 == 0:
        half = window_hashes(hashes, length // 2)
        return mixed(half[:n] * _STEP + half[length // 2 : length // 2 + n])
    total = np.full(n, np.uint64(length))
    for k in range(length):
        total = total * _STEP + hashes[k : k + n]
    return mixed(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[: len(values) - span], values[span:]), 2 * span
    more = width - span
    return np.minimum(values[: len(values) - more], values[more:]) if more else values


def shingle_set(words: list[bytes], length: int = 5) -> np.ndarray:
    """Sorted distinct window hashes; the whole sequence as one if it is shorter, none without words."""
    if not words:
        return np.empty(0, "uint64")
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(length, len(words))))
