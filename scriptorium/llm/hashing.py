"""Word hashes of whole blocks of text in numpy, without an object a word."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=2)
def _powers_of(size: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.full(size, _BASE, np.uint64)
    back = np.full(size, pow(int(_BASE), -1, 1 << 64), np.uint64)
    base[0] = back[0] = 1
    return np.multiply.accumulate(base), np.multiply.accumulate(back)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64."""
    power, inverse = _powers_of(1 << max(10, (size - 1).bit_length()))
    return power[:size], inverse[:size]


def span_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span of 64-bit values, all from one prefix sum; equal spans are equal."""
    power, inverse = powers(len(values) + 1)
    prefix = np.concatenate(([np.uint64(0)], np.cumsum(values * power[:-1])))
    return (prefix[stops] - prefix[starts]) * inverse[starts]


def sum_hashes(values: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each span of values from a scramble of each value with its place in the span.

    Spans ascend, are disjoint and not empty. No polynomial: regular spans (of two words in
    turn, say) have no common hash for whatever base.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
    place = inside.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    scrambled = mix(values[np.repeat(starts, sizes) + inside] + place)
    return mix(np.add.reduceat(scrambled * np.uint64(0x94D049BB133111EB), begins) + sizes.astype(np.uint64))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, stops) of the runs without ASCII white space in bytes."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
