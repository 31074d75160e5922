"""Words and word shingles of whole batches of texts, as hashes.

A word is a longest run of bytes outside 0x20 and 0x09-0x0D; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from basalt.llm.common import slices

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WHITE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(*shape: int, seed: int) -> np.ndarray:
    """Fixed odd multipliers."""
    n = int(np.prod(shape))
    return (mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * STEP) | np.uint64(1)).reshape(shape)


def words(data: bytes, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, its first byte, and the number of words before each text (one more than texts)."""
    if not data:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    data = data.translate(LOWER) if lower else data
    white = WHITE[np.frombuffer(data, np.uint8)]
    edge = np.empty(len(data) + 1, bool)
    np.not_equal(white[1:], white[:-1], out=edge[1:-1])
    edge[at] = True
    bounds = np.flatnonzero(edge)
    coded = slices(data, bounds).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    is_word = ~white[bounds[:-1]]
    begin = bounds[:-1][is_word]
    return hashes[coded.indices.to_numpy(zero_copy_only=False)[is_word]], begin, np.searchsorted(begin, at)


def runs(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of `width` successive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i, k in enumerate(odd(width, seed=seed)):
        out += hashes[i : i + n] * k
    return mix(out)


def shingle_sets(data: bytes, at: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; with fewer words, one
    hash of all of them; without words, none."""
    hashes, _, bounds = words(data, at)
    every = runs(hashes, width)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        else:
            yield runs(hashes[a:b], b - a, seed=100 + b - a) if b > a else np.zeros(0, np.uint64)
