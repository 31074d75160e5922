"""Byte-level BPE pre-tokens of whole batches of texts, found by array operations.

The pattern is that of public_tokenizers.PATTERN: contractions, then runs of letters, numbers or
other characters with one optional space before them, then white space, whose last character is
left to the word that follows. Instead of running it as a regular expression, the start of each
match is derived from the class of each character and of its neighbours.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex

from basalt.llm.common import byte_groups, slices, utf8

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Bytes of text whose characters are classified at a time: each takes some twenty bytes then.
PART_BYTES = 1 << 19


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point: white space, letter, number or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0  # surrogates, which no text holds
    every = points.tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def starts(data: bytes, at: np.ndarray) -> np.ndarray:
    """Byte offsets where a pre-token starts, the end of the data last. at: offsets of the texts."""
    if not data:
        return np.zeros(1, np.int64)
    if data.isascii():
        cps = np.frombuffer(data, np.uint8)
        where = None
        first = at[:-1][at[:-1] < at[1:]]
    else:
        cps = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
        where = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(width, out=where[1:])
        first = np.searchsorted(where, at[:-1][at[:-1] < at[1:]])
    n = len(cps)
    cls = classes()[cps]
    new = np.zeros(n + 1, bool)  # a text starts here
    new[first] = True
    new[n] = True
    start = np.zeros(n + 1, bool)
    np.not_equal(cls[1:], cls[:-1], out=start[1:n])
    start |= new
    space = cls == SPACE
    last = space[:-1] & ~space[1:] & ~new[1:n]  # white space before another character of the text
    start[: n - 1] |= last
    start[1:n] &= ~(last & (cps[:-1] == 0x20))
    ticks = np.flatnonzero((cps == 0x27) & start[:n])
    ticks = ticks[ticks + 1 < n]
    ticks = ticks[(cls[ticks + 1] == LETTER) & ~new[ticks + 1]]
    if len(ticks):
        a = cps[ticks + 1]
        two = np.minimum(ticks + 2, n - 1)
        b = np.where((ticks + 2 < n) & ~new[np.minimum(ticks + 2, n)], cps[two], 0)
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for which, size in ((short, 2), (long, 3)):
            t = ticks[which]
            start[t + 1] = False
            start[t + size] = True
    found = np.flatnonzero(start)
    return found if where is None else where[found]


def pretokens(data: bytes, at: np.ndarray):
    """The distinct pre-tokens (an Arrow array of bytes), the index of each occurrence among them,
    and the number of occurrences before each text (one more than texts)."""
    begin = starts(data, at)
    coded = slices(data, begin).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.searchsorted(begin, at)


def pretokens_of(texts: pa.ChunkedArray):
    """pretokens() of a string column without nulls, PART_BYTES of its texts at a time."""
    parts, counts = [], [np.zeros(1, np.int64)]
    for column in texts.chunks:
        for a, b in byte_groups(column, PART_BYTES):
            data, at = utf8(column.slice(a, b - a))
            begin = starts(data, at)
            parts.append(slices(data, begin).dictionary_encode())
            counts.append(np.searchsorted(begin, at[1:]) + counts[-1][-1])
    coded = pa.chunked_array(parts, pa.dictionary(pa.int32(), pa.binary())).unify_dictionaries()
    words = coded.chunk(0).dictionary if parts else pa.array([], pa.binary())
    index = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks)])
    return words, index, np.concatenate(counts)
