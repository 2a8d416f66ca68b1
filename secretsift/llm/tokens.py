"""Word hashes of many texts at once, for the operators that work in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

# Texts are handled in groups of about this many bytes, so that memory does not
# depend on how many rows a batch has; one longer text is a group of its own.
GROUP_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def places(count: int) -> np.ndarray:
    """A value for each place of a byte in its word."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C55))


@cache
def powers(count: int, base: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``GROUP_BYTES`` of text each."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + GROUP_BYTES, "right")) - 1)
        yield start, min(end, len(texts))
        start = min(end, len(texts))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``texts`` in order, and where each text's words begin.

    Words are runs of anything but ASCII white space; ``lower`` reads A-Z as a-z.
    Nulls have no words.
    """
    texts = texts.cast(pa.string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    data = data[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    at = np.flatnonzero(inside)
    if lower:
        data = _LOWER[data]
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    # Each byte at each place has a value of its own. A polynomial in the place would give
    # words like Thue-Morse sequences and their mirrors one sum, whatever its base.
    values = (_BYTES[data[at]] ^ places(1 << int(place.max() + 1).bit_length())[place]) * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0x94D049BB133111EB)
    sums = np.add.reduceat(values ^ (values >> np.uint64(32)), first)
    return mixed(sums + lengths.astype(np.uint64)), bounds


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` consecutive values, those that cross texts included."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    power = powers(64, 0xD6E8FEB86659FD93)
    out = np.zeros(count, dtype=np.uint64)
    for i in range(length):
        out += hashes[i : i + count] * power[i]
    return mixed(out ^ np.uint64(length))
