"""Word shingles of whole texts as 64-bit hashes, vectorised over a batch.

Words are maximal runs without the ASCII white space 0x20 and 0x09 to 0x0D, with A to Z
folded to lower case. Hashes are fixed: the same on every worker and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLD = _FOLD.astype(np.uint8)
#: Odd multipliers of the words of a shingle.
_POSITION = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
#: The low bytes of a lane that a word still fills, by how many they are.
_FILLED = np.array([*((1 << 8 * k) - 1 for k in range(8)), (1 << 64) - 1], np.uint64)
#: Bytes of text hashed at once.
_AT_ONCE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lanes_of(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that begin ``at`` as lanes of eight bytes, the last filled up with zeros;
    each lane's place in its word; each word's first lane. ``data`` has eight bytes to spare."""
    count = (length + 7) >> 3
    first = np.cumsum(count) - count
    place = np.arange(int(count.sum())) - np.repeat(first, count)
    every = np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), 0, (1,))
    left = np.repeat(length, count) - 8 * place
    return every[np.repeat(at, count) + 8 * place] & _FILLED[np.minimum(left, 8)], place, first


def words_at(data: np.ndarray, starts: np.ndarray, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of the documents that start at ``starts``; the index of each
    document's first word, with the number of words at the end; where words begin.
    ``breaks`` tells the bytes between words. Each lane of eight bytes is mixed with its
    place before the lanes are summed, so that no order or swap of letters cancels out."""
    n = len(data)
    space = breaks[data]
    begins = ~space
    begins[1:] &= space[:-1]
    inner = starts[starts < n]
    begins[inner] = ~space[inner]
    at = np.flatnonzero(begins)
    first = np.append(np.searchsorted(at, starts), len(at))
    if not len(at):
        return np.zeros(0, np.uint64), first, at
    ends = ~space
    ends[:-1] &= space[1:]
    before = inner[inner > 0] - 1
    ends[before] = ~space[before]
    length = np.flatnonzero(ends) + 1 - at
    lanes, place, lane = lanes_of(np.concatenate([_FOLD[data], np.zeros(8, np.uint8)]), at, length)
    mixed = mix(mix(lanes) + (place + 1).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return mix(np.add.reduceat(mixed, lane) + length.astype(np.uint64)), first, at


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words_at(data, starts)[:2]


def sets_of(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes; a text with fewer words has its
    whole sequence as the one shingle; null and wordless texts have none."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    n = len(texts)
    if not n:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + _AT_ONCE, "right")) - 1)
        part = data[bounds[k] : bounds[end]]
        hashes, first = _words(part, bounds[k:end] - bounds[k])
        rolled = np.zeros(0, np.uint64)
        if len(hashes) >= words:
            rolled = hashes[: len(hashes) - words + 1] * _POSITION[0]
            for j in range(1, words):
                rolled = rolled + hashes[j : len(hashes) - words + 1 + j] * _POSITION[j]
            rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                found = np.sort(rolled[a : b - words + 1])
                yield found[np.append(True, found[1:] != found[:-1])]
            elif b > a:
                whole = (hashes[a:b] * _POSITION[: b - a]).sum(dtype=np.uint64) + _U(b - a)
                yield mix(np.array([whole]))
            else:
                yield np.zeros(0, np.uint64)
        k = end
