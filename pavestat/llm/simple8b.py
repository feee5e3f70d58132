"""Simple-8b: a selector in the top four bits of each 64-bit word says how many ids of
how many bits the other sixty hold.

Ids are cut into blocks of ``BLOCK``; each block starts a new word and its word offset
is stored, so blocks decode side by side in numpy. Values of 61 to 64 bits are escaped:
a word with selector 0, then the raw value. Blocks with escapes are decoded one by one.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: Fixed values of the coding: (ids per word, bits per id) for the selectors 2 to 15.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 0
_COUNT = np.array([1, 0, *(c for c, _ in PACKINGS)])
_BY_COUNT = {c: s for s, (c, _) in enumerate(PACKINGS, 2)}
_ROW = BLOCK + 60  # a block and room for the last word's padding
_U = np.uint64


_SMALL = np.frexp(np.arange(1 << 18, dtype=np.float64))[1].astype(np.int8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; 0 for 0."""
    if len(values) and values.max() < len(_SMALL):
        return _SMALL[values.astype(np.int64)]
    low = values & _U(0xFFFFFFFF)
    high = values >> _U(32)
    top = np.where(high > 0, high, low).astype(np.float64)
    return (np.frexp(top)[1] + np.where(high > 0, 32, 0)).astype(np.int8)


def _choose(width: np.ndarray) -> np.ndarray:
    """The selector that packs most values from each place on. The widest of the next
    c values is kept for all places at once as c grows."""
    best = np.where(width > 60, np.int8(ESCAPE), np.int8(15))
    widest, n = width.copy(), len(width)
    for count in range(2, 61):
        part = widest[: n - count + 1]
        np.maximum(part, width[count - 1 :], out=part)
        if count in _BY_COUNT:
            s = _BY_COUNT[count]
            np.copyto(best[: len(part)], np.int8(s), where=part <= PACKINGS[s - 2][1])
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and whether a block has escapes."""
    values = np.asarray(values, dtype=np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, bool)
    grid = np.zeros((blocks, _ROW), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(values)] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    size = np.full(blocks, BLOCK)
    size[-1] = len(values) - (blocks - 1) * BLOCK
    best = _choose(_widths(grid.ravel()))
    place, words, live = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), np.arange(blocks)
    steps = []
    while len(live):
        selector = best[live * _ROW + place[live]].astype(np.int64)
        steps.append((live, place[live], words[live], selector))
        place[live] += _COUNT[selector]
        words[live] += 1 + (selector == ESCAPE)
        live = live[place[live] < size[live]]
    block, start, order, selector = (np.concatenate(x) for x in zip(*steps, strict=True))
    offset = np.concatenate([[0], np.cumsum(words)[:-1]])
    out = np.zeros(int(words.sum()), np.uint64)
    target, source, cells = offset[block] + order, block * _ROW + start, grid.ravel()
    for s in np.unique(selector):
        pick = selector == s
        if s == ESCAPE:
            out[target[pick]] = _U(ESCAPE)
            out[target[pick] + 1] = cells[source[pick]]
            continue
        count, bits = PACKINGS[s - 2]
        word = np.full(int(pick.sum()), int(s) << 60, np.uint64)
        for j in range(count):
            word |= cells[source[pick] + j] << _U(bits * j)
        out[target[pick]] = word
    escaped = np.zeros(blocks, bool)
    escaped[block[selector == ESCAPE]] = True
    return out, offset.astype(np.uint32), escaped


def _unpack(words: np.ndarray, selector: np.ndarray, target: np.ndarray, cells: np.ndarray) -> None:
    for s in np.unique(selector):
        if s < 2:
            raise ValueError("a word with a selector that holds no packed ids")
        count, bits = PACKINGS[s - 2]
        pick = selector == s
        word, to, mask = words[pick], target[pick], _U((1 << bits) - 1)
        for j in range(count):
            cells[to + j] = word >> _U(bits * j) & mask


def decode(words: np.ndarray, offset: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values back, as unsigned 64-bit integers."""
    blocks = len(offset)
    if blocks != -(-n // BLOCK):
        raise ValueError("the number of blocks and of values disagree")
    if not blocks:
        return np.zeros(0, np.uint64)
    bounds = np.append(offset.astype(np.int64), len(words))
    cells = np.zeros(blocks * _ROW, np.uint64)
    block = np.repeat(np.arange(blocks), np.diff(bounds))
    plain = ~escaped[block]
    selector = np.where(plain, (words >> _U(60)).astype(np.int64), 2)
    count = np.where(plain, _COUNT[selector], 0)
    before = np.cumsum(count) - count
    within = before - before[np.minimum(bounds[:-1], len(words) - 1)][block]
    _unpack(words[plain], selector[plain], (block * _ROW + within)[plain], cells)
    for b in np.flatnonzero(escaped):
        k, to, end = bounds[b], b * _ROW, b * _ROW + min(BLOCK, n - b * BLOCK)
        while to < end:
            s = int(words[k] >> _U(60))
            if s == ESCAPE:
                cells[to] = words[k + 1]
                k, to = k + 2, to + 1
            else:
                _unpack(words[k : k + 1], np.array([s]), np.array([to]), cells)
                k, to = k + 1, to + PACKINGS[s - 2][0]
        cells[end : (b + 1) * _ROW] = 0
    return cells.reshape(blocks, _ROW)[:, :BLOCK].ravel()[:n]
