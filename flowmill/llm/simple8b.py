"""Simple-8b coding of whole arrays, many blocks at a time.

A 64-bit word holds a selector in its top 4 bits and as many values of one width as fit into the
other 60. Selector 0 is an escape: its payload is the place of a value of more than 60 bits in a
list of raw values. Values are cut into blocks of `BLOCK`; a block begins with a word of its own,
and the word where each block begins is kept, so blocks are coded and decoded side by side. The
last word of a block may have room left over.
"""

from __future__ import annotations

import numpy as np

from flowmill.llm.shared import ragged

BLOCK = 512
# The packings, by selector from 1.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
LAST = len(COUNTS) - 1


def _classes(values: np.ndarray) -> np.ndarray:
    """For each value how many of the packings from selector 1 on are too narrow for it."""
    wide = np.zeros(len(values), np.uint8)
    for width in WIDTHS[1:]:
        wide += values >> values.dtype.type(width) != 0
    return wide


#: Classes of all 16-bit values, which most ids are.
_SMALL = _classes(np.arange(1 << 16, dtype=np.uint64))


def _grid(values: np.ndarray, blocks: int) -> np.ndarray:
    """The values with a row for each block and zeros behind it, as many as a word may pack."""
    grid = np.zeros((blocks, BLOCK + 60), values.dtype)
    full = len(values) // BLOCK
    grid[:full, :BLOCK] = values[: full * BLOCK].reshape(full, BLOCK)
    grid[full:, : len(values) - full * BLOCK] = values[full * BLOCK :]
    return grid


def _selectors(values: np.ndarray, blocks: int) -> np.ndarray:
    """The densest selector for a word that begins at each place of the grid, flat."""
    small = not (values >> np.uint64(16)).any()
    most = _grid(_SMALL[values.astype(np.uint16)] if small else _classes(values), blocks).ravel()
    fitting, held = np.zeros(len(most), np.uint8), 1
    for s in range(LAST, 0, -1):
        step = int(COUNTS[s]) - held
        if step:  # the widest class among as many values as the selector packs, from that among fewer
            np.maximum(most[:-step], most[step:], out=most[:-step])
            held += step
        fitting += most < s
    # a packing that fits has all wider ones fit, so their number tells the densest; none is the escape
    return np.where(fitting > 0, LAST + 1 - fitting, 0)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the number of words before each block (and in all), and the raw values."""
    values = np.ascontiguousarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), values
    best, grid, stride = _selectors(values, blocks), _grid(values, blocks).ravel(), BLOCK + 60
    at = np.arange(blocks) * stride
    end = at + BLOCK
    end[-1] = at[-1] + len(values) - BLOCK * (blocks - 1)
    begins = np.zeros(len(best), bool)
    while len(at):
        begins[at] = True
        at = at + COUNTS[best[at]]
        going = at < end
        at, end = at[going], end[going]
    at = np.flatnonzero(begins)
    chosen = best[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    escaped = chosen == 0
    raw = grid[at[escaped]]
    words[escaped] = np.arange(len(raw), dtype=np.uint64)
    for s in np.unique(chosen[~escaped]).tolist():
        here = np.flatnonzero(chosen == s)
        first, packed = at[here], words[here]
        for j in range(COUNTS[s]):
            packed |= grid[first + j] << np.uint64(WIDTHS[s] * j)
        words[here] = packed
    return words, np.concatenate([[0], np.cumsum(np.bincount(at // stride, minlength=blocks))]), raw


def decode(words: np.ndarray, offsets: np.ndarray, raw: np.ndarray, n: int) -> np.ndarray:
    """The n values that `encode` was given."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    s = (words >> np.uint64(60)).astype(np.int64)
    held = np.cumsum(COUNTS[s]) - COUNTS[s]
    per = np.diff(offsets)
    block = np.repeat(np.arange(len(per)), per)
    start = held - held[offsets[:-1]][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    payload = words & np.uint64((1 << 60) - 1)
    for k in np.unique(s):
        here = np.flatnonzero(s == k)
        if k == 0:
            out[start[here]] = raw[payload[here].astype(np.int64)]
            continue
        take = np.minimum(COUNTS[k], end[here] - start[here])
        shift = (np.arange(COUNTS[k]) * WIDTHS[k]).astype(np.uint64)
        values = (payload[here, None] >> shift) & np.uint64((1 << int(WIDTHS[k])) - 1)
        out[ragged(start[here], take)] = values[np.arange(COUNTS[k]) < take[:, None]]
    return out
