"""Simple-8b: runs of whole numbers packed into 64-bit words.

The top four bits of a word are its selector, the other sixty hold as many
values of equal width as the selector says. A value of more than 60 bits is
escaped: a word with selector 0, then the value itself. Numbers are packed in
blocks of ``BLOCK`` values; a block's first word is known, so that blocks are
decoded on their own and all words of one selector at once.
"""

from __future__ import annotations

import numpy as np

# How many values of how many bits the selectors 1 to 14 pack; 0 is the escape.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 4096


def _all_of(flags: np.ndarray, count: int) -> np.ndarray:
    """Whether ``count`` flags in a row hold, from each place of a row on."""
    width, have = flags.shape[1] - max(COUNTS), 1
    while have * 2 <= count:
        flags = flags[:, :flags.shape[1] - have] & flags[:, have:]
        have *= 2
    return flags[:, :width] & flags[:, count - have:count - have + width]


def _selectors(values: np.ndarray) -> np.ndarray:
    """The selector that packs most values from each position of its block on;
    places beyond a block's end fit anywhere."""
    n = len(values)
    if values.max() < 1 << 32:
        values = values.astype(np.uint32)
    blocks = -(-n // BLOCK)
    grid = np.zeros((blocks, BLOCK + max(COUNTS)), dtype=values.dtype)
    whole = n // BLOCK
    grid[:whole, :BLOCK] = values[:whole * BLOCK].reshape(whole, BLOCK)
    grid[whole:, :n - whole * BLOCK] = values[whole * BLOCK:]
    selector = np.zeros((blocks, BLOCK), dtype=np.uint8)  # the escape
    top = int(values.max())
    for s in range(len(COUNTS), 0, -1):  # from the widest on: who packs more replaces who packs fewer
        if top >> WIDTHS[s - 1] == 0:
            if s > 1 and top >> WIDTHS[s - 2] == 0:
                continue  # the next one takes every value, too, and more of them
            selector[:] = s
            continue
        ok = _all_of(grid < grid.dtype.type(1 << WIDTHS[s - 1]), COUNTS[s - 1])
        if not ok.any():
            break
        np.copyto(selector, np.uint8(s), where=ok)
    return selector.reshape(-1)[:n]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the values, and the first word of each block."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    selector = _selectors(values)
    taken = ((1,) + COUNTS)
    picks, starts = selector.tobytes(), []
    for block in range(0, n, BLOCK):
        at, end = block, min(block + BLOCK, n)
        while at < end:
            starts.append(at)
            at += taken[picks[at]]
    starts = np.array(starts)
    chosen = selector[starts].astype(np.int64)
    words = np.zeros(len(starts), dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(max(COUNTS), np.uint64)])
    ends = np.minimum((starts // BLOCK + 1) * BLOCK, n)
    for s in np.unique(chosen):
        if s == 0:
            continue
        where = np.nonzero(chosen == s)[0]
        count, width = COUNTS[s - 1], WIDTHS[s - 1]
        word = np.full(len(where), int(s) << 60, dtype=np.uint64)
        for k in range(count):
            at = starts[where] + k
            word |= np.where(at < ends[where], padded[at], np.uint64(0)) << np.uint64(k * width)
        words[where] = word
    escaped = chosen == 0
    first = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])  # an escape takes two words
    out = np.zeros(len(starts) + int(escaped.sum()), dtype=np.uint64)
    out[first] = words
    out[first[escaped] + 1] = values[starts[escaped]]
    block_start = first[starts % BLOCK == 0]
    return out, block_start.astype(np.int64)


def decode(words: np.ndarray, total: int, block_start: np.ndarray) -> np.ndarray:
    """The ``total`` values of whole blocks: ``words`` from the first block's
    first word on, ``block_start`` relative to it."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    if total == 0:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (selector == 0).any():  # the word after an escape is a value, whatever it looks like
        for at in np.nonzero(selector == 0)[0]:
            if not raw[at]:
                raw[at + 1] = True
    counts = np.array((1,) + COUNTS + (0,))[selector]
    counts[raw] = 0
    blocks = len(block_start)
    block_of = np.searchsorted(block_start, np.arange(len(words)), side="right") - 1
    before = np.concatenate([[0], np.cumsum(counts)])[:-1]
    start = block_of * BLOCK + before - before[block_start][block_of]
    sizes = np.full(blocks, BLOCK)
    sizes[-1] = total - (blocks - 1) * BLOCK
    end = block_of * BLOCK + sizes[block_of]
    out = np.zeros(total + max(COUNTS), dtype=np.uint64)
    for s in np.unique(selector[~raw]):
        where = np.nonzero((selector == s) & ~raw)[0]
        if s == 0:
            out[start[where]] = words[where + 1]
            continue
        count, width = COUNTS[s - 1], WIDTHS[s - 1]
        mask = (np.uint64(1) << np.uint64(width)) - np.uint64(1)
        for k in range(count):
            at = start[where] + k
            inside = at < end[where]
            out[at[inside]] = (words[where[inside]] >> np.uint64(k * width)) & mask
    return out[:total]
