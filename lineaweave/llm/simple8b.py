"""Simple-8b: integers packed into 64-bit words.

The upper four bits of a word select how many integers the other sixty hold
and in how many bits each. Selector 15 is the escape: the next word is one
integer of more than sixty bits as it is. Integers are coded in blocks of
``BLOCK``, each of which starts a word, so that all blocks are packed and
unpacked side by side with array operations, and one block can be read alone.
"""

from __future__ import annotations

import numpy as np

#: Integers in a block.
BLOCK = 256
# integers in a word by selector, and bits of each: as many as fit into sixty
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
ESCAPE = 15


# bits of the small integers, which most token ids are
_SHORT = np.maximum(np.frexp(np.arange(1 << 17, dtype=np.float64))[1], 1)


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 64-bit value takes, at least 1."""
    if len(values) and values.max() < len(_SHORT):
        return _SHORT[values]
    values = values.astype(np.uint64)
    bits = np.ones(len(values), np.int64)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1) << np.uint64(step)
        bits[big] += step
        rest[big] >>= np.uint64(step)
    return bits


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of ``values`` (unsigned 64-bit), and the number of words before each block."""
    values = np.ascontiguousarray(values, np.uint64)
    n, pad = len(values), int(COUNTS[0])
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a block's values and, behind them, zeros: what a last word does not fill
    padded = np.zeros((blocks, BLOCK + pad), np.uint64)
    padded[:, :BLOCK].flat[:n] = values
    bits = np.ones(padded.shape, np.uint8)
    bits[:, :BLOCK].flat[:n] = bit_length(values)
    # at each place the selector that takes the most integers; most: the largest of the next 1, 2, 4 ... widths
    selector = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    most, span = bits, 1
    for s in range(len(COUNTS) - 1, -1, -1):
        count = int(COUNTS[s])
        while 2 * span <= count:
            most = np.maximum(most[:, :-span], most[:, span:])
            span *= 2
        over = np.maximum(most[:, :BLOCK], most[:, count - span:count - span + BLOCK])
        selector[over <= BITS[s]] = s
    taken = np.append(COUNTS, [1, 1])[selector]
    # all blocks go on from word to word side by side
    size = np.full(blocks, BLOCK)
    size[-1] = n - BLOCK * (blocks - 1)
    live, at = np.arange(blocks), np.zeros(blocks, np.int64)
    steps = []
    while len(live):
        steps.append((live, at))
        at = at + taken[live, at]
        more = at < size[live]
        live, at = live[more], at[more]
    block, place = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(block, kind="stable")
    block, place = block[order], place[order]
    kind = selector[block, place]
    width = np.where(kind == ESCAPE, 2, 1)
    to = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[to] = kind.astype(np.uint64) << np.uint64(60)
    flat, first = padded.ravel(), block * padded.shape[1] + place
    for s in range(len(COUNTS)):
        own = np.flatnonzero(kind == s)
        here, word = first[own], np.zeros(len(own), np.uint64)
        for lane in range(COUNTS[s]):
            word |= flat[here + lane] << np.uint64(lane * BITS[s])
        words[to[own]] |= word
    raw = np.flatnonzero(kind == ESCAPE)
    words[to[raw] + 1] = padded[block[raw], place[raw]]
    per_block = np.bincount(block, weights=width, minlength=blocks).astype(np.int64)
    return words, np.cumsum(per_block) - per_block


def unpack(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers of ``words``, whose blocks begin at ``starts``."""
    words = np.ascontiguousarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = _raw(selector)
    counts = np.where(raw, 0, np.where(selector == ESCAPE, 1, COUNTS[np.minimum(selector, 13)]))
    if len(starts):  # a block's last word holds only what is left of it
        block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        size = np.minimum(BLOCK, n - BLOCK * np.arange(len(starts)))
        before = np.cumsum(counts) - counts
        before -= before[starts][block]
        counts = np.minimum(counts, np.maximum(size[block] - before, 0))
    out = np.zeros(n, np.uint64)
    to = np.cumsum(counts) - counts
    for s in range(len(COUNTS)):
        own = np.flatnonzero((selector == s) & ~raw)
        if len(own):
            lane = np.arange(COUNTS[s])
            inside = lane < counts[own][:, None]
            mask = (np.uint64(1) << np.uint64(BITS[s])) - np.uint64(1)
            values = words[own][:, None] >> (lane.astype(np.uint64) * np.uint64(BITS[s])) & mask
            out[(to[own][:, None] + lane)[inside]] = values[inside]
    escapes = np.flatnonzero((selector == ESCAPE) & ~raw)
    out[to[escapes]] = words[escapes + 1]
    return out


def _raw(selector: np.ndarray) -> np.ndarray:
    """Which words are the integer that follows an escape."""
    raw = np.zeros(len(selector), bool)
    for k in np.flatnonzero(selector == ESCAPE):
        if not raw[k]:
            raw[k + 1] = True
    return raw
