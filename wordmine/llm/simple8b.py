"""Simple-8b coding of unsigned integers, vectorised over blocks.

A 64-bit word holds a selector in its top 4 bits and a fixed count of equally
wide integers in the other 60. Each block of ``BLOCK`` integers starts a new
word, and its first word's number is stored, so blocks are coded and decoded
side by side. An integer of more than 60 bits is an escape: a word of selector
0, then the integer itself in the next word.
"""

from __future__ import annotations

import numpy as np

# Integers per word and bits per integer, by selector.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
BLOCK = 512


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each integer, the selector of a word that begins with it (0: an escape, if nothing fits)."""
    n = len(values)
    whole = -(-n // block) * block
    # the narrowest selector of each integer; what fills the last block up fits in any word
    narrowest = np.zeros(whole, np.int8)
    for s in range(1, len(BITS)):
        wide = values >> np.uint64(BITS[s]) != 0
        narrowest[:n] += wide
        if not wide.any():
            break
    widest, chosen = s, np.zeros(whole, np.int8)
    before = np.zeros(whole + 1, np.int32 if whole < 1 << 31 else np.int64)
    for s in range(widest, 0, -1):
        # before[i]: how many of the first i integers need more than BITS[s] bits
        np.cumsum(narrowest >= s, out=before[1:])
        if before[-1] == n:
            break
        count = min(int(COUNTS[s]), block)
        fits = np.empty(whole, bool)
        np.equal(before[count:], before[:whole - count + 1], out=fits[:whole - count + 1])
        # words that would cross a block's end hold what is left of it
        last = before[:whole].reshape(-1, block)[:, block - count:]
        fits.reshape(-1, block)[:, block - count:] = last == before[block::block, None]
        chosen[fits] = s
    return chosen[:n]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned integers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    begins = np.arange(0, n, block)
    ends = np.minimum(begins + block, n)
    selector_at = _selectors(values, block)
    at, block_no = begins.copy(), np.arange(len(begins))
    starts, selectors, taken, owners = [], [], [], []
    while len(at):
        chosen = selector_at[at].astype(np.int64)
        took = np.minimum(np.maximum(COUNTS[chosen], 1), ends - at)
        starts.append(at)
        selectors.append(chosen)
        taken.append(took)
        owners.append(block_no)
        at = at + took
        left = at < ends
        at, ends, block_no = at[left], ends[left], block_no[left]
    start, selector, take, owner = map(np.concatenate, (starts, selectors, taken, owners))
    order = np.argsort(start)
    start, selector, take, owner = start[order], selector[order], take[order], owner[order]
    width = 1 + (selector == 0)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s in np.unique(selector).tolist():
        of = np.flatnonzero(selector == s)
        if s == 0:
            words[place[of] + 1] = values[start[of]]
            continue
        packed = np.full(len(of), np.uint64(s) << np.uint64(60))
        for k in range(int(COUNTS[s])):
            inside = k < take[of]
            if inside.all():
                packed |= values[start[of] + k] << np.uint64(k * BITS[s])
            else:
                packed[inside] |= values[start[of[inside]] + k] << np.uint64(k * BITS[s])
        words[place[of]] = packed
    return words, place[np.searchsorted(owner, np.arange(len(begins)))]


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` integers of the words; ``offsets`` is the first word of each block."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # words that hold an escaped integer are no words of their own: those after
    # an escape, which is itself no such word (runs of zeros alternate)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():
        at = 0
        zeros = np.flatnonzero(selector == 0)
        for z in zeros.tolist():
            if z >= at:
                raw[z + 1] = True
                at = z + 2
    kept = np.flatnonzero(~raw)
    selector = selector[kept]
    count = np.maximum(COUNTS[selector], 1)
    # where each word's integers go: words follow one another inside a block
    first = np.searchsorted(kept, offsets)
    before = np.cumsum(count) - count
    in_block = np.searchsorted(offsets, kept, side="right") - 1
    start = in_block * block + before - before[first][in_block]
    end = np.minimum((in_block + 1) * block, n)
    for s in np.unique(selector).tolist():
        of = np.flatnonzero(selector == s)
        if s == 0:
            out[start[of]] = words[kept[of] + 1]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        data, place, stop = words[kept[of]], start[of], end[of]
        whole = bool((place + COUNTS[s] <= stop).all())
        for k in range(int(COUNTS[s])):
            value = data >> np.uint64(k * BITS[s]) & mask
            if whole:
                out[place + k] = value
            else:
                inside = place + k < stop
                out[place[inside] + k] = value[inside]
    return out
