"""Simple-8b: whole numbers in 64-bit words, 4 bits of selector and 60 of payload.

A selector says how many numbers a word holds and in how many bits each. Words
are grouped in blocks of BLOCK numbers; a block's words are followed by the
numbers that exceed 60 bits (escapes), to which escape words point. With the
offset of each block, all blocks of a buffer are coded and decoded at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 512

# Fixed values of the format: numbers per word by selector (60 // count bits each), then a run of zeros, then an escape.
COUNTS = [60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
ZERO_RUN, ZEROS = 14, 120
ESCAPE = 15

_COUNT = np.array([*COUNTS, ZEROS, 1], np.int64)
_BITS = np.array([*(60 // n for n in COUNTS), 0, 60], np.int64)
_EDGES = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
_PAYLOAD = np.uint64((1 << 60) - 1)


def block_bounds(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First number of each block and the one after its last, for runs of numbers that each begin a block."""
    lengths = np.asarray(lengths, np.int64)
    blocks = -(-lengths // BLOCK)
    ends = np.cumsum(lengths)
    nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = np.repeat(ends - lengths, blocks) + nth * BLOCK
    return first, np.minimum(first + BLOCK, np.repeat(ends, blocks))


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, words per block (escaped numbers counted) and escaped numbers per block, of runs of ``lengths`` numbers."""
    values = np.asarray(values, np.uint64)
    first, last = block_bounds(lengths)
    if not len(first):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    bits = (np.searchsorted(_EDGES, values, side="right") - 1).astype(np.int8)
    at = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64)
    left = np.repeat(last, last - first).astype(at.dtype) - at
    selector, widest = np.full(len(values), ESCAPE, np.int8), int(bits.max())
    # from few numbers a word to many, so that the densest that fits is what stays
    for s in [*range(len(COUNTS) - 1, -1, -1), ZERO_RUN]:
        if _BITS[s] >= widest:
            selector[:] = s
            continue
        free = np.where(bits > _BITS[s], at, at.dtype.type(len(values)))
        np.minimum.accumulate(free[::-1], out=free[::-1])
        free -= at
        selector[free >= np.minimum(left, _COUNT[s].astype(at.dtype))] = s
    step = np.minimum(_COUNT[selector], left)

    begins = np.zeros(len(values), bool)
    now, end = first, last
    while len(now):
        begins[now] = True
        now = now + step[now]
        more = now < end
        now, end = now[more], end[more]
    start = np.flatnonzero(begins)
    of = np.searchsorted(first, start, side="right") - 1
    kind = selector[start]
    escaped = kind == ESCAPE
    coded, escapes = np.bincount(of, minlength=len(first)), np.bincount(of[escaped], minlength=len(first))
    size = coded + escapes
    offset = np.cumsum(size) - size
    place = offset[of] + np.arange(len(start)) - (np.cumsum(coded) - coded)[of]
    words = np.zeros(size.sum(), np.uint64)
    for s in np.unique(kind[~escaped]):
        own = np.flatnonzero(kind == s)
        word = np.full(len(own), np.uint64(s) << np.uint64(60))
        for j in range(int(step[start[own]].max()) if s != ZERO_RUN else 0):
            there = step[start[own]] > j
            word[there] |= values[start[own[there]] + j] << np.uint64(j * _BITS[s])
        words[place[own]] = word
    if escaped.any():
        number = np.arange(escaped.sum()) - (np.cumsum(escapes) - escapes)[of[escaped]]
        words[place[escaped]] = (np.uint64(ESCAPE) << np.uint64(60)) | number.astype(np.uint64)
        words[(offset + coded)[of[escaped]] + number] = values[start[escaped]]
    return words, size, escapes


def decode(words: np.ndarray, size: np.ndarray, escapes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The numbers of whole blocks, given per block its words, its escaped numbers, and how many numbers it holds."""
    words = np.asarray(words, np.uint64)
    size, escapes, numbers = (np.asarray(x, np.int64) for x in (size, escapes, numbers))
    out = np.zeros(numbers.sum(), np.uint64)
    if not len(size):
        return out
    offset, coded = np.cumsum(size) - size, size - escapes
    of = np.repeat(np.arange(len(size)), coded)
    place = offset[of] + np.arange(coded.sum()) - (np.cumsum(coded) - coded)[of]
    word = words[place]
    kind = (word >> np.uint64(60)).astype(np.int64)
    count = _COUNT[kind]
    upto = np.cumsum(count) - count
    begin = upto - upto[np.searchsorted(of, np.arange(len(size)))][of]
    count = np.minimum(count, numbers[of] - begin)
    begin = begin + (np.cumsum(numbers) - numbers)[of]
    for s in np.unique(kind):
        own = np.flatnonzero(kind == s)
        if s == ESCAPE:
            out[begin[own]] = words[(offset + coded)[of[own]] + (word[own] & _PAYLOAD).astype(np.int64)]
            continue
        if s == ZERO_RUN:
            continue
        mask = np.uint64((1 << int(_BITS[s])) - 1)
        for j in range(int(count[own].max())):
            there = own[count[own] > j]
            out[begin[there] + j] = word[there] >> np.uint64(j * _BITS[s]) & mask
    return out
