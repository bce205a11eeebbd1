"""Canonical length-limited Huffman codes over token ids, in numpy.

A code is given by the length of each symbol's code word alone; code words are
handed out in order of (length, symbol). Streams are written from the highest
bit on and cut into blocks of ``BLOCK`` tokens that start at a byte; the bit
offset of every ``STRIDE``-th token of a block is kept, and a reader follows all
these points at once, one table lookup for each token.
"""

from __future__ import annotations

import numpy as np

#: Longest code word; 25 bits at most fit the reader's 32-bit window.
LIMIT = 18
BLOCK = 1 << 18
STRIDE = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits for counted symbols (package
    merge); 0 for symbols that never occur. One symbol alone gets one bit."""
    counts = np.asarray(counts, np.int64)
    lengths = np.zeros(len(counts), np.uint8)
    present = np.flatnonzero(counts)
    n = len(present)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    if n < 2:
        lengths[present] = 1
        return lengths
    order = present[np.argsort(counts[present], kind="stable")]
    leaves = counts[order]
    packages, levels = leaves[:0], []
    for _ in range(limit):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")  # leaves come before packages of equal weight
        levels.append(at >= n)
        merged = merged[at]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    taken = 2 * n - 2
    for is_package in reversed(levels):
        inner = int(is_package[:taken].sum())
        lengths[order[: taken - inner]] += 1
        taken = 2 * inner
    return lengths


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        symbols = np.flatnonzero(self.lengths)
        symbols = symbols[np.argsort(self.lengths[symbols], kind="stable")]
        size = self.lengths[symbols].astype(np.int64)
        self.width = int(size.max(initial=1))
        span = np.int64(1) << (self.width - size)
        first = np.cumsum(span) - span
        self.words = np.zeros(len(self.lengths), np.uint64)
        self.words[symbols] = (first >> (self.width - size)).astype(np.uint64)
        rest = (1 << self.width) - int(span.sum())
        # symbol and length in one entry; unused windows stay at length 1
        self.table = np.concatenate([np.repeat(symbols.astype(np.uint32) << np.uint32(5) | size.astype(np.uint32), span), np.ones(rest, np.uint32)])

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits of one block and the bit offset of each STRIDE-th token."""
        if not len(ids):
            return b"", np.zeros(0, np.uint32)
        size = self.lengths[ids]
        if not size.all():
            raise ValueError("an id has no code word")
        ends = np.cumsum(size, dtype=np.int64)
        start = ends - size
        # a word lies in a frame of two 32-bit cells; frames of one cell are added
        # up, as their words have no bit in common
        cell = start >> 5
        framed = self.words[ids] << (64 - (start & 31) - size).astype(np.uint64)
        firsts = np.flatnonzero(np.diff(cell, prepend=-1))
        sums = np.add.reduceat(framed, firsts)
        out = np.zeros(int(cell[-1]) + 2, np.uint32)
        out[cell[firsts]] = (sums >> np.uint64(32)).astype(np.uint32)
        out[cell[firsts] + 1] |= sums.astype(np.uint32)
        return out.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8], start[::STRIDE].astype(np.uint32)

    def decode(self, bits: np.ndarray, points: np.ndarray, steps: int) -> np.ndarray:
        """``steps`` tokens from each bit offset of ``points``: an array (points, steps).
        What stands after a stream's end is noise for the caller to cut off."""
        padded = np.concatenate([bits, np.zeros(4, np.uint8)]).astype(np.uint32)
        window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        at, last = points.astype(np.int64), 8 * (len(window) - 1)
        out = np.empty((steps, len(points)), np.uint32)
        for step in range(steps):
            np.minimum(at, last, out=at)
            seen = window[at >> 3] << (at & 7).astype(np.uint32)
            entry = self.table[seen >> np.uint32(32 - self.width)]
            out[step] = entry >> np.uint32(5)
            at += entry & np.uint32(31)
        return out.T
