"""Compressed FM-index over one shard's words, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` sorted by their first ``depth`` symbols or more."""
    rank = text.astype(np.int64)
    h = 1
    while True:
        follow = np.zeros_like(rank)
        if h < len(rank):
            follow[:-h] = rank[h:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.empty_like(rank)
        new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = new
        h *= 2
        if h >= depth or int(rank.max()) == len(rank) - 1:
            return order


class BitVector:
    """Bits in 64-bit words with a count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & below)


class WaveletTree:
    """Level-wise wavelet tree: on each level the symbols are split by one bit, zeros first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        s = symbols
        for k in range(self.depth - 1, -1, -1):
            bit = ((s >> k) & 1).astype(np.uint8)
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        # where each symbol begins in the order after the last level
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        self.start = np.zeros(sigma, dtype=np.int64)
        self.start[s[first]] = first

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol among the first ``lo`` and the first ``hi`` symbols."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.depth - 1 - k)) & 1).astype(bool)
            a, b = bits.rank1(lo), bits.rank1(hi)
            lo = np.where(one, zeros + a, lo - a)
            hi = np.where(one, zeros + b, hi - b)
        start = self.start[symbol]
        return lo - start, hi - start


class FMIndex:
    """Backward search over texts of positive symbols; each text counts ``weight`` times."""

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, sigma: int, depth: int):
        sizes = np.array([len(x) + 1 for x in texts])
        text = np.zeros(int(sizes.sum()), dtype=np.int64)  # 0 ends each text
        starts = np.cumsum(sizes) - sizes
        self.starts = starts
        for s, x in zip(starts, texts):
            text[s:s + len(x)] = x
        self.text = text
        order = suffix_order(text, depth)
        self.tree = WaveletTree(text[order - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(weights, sizes)[order])])

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns with ``symbol`` put before them."""
        a, b = self.tree.ranks(symbol, lo, hi)
        return self.less[symbol] + a, self.less[symbol] + b

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.weight[hi] - self.weight[lo]

    def longest_back(self, end: np.ndarray, stop: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: for each place ``end`` (inclusive), the smallest start, not below ``stop``, from which the
        string up to ``end`` occurs ``least`` times or more; ``end + 1`` if none."""
        at = end.copy()
        lo, hi = np.zeros_like(end), np.full_like(end, len(self.text))
        out = end + 1
        live = np.arange(len(end))
        while len(live):
            lo, hi = self.extend(self.text[at], lo, hi)
            ok = self.occurrences(lo, hi) >= least
            out[live[ok]] = at[ok]
            ok &= at > stop[live]
            live, at, lo, hi = live[ok], at[ok] - 1, lo[ok], hi[ok]
        return out


def repeated_windows(index: FMIndex, length: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` symbols of the indexed texts that occur twice or more: (text, window) pairs.

    Each text is streamed against the index.  A search from its end settles texts that repeat as a whole, and the windows
    inside the longest repeated ending.  A second search, from before the place where the first one failed, settles
    those inside the longest repeated stretch there.  The windows left are searched from the left; a search that fails at
    place i rules out all windows that hold the string from i on, so the next window starts behind i.
    """
    starts = index.starts
    text = np.flatnonzero(sizes >= length)
    last = (sizes - length)[text]  # last window
    begin = starts[text]
    reach = index.longest_back(begin + sizes[text] - 1, begin) - begin
    found = [_spread(text, reach, np.maximum(last - reach + 1, 0))]
    limit = np.minimum(reach, last + 1)  # windows from here on are settled
    # windows that end before the place of failure, reach - 1
    end = reach - 2
    use = np.flatnonzero(end >= length - 1)
    low, high = np.zeros(len(text), dtype=np.int64), np.full(len(text), -1)  # settled windows in between
    low[use] = index.longest_back(begin[use] + end[use], begin[use]) - begin[use]
    high[use] = end[use] - length + 1
    found.append(_spread(text, low, np.maximum(high - low + 1, 0)))
    x = np.zeros(len(text), dtype=np.int64)
    while len(text):
        x = np.where((x >= low) & (x <= high), high + 1, x)
        go = x < limit
        text, x, limit, low, high = text[go], x[go], limit[go], low[go], high[go]
        if not len(text):
            break
        begin = starts[text] + x
        got = index.longest_back(begin + length - 1, begin)
        hit = got == begin
        found.append((text[hit], x[hit]))
        x = np.where(hit, x + 1, got - starts[text])
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _spread(text: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.cumsum(n)
    return np.repeat(text, n), np.arange(int(n.sum())) - np.repeat(total - n, n) + np.repeat(first, n)
