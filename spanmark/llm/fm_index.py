"""A compressed FM-index over word codes: BWT in a wavelet matrix of packed bits, backward search, and
matching statistics of many streamed sequences at a time."""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with the ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.uint32)
        self.zeros = len(bits) - int(np.count_nonzero(bits))

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w].astype(np.int64) + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    """Index over sequences of 64-bit codes. Each sequence ends in an end mark of its own, smaller than any code.

    `depth` is the longest match of interest: the suffix order is exact, and for the parent step of
    matching statistics the groups of suffixes equal in their first depth - 1 codes are kept.
    """

    def __init__(self, sequences: list[np.ndarray], depth: int):
        self.depth = depth
        size = np.array([len(s) + 1 for s in sequences], np.int64)
        self.n, ends = int(size.sum()), np.cumsum(size) - 1
        flat = np.zeros(self.n, np.uint64)
        inside = np.ones(self.n, bool)
        inside[ends] = False
        flat[inside] = np.concatenate(sequences)
        self.alphabet, ids = np.unique(flat[inside], return_inverse=True)
        symbol = np.zeros(self.n, np.int64)  # 0: an end mark
        symbol[inside] = ids + 1
        first = np.zeros(self.n, np.int64)
        first[ends] = np.arange(len(ends))
        first[inside] = ids + len(ends)
        order, ranks, width = np.argsort(first), first, 1
        by_width = {1: first}
        longest = int(size.max())
        while width < max(longest, depth):
            later = np.zeros(self.n, np.int64)
            later[:-width] = ranks[width:] + 1
            key = ranks * (self.n + 1) + later
            order = np.argsort(key)
            new = np.r_[True, key[order[1:]] != key[order[:-1]]]
            ranks = np.empty(self.n, np.int64)
            ranks[order] = np.cumsum(new) - 1
            width *= 2
            by_width[width] = ranks
        # groups of suffixes equal in depth - 1 codes, from the powers of two that sum up to it
        part, at = None, 0
        for bit in range(depth.bit_length(), -1, -1):
            w = 1 << bit
            if (depth - 1) & w:
                shifted = np.zeros(self.n, np.int64)
                shifted[: self.n - at] = by_width[w][at:] + 1
                if part is not None:
                    _, part = np.unique(part, return_inverse=True)
                    shifted += part * (self.n + 2)
                part, at = shifted, at + w
        grouped = part[order] if depth > 1 else np.zeros(self.n, np.int64)
        edge = np.flatnonzero(np.r_[True, grouped[1:] != grouped[:-1]])
        of = np.cumsum(np.r_[False, grouped[1:] != grouped[:-1]])
        self.group_low = edge[of]
        self.group_high = np.r_[edge[1:], self.n][of]
        bwt = symbol[order - 1]
        self.before = np.r_[0, np.cumsum(np.bincount(symbol, minlength=len(self.alphabet) + 1))]
        self.levels, self.starts = [], np.zeros(len(self.alphabet) + 1, np.int64)
        top = int(len(self.alphabet)).bit_length()
        seq, ids = bwt, np.arange(len(self.alphabet) + 1)
        for level in range(top - 1, -1, -1):
            bit = (seq >> level) & 1
            bits = Bits(bit.astype(np.uint8))
            self.levels.append((level, bits))
            one = (ids >> level) & 1
            ones = bits.ones(self.starts)
            self.starts = np.where(one == 1, bits.zeros + ones, self.starts - ones)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of codes; -1 for codes that the index has not."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), max(len(self.alphabet) - 1, 0))
        return np.where(self.alphabet[at] == codes, at + 1, -1)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands in the BWT before position i, down the levels of the wavelet matrix."""
        at = i
        for level, bits in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> level) & 1 == 1, bits.zeros + ones, at - ones)
        return at - self.starts[symbol]

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search by one symbol: the suffixes that begin with it and go on as [low, high) do."""
        both = self.rank(np.r_[symbol, symbol], np.r_[low, high])
        base = self.before[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def window_counts(self, queries: list[np.ndarray]) -> list[np.ndarray]:
        """For each window of `depth` codes of each query, how often it occurs in the index.

        All queries are read from the right at once. At full depth the match is first shortened to its
        first depth - 1 codes (the parent step). Where no suffix goes on, reading starts again at
        the last end that can still lie in a match.
        """
        depth = self.depth
        size = np.array([len(q) for q in queries], np.int64)
        base = np.cumsum(size) - size
        symbol = self.ids(np.concatenate(queries)) if len(queries) else np.empty(0, np.int64)
        found = np.zeros(int(size.sum()), np.int64)
        live = np.flatnonzero(size >= depth)
        at = size[live] - 1  # next code to read, going left
        matched = np.zeros(len(live), np.int64)
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        while len(live):
            full = matched == depth
            high = np.where(full, self.group_high[np.minimum(low, self.n - 1)], high)
            low = np.where(full, self.group_low[np.minimum(low, self.n - 1)], low)
            matched = np.where(full, depth - 1, matched)
            s = symbol[base[live] + at]
            new_low, new_high = self.step(np.maximum(s, 0), low, high)
            ok = (s > 0) & (new_low < new_high)
            # a failure at `at` after `matched` codes: no match holds both ends, so start one code to the left of the right one
            at = np.where(ok, at - 1, np.where(matched > 0, at + matched - 1, at - 1))
            matched = np.where(ok, matched + 1, 0)
            low, high = np.where(ok, new_low, 0), np.where(ok, new_high, self.n)
            hit = ok & (matched == depth)
            found[base[live[hit]] + at[hit] + 1] = (high - low)[hit]
            stay = at >= np.maximum(depth - 1 - matched, 0)  # fewer codes are left than a window needs: done
            stay &= (at + 1 + matched) >= depth
            live, at, matched, low, high = (a[stay] for a in (live, at, matched, low, high))
        return [found[b : b + max(0, n - depth + 1)] for b, n in zip(base.tolist(), size.tolist())]
