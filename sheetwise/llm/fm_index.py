"""A compressed full-text index over word numbers: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np

#: no text holds it
ABSENT = np.iinfo(np.int64).max


class Bits:
    """A bit vector with rank; 64 bits and one count per block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, "<u8")
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & low)


class Wavelet:
    """A wavelet matrix: one bit vector per bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = []
        for bit in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(bits)))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``low`` and before ``high``."""
        start = np.zeros_like(low)
        for bit, bits in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            ones = [bits.rank(x) for x in (start, low, high)]
            start, low, high = (np.where(one, bits.zeros + r, x - r) for r, x in zip(ones, (start, low, high)))
        return low - start, high - start


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; the symbols that end a text must all differ."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1]
    step = 1
    while True:
        after = np.full(n, -1)
        after[: n - step] = rank[step:] if step < n else after[: n - step]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FmIndex:
    """Texts of word numbers (from 0), each with an owner, searched backwards.

    Besides the transform it keeps, for suffixes that agree in ``depth`` words, the smallest owner.
    """

    def __init__(self, texts: list[np.ndarray], owners: np.ndarray, words: int, depth: int):
        k, sizes = len(texts), np.array([len(t) + 1 for t in texts])
        self.depth, ends = depth, np.cumsum(sizes) - 1
        joined = np.empty(int(sizes.sum()), np.int64)
        inner = np.ones(len(joined), bool)
        inner[ends] = False
        joined[inner] = np.concatenate(texts) + k
        joined[ends] = np.arange(k)  # every text ends with a symbol of its own, smaller than all words
        order = suffix_order(joined)
        # words as 1.., all ends as 0: those are never searched
        symbols = np.where(joined >= k, joined - k + 1, 0)
        self.transform = Wavelet(symbols[order - 1], words + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=words + 1))])
        left = np.repeat(ends, sizes) - np.arange(len(joined))  # words up to the end of the text
        name, length, names = joined, 1, {1: joined}
        while length < depth:  # numbers of the stretches of ``depth`` words, from those of shorter ones
            step = min(length, depth - length)
            shifted = np.concatenate([name[step:], np.arange(step) + len(joined)])
            name = np.unique(name * (2 * len(joined) + words + k) + shifted, return_inverse=True)[1]
            length += step
        at = np.where(left >= depth, name, len(joined) + np.arange(len(joined)))[order]
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
        self.starts = np.append(starts, len(at))
        self.owner = np.minimum.reduceat(np.repeat(owners, sizes)[order], starts)
        self.rows = len(joined)

    def _extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffixes that begin with the symbol and go on as the given ones."""
        before, upto = self.transform.rank(symbol, low, high)
        return self.first[symbol] + before, self.first[symbol] + upto

    def _apart(self, pattern: np.ndarray) -> np.ndarray:
        """The smallest owner per stretch of ``depth`` words, each searched from its own end."""
        stretches = np.lib.stride_tricks.sliding_window_view(pattern, self.depth) + 1
        low, high = np.zeros(len(stretches), np.int64), np.full(len(stretches), self.rows)
        for column in range(self.depth - 1, -1, -1):
            low, high = self._extend(stretches[:, column], low, np.maximum(low, high))
        found = np.full(len(stretches), ABSENT)
        found[high > low] = self.owner[self.group[low[high > low]]]
        return found

    def smallest_owners(self, patterns: list[np.ndarray]) -> list[np.ndarray]:
        """For each pattern and each of its stretches of ``depth`` words, the smallest owner of a text that holds it.

        All patterns are streamed together, from their ends backwards. The match grows by a word to the left;
        one that reaches the depth is widened to all suffixes that share ``depth`` words, so each position
        costs one step. A pattern whose match breaks off is searched stretch by stretch; a stretch that no
        text holds gets ``ABSENT``.
        """
        sizes = np.array([len(p) for p in patterns])
        width = int(sizes.max(initial=0))
        padded = np.full((len(patterns), width), -1)
        for row, p in zip(padded, patterns):
            row[width - len(p) :] = p
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.rows)
        broken = np.zeros(len(patterns), bool)
        found = np.full(padded.shape, ABSENT)
        for column in range(width - 1, -1, -1):
            live = np.flatnonzero((sizes >= width - column) & ~broken)
            lo, hi = self._extend(padded[live, column] + 1, low[live], high[live])
            broken[live] = hi <= lo
            if width - column >= self.depth:
                lo = np.minimum(lo, self.rows - 1)
                group = self.group[lo]
                found[live, column] = self.owner[group]
                lo, hi = self.starts[group], self.starts[group + 1]
            low[live], high[live] = lo, hi
        out = [found[i, width - s : width - min(s, self.depth - 1)] for i, s in enumerate(sizes.tolist())]
        for i in np.flatnonzero(broken & (sizes >= self.depth)).tolist():
            out[i] = self._apart(patterns[i])
        return out
