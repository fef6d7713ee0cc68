"""A compressed full-text index of a sequence of numbers: wavelet matrix over its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((bits.size // 64 + 1) * 64, np.uint8)
        padded[: bits.size] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int64)
        self.zeros = bits.size - int(ones.sum())

    def rank(self, p: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = p >> 6
        low = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


def suffix_order(text: np.ndarray, depth: int = 64) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols, which is enough to search for patterns of that length."""
    n = text.size
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return order


class FMIndex:
    """Counts how often patterns stand in a text of numbers from 0; search goes from a pattern's end to its start."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        last = text[order - 1]
        self.size = text.size
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
        self.levels: list[Bits] = []
        self.depth = max(1, int(text.max()).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bit = (last >> level) & 1
            self.levels.append(Bits(bit))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        symbols = np.arange(self.first.size - 1)
        self.base = self._down(symbols, np.zeros(symbols.size, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(place)
            place = np.where((symbol >> level) & 1 == 1, bits.zeros + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        start = self.first[symbol] - self.base[symbol]
        return start + self._down(symbol, low), start + self._down(symbol, high)


def repeated_stretches(index: FMIndex, text: np.ndarray, start: np.ndarray, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window, of those that stand twice or more in the index, of each segment; -1 for none.

    Segment i has ``windows[i]`` windows of ``span`` symbols from ``start[i]`` on in ``text``. All segments
    are searched in step. A backward search that fails at f tells that no window that holds f and
    what was matched behind it repeats, so the first window is found by jumping to f + 1; the last
    one is found from the right.
    """
    n = start.size
    lowest, highest = np.full(n, -1), np.full(n, -1)
    window = np.zeros(n, np.int64)
    from_left = np.ones(n, bool)
    place = window + span - 1
    low, high = np.zeros(n, np.int64), np.full(n, index.size)
    active = np.arange(n)
    while active.size:
        symbol = text[start[active] + place[active]]
        a, b = index.extend(symbol, low[active], high[active])
        low[active], high[active] = a, b
        fails = b - a < 2
        done = ~fails & (place[active] == window[active])
        place[active] -= 1
        left = from_left[active]
        # From the left: a hit ends this half of the search, a miss jumps behind the place it failed at.
        hit = active[done & left]
        lowest[hit], from_left[hit], window[hit] = window[hit], False, windows[hit] - 1
        miss = active[fails & left]
        window[miss] = place[miss] + 2
        # From the right: a hit ends the search, a miss goes one window back; the lowest is known to repeat.
        end = active[done & ~left]
        highest[end] = window[end]
        back = active[fails & ~left]
        window[back] -= 1
        over = np.zeros(n, bool)
        over[miss[window[miss] >= windows[miss]]] = True
        over[end] = True
        reached = np.concatenate([hit, back])
        reached = reached[window[reached] <= lowest[reached]]
        highest[reached] = lowest[reached]
        over[reached] = True
        again = np.concatenate([hit, miss, back])
        place[again] = window[again] + span - 1
        low[again], high[again] = 0, index.size
        active = active[~over[active]]
    return lowest, highest
