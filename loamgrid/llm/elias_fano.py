"""Compact monotone sequences and packed integers as numpy arrays, with queries on whole arrays of arguments."""

from __future__ import annotations

import numpy as np

U = np.uint64
ALL = U(0xFFFFFFFFFFFFFFFF)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned integers of `width` bits each, side by side in 64-bit words (one spare word at the end)."""
    out = np.zeros(len(values) * width // 64 + 2, U)
    if width:
        bit = np.arange(len(values), dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(U)
        np.bitwise_or.at(out, word, values << shift)
        over = np.flatnonzero(shift + U(width) > U(64))
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (U(64) - shift[over]))
    return out


def unpack(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), U)
    bit = at * width
    word, shift = bit >> 6, (bit & 63).astype(U)
    high = np.where(shift > 0, words[word + 1] << ((U(64) - shift) & U(63)), U(0))
    return (words[word] >> shift | high) & (ALL >> U(64 - width))


def _nth_bit(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the set bit that has `rank` set bits below it."""
    at, rank = np.zeros(len(word), np.int64), rank.copy()
    for step in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word >> at.astype(U) & ((U(1) << U(step)) - U(1))).astype(np.int64)
        go = rank >= below
        rank -= np.where(go, below, 0)
        at += np.where(go, step, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of unsigned integers: low bits packed, high parts in unary, ranks of every 64 bits."""

    NAMES = ("low", "high", "ones")

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values: non-decreasing, below the universe."""
        n = len(values)
        width = max(0, (universe // max(1, n)).bit_length() - 1)
        values = values.astype(U)
        low = pack(values & (ALL >> U(64 - width)) if width else np.zeros(n, U), width)
        place = (values >> U(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(((int(universe - 1) >> width) + n + 1) // 64 + 2, U)
        np.bitwise_or.at(high, place >> 6, U(1) << (place & 63).astype(U))
        ones = np.r_[0, np.cumsum(np.bitwise_count(high).astype(np.int64))[:-1]]
        return cls(n, width, low, high, ones)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at positions."""
        word = np.searchsorted(self.ones, at, "right") - 1
        place = (word << 6) + _nth_bit(self.high[word], at - self.ones[word])
        return (place - at).astype(U) << U(self.width) | unpack(self.low, self.width, at)

    def _zero(self, rank: np.ndarray) -> np.ndarray:
        """Position of the zero with `rank` zeros before it, in the high part."""
        first, last = np.zeros(len(rank), np.int64), np.full(len(rank), len(self.high) - 1)
        while (first < last).any():  # the last word with at most `rank` zeros before it
            middle = (first + last + 1) >> 1
            go = (middle << 6) - self.ones[middle] <= rank
            first, last = np.where(go, middle, first), np.where(go, last, middle - 1)
        return (first << 6) + _nth_bit(~self.high[first], rank - ((first << 6) - self.ones[first]))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Position of each value (strictly increasing sequence), or -1: successor search among those with its high part."""
        if not self.n:
            return np.full(len(values), -1)
        part = (values >> U(self.width)).astype(np.int64)
        begin = np.where(part > 0, self._zero(np.maximum(part - 1, 0)) - np.maximum(part - 1, 0), 0)
        end = self._zero(part) - part
        target = values & (ALL >> U(64 - self.width)) if self.width else np.zeros(len(values), U)
        return search(self.low, self.width, begin, end, target)


def search(words: np.ndarray, width: int, begin: np.ndarray, end: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Position of each target among packed integers that ascend in [begin, end), or -1."""
    out = np.full(len(begin), -1)
    at = np.flatnonzero(begin < end)
    first, last, target = begin[at], end[at], target[at]
    while len(at):
        middle = (first + last) >> 1
        value = unpack(words, width, middle)
        hit = value == target
        out[at[hit]] = middle[hit]
        less = value < target
        first, last = np.where(less, middle + 1, first), np.where(less, last, middle)
        go = (first < last) & ~hit
        at, first, last, target = at[go], first[go], last[go], target[go]
    return out
