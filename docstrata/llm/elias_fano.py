"""Elias-Fano sequences: monotone integers in about 2 + log2(universe / n) bits each, with vectorised look-ups.

A sequence is a few arrays that can be saved and memory-mapped. The low bits of the values are packed; the high bits
are unary in a bit vector: for every value of the high part the ones of its members, then a zero.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64

#: One, and the highest bit, of every byte of a word.
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: Place of the r-th one in a byte.
_IN_BYTE = np.zeros((256, 8), dtype=np.int64)
for _byte in range(256):
    for _rank, _place in enumerate(k for k in range(8) if _byte >> k & 1):
        _IN_BYTE[_byte, _rank] = _place


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Low `bits` bits of the values, one after the other."""
    out = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if bits and len(values):
        at = np.arange(len(values), dtype=np.uint64) * _U(bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        low = values.astype(np.uint64) & _U((1 << bits) - 1)
        np.bitwise_or.at(out, word, low << shift)
        over = np.flatnonzero(shift + _U(bits) > 64)
        np.bitwise_or.at(out, word[over] + 1, low[over] >> (_U(64) - shift[over]))
    return out


def _in_word(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the one with `rank` ones before it, in every word: the byte by prefix sums within the word, then a
    table."""
    rank = rank.view(np.uint64)
    sums = words - ((words >> _U(1)) & _U(0x5555555555555555))
    sums = (sums & _U(0x3333333333333333)) + ((sums >> _U(2)) & _U(0x3333333333333333))
    sums = ((sums + (sums >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # ones up to and with each byte
    place = np.bitwise_count((((rank * _ONES) | _TOPS) - sums) & _TOPS).astype(np.uint64) << _U(3)
    rank = rank - (((sums << _U(8)) >> place) & _U(255))
    byte = (words >> place) & _U(255)
    return place.view(np.int64) + _IN_BYTE.take(((byte << _U(3)) | rank).view(np.int64))


@dataclass
class EliasFano:
    size: int
    bits: int
    low: np.ndarray  # packed low bits
    high: np.ndarray  # the bit vector, in words
    ones: np.ndarray  # ones before each word
    zeros: np.ndarray  # zeros before each word

    @staticmethod
    def build(values: np.ndarray) -> EliasFano:
        """Of values >= 0 in ascending order, equal ones allowed."""
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        top = int(values[-1]) >> bits if n else 0
        words = (n + top + 1) // 64 + 2
        at = (values >> bits) + np.arange(n)
        flags = np.zeros(words * 64, dtype=np.uint8)
        flags[at] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        ones = np.concatenate([[0], ones[:-1]])
        kind = np.uint32 if words < 1 << 25 else np.int64
        zeros = np.arange(words) * 64 - ones
        return EliasFano(n, bits, _pack(values, bits), high, ones.astype(kind), zeros.astype(kind))

    def _select(self, rank: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the one (or zero) with `rank` of its kind before it."""
        before = self.zeros if zeros else self.ones
        word = np.searchsorted(before, rank.astype(before.dtype), "right") - 1
        bits = self.high[word]
        return word * 64 + _in_word(~bits if zeros else bits, rank - before[word])

    def _next_one(self, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Place of the one after those at the places, which have `rank` ones before them; any for the last one."""
        rest = self.high[place >> 6] >> (place & 63).view(np.uint64) >> _U(1)
        after = place + 1 + np.bitwise_count((rest & (~rest + _U(1))) - _U(1))
        over = np.flatnonzero(rest == 0)
        if len(over):  # in a later word
            after[over] = self._select(np.minimum(rank[over] + 1, self.size - 1), False)
        return after

    def _run_end(self, place: np.ndarray) -> np.ndarray:
        """Place of the first zero at or after each place."""
        word, shift = place >> 6, (place & 63).view(np.uint64)
        clear = ~self.high[word] >> shift
        end = place + np.bitwise_count((clear & (~clear + _U(1))) - _U(1))
        over = np.flatnonzero(clear == 0)
        if len(over):  # the run goes on beyond the word: one zero more than before the place
            ones = self.ones[word[over]].astype(np.int64) + np.bitwise_count(self.high[word[over]] & ((_U(1) << shift[over]) - _U(1)))
            end[over] = self._select(place[over] - ones, True)
        return end

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), dtype=np.int64)
        at = index * self.bits
        word, shift = at >> 6, (at & 63).view(np.uint64)
        # The next word is shifted in two steps, as no number can be shifted by 64.
        value = (self.low[word] >> shift) | (self.low[word + 1] << _U(1) << (shift ^ _U(63)))
        return (value & _U((1 << self.bits) - 1)).view(np.int64)

    def values(self) -> np.ndarray:
        """All values, in order; much cheaper a value than searching for each."""
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        at = np.arange(self.size)
        return ((place - at) << self.bits) | self._lows(at)

    def access(self, index: np.ndarray) -> np.ndarray:
        """Values at the given places."""
        index = np.asarray(index, dtype=np.int64)
        if not len(index):
            return index
        if len(index) > self.size // 8:
            return self.values()[index]
        return ((self._select(index, False) - index) << self.bits) | self._lows(index)

    def around(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values before and at the given places, 0 before the first. The second of two neighbours costs no search."""
        if not len(index):
            return index, index
        rank = np.maximum(index - 1, 0)
        place = self._select(rank, False)
        before = ((place - rank) << self.bits) | self._lows(rank)
        at = ((self._next_one(place, rank) - index) << self.bits) | self._lows(index)
        first = np.flatnonzero(index == 0)
        at[first], before[first] = before[first], 0
        return before, at

    def find(self, values: np.ndarray) -> np.ndarray:
        """First place of each value, -1 where it is not there."""
        values = np.asarray(values, dtype=np.int64)
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.size or not len(values):
            return out
        head = values >> self.bits
        live = np.flatnonzero((values >= 0) & (head < len(self.high) * 64 - self.size))
        head, want = head[live], values[live] & ((1 << self.bits) - 1)
        # The members of a high part, two or so on average but many where the sequence is dense: a binary search for the
        # first that is not less, which a single member needs no step for.
        place = self._select(np.maximum(head - 1, 0), True) + 1
        place[head == 0] = 0
        low, end = place - head, self._run_end(place) - head
        inside = np.flatnonzero(low < end)
        live, want, low, high = live[inside], want[inside], low[inside], end[inside] - 1
        open_ = np.flatnonzero(low < high)
        a, b, asked = low[open_], high[open_], want[open_]
        while len(open_):
            middle = (a + b) >> 1
            less = self._lows(middle) < asked
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            low[open_] = a
            left = np.flatnonzero(a < b)
            open_, a, b, asked = open_[left], a[left], b[left], asked[left]
        same = np.flatnonzero(self._lows(low) == want)
        out[live[same]] = low[same]
        return out
