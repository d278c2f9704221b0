"""Short byte strings as two exact 64-bit numbers, and a hash table of such keys, by arrays."""

from __future__ import annotations

import numpy as np

_LOW = np.array([(1 << 8 * min(n, 8)) - 1 for n in range(17)], np.uint64)  # of a string's first 8 bytes those that it has
_HIGH = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in range(17)], np.uint64)


def padded(b: np.ndarray) -> np.ndarray:
    """A copy of some bytes with room behind, as keys() reads beyond."""
    out = np.zeros(len(b) + 32 & ~7, np.uint8)
    out[: len(b)] = b
    return out


def beyond_keys(b: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the strings at some places have no exact keys: those of more than 16 bytes, or with a zero byte."""
    out = size > 16
    if not b.all():
        zero = np.flatnonzero(b == 0)
        own = np.searchsorted(at, zero, "right") - 1
        own = own[(own >= 0) & (zero < (at + size)[own])]
        out[own] = True
    return out


def keys(b: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and second eight bytes of the strings at some places of a padded() buffer, zeros behind their ends."""
    words, place, shift = b.view("<u8"), at >> 3, ((at & 7) << 3).astype(np.uint64)
    back, mask = np.uint64(63) - shift, np.minimum(size, 16)
    low, high, more = words.take(place), words.take(place + 1), words.take(place + 2)
    low >>= shift
    low |= (high << np.uint64(1)) << back
    low &= _LOW.take(mask)
    high >>= shift
    high |= (more << np.uint64(1)) << back
    high &= _HIGH.take(mask)
    return low, high


def mix(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    x = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def one_of_each(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of different keys, all but those whose mix another key has."""
    return np.unique(mix(low, high), return_index=True)[1]


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """All positions from each start to before its stop."""
    size = stop - start
    out = np.repeat(start - (np.cumsum(size) - size), size)
    return out + np.arange(len(out))


class Table:
    """Keys with values that are not 0. It grows by itself."""

    def __init__(self, bits: int = 16):
        self._room(bits)
        self.kept = 0

    def _room(self, bits: int) -> None:
        self.bits, self.last = bits, (1 << bits) - 1
        self.rows = np.zeros((1 << bits, 4), np.uint64)  # key, value (0: empty), nothing: a row stays within a line of the processor's cache
        self.low, self.high, self.value = self.rows[:, 0], self.rows[:, 1], self.rows[:, 2].view(np.int64)

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - self.bits)).astype(np.intp)

    def put(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> None:
        """Adds different keys that the table does not hold."""
        self.kept += len(value)
        while self.kept > 1 << self.bits - 1:
            held = np.flatnonzero(self.value)
            low, high, value = np.append(low, self.low[held]), np.append(high, self.high[held]), np.append(value, self.value[held])
            self._room(self.bits + 1)
        slot = self._slot(mix(low, high))
        while len(value):
            free = np.flatnonzero(self.value[slot] == 0)
            self.value[slot[free]] = value[free]  # of several at one place one stays
            won = free[self.value[slot[free]] == value[free]]
            self.low[slot[won]], self.high[slot[won]] = low[won], high[won]
            lost = np.ones(len(value), bool)
            lost[won] = False
            low, high, value, slot = low[lost], high[lost], value[lost], (slot[lost] + 1) & self.last

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Values of keys, 0 for those that the table does not hold."""
        slot = self._slot(mix(low, high))
        rows = self.rows.take(slot, 0)
        value = rows[:, 2].view(np.int64).copy()
        rest = np.flatnonzero((rows[:, 0] != low) | (rows[:, 1] != high))
        on = rest[value[rest] != 0]
        value[rest] = 0
        rest, slot = on, slot[on]
        while len(rest):
            slot = (slot + 1) & self.last
            rows = self.rows.take(slot, 0)
            got = rows[:, 2].view(np.int64)
            hit = (rows[:, 0] == low[rest]) & (rows[:, 1] == high[rest])
            value[rest[hit]] = got[hit]
            on = np.flatnonzero(~hit & (got != 0))
            rest, slot = rest[on], slot[on]
        return value
