"""A growing map from short byte strings to lists of token ids, probed for whole arrays at a time and exact.

Strings are found by a 64-bit hash and then compared in full, eight bytes at a time; two strings of one hash are told
apart (the second is reported as such, never as the first).
"""

from __future__ import annotations

import numpy as np

from .words import KEEP, eights, hashes

#: The longest string that is kept, in bytes and in rounds of eight.
LONGEST, ROUNDS = 32, 4
_U = np.uint64


class PieceTable:
    """Row r stands for a string of length[r] bytes, and for ids[start[r] : start[r] + size[r]]."""

    def __init__(self, width: np.dtype):
        self.width = width
        self.clear()

    def clear(self) -> None:
        self.n = self.used = 0
        self.hash, self.length = np.zeros(1024, _U), np.zeros(1024, np.uint8)
        self.parts = np.zeros((1024, ROUNDS), _U)
        self.start, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, self.width)
        self._slots(12)

    def _slots(self, bits: int) -> None:
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row of each string (of LONGEST bytes at most), -1 for unknown ones, -2 for those whose hash is another's; and their hashes."""
        h = hashes(data, start, end)
        at = self._home(h)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.hash[out] != h))
        at = at[todo]
        while todo.size:
            at = (at + 1) & self.mask
            row = self.slots[at]
            out[todo] = row
            go = (row >= 0) & (self.hash[row] != h[todo])
            todo, at = todo[go], at[go]
        self._compared(out, eights(data), start, end - start)
        return out, h

    def _compared(self, out: np.ndarray, eight: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Sets out to -2 where the row's string is another one."""
        out[(out >= 0) & ((self.length[out] != length) | (self.parts[out, 0] != (eight[start] & KEEP[np.minimum(length, 8)])))] = -2
        for r in range(1, ROUNDS):
            on = np.flatnonzero((length > 8 * r) & (out >= 0))
            if not on.size:
                break
            part = eight[start[on] + 8 * r] & KEEP[np.minimum(length[on] - 8 * r, 8)]
            out[on[self.parts[out[on], r] != part]] = -2

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Strings of distinct hashes that aren't here yet, and their ids end to end."""
        n, length, eight = len(h), end - start, eights(data)
        self._room(n, len(ids))
        rows = np.arange(self.n, self.n + n)
        self.hash[rows], self.length[rows], self.size[rows] = h, length, size
        self.start[rows] = self.used + np.cumsum(size) - size
        for r in range(ROUNDS):
            on = length > 8 * r
            self.parts[rows[on], r] = eight[start[on] + 8 * r] & KEEP[np.minimum(length[on] - 8 * r, 8)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += n
        self._placed(rows)

    def _room(self, n: int, ids: int) -> None:
        if (need := self.n + n) > len(self.hash):
            for name in ("hash", "length", "parts", "start", "size"):
                old = getattr(self, name)
                new = np.zeros((max(need, 3 * len(old) // 2), *old.shape[1:]), old.dtype)
                new[: self.n] = old[: self.n]
                setattr(self, name, new)
        self.pool(ids)
        if 2 * need > len(self.slots):
            self._slots(int(2 * need).bit_length())
            self._placed(np.arange(self.n))

    def pool(self, more: int) -> np.ndarray:
        """The ids' array, with room for more behind those in use."""
        if self.used + more > len(self.ids):
            new = np.zeros(max(self.used + more, 3 * len(self.ids) // 2), self.width)
            new[: self.used] = self.ids[: self.used]
            self.ids = new
        return self.ids

    def _placed(self, rows: np.ndarray) -> None:
        at = self._home(self.hash[rows])
        while rows.size:
            free = np.flatnonzero(self.slots[at] < 0)
            # Of several rows for one free slot the last written stays.
            self.slots[at[free]] = rows[free]
            rest = self.slots[at] != rows
            rows, at = rows[rest], (at[rest] + 1) & self.mask
