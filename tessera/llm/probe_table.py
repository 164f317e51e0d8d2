"""A frozen map from 64-bit keys to row numbers, probed for whole arrays at a time."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_EMPTY = _U(2**64 - 1)


class ProbeTable:
    """Linear probing over a power of two of slots, at most half full. Keys must be distinct."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, _EMPTY, _U)
        self.rows = np.zeros(1 << bits, np.int32)
        self.last = -1
        todo, at = np.arange(len(keys)), self._home(keys)
        if (lost := np.flatnonzero(keys == _EMPTY)).size:
            # The mark of an empty slot may itself be a key.
            self.last = int(lost[0])
            todo, at = np.delete(todo, lost), np.delete(at, lost)
        while todo.size:
            free = self.slots[at] == _EMPTY
            # Of several keys for one free slot the first written stays.
            place, first = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.slots[place] = keys[todo[chosen]]
            self.rows[place] = todo[chosen]
            rest = np.ones(len(todo), bool)
            rest[chosen] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        at = self._home(keys)
        slot = self.slots[at]
        out = np.where(slot == keys, self.rows[at], np.int32(-1))
        todo = np.flatnonzero((slot != keys) & (slot != _EMPTY))
        at = at[todo]
        while todo.size:
            at = (at + 1) & self.mask
            slot = self.slots[at]
            hit = slot == keys[todo]
            out[todo[hit]] = self.rows[at[hit]]
            go = ~hit & (slot != _EMPTY)
            todo, at = todo[go], at[go]
        if self.last >= 0 or (keys == _EMPTY).any():
            out[keys == _EMPTY] = self.last
        return out
