"""Words of UTF-8 texts as NumPy arrays: positions, and a 64-bit hash of each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

from .runtime import raw_bytes

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but blanks, or letters, digits and whatever isn't ASCII (after A-Z are lowered).
NOT_BLANK = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
ALPHANUMERIC = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=_U)
_LONG = 64


@dataclass
class Words:
    """data: lowered bytes; words i spans data[start[i]:end[i]]; row r has words first[r]:first[r + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return hashes(self.data, self.start, self.end)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, joined by one space."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j], strict=True))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    h ^= h >> _U(32)
    return h


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset on (zeros behind the end) as one number each."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span: eight bytes a round; spans over _LONG bytes by xxhash."""
    eight = eights(data)
    length = end - start
    out = length.astype(_U) * _U(0x9E3779B97F4A7C15)
    out = mix(out ^ (eight[start] & KEEP[np.minimum(length, 8)]))
    active = np.flatnonzero((length > 8) & (length <= _LONG))
    done = 8
    while active.size:
        rest = length[active] - done
        out[active] = mix(out[active] ^ (eight[start[active] + done] & KEEP[np.minimum(rest, 8)]))
        active = active[rest > 8]
        done += 8
    for i in np.flatnonzero(length > _LONG):
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def scan(texts: pa.Array, word: np.ndarray) -> Words:
    """Words of each text of a column without nulls; word says which (lowered) bytes belong to words."""
    raw, offsets = raw_bytes(texts)
    data = _LOWER[raw]
    inside = word[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        starts[heads] = inside[heads]
        tails = offsets[1:][offsets[1:] > 0] - 1
        ends[tails] = inside[tails]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def runs(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs that lie within a row (a row with 1 to k - 1 words: its whole sequence); rows' offsets."""
    n = np.diff(first)
    if not len(h):
        return np.zeros(0, _U), np.zeros(len(first), np.int64)
    order = np.zeros(len(h) + k, _U)
    for i in range(k):
        shifted = np.zeros(len(h), _U)
        shifted[: len(h) - i] = h[i:]
        order[: len(h)] = mix(order[: len(h)] * _U(0x9E3779B97F4A7C15) + shifted + _U(i + 1))
    counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(first[:-1], counts)
    out = order[at]
    for r in np.flatnonzero((n > 0) & (n < k)):
        v = np.zeros(1, _U)
        for i in range(k):
            v = mix(v * _U(0x9E3779B97F4A7C15) + (h[first[r] + i : first[r] + i + 1] if i < n[r] else _U(0)) + _U(i + 1))
        out[offsets[r]] = v[0]
    return out, offsets
