"""Encoding with a BPE file of the tokenizers library, exact and with each piece of text encoded once per worker.

The rules that make reuse exact. The file's normalizer folds runs of white space to one blank, its pre-tokenizer never
joins over white space and drops it, and no canonical composition crosses an ASCII blank. So the ids of a text are the
ids of its words (what stands between ASCII blanks), one after another. A word of ASCII and Latin-1 letters, digits and
ASCII marks falls into pieces by the pre-tokenizer's pattern: runs of letters, single digits, runs of marks; composition
changes none of them and lowering goes letter by letter. Any other word (apostrophes, `<|`, control characters, all
other alphabets) is a piece by itself and is given to the library as it stands. `checked()` refuses files of other kinds.
"""

from __future__ import annotations

import functools
import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .piece_table import LONGEST, PieceTable
from .runtime import raw_bytes

#: Pieces that one worker remembers (some 100 bytes each); beyond, it starts anew.
CACHED_PIECES = 1_500_000
#: Bytes of a text that are split into pieces at a time.
SPAN_BYTES = 1 << 20
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _classes() -> np.ndarray:
    """The class of each (lowered) byte; of 0xC3 and what follows it in split()."""
    out = np.full(256, _OTHER, np.uint8)
    out[33:127] = _MARK
    out[48:58] = _DIGIT
    out[97:123] = out[65:91] = _LETTER
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    out[ord("'")] = _OTHER
    return out


def _letters() -> np.ndarray:
    """The letter that stands for each byte: itself where it prints in Latin-1, else the next one from U+0100 on. A blank stays."""
    prints = [33 <= b <= 126 or 161 <= b <= 172 or b >= 174 for b in range(256)]
    more = iter(range(256, 512))
    out = np.array([b if p else next(more) for b, p in enumerate(prints)], "<u2")
    out[32] = 32
    return out


_CLASS, _LETTERS = _classes(), _letters()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# What the supported files' normalizers and pre-tokenizers consist of, and the end of a word.
NORMALIZER, PRE_TOKENIZER, WORD_END = ("NFC", "Replace", "Lowercase"), ("Split", "ByteLevel"), "</w>"


def checked(path: str) -> None:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps, parts = (spec.get("normalizer") or {}).get("normalizers") or [{}], (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = parts[0]
    pattern = (split.get("pattern") or {}).get("Regex", "")
    kinds = tuple(x.get("type") for x in steps) == NORMALIZER and tuple(x.get("type") for x in parts) == PRE_TOKENIZER
    ends = spec["model"].get("end_of_word_suffix") == WORD_END
    if not kinds or not ends or split.get("behavior") != "Removed" or not split.get("invert") or r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" not in pattern or spec.get("post_processor") or spec.get("decoder"):
        raise ValueError("only files that drop white space between pre-tokens, without post-processor and decoder, are supported")


@dataclass
class Pieces:
    """Piece i is data[start[i]:end[i]]; word w has pieces first[w]:first[w + 1] and is at word_start[w]:word_end[w]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hard: np.ndarray
    word_start: np.ndarray
    word_end: np.ndarray


def split(raw: np.ndarray, bounds: np.ndarray) -> Pieces:
    """Words end at blanks and at bounds (sorted offsets); hard words are one piece each, with the bytes they came with."""
    low = _LOWER[raw]
    kind = _CLASS[low]
    # Latin-1 letters are 0xC3 and one more byte; upper-case ones are 32 below their lower-case forms.
    lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)
    if lead.size:
        second = raw[lead + 1]
        lead = lead[(second != 0x97) & (second != 0xB7)]
        second = raw[lead + 1]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] = np.where(second <= 0x9E, second + 32, second)
    bar = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|"))) if len(raw) else np.zeros(0, np.int64)
    kind[bar] = _OTHER
    inside = kind != _BLANK
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[bounds[bounds < len(raw)]] |= inside[bounds[bounds < len(raw)]]
    word_start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    word_end = np.flatnonzero(ends) + 1
    hard = np.zeros(len(word_start), bool)
    other = np.flatnonzero(kind == _OTHER)
    if other.size:
        hard[np.searchsorted(word_start, other, "right") - 1] = True
        edge = np.zeros(len(raw) + 1, np.int8)
        edge[word_start[hard]] = 1
        edge[word_end[hard]] -= 1
        whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        low[whole] = raw[whole]
        kind[whole] = _OTHER
    if len(raw):
        cut = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        begins[1:] |= cut & inside[1:]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, word_start)
    word = np.repeat(np.arange(len(word_start)), np.diff(np.append(first, len(start))))
    end = np.minimum(np.append(start[1:], len(raw)), word_end[word])
    return Pieces(low, start, end, np.append(first, len(start)), hard[word], word_start, word_end)


@dataclass
class Encoded:
    """ids of all rows end to end; row r has ids[at[r]:at[r + 1]]; word w is bytes word_start[w]:word_end[w] and its ids begin at word_at[w]."""

    ids: np.ndarray
    at: np.ndarray
    word_start: np.ndarray
    word_end: np.ndarray
    word_at: np.ndarray


class WordEncoder:
    """encode(data, offsets) gives for each row what the library gives for the whole text."""

    def __init__(self, path: str, pieces: int = CACHED_PIECES):
        self.most = pieces
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        checked(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The file's model alone, for pieces (in the letters that stand for bytes) that need none of the steps before it.
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        size = self.tokenizer.get_vocab_size()
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        #: What decode() gives for each id, and whether a piece ends with it.
        self.texts = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.closes = np.array([t.endswith(WORD_END.encode()) for t in self.texts])
        self.known = PieceTable(self.width)

    def _library(self, words: list[bytes], hard: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has: of hard ones by the whole tokenizer, of others by its model."""
        if hard:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], self.width), np.array([len(ids) for ids in each], np.int64)
        text = _LETTERS[np.frombuffer(b" ".join(words), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.width)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            raise ValueError("the model gave pieces without an end")
        return ids, np.diff(ends, prepend=0)

    def _one(self, word: bytes, hard: bool) -> list[int]:
        return self._library([word], hard)[0].tolist()

    def _rows(self, p: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every piece where its ids begin in the pool and how many there are; the pool (to be read before the next call)."""
        short = p.end - p.start <= LONGEST
        every = short.all()
        start, end, hard = (p.start, p.end, p.hard) if every else (p.start[short], p.end[short], p.hard[short])
        found, h = self.known.find(p.data, start, end)
        missing = np.flatnonzero(found == -1)
        if missing.size:
            if self.known.n + missing.size > self.most:
                # As many more at most; counted exactly only where that may matter.
                if self.known.n + len(np.unique(h[missing])) > self.most:
                    self.known.clear()
                    found[:] = -1
                    missing = np.arange(len(found))
            _, pick = np.unique(h[missing], return_index=True)
            pick = missing[pick]
            raw = p.data.tobytes()
            for group in (False, True):
                new = pick[hard[pick] == group]
                if new.size:
                    a, b = start[new], end[new]
                    self.known.add(p.data, a, b, h[new], *self._library([raw[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)], group))
            found[missing] = self.known.find(p.data, start[missing], end[missing])[0]
        if every and (found >= 0).all():
            return self.known.start[found], self.known.size[found], self.known.ids
        # Long pieces, and those of another's hash, are encoded once for this call, behind the known ones in the pool.
        row = np.full(len(p.start), -2, np.int64)
        row[short] = found
        apart = np.flatnonzero(row < 0)
        raw = p.data.tobytes()
        words = [(raw[i:j], k) for i, j, k in zip(p.start[apart].tolist(), p.end[apart].tolist(), p.hard[apart].tolist(), strict=True)]
        place: dict[tuple[bytes, bool], tuple[int, int]] = {}
        ids: list[int] = []
        for w in words:
            if w not in place:
                own = self._one(*w)
                place[w] = (self.known.used + len(ids), len(own))
                ids += own
        pool = self.known.pool(len(ids))
        pool[self.known.used : self.known.used + len(ids)] = ids
        begin, size = self.known.start[np.maximum(row, 0)], self.known.size[np.maximum(row, 0)]
        begin[apart], size[apart] = [place[w][0] for w in words], [place[w][1] for w in words]
        return begin, size, pool

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> Encoded:
        """Ids of the rows data[offsets[r]:offsets[r + 1]]; some SPAN_BYTES are split into pieces at a time."""
        ids, word_start, word_end, word_at = [], [], [], []
        held = a = 0
        while a < len(data):
            b = _end_of_span(data, offsets, a)
            p = split(data[a:b], offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a)
            if len(p.start):
                begin, size, pool = self._rows(p)
                upto = np.cumsum(size, dtype=np.int64)
                ids.append(pool[np.repeat(begin - (upto - size), size) + np.arange(upto[-1])])
                word_start.append(p.word_start + a)
                word_end.append(p.word_end + a)
                word_at.append(held + (upto - size)[p.first[:-1]])
                held += int(upto[-1])
            a = b
        if not ids:
            none = np.zeros(0, np.int64)
            return Encoded(np.zeros(0, self.width), np.zeros(len(offsets), np.int64), none, none, np.zeros(1, np.int64))
        starts, at = np.concatenate(word_start), np.append(np.concatenate(word_at), held)
        return Encoded(np.concatenate(ids), at[np.searchsorted(starts, offsets)], starts, np.concatenate(word_end), at)

    def texts_of(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of each text."""
        e = self.encode(*raw_bytes(pa.array([t.decode() for t in texts], pa.string())))
        return [e.ids[a:b].tolist() for a, b in zip(e.at[:-1].tolist(), e.at[1:].tolist(), strict=True)]

    def decoded(self, ids: np.ndarray) -> bytes:
        """What decode(ids, skip_special_tokens=False) gives."""
        return b" ".join(map(self.texts.__getitem__, ids.tolist()))


def _end_of_span(data: np.ndarray, offsets: np.ndarray, a: int) -> int:
    """The first row's end or blank at least SPAN_BYTES after a, or the end of data."""
    b = a + SPAN_BYTES
    if b >= len(data):
        return len(data)
    row = int(offsets[np.searchsorted(offsets, b)])
    step = 1 << 12
    while b < row:
        found = np.flatnonzero(_CLASS[data[b : min(b + step, row)]] == _BLANK)
        if found.size:
            return b + int(found[0]) + 1
        b += step
        step *= 2
    return row


@functools.lru_cache(maxsize=2)
def encoder(path: str, pieces: int = CACHED_PIECES) -> WordEncoder:
    """One encoder for each file, size and worker."""
    return WordEncoder(path, pieces)
