"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts each text where its high bits are all ones, so that texts that share passages
share chunks. A worker encodes a chunk once and reuses its ids for all documents that it meets. A cut may fall inside a
word, and context may reach over it, so each join is repaired: the last two words before the cut and the first two after
it are encoded together, and the new ids have to begin and end exactly as the chunks' own ids of the outer two words do.
Where they don't, the chunks on both sides are given up and the window grows over them to the next ones (at last over the
whole text), and is encoded again until both sides agree. A chunk of fewer than three words only widens the window.

`encode(df, path)` adds `ids` (array of int); `decode(df, path)` adds `decoded` from `ids`.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an empty text; texts of any length
are encoded whole; repeated rows get equal results; columns named as the outputs are replaced, others pass through; an
empty table gives an empty one. A chunk is known by 128 bits of xxh3. The store is bounded (STORE_BYTES; the chunks not met for longest go)
and each worker's own, kept from task to task: no text is shuffled for the sake of sharing.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .runtime import byte_blocks, map_batches, raw_bytes, schema_of, text_or_empty
from .word_bpe import WordEncoder, encoder

#: One cut in so many bytes; the longest chunk; what a worker's chunk store may hold.
MEAN_BYTES, MOST_BYTES, STORE_BYTES = 1024, 1 << 16, 24 << 20
#: Pieces that a worker remembers beside its chunks; ids that are rendered at a time.
PIECES, RENDERED = 600_000, 1 << 18
#: Bytes of texts that are worked on at a time: workers live on beside each other, so each holds little.
WORKED_BYTES = 1 << 19
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted offsets in data at which chunks begin or end: contents' cuts, rows' bounds and forced ones in long runs."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint32(step) if len(h) > step else 0
        h = shifted
    at = np.flatnonzero(h >= np.uint32((1 << 32) - (1 << 32) // MEAN_BYTES)) + 1
    found = np.union1d(at, offsets)
    gaps = np.diff(found)
    if (gaps > MOST_BYTES).any():
        found = np.union1d(found, np.concatenate([np.arange(a, b, MOST_BYTES) for a, b in zip(found[:-1], found[1:], strict=True) if b - a > MOST_BYTES]))
    # A cut inside a letter of several bytes moves to its end.
    for _ in range(3):
        inside = (found < len(data)) & ((data[np.minimum(found, max(len(data) - 1, 0))] & 0xC0) == 0x80) if len(data) else np.zeros(len(found), bool)
        if not inside.any():
            break
        found = np.where(inside, found + 1, found)
    return np.unique(found)


class ChunkCodec:
    """Encodes texts by reused chunks.

    Of a chunk are kept its ids (as bytes), the text up to the end of its second word, the text from its last word but
    one on, and where in the ids the second word, the last but one and the last begin and the second ends.
    """

    def __init__(self, words: WordEncoder):
        self.words = words
        self.store: dict[bytes, tuple | None] = {}
        self.older: dict[bytes, tuple | None] = {}
        self.held = 0
        self.hits = self.misses = self.regrown = 0

    def _known(self, chunks: list[bytes]) -> list[tuple | None]:
        """What is kept of each chunk (None: fewer than three words); new ones are encoded together."""
        keys = [xxhash.xxh3_128_digest(c) for c in chunks]
        known: dict[bytes, tuple | None] = {}
        new: dict[bytes, bytes] = {}
        for key, c in zip(keys, chunks, strict=True):
            if key in known or key in new:
                continue
            if key in self.store:
                known[key] = self.store[key]
            elif key in self.older:
                known[key] = self._keep(key, self.older[key])
            else:
                new[key] = c
        self.hits += len(chunks) - len(new)
        self.misses += len(new)
        for key, made in zip(new, self._encoded(list(new.values())), strict=True):
            known[key] = self._keep(key, made)
        return [known[key] for key in keys]

    def _keep(self, key: bytes, made: tuple | None) -> tuple | None:
        if self.held > STORE_BYTES // 2:
            self.older, self.store, self.held = self.store, {}, 0
        self.store[key] = made
        self.held += 400 + (len(made[0]) + len(made[1]) + len(made[2]) if made else 0)
        return made

    def _encoded(self, chunks: list[bytes]) -> Iterator[tuple | None]:
        offsets = np.cumsum([0, *map(len, chunks)])
        e = self.words.encode(np.frombuffer(b"".join(chunks), np.uint8), offsets)
        width = self.words.width.itemsize
        first, offsets = np.searchsorted(e.word_start, offsets).tolist(), offsets.tolist()
        for i, c in enumerate(chunks):
            a, b = first[i], first[i + 1]
            if b - a < 3:
                yield None
                continue
            at, start = e.word_at, offsets[i]
            begin = int(at[a])
            places = ((at[[a + 1, a + 2, b - 2, b - 1]] - begin) * width).tolist()
            yield e.ids[begin : at[b]].tobytes(), c[: e.word_end[a + 1] - start], c[e.word_start[b - 2] - start :], *places

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each row, as bytes."""
        at = cuts(data, offsets)
        raw, bounds = data.tobytes(), at.tolist()
        first = np.searchsorted(at, offsets).tolist()
        chunks = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        known = self._known(chunks)
        out: list[bytes] = [b""] * (len(offsets) - 1)
        todo = range(len(out))
        # Windows that do not agree grow by twice as many chunks each time, so a text is parted a few times, whatever its length.
        reach = 1
        while todo:
            rows = [self._parted(first[r], first[r + 1], chunks, known) for r in todo]
            windows = {w: None for _, joins in rows for w, *_ in joins}
            ids = self._joined(list(windows))
            again = []
            for r, (parts, joins) in zip(todo, rows, strict=True):
                repaired, wrong = [], False
                for window, left, right, before, after in joins:
                    own = ids[window]
                    vacuous = (before is not None and not left) or (after is not None and not right)
                    if vacuous or len(own) < len(left) + len(right) or not own.startswith(left) or not own.endswith(right):
                        # No agreement, or nothing to agree on: the neighbours on both sides become part of the window.
                        wrong = True
                        if before is not None:
                            a = max(first[r], before - reach + 1)
                            known[a : before + 1] = [None] * (before + 1 - a)
                        if after is not None:
                            b = min(first[r + 1], after + reach)
                            known[after:b] = [None] * (b - after)
                    repaired.append(own[len(left) : len(own) - len(right)])
                if wrong:
                    self.regrown += 1
                    again.append(r)
                else:
                    more = iter(repaired)
                    out[r] = b"".join([next(more) if p is None else p for p in parts])
            todo = again
            reach *= 2
        return out

    @staticmethod
    def _parted(a: int, b: int, chunks: list[bytes], known: list[tuple | None]) -> tuple[list, list]:
        """A row's parts (None: the next join) and its joins: window, ids that it has to begin and end with, chunks on both sides."""
        parts: list[bytes | None] = []
        joins = []
        open_: list[bytes] = []
        left = b""
        before = None
        for k in range(a, b):
            if known[k] is None:
                open_.append(chunks[k])
                continue
            ids, head, tail, second, third, last_but_one, last = known[k]
            joins.append((b"".join([*open_, head]), left, ids[second:third], before, k))
            parts += [None, ids[second:last]]
            open_, left, before = [tail], ids[last_but_one:last], k
        if open_:
            joins.append((b"".join(open_), left, b"", before, None))
            parts.append(None)
        return parts, joins

    def _joined(self, windows: list[bytes]) -> dict[bytes, bytes]:
        e = self.words.encode(np.frombuffer(b"".join(windows), np.uint8), np.cumsum([0, *map(len, windows)]))
        width, ids, at = self.words.width.itemsize, e.ids.tobytes(), e.at.tolist()
        return {w: ids[a * width : b * width] for w, a, b in zip(windows, at[:-1], at[1:], strict=True)}


@functools.lru_cache(maxsize=2)
def codec(path: str) -> ChunkCodec:
    """One chunk store for each file and worker."""
    return ChunkCodec(encoder(path, PIECES))


class Renderer:
    """SHA-256 of the decimals of rows of ids, and of their decoded texts; RENDERED ids are written out at a time."""

    def __init__(self, texts: list[bytes]):
        self.texts = [t + b" " for t in texts]
        self.text_size = np.array([len(t) for t in self.texts], np.int64)
        width = len(str(len(texts))) + 1
        self.digits = np.frombuffer(b"".join(f"{i} ".encode().ljust(width, b"\0") for i in range(len(texts))), np.uint8).reshape(-1, width)
        self.digit_size = (self.digits != 0).sum(axis=1)

    def _decimals(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        wide = self.digits[ids].reshape(-1)
        return wide[wide != 0].tobytes(), self.digit_size[ids]

    def _decoded(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        return b"".join(map(self.texts.__getitem__, ids.tolist())), self.text_size[ids]

    def decimals(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        return self._digests(ids, at, self._decimals)

    def decoded(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        return self._digests(ids, at, self._decoded)

    @staticmethod
    def _digests(ids: np.ndarray, at: np.ndarray, render) -> list[str]:
        """Of each row ids[at[r]:at[r + 1]], without the blank behind the last one."""
        out: list[str] = []
        r = 0
        while r < len(at) - 1:
            last = max(r + 1, int(np.searchsorted(at, at[r] + RENDERED, "right")) - 1)
            if last == r + 1:
                whole = hashlib.sha256()
                for a in range(int(at[r]), int(at[last]), RENDERED):
                    b = min(a + RENDERED, int(at[last]))
                    text = render(ids[a:b])[0]
                    whole.update(text[:-1] if b == at[last] else text)
                out.append(whole.hexdigest())
            else:
                text, size = render(ids[at[r] : at[last]])
                ends = np.concatenate([[0], np.cumsum(size)])[at[r : last + 1] - at[r]].tolist()
                out += [hashlib.sha256(text[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            r = last
        return out


@functools.lru_cache(maxsize=2)
def renderer(path: str) -> Renderer:
    return Renderer(encoder(path, PIECES).texts)


def _ids(block: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and where each begins."""
    rows = codec(path).encode(*raw_bytes(block))
    width = codec(path).words.width
    return np.frombuffer(b"".join(rows), width), np.concatenate([[0], np.cumsum([len(x) // width.itemsize for x in rows])]).astype(np.int64)


def _listed(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, path: str) -> DataFrame:
    """df with the column ids (array of int)."""
    kept = df.drop("ids").withColumn("text", text_or_empty())
    names = kept.columns

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in byte_blocks(batch, "text", WORKED_BYTES):
            yield dict(zip(names, block.columns, strict=True)) | {"ids": _listed(*_ids(block.column("text"), path))}

    return map_batches(kept, step, f"{schema_of(kept)}, ids array<int>")


def decode(df: DataFrame, path: str) -> DataFrame:
    """df with the column decoded, from ids; null ids decode to null."""
    kept = df.drop("decoded")
    names = kept.columns

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        library = encoder(path, PIECES).tokenizer
        texts = [None if x is None else library.decode(x, skip_special_tokens=False) for x in batch.column("ids").to_pylist()]
        yield dict(zip(names, batch.columns, strict=True)) | {"decoded": pa.array(texts, pa.string())}

    return map_batches(kept, step, f"{schema_of(kept)}, decoded string")


def tokenized(df: DataFrame, path: str) -> DataFrame:
    """df's columns but text, then n_tokens, ids (array of int) and decoded_sha256 (hex digest of the decoded text)."""
    kept = df.drop("n_tokens", "ids", "decoded_sha256").withColumn("text", text_or_empty())
    names = kept.columns

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in byte_blocks(batch, "text", WORKED_BYTES):
            ids, at = _ids(block.column("text"), path)
            yield {c: block.column(c) for c in names if c != "text"} | {
                "n_tokens": pa.array(np.diff(at)),
                "ids": _listed(ids, at),
                "decoded_sha256": pa.array(renderer(path).decoded(ids, at), pa.string()),
            }

    return map_batches(kept, step, ", ".join(x for x in (schema_of(kept.drop("text")), "n_tokens long, ids array<int>, decoded_sha256 string") if x))


def digest(df: DataFrame, path: str) -> DataFrame:
    """The contract's row per document, from the chunks' ids."""
    kept = df.select("doc_id", text_or_empty().alias("text"))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in byte_blocks(batch, "text", WORKED_BYTES):
            ids, at = _ids(block.column("text"), path)
            yield {
                "doc_id": block.column("doc_id"),
                "n_tokens": pa.array(np.diff(at)),
                "ids_sha256": pa.array(renderer(path).decimals(ids, at), pa.string()),
                "decoded_sha256": pa.array(renderer(path).decoded(ids, at), pa.string()),
            }

    return map_batches(kept, step, f"{schema_of(kept.select('doc_id'))}, n_tokens long, ids_sha256 string, decoded_sha256 string")
