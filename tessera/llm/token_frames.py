"""Token ids in binary shards: independent zstandard frames, a trailing seek table and a checksum per frame.

A shard holds, one after another: data frames (ids of whole documents, little-endian, some FRAME_BYTES each), an index
frame (per document: id, whether it has one, count of ids, frame, offset in ids), and the public seekable format's table
as a skippable frame: per frame its compressed and plain size and the low 32 bits of the XXH64 of its plain bytes.
`read_documents(path, wanted)` reads the table, the index and only the frames of the documents asked for.

`write_shards(df, tokenizer, path)` returns the manifest, one row per shard; shards are ranges of doc_id, ascending, and
so are the documents within each. `read_shards(manifest)` gives a row per document.

Defined results: a null text counts as empty and has the end id only; doc_id is cast to a 64-bit integer (what can't be is
null); a null doc_id comes before all others; rows that share a doc_id stay and follow each other by their ids; other
columns are not written; an empty table gives no shards and an empty result. A task streams its shard to the shared
folder under a name of its own attempt; only the manifest's names count, so a lost or repeated task does no harm.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import byte_blocks, map_batches, raw_bytes, shared_folder, stored, text_or_empty
from .word_bpe import encoder

END_ID = 2
FRAME_BYTES, LEVEL = 1 << 18, 3
#: Bytes of texts that are encoded at a time.
WORKED_BYTES = 1 << 20
# Fixed values of the public seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_HEAD = struct.Struct("<4sII")
_INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("count", "<u4"), ("frame", "<u4"), ("offset", "<u4")])
MANIFEST = "shard int, path string, documents long, tokens long"


class FrameWriter:
    """Writes one shard to an open binary file."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple] = []
        self.parts: list[bytes] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        count = len(ids) // self.width
        self.index.append((doc_id or 0, doc_id is not None, count, len(self.frames), self.size // self.width))
        self.parts.append(ids)
        self.size += len(ids)
        self.tokens += count
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.parts:
            self._frame(b"".join(self.parts))
            self.parts, self.size = [], 0

    def _frame(self, plain: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        self._frame(_HEAD.pack(b"TSRA", self.width, len(self.index)) + np.array(self.index, _INDEX).tobytes())
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Random access to one shard: file needs seek() and read()."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & 0x80:
            raise ValueError("no seek table with checksums")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        head = self.frame(n - 1)
        mark, self.width, count = _HEAD.unpack(head[: _HEAD.size])
        if mark != b"TSRA":
            raise ValueError("no index frame")
        self.index = np.frombuffer(head, _INDEX, count, _HEAD.size)

    def frame(self, i: int) -> bytes:
        packed, plain, check = self.table[i].tolist()
        self.file.seek(int(self.at[i]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=max(plain, 1))
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} does not match its checksum")
        return data

    def documents(self, rows: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of index rows in file order; frames without such rows are not read."""
        data, held = b"", -1
        for i in range(len(self.index)) if rows is None else rows.tolist():
            doc_id, has_id, count, frame, offset = self.index[i].tolist()
            if frame != held:
                data, held = self.frame(frame), frame
            yield doc_id if has_id else None, np.frombuffer(data, f"<u{self.width}", count, offset * self.width)


def read_documents(uri: str, wanted: list[int]) -> dict[int, list[np.ndarray]]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as f:
        shard = FrameReader(f, f.size())
        rows = np.flatnonzero(np.isin(shard.index["doc_id"], wanted) & (shard.index["has_id"] == 1))
        out: dict[int, list[np.ndarray]] = {}
        for doc_id, ids in shard.documents(rows):
            out.setdefault(doc_id, []).append(ids)
    return out


def encoded(df: DataFrame, tokenizer: str, bounds: list[int]) -> DataFrame:
    """doc_id, its shard (by bounds, ascending) and its ids with the end id."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        words = encoder(tokenizer)
        end = np.array([END_ID], words.width).tobytes()
        edges = np.array(bounds, np.int64)
        for block in byte_blocks(batch, "text", WORKED_BYTES):
            doc_id = block.column("doc_id")
            shard = np.searchsorted(edges, doc_id.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
            e = words.encode(*raw_bytes(block.column("text")))
            ids, at, width = e.ids.tobytes(), e.at.tolist(), words.width.itemsize
            rows = [ids[a * width : b * width] + end for a, b in zip(at[:-1], at[1:], strict=True)]
            yield {"doc_id": doc_id, "shard": pa.array(shard, pa.int32()), "ids": pa.array(rows, pa.binary())}

    return map_batches(df.select(F.col("doc_id").try_cast("long"), text_or_empty().alias("text")), step, "doc_id long, shard int, ids binary")


def write_shards(df: DataFrame, tokenizer: str, path: str, shards: int | None = None) -> DataFrame:
    """Writes df's documents below path in shards (as many as df has partitions) and returns the stored manifest."""
    shards = shards or max(1, df.rdd.getNumPartitions())
    # Quantiles of doc_id alone: a range exchange would encode every text twice to sample the keys.
    ids = df.select(F.col("doc_id").try_cast("long").cast("double").alias("doc_id"))
    # As doubles, the largest ids round up beyond 64 bits.
    bounds = sorted({min(int(q), 2**63 - 1) for q in ids.approxQuantile("doc_id", [i / shards for i in range(1, shards)], 0.25 / shards)}) if shards > 1 else []
    ordered = encoded(df, tokenizer, bounds).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    folder = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer).width.itemsize
        writer = out = name = held = None

        def done() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([held], pa.int32()), "path": [name], "documents": pa.array([len(writer.index)], pa.int64()), "tokens": pa.array([writer.tokens], pa.int64())})

        for batch in batches:
            for doc_id, shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if shard != held:
                    if writer:
                        yield done()
                    held, name = shard, f"{folder}/shard-{shard:06d}-{TaskContext.get().taskAttemptId()}.zst"
                    fs, at = pafs.FileSystem.from_uri(name)
                    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(at, compression=None)
                    writer = FrameWriter(out, width)
                writer.add(doc_id, ids.as_py())
        if writer:
            yield done()

    # Rebalanced: a row from each task would be a file each.
    return stored(ordered.mapInArrow(run, MANIFEST).hint("rebalance"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as 32-bit integers), from the files."""
    # One row per shard: the running sum is over the manifest, not over documents.
    starts = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    shards = max(1, manifest.count())

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                shard = FrameReader(f, f.size())
                ids_of, crc = [], []
                for doc_id, ids in shard.documents():
                    ids_of.append(doc_id)
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                count = shard.index["count"].astype(np.int64)
                yield {"doc_id": pa.array(ids_of, pa.int64()), "start": pa.array(start + np.cumsum(count) - count), "n_tokens": pa.array(count), "ids_crc32": pa.array(crc, pa.int64())}

    return map_batches(starts.select("shard", "path", "start").repartitionById(shards, "shard"), step, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(df: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's row per document, read back from the written shards."""
    return read_shards(write_shards(df, tokenizer, shared_folder(df.sparkSession, "token-shards")))
