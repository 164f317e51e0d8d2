"""What every operator of this subpackage shares: null rules, Arrow batches and the shared folder."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dropped, shared_folder, stored

__all__ = ["BLOCK_BYTES", "bounded", "byte_blocks", "dropped", "give_back", "id_remainder", "map_batches", "masked", "raw_bytes", "schema_of", "shared_folder", "stored", "table", "text_or_empty"]

#: A sub-batch of texts is closed at this many bytes, whatever the Arrow batch holds.
BLOCK_BYTES = 4 << 20


#: Arrow batches between the JVM and its workers, which both hold several.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH_BYTES at most (Spark's default is 64 MB)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = spark.conf.get(key)
    if not size.rstrip("b").isdigit() or int(size.rstrip("b")) > BATCH_BYTES or int(size.rstrip("b")) <= 0:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def masked(df: DataFrame, *kept: str) -> DataFrame:
    """df with numbers for names, but for the kept ones: columns that are added clash with none, toDF(*df.columns) undoes it."""
    return df.toDF(*(c if c in kept else f"c{i}" for i, c in enumerate(df.columns)))


def schema_of(df: DataFrame) -> str:
    """The schema of df as text, for mapInArrow; any name may stand in it."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def give_back() -> None:
    """Returns to the system what Arrow and the C library hold in reserve: a worker lives on beside those of other tasks."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


@functools.lru_cache
def _trim() -> Callable[[int], int] | None:
    """malloc_trim, where the C library has it."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, last: Callable[[], None] | None = None) -> DataFrame:
    """mapInArrow with a step from one batch to dicts of output columns; last() is called when a task is done."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for columns in step(batch.rename_columns(names)):
                    yield pa.RecordBatch.from_pydict(columns)
                give_back()
        if last:
            last()
        give_back()

    # Names with dots or backticks are no columns to mapInArrow.
    return masked(df).mapInArrow(run, schema)


def byte_blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about limit bytes each (one text at least)."""
    values = batch.column(column)
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def raw_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a non-null string column end to end, and the offsets of its rows."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    data = values.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
