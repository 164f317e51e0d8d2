"""Nearest training rows and kernels of a query set against all rows, block against block.

Both sides are packed into rows of many values. Packed training rows fall into slots, each block of queries goes to every
slot, and the two meet by an equality of slots: one plan and one pass whatever the number of queries, nothing broadcast
or collected, and the work spread over as many tasks as there are pairs of block and slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Rows of a packed block of queries and of training rows.
QUERY_BLOCK, TRAIN_BLOCK = 4096, 65536


def _packed(df: DataFrame, block: int, kinds: list[type]) -> DataFrame:
    """df's columns as binaries of at most `block` rows each; a column of arrays is a matrix, row by row."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in names]
        size = 0

        def done(part: list[np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(names, part, strict=True)} | {"rows": [len(part[0])]})

        for batch in batches:
            if not batch.num_rows:
                continue
            for into, column, kind in zip(held, batch.columns, kinds, strict=True):
                into.append(np.array(column.to_pylist(), kind))
            size += batch.num_rows
            if size >= block:
                whole = [np.concatenate(x) for x in held]
                for a in range(0, size - block + 1, block):
                    yield done([x[a : a + block] for x in whole])
                held, size = [[x[size - size % block :]] for x in whole], size % block
        if size:
            yield done([np.concatenate(x) for x in held])

    return df.mapInArrow(run, ", ".join([*(f"`{n}` binary" for n in names), "rows long"]))


def _against(train: DataFrame, queries: DataFrame, key: str, value: str, kind: type, result: str, combine: Callable[[Column], Column], work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Per distinct query key and value the combination of work(queries, training rows) over all training rows, one number per query."""
    valid = F.col(value).isNotNull()
    rows = stored(_packed(train.select(value).where(valid), TRAIN_BLOCK, [kind]).toDF("train", "n"), "packed-rows")
    asked = stored(_packed(queries.select(F.col(key).cast("long"), value).where(valid & F.col(key).isNotNull()), QUERY_BLOCK, [np.int64, kind]).toDF("keys", "values", "m"), "packed-queries")
    slots = max(1, rows.count())
    slotted = rows.withColumn("slot", F.pmod(F.xxhash64("train"), F.lit(slots)))
    pairs = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).join(slotted, "slot").select("keys", "values", "m", "train", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, values, m, rows, n in zip(*(batch.column(i) for i in range(5)), strict=True):
                q = np.frombuffer(values.as_buffer(), kind).reshape(m.as_py(), -1)
                t = np.frombuffer(rows.as_buffer(), kind).reshape(n.as_py(), -1)
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.frombuffer(keys.as_buffer(), np.int64)), "part": pa.array(work(q, t))})

    return pairs.mapInArrow(run, "key long, part double").groupBy("key").agg(combine(F.col("part")).alias(result))


_BLOCK = "block long, low int, high int, some long, every long, first long, keys binary, values binary"


def _sorted_blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """key and value as blocks of neighbours by bit count and bits: with the bounds of the counts and the bits that some or all rows have."""
    ordered = df.repartitionByRange(F.bit_count("value"), "value").sortWithinPartitions(F.bit_count("value"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, keys, values = TaskContext.get().partitionId() << 32, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def done(k: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            count = np.bitwise_count(v)
            ints = {"low": pa.array([int(count.min())], pa.int32()), "high": pa.array([int(count.max())], pa.int32())}
            return pa.RecordBatch.from_pydict({"block": [number]} | ints | {"some": [int(np.bitwise_or.reduce(v))], "every": [int(np.bitwise_and.reduce(v))], "first": [int(v[0])], "keys": pa.array([k.tobytes()], pa.binary()), "values": pa.array([v.tobytes()], pa.binary())})

        for batch in batches:
            keys, values = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([values, batch.column(1).to_numpy()])
            while len(values) >= size:
                yield done(keys[:size], values[:size])
                keys, values = keys[size:], values[size:]
        if len(values):
            yield done(keys, values)

    return stored(ordered.mapInArrow(run, _BLOCK), name)


def similarity_bound(q: str, t: str) -> Column:
    """The largest Tanimoto similarity that a row of block q may have to one of block t: most common bits over fewest bits of either."""
    c = lambda side, name: F.col(f"{side}_{name}")
    both = F.least(F.bit_count(c(q, "some").bitwiseAND(c(t, "some"))), c(q, "high"), c(t, "high"))
    lone = lambda x, y: F.bit_count(c(x, "every").bitwiseAND(F.bitwise_not(c(y, "some"))))
    either = F.greatest(c(q, "low") + lone(t, q), c(t, "low") + lone(q, t), F.lit(1))
    return F.least(F.lit(1.0), both / either)


def _bounds(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """q, t (blocks), bound and apart (how far the first bits lie) of every pair of blocks: a few numbers each, no payload."""
    slots = max(1, rows.count())
    names = ["block", "low", "high", "some", "every", "first"]
    left = asked.select(*[F.col(n).alias(f"q_{n}") for n in names]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    right = rows.select(*[F.col(n).alias(f"t_{n}") for n in names]).withColumn("slot", F.pmod(F.xxhash64("t_block"), F.lit(slots)))
    pairs = left.join(right, "slot")
    return pairs.select(F.col("q_block").alias("q"), F.col("t_block").alias("t"), similarity_bound("q", "t").alias("bound"), F.abs(F.col("q_first").cast("double") - F.col("t_first").cast("double")).alias("apart"))


def _best(pairs: DataFrame, asked: DataFrame, rows: DataFrame, own: bool) -> DataFrame:
    """key and part, the largest similarity of each query of the pairs (q, t) of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, values, times, train in zip(*batch.columns, strict=True):
                q, t, n = (np.frombuffer(v.as_buffer(), np.int64) for v in (values, train, times))
                count, size, out = np.bitwise_count(q).astype(np.int64), np.bitwise_count(t).astype(np.int64), np.zeros(len(q))
                for a in range(0, len(t), 256):
                    both = np.bitwise_count(q[:, None] & t[None, a : a + 256]).astype(np.int64)
                    found = both / np.maximum(count[:, None] + size[None, a : a + 256] - both, 1)
                    if own:
                        # The query's own row is no neighbour; other rows of the same bits are.
                        found[(q[:, None] == t[None, a : a + 256]) & (n[None, a : a + 256] < 2)] = 0
                    out = np.maximum(out, found.max(axis=1))
                yield pa.RecordBatch.from_pydict({"key": pa.array(np.frombuffer(keys.as_buffer(), np.int64)), "part": pa.array(out)})

    sides = pairs.select("q", "t").join(asked.select(F.col("block").alias("q"), "keys", "values"), "q").join(rows.select(F.col("block").alias("t"), F.col("keys").alias("times"), F.col("values").alias("train")), "t")
    return sides.select("keys", "values", "times", "train").mapInArrow(run, "key long, part double")


def _open_pairs(bounds: DataFrame, seeds: DataFrame, asked: DataFrame, best: DataFrame) -> DataFrame:
    """Pairs that may still hold a better neighbour: whose bound is above the least of the best similarities in the query block."""
    inside = asked.select("block", "keys")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in zip(*batch.columns, strict=True):
                k = np.frombuffer(keys.as_buffer(), np.int64)
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(k), block.as_py(), np.int64)), "key": pa.array(k)})

    least = inside.mapInArrow(listed, "q long, key long").join(best, "key", "left").groupBy("q").agg(F.min(F.coalesce("part", F.lit(0.0))).alias("least"))
    return bounds.join(least, "q").where("bound > least").join(seeds.select("q", "t"), ["q", "t"], "left_anti").select("q", "t")


def nearest_tanimoto(train: DataFrame, queries: DataFrame, key: str, bits: str, threshold: float = 0.35, own: bool = False) -> DataFrame:
    """Per query key its largest Tanimoto similarity to any training row and whether that is below the threshold.

    Both have a long of bits, queries a long key. Keys with several values get the largest of all. Both outputs are null
    for a query without a value or if there are no training rows. own: queries are training rows, and a row is not its own neighbour
    (equal bits of another row are).

    Training rows of equal bits are one. Both sides lie in blocks of neighbours; each query block first meets the training
    block of the highest bound, and then only those whose bound is above the least similarity found in it. Pairs are skipped
    by what the bits allow, so the answer is that of all pairs.
    """
    valid = F.col(bits).isNotNull()
    rows = _sorted_blocks(train.where(valid).groupBy(F.col(bits).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("key")).select("key", "value"), TRAIN_BLOCK, "near-rows")
    asked = _sorted_blocks(queries.where(valid & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(bits).cast("long").alias("value")), QUERY_BLOCK, "near-queries")
    bounds = stored(_bounds(asked, rows), "near-bounds")
    seeds = stored(bounds.groupBy("q").agg(F.min_by("t", F.struct(-F.col("bound"), "apart", "t")).alias("t")), "near-seeds")
    first = stored(_best(seeds, asked, rows, own).groupBy("key").agg(F.max("part").alias("part")), "near-first")
    second = _best(_open_pairs(bounds, seeds, asked, first), asked, rows, own)
    found = first.unionByName(second).groupBy("key").agg(F.max("part").alias("similarity"))
    out = queries.select(F.col(key)).distinct().join(found.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left")
    return out.select(key, "similarity", (F.col("similarity") < threshold).alias("ood"))


def kernel_sums(train: DataFrame, queries: DataFrame, key: str, vector: str, gamma: float, columns: int = 1) -> DataFrame:
    """Per query key the sum over all training rows of exp(-gamma d2 / columns); 0 without training rows, null without a vector."""

    def total(q: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        for a in range(0, len(t), 1024):
            d = (q * q).sum(1)[:, None] + (t[a : a + 1024] ** 2).sum(1)[None, :] - 2 * q @ t[a : a + 1024].T
            out += np.exp(-gamma * np.maximum(d, 0) / columns).sum(axis=1)
        return out

    found = _against(train, queries, key, vector, np.float64, "kernel_sum", F.sum, total)
    asked = queries.groupBy(key).agg(F.max(F.col(vector).isNotNull()).alias("_valid"))
    out = asked.join(found.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left")
    return out.select(key, F.coalesce("kernel_sum", F.when(F.col("_valid"), F.lit(0.0))).alias("kernel_sum"))
