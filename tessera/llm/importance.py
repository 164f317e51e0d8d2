"""Target-distribution importance resampling over an integer word dictionary.

Documents are drawn as if they came from the target's distribution of hashed n-grams: a bucket's gain is the logarithm of its
share in the target over its share in the corpus, a document's weight the mean gain of its features, and the highest sums of
weight and Gumbel noise are drawn.

1. Texts are split into words block by block; a block keeps its distinct words, its distinct n-grams as tuples of word numbers,
   and each document's features as numbers of those.
2. Blocks' words meet by word, get one id and are hashed in one of their rows: the dictionary. Blocks' tuples are restated in ids.
3. Each distinct tuple's bytes are put together from the dictionary and hashed once (a word is its own tuple), and the bucket is joined
   back to the blocks' counts, which add up to those of buckets and give the gains.
4. Gains go back to the blocks, where the documents' features are summed.

A word that every text has is in one row of each block, so no key is hotter than the number of blocks. Tables: blocks
(stored once), their distinct words and tuples, 10,000 buckets (the only broadcast).

Null texts have no words: no features, weight 0. A null doc_id is hashed as the empty text and ranks last among ties. Repeated rows
get the same values and ranks of their own. A text of any length is one block. An empty table gives no rows, an empty target gains
by the corpus alone. Columns of any name pass through `resampled`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import byte_blocks, give_back, masked, schema_of, stored, text_or_empty
from .words import ALPHANUMERIC, scan

BUCKETS, SCALE = 10_000, 1000
SEED = "2024"
#: Words that a document needs to be drawn; per cent of those documents that are.
LEAST_WORDS, PER_CENT = 20, 10
#: Bytes of text in a block: its row stays below a few MB.
BLOCK = 4 << 20
#: Gains are packed as numbers of 32 bits.
_MIDDLE = 1 << 31


def _width(distinct: int) -> str:
    return "<u2" if distinct <= 1 << 16 else "<u4"


def _dictionary(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Each word's number among the distinct words, those words, and the rows' offsets."""
    words = scan(texts, ALPHANUMERIC)
    length = words.end - words.start
    ends = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(ends[-1]) + np.repeat(words.start - ends[:-1], length)
    column = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(words.data[at])])
    coded = column.dictionary_encode()
    return np.asarray(coded.indices, np.int64), coded.dictionary.cast(pa.large_string()).cast(pa.string()), words.first


def _tuples(number: np.ndarray, first: np.ndarray, longest: int, distinct: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Distinct tuples of 2 to `longest` numbers, and all features of all rows (numbers of words, then of tuples) with their rows."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    features, owners, found, before = [number], [rows], [], distinct
    run = number
    for k in range(2, longest + 1):
        # The number of a run of k - 1 words and the next word's make one of k, if both lie in one row.
        if len(number) < k:
            break
        inside = rows[: len(number) - k + 1] == rows[k - 1 :]
        pairs = run[: len(number) - k + 1] * distinct + number[k - 1 :]
        kept = np.flatnonzero(inside)
        _, at, run_of = np.unique(pairs[kept], return_index=True, return_inverse=True)
        found.append(number[kept[at][:, None] + np.arange(k)])
        run = np.zeros(len(inside), np.int64)
        run[kept] = run_of
        features.append(run_of + before)
        owners.append(rows[kept])
        before += len(at)
    return found, np.concatenate(features), np.concatenate(owners)


def blocks(docs: DataFrame, target: DataFrame, longest: int) -> DataFrame:
    """Both sides' texts (column `text`, others are kept) as rows of block, side, rows, n_words, n_features, features, words, tuples and counts."""
    inner = docs.drop("text")
    names, fields = inner.columns, schema_of(inner)
    schema = f"block long, aimed boolean, rows array<struct<{fields.replace('` ', '`: ')}>>, n_words array<long>, n_features array<long>, features binary, words array<string>, tuples array<array<int>>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch], aimed: bool) -> Iterator[pa.RecordBatch]:
        number = (2 * TaskContext.get().partitionId() + aimed) << 32
        for batch in batches:
            batch = batch.rename_columns([*names, "text"])
            for part in byte_blocks(batch, "text", BLOCK) if batch.num_rows else ():
                code, words, first = _dictionary(part.column("text"))
                tuples, features, owner = _tuples(code, first, longest, len(words))
                order = np.argsort(owner, kind="stable")
                counts = np.bincount(features, minlength=len(words) + sum(map(len, tuples)))
                kept = pa.StructArray.from_arrays(part.columns[:-1], names=names)
                n = np.bincount(owner, minlength=part.num_rows)
                one = lambda values, kind: pa.array([values], kind)
                yield pa.RecordBatch.from_pydict({
                    "block": [number], "aimed": [aimed], "rows": pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), kept),
                    "n_words": one(np.diff(first), pa.list_(pa.int64())), "n_features": one(n, pa.list_(pa.int64())),
                    "features": one(zstandard.compress(features[order].astype(_width(len(counts))).tobytes(), 1), pa.binary()),
                    "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                    "tuples": one([t.tolist() for x in tuples for t in x], pa.list_(pa.list_(pa.int32()))), "counts": one(counts, pa.list_(pa.int64())),
                })
                number += 1
            give_back()

    def side(df: DataFrame, aimed: bool) -> DataFrame:
        return df.select(*names, text_or_empty().alias("text")).mapInArrow(lambda batches: run(batches, aimed), schema)

    return side(docs, False).unionByName(side(target, True))


def _bucket(text: str, buckets: int) -> Column:
    return F.crc32(F.col(text).cast("binary")) % buckets


def _ratio(uses: DataFrame, buckets: int) -> DataFrame:
    """bucket and gain: the floored thousandfold logarithm of smoothed shares, of all buckets that occur."""
    t = F.sum(F.when(F.col("aimed"), F.col("n")).otherwise(0))
    sums = uses.groupBy("bucket").agg((F.sum("n") - t).alias("s"), t.alias("t"))
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    share = (F.col("t") + 1.0) * (F.col("all_s") + float(buckets)) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    # One row of totals, and 10,000 buckets at most.
    return sums.join(F.broadcast(total)).select("bucket", F.floor(SCALE * F.log(share)).alias("gain"))


def weighed(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """docs' columns but text, then n_words, n_features and weight. target has the same columns; features are runs of 1 to longest words."""
    held = stored(blocks(docs, target, longest), "blocks")
    here = F.posexplode(F.arrays_zip(F.col("words").alias("word"), F.slice("counts", 1, F.size("words")).alias("n"))).alias("at", "one")
    fresh = held.select("block", here).select("block", "at", "one.word", "one.n", F.monotonically_increasing_id().alias("m"))
    # The least number of a word's rows is its id. That row spells the word, and its hash goes to the word's other rows.
    same = Window.partitionBy("word")
    ided = fresh.withColumn("id", F.min("m").over(same)).withColumn("spelled", F.when(F.col("m") == F.col("id"), F.col("word")))
    named = stored(ided.select("id", "spelled", "block", "at", "n", F.max(_bucket("spelled", buckets)).over(same).alias("bucket")), "named")
    uses = named.select("block", "at", "n", "bucket")
    if longest > 1:
        names = named.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("names"))
        tuples = F.transform("tuples", lambda t: F.transform(t, lambda i: F.element_at("names", i + 1)["id"]))
        at = F.col("from") + F.col("k")
        used = held.join(names, "block").select("block", F.size("words").alias("from"), "counts", F.posexplode(tuples).alias("k", "gram"))
        used = stored(used.select("block", at.alias("at"), "gram", F.element_at("counts", at + 1).alias("n")), "used")
        spelled = named.where("spelled IS NOT NULL").select("id", F.col("spelled").alias("word"))
        parts = used.select("gram").distinct().select("gram", F.posexplode("gram").alias("k", "id")).join(spelled, "id")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ")
        grams = parts.groupBy("gram").agg(joined.alias("bytes")).select("gram", _bucket("bytes", buckets).alias("bucket"))
        uses = stored(uses.unionByName(used.join(grams, "gram").select("block", "at", "n", "bucket")), "uses")
    aimed = F.shiftright("block", 32).bitwiseAND(1) == 1
    gains = F.broadcast(stored(_ratio(uses.withColumn("aimed", aimed), buckets), "gains"))
    # A feature's place and gain as one number, in the order of places.
    packed = F.shiftleft(F.col("at").cast("long"), 32) + F.col("gain") + _MIDDLE
    back = uses.where(~aimed).join(gains, "bucket").groupBy("block").agg(F.sort_array(F.collect_list(packed)).alias("gains"))
    summed = held.where("NOT aimed").select("block", "rows", "n_words", "n_features", "features").join(back, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, n_words, n_features, features, gains in zip(*batch.columns[1:], strict=True):
                n = np.asarray(n_features.values, np.int64)
                value = np.zeros(0, np.int64)
                if gains.is_valid and n.sum():
                    value = (np.asarray(gains.values, np.int64) & 0xFFFFFFFF) - _MIDDLE
                    value = value[np.frombuffer(zstandard.decompress(features.as_buffer()), _width(len(value)))]
                ends = np.concatenate([[0], np.cumsum(value)])
                stop = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([rows.values, n_words.values, n_features.values, pa.array((ends[stop] - ends[stop - n]) // np.maximum(n, 1))], names=["row", "n_words", "n_features", "weight"])
            give_back()

    out = summed.mapInArrow(run, f"row {held.schema['rows'].dataType.elementType.simpleString()}, n_words long, n_features long, weight long")
    return out.select("row.*", "n_words", "n_features", "weight")


def scored(weights: DataFrame, doc_id: str = "doc_id", seed: str = SEED, least: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """weights with `score` (weight plus Gumbel noise of the hashed id) and `rank`, which the drawn rows alone have."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    rows = stored(weights.withColumn("score", F.col("weight") + F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0)))), "scores")
    # Scores are whole numbers within the bounds of logarithms of doubles: their number doesn't grow with the rows.
    able = rows.where(F.col("n_words") >= least)
    counts = able.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")
    drawn = F.floor(per_cent * F.sum("n").over(Window.partitionBy()) / 100)
    cuts = counts.select("score", higher.alias("higher"), drawn.alias("drawn")).where("higher < drawn")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last(doc_id)))
    top = able.join(F.broadcast(cuts), "score").withColumn("rank", (F.col("higher") + place).cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))).drop("higher", "drawn")
    rest = rows.where(F.coalesce(F.col("n_words") < least, F.lit(True))).unionByName(able.join(F.broadcast(cuts.select("score")), "score", "left_anti"))
    return top.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, doc_id: str = "doc_id", text: str = "text", seed: str = SEED, least: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of docs that are drawn, with their columns and `rank`. Rows are numbered and stored once, as a row is more than its id."""
    own = masked(docs)
    key, body = own.columns[docs.columns.index(doc_id)], own.columns[docs.columns.index(text)]
    rows = stored(own.withColumn("row", F.monotonically_increasing_id()), "rows")
    slim = rows.select("row", F.col(key).alias("doc_id"), F.col(body).alias("text"))
    aim = target.select(F.lit(None).cast("long").alias("row"), F.lit(None).cast(slim.schema["doc_id"].dataType).alias("doc_id"), F.col(text).alias("text"))
    drawn = scored(weighed(slim, aim, longest), "doc_id", seed, least, per_cent).where("rank IS NOT NULL").select("row", "rank")
    return rows.join(drawn, "row").select(*own.columns, "rank").toDF(*docs.columns, "rank")


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank."""
    slim = docs.select("doc_id", "text")
    aim = target.select(F.lit(None).cast(slim.schema["doc_id"].dataType).alias("doc_id"), "text")
    return scored(weighed(slim, aim)).select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 is a fold over the bytes' hexadecimal digits, with a table that is worked out from its polynomial.
ORACLE_SQL = r"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS crc),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY ALL),
v AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY ALL),
x AS (SELECT word, coalesce(a.n, 0) AS s, coalesce(v.n, 0) AS t FROM (SELECT word, sum(n) AS n FROM u GROUP BY ALL) a FULL JOIN v USING (word)),
b AS (SELECT *, xor(list_reduce(list_transform(range(octet_length(encode(word))), lambda k: CAST('0x' || substr(hex(encode(word)), 2 * k + 1, 2) AS BIGINT)), lambda a, y: xor(a >> 8, crc[(xor(a, y) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM x, c),
g AS (SELECT bucket, floor(1000 * ln((sum(t) + 1.0::DOUBLE) * ((SELECT sum(s) FROM b) + 10000.0::DOUBLE) / ((sum(s) + 1.0::DOUBLE) * ((SELECT sum(t) FROM b) + 10000.0::DOUBLE)))) AS gain FROM b GROUP BY 1),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM u JOIN b USING (word) JOIN g USING (bucket) GROUP BY 1),
s AS (SELECT d.doc_id, coalesce(m.n, 0) AS n_features, coalesce(m.weight, 0) AS weight,
  coalesce(m.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= floor(10 * able / 100) THEN place END AS rank FROM k
"""
