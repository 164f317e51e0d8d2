"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, broadcast to workers.

Counting. Tasks count tokens and pairs of neighbouring tokens (n = 2) of the training documents and send each distinct
one once, packed by segment of its hash, to as many reducers as spark.sql.shuffle.partitions names. There is a segment
for every SEGMENT_BYTES of text, or as many as reducers; a reducer takes its segments in order, and holds one at a time. It keeps exact
token counts and turns pair counts c into levels q = 1 + floor(log2 c); a pair of level q is put into its segment's
filter q times, as (pair, 1) to (pair, q). A filter is an array of 64-bit words; an entry sets BITS_SET bits of one word
and there are ENTRY_BITS bits for each entry.

Scoring. A token's level is found by probing (pair, 1), (pair, 2), ... until one is absent. With C2 the count that the
level stands for, C1 the count of the token before (texts begin after an end) and p1 the token's own smoothed
probability, p = LAMBDA * min(1, C2 / C1) + (1 - LAMBDA) * p1; a text's score is the sum of log10 p.

Sizes. Exact counts of the most frequent tokens (at most FREQUENT, all with a count of at least some power of two) are
broadcast; occurrences of other tokens, and of tokens after them, meet the exact counts by shuffled joins. So base_score is
exact, and p1 and C1 are at every size: FREQUENT changes no result. The filter is broadcast FILTER_BYTES at a time:
each group of segments takes one pass over the documents and is destroyed before the next is read, and a text's parts
are summed. Beyond MOST_PASSES groups the pairs go to the filter instead: each block of documents sends its distinct
pairs to their segments by a shuffle and gets their levels back, with the same scores. So neither what is broadcast nor
the number of passes grows with the corpus. A reducer holds one segment's pairs, about those of SEGMENT_BYTES of text.

Tokens are runs without blanks, A-Z lowered, by their 64-bit hashes, then one end. Defined results: a null text counts as
empty (one end); texts of any length are scored whole; repeated rows stay; without training documents N = V = 0, c = 0
for all and every pair is absent; an empty table gives an empty one. Documents are read once for their size, once to count and once to number them in the shared folder, from where each group
of segments reads them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .probe_table import ProbeTable
from .runtime import byte_blocks, dropped, give_back, id_remainder, map_batches, stored, text_or_empty
from .words import NOT_BLANK, mix, scan

BITS_SET, ENTRY_BITS, LAMBDA = 5, 10, 0.75
FREQUENT, FILTER_BYTES = 1 << 20, 64 << 20
#: Text whose pairs one segment has.
SEGMENT_BYTES = 8 << 20
#: Text that is worked on at a time, as arrays of many times its size.
WORK_BYTES = 1 << 20
#: Groups of filters that are broadcast; of a larger filter each pair is sent to its segment.
MOST_PASSES = 8
#: Distinct pairs that a counting task holds before it sends them.
HELD = 3_000_000
LEVELS = 48
_U = np.uint64
END = _U(0x656E64206F662074)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each row's followed by an end, and rows' offsets."""
    found = scan(texts, NOT_BLANK)
    n = np.diff(found.first)
    h = np.full(len(found.start) + len(n), END, _U)
    h[np.arange(len(found.start)) + np.repeat(np.arange(len(n)), n)] = found.hashes()
    return h, np.concatenate([[0], np.cumsum(n + 1)])


def before(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token before each; an end before the first of a row."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[at[:-1]] = END
    return out


def pairs(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(before(h, at) * _U(0x9E3779B97F4A7C15) + h + _U(2))


def counted(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the sums of their counts."""
    if not len(h):
        return h, c
    order = np.argsort(h)
    h = h[order]
    heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[heads], np.add.reduceat(c[order], heads)


def segment(h: np.ndarray, segments: int) -> np.ndarray:
    """By the highest bits, so that ascending hashes have ascending segments."""
    return (((h >> _U(32)) * _U(segments)) >> _U(32)).astype(np.int64)


def _places(h: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each entry (pair, level) and its bits."""
    g = mix(h + _U(level * 0x9E3779B9))
    word = (((g >> _U(32)) * np.asarray(words, _U)) >> _U(32)).astype(np.int64)
    bits = np.zeros(len(h), _U)
    for i in range(BITS_SET):
        bits |= _U(1) << ((g >> _U(6 * i)) & _U(63))
    return word, bits


def filled(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The filter of one segment's pairs and counts."""
    level = np.floor(np.log2(c)).astype(np.int64) + 1 if len(c) else c
    words = -(-int(level.sum()) * ENTRY_BITS // 64)
    out = np.zeros(max(words, 1), _U)
    for q in range(1, int(level.max(initial=0)) + 1):
        word, bits = _places(h[level >= q], q, len(out))
        order = np.argsort(word)
        word, bits = word[order], bits[order]
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out[word[heads]] |= np.bitwise_or.reduceat(bits, heads)
    return out


@dataclass
class Filters:
    """The filters of segments first to first + len(size) - 1 of all, end to end."""

    words: np.ndarray
    size: np.ndarray
    first: int
    segments: int

    def covers(self, h: np.ndarray) -> np.ndarray:
        s = segment(h, self.segments)
        return (s >= self.first) & (s < self.first + len(self.size))

    def level(self, h: np.ndarray) -> np.ndarray:
        """The highest level up to which every probe finds its entry."""
        s = segment(h, self.segments) - self.first
        size, start = self.size[s], (np.cumsum(self.size) - self.size)[s]
        out = np.zeros(len(h), np.int64)
        open_ = np.arange(len(h))
        for q in range(1, LEVELS):
            word, bits = _places(h[open_], q, size[open_])
            hit = (self.words[start[open_] + word] & bits) == bits
            open_ = open_[hit]
            if not open_.size:
                break
            out[open_] = q
        return out


#: The count that a level stands for: the middle of its range on the log scale, 1 for level 1.
STANDS_FOR = np.concatenate([[0.0, 1.0], np.floor(2.0 ** (np.arange(1, LEVELS) + 0.5))])


@dataclass
class Frequent:
    """Exact counts of the frequent tokens and what the corpus has in all."""

    table: ProbeTable
    count: np.ndarray
    total: int
    distinct: int

    def of(self, h: np.ndarray) -> np.ndarray:
        """Counts; -1 outside this table."""
        row = self.table.find(h)
        return np.where(row >= 0, self.count[np.maximum(row, 0)], -1) if len(self.count) else np.full(len(h), -1)

    @property
    def scale(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)


def _gathered(df: DataFrame, segments: int) -> DataFrame:
    """Packed partial counts (n, segment, hashes, counts) of every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {1: [(np.zeros(0, _U), np.zeros(0, np.int64))], 2: [(np.zeros(0, _U), np.zeros(0, np.int64))]}

        def merged(n: int) -> None:
            held[n] = [counted(*(np.concatenate(x) for x in zip(*held[n], strict=True)))]

        def sent() -> Iterator[pa.RecordBatch]:
            for n in (1, 2):
                merged(n)
                h, c = held[n][0]
                kind = "<u4" if c.max(initial=0) < 1 << 32 else "<u8"
                cut = np.searchsorted(segment(h, segments), np.arange(segments + 1))
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array(np.full(len(full), n, np.int32)),
                    "segment": pa.array(full.astype(np.int32)),
                    "hashes": pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in full.tolist()], pa.binary()),
                    "counts": pa.array([c[cut[i] : cut[i + 1]].astype(kind).tobytes() for i in full.tolist()], pa.binary()),
                })
                held[n] = [(np.zeros(0, _U), np.zeros(0, np.int64))]

        for batch in batches:
            for block in byte_blocks(batch, "text", WORK_BYTES):
                h, at = tokens(block.column("text"))
                for n, grams in ((1, h), (2, pairs(h, at))):
                    held[n].append(counted(grams, np.ones(len(grams), np.int64)))
                if sum(len(x) for x, _ in held[2]) > HELD:
                    merged(1)
                    merged(2)
                    if len(held[2][0][0]) > HELD // 2:
                        yield from sent()
        yield from sent()

    return df.mapInArrow(run, "n int, segment int, hashes binary, counts binary")


def _counts(df: DataFrame, segments: int) -> DataFrame:
    """Per n and segment: exact token counts (n = 1) or the filter (n = 2), and how many tokens have each bit length."""

    def reduced(n: int, s: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h, c = counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        lengths = np.bincount(np.floor(np.log2(c)).astype(np.int64) + 1, minlength=64)
        return pa.RecordBatch.from_pydict({
            "n": pa.array([n], pa.int32()), "segment": pa.array([s], pa.int32()), "total": pa.array([int(c.sum())]), "distinct": pa.array([len(h)]),
            "lengths": pa.array([lengths.tolist()], pa.list_(pa.int64())),
            "hashes": pa.array([h.tobytes() if n == 1 else b""], pa.binary()), "counts": pa.array([c.tobytes() if n == 1 else b""], pa.binary()),
            "filter": pa.array([filled(h, c).tobytes() if n == 2 else b""], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for n, s, h, c in zip(*batch.columns, strict=True):
                if at != (n.as_py(), s.as_py()):
                    if held:
                        yield reduced(*at, held)
                    at, held = (n.as_py(), s.as_py()), []
                h, c = h.as_py(), c.as_py()
                h = np.frombuffer(h, _U)
                held.append((h, np.frombuffer(c, "<u4" if len(c) == 4 * len(h) else "<u8").astype(np.int64)))
        if held:
            yield reduced(*at, held)
        give_back()

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Neighbours go to one reducer, which gets them in order.
    dealt = _gathered(df, segments).repartitionById(parts, F.floor(F.col("segment") * parts / segments).cast("int")).sortWithinPartitions("n", "segment")
    return stored(dealt.mapInArrow(run, "n int, segment int, total long, distinct long, lengths array<long>, hashes binary, counts binary, filter binary"), "ngrams", large=True)


def _listed(counts: DataFrame, low: int, high: int) -> DataFrame:
    """token (its hash, signed) and count of tokens with low <= count < high, from the packed counts."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h, c = np.frombuffer(h, np.int64), np.frombuffer(c, np.int64)
            own = (c >= low) & (c < high)
            yield {"token": pa.array(h[own]), "count": pa.array(c[own])}

    return map_batches(counts.where("n = 1").select("hashes", "counts"), step, "token long, count long")


@dataclass
class Model:
    counts: DataFrame
    frequent: Frequent
    least: int
    segments: int

    def filter_bytes(self) -> int:
        return self.counts.where("n = 2").agg(F.coalesce(F.sum(F.octet_length("filter").cast("long")), F.lit(0))).first()[0]

    def groups(self) -> Iterator[Filters]:
        """The filters, FILTER_BYTES at a time (one segment at least)."""
        sizes = {r[0]: r[1] for r in self.counts.where("n = 2").select("segment", F.octet_length("filter")).collect()}
        size = [sizes.get(s, 8) for s in range(self.segments)]
        first = 0
        while first < self.segments:
            last, held = first + 1, size[first]
            while last < self.segments and held + size[last] <= FILTER_BYTES:
                held += size[last]
                last += 1
            # Filled in place: the driver holds one group and one segment at a time.
            each = np.array(size[first:last], np.int64) // 8
            start = np.cumsum(each) - each
            words = np.zeros(int(each.sum()), _U)
            for r in self.counts.where(f"n = 2 AND segment >= {first} AND segment < {last}").select("segment", "filter").toLocalIterator():
                at = int(start[r[0] - first])
                words[at : at + int(each[r[0] - first])] = np.frombuffer(r[1], _U)
            yield Filters(words, each, first, self.segments)
            del words
            first = last


def train(df: DataFrame) -> Model:
    """The model of all rows of df."""
    texts = df.select(text_or_empty().alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    segments = max(-(-size // SEGMENT_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = _counts(texts, segments)
    total, distinct = counts.where("n = 1").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    lengths = {r["bits"]: r["words"] for r in counts.where("n = 1").select(F.posexplode("lengths").alias("bits", "words")).groupBy("bits").agg(F.sum("words").alias("words")).collect()}
    held, bits = 0, 64
    while bits > 1 and held + lengths.get(bits - 1, 0) <= FREQUENT:
        bits -= 1
        held += lengths.get(bits, 0)
    least = 1 << (bits - 1)
    rows = _listed(counts, least, 1 << 62).toArrow()
    token, count = rows.column("token").to_numpy().view(_U), rows.column("count").to_numpy()
    return Model(counts, Frequent(ProbeTable(token), count, total, distinct), least, segments)


#: Open places of a row, equal ones once: count and before are those of a place's token and of the token before, -1 where
#: a join has to find it, of the token key; if both are, of the token before by the token other.
_OPEN = [("key", pa.int64()), ("other", pa.int64()), ("count", pa.int64()), ("before", pa.int64()), ("level", pa.int32()), ("times", pa.int64())]
_PART = "row long, doc_id {}, held_out boolean, n_tokens long, known long, base double, part double, open array<struct<key:bigint,other:bigint,count:bigint,before:bigint,level:int,times:bigint>>"


def _scored(h: np.ndarray, at: np.ndarray, frequent: Frequent, own: np.ndarray, level: np.ndarray, first: bool) -> dict:
    """What the pairs at the places `own`, of these levels, add to each row; with first also the tokens' counts."""
    c, n = frequent.of(h), len(at) - 1
    context = np.empty_like(c)
    context[1:] = c[:-1]
    context[at[:-1]] = frequent.of(np.array([END], _U))[0]
    closed = (c[own] >= 0) & (context[own] >= 0)
    exact = own[closed]
    p1 = (c[exact] + 0.1) / frequent.scale
    share = np.minimum(1.0, STANDS_FOR[level[closed]] / np.maximum(context[exact], 1))
    logs = np.zeros(len(h))
    logs[exact] = np.log10(LAMBDA * share + (1 - LAMBDA) * p1)
    lost, level = own[~closed], level[~closed]
    gram, doc = pairs(h, at)[lost], np.searchsorted(at, lost, "right") - 1
    order = np.lexsort((gram, doc))
    lost, level, gram, doc = lost[order], level[order], gram[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])])) if len(lost) else np.zeros(0, np.int64)
    times = np.diff(np.append(heads, len(lost)))
    ends = np.searchsorted(doc[heads], np.arange(n + 1)).astype(np.int32)
    lost, level = lost[heads], level[heads]
    token, previous = h[lost].view(np.int64), before(h, at)[lost].view(np.int64)
    columns = [np.where(c[lost] < 0, token, previous), np.where((c[lost] < 0) & (context[lost] < 0), previous, 0), c[lost], context[lost], level, times]
    places = pa.StructArray.from_arrays([pa.array(x).cast(kind) for x, (_, kind) in zip(columns, _OPEN, strict=True)], [name for name, _ in _OPEN])
    known = (c > 0).astype(np.int64) if first else np.zeros(len(h), np.int64)
    base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.1), 0.0) if first else np.zeros(len(h))
    return {"n_tokens": pa.array(np.diff(at)), **{k: pa.array(np.add.reduceat(v, at[:-1])) for k, v in (("known", known), ("base", base), ("part", logs))}, "open": pa.ListArray.from_arrays(pa.array(ends), places)}


_ROW = ("row", "doc_id", "held_out")


def _part(rows: DataFrame, counted: Broadcast, group: Broadcast, first: bool) -> DataFrame:
    """What one group of filters adds to each row; the first pass also has the tokens' counts."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        frequent, filters = counted.value, group.value
        for block in byte_blocks(batch, "text", WORK_BYTES):
            h, at = tokens(block.column("text"))
            grams = pairs(h, at)
            own = np.flatnonzero(filters.covers(grams))
            yield {c: block.column(c) for c in _ROW} | _scored(h, at, frequent, own, filters.level(grams[own]), first)

    return map_batches(rows, step, _PART.format(rows.schema["doc_id"].dataType.simpleString()))


def _passes(rows: DataFrame, model: Model, counted: Broadcast) -> DataFrame:
    """All parts, by a pass over the documents for each group of filters."""
    context, each = rows.sparkSession.sparkContext, []
    for filters in model.groups():
        # One group at a time, on the driver as on the executors: it is gone before the next is read.
        group = context.broadcast(filters)
        del filters
        each.append(stored(_part(rows, counted, group, not each), "lm-part"))
        group.destroy()
    return functools.reduce(DataFrame.unionByName, each)


def _routed(rows: DataFrame, model: Model, counted: Broadcast) -> DataFrame:
    """All parts, by sending each block's distinct pairs to the segments that hold their filters, and the levels back.

    Documents are read once, as blocks of token hashes; what is sent grows with the text alone, and a task holds one
    segment's filter or one block.
    """
    kind, segments = rows.schema["doc_id"].dataType.simpleString(), model.segments

    def pack(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in byte_blocks(batch, "text", WORK_BYTES):
            h, at = tokens(block.column("text"))
            whole = [0, block.num_rows]
            yield {"block": block.column("row").slice(0, 1)} | {c: pa.ListArray.from_arrays(whole, block.column(c)) for c in _ROW} | {"size": pa.ListArray.from_arrays(whole, pa.array(np.diff(at))), "tokens": pa.array([h.tobytes()], pa.binary())}

    blocks = stored(map_batches(rows, pack, f"block long, row array<long>, doc_id array<{kind}>, held_out array<boolean>, size array<long>, tokens binary"), "lm-blocks", large=True)

    def unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
        size = batch.column("size")[i].values.to_numpy()
        return np.frombuffer(batch.column("tokens")[i].as_buffer(), _U), np.concatenate([[0], np.cumsum(size)])

    def ask(batch: pa.RecordBatch) -> Iterator[dict]:
        for i, block in enumerate(batch.column("block").to_pylist()):
            grams = np.unique(pairs(*unpacked(batch, i)))
            cut = np.searchsorted(segment(grams, segments), np.arange(segments + 1))
            full = np.flatnonzero(np.diff(cut)).tolist()
            yield {"segment": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int64()), "payload": pa.array([grams[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary())}

    asked = map_batches(blocks.select("block", "size", "tokens"), ask, "segment int, block long, payload binary")
    filters = model.counts.where("n = 2").select("segment", F.lit(None).cast("long").alias("block"), F.col("filter").alias("payload"))
    dealt = asked.unionByName(filters).repartition("segment").sortWithinPartitions("segment", F.col("block").asc_nulls_first())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = None, -1
        for batch in batches:
            names, blocks_ = batch.column("segment").to_numpy(), batch.column("block")
            payload = [np.frombuffer(v.as_buffer(), _U) for v in batch.column("payload")]
            asks, told = [], []
            # Rows of one segment follow each other, its filter first; all that a batch asks of it is looked up at once.
            for own in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
                if len(own) and not blocks_[int(own[0])].is_valid:
                    held, at = Filters(payload[own[0]].copy(), np.array([len(payload[own[0]])]), int(names[own[0]]), segments), names[own[0]]
                    own = own[1:]
                if not len(own):
                    continue
                asked = np.concatenate([payload[i] for i in own])
                # A segment without pairs has no filter: no pair of it was ever seen.
                level = (held.level(asked) if at == names[own[0]] else np.zeros(len(asked), np.int64)).astype(np.uint8)
                asks += own.tolist()
                told += [x.tobytes() for x in np.split(level, np.cumsum([len(payload[i]) for i in own])[:-1])]
            yield pa.RecordBatch.from_pydict({"block": blocks_.take(pa.array(asks, pa.int64())), "segment": batch.column("segment").take(pa.array(asks, pa.int64())), "levels": pa.array(told, pa.binary())})

    levels = dealt.mapInArrow(answer, "block long, segment int, levels binary")
    back = blocks.join(levels.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("segment", "levels"))).alias("levels")), "block")

    def close(batch: pa.RecordBatch) -> Iterator[dict]:
        frequent = counted.value
        for i in range(batch.num_rows):
            h, at = unpacked(batch, i)
            grams, which = np.unique(pairs(h, at), return_inverse=True)
            found = np.frombuffer(b"".join(x["levels"] for x in batch.column("levels")[i].as_py()), np.uint8).astype(np.int64)
            if len(found) != len(grams):
                raise ValueError("levels of some pairs are missing")
            yield {c: batch.column(c)[i].values for c in _ROW} | _scored(h, at, frequent, np.arange(len(h)), found[which], True)

    return stored(map_batches(back, close, _PART.format(kind)), "lm-parts")


def score(df: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of df."""
    frequent = model.frequent
    # Rows are numbered once, in a table: a scan that is planned anew between passes would number them otherwise.
    rows = stored(df.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out.alias("held_out"), text_or_empty().alias("text")), "lm-rows")
    known = df.sparkSession.sparkContext.broadcast(frequent)
    parts = (_passes if model.filter_bytes() <= MOST_PASSES * FILTER_BYTES else _routed)(rows, model, known)
    known.destroy()
    dropped(rows)
    counts = _listed(model.counts, 1, model.least).withColumnRenamed("count", "c")
    places = parts.select("row", F.explode("open").alias("o")).select("row", "o.*")
    both = (F.col("count") < 0) & (F.col("before") < 0)
    found = F.coalesce("c", F.lit(0))

    def looked_up(places: DataFrame, key: str) -> DataFrame:
        return places.join(counts, places[key] == counts["token"], "left")

    # A place whose count and context are both open is joined twice, any other once.
    once = looked_up(places.where(~both), "key").withColumns({"n": F.when(F.col("count") < 0, found).otherwise(F.col("count")), "m": F.when(F.col("before") < 0, found).otherwise(F.col("before"))})
    twice = looked_up(looked_up(places.where(both), "key").withColumn("n", found).drop("c", "token"), "other").withColumn("m", found)
    names = ["row", "count", "level", "times", "n", "m"]
    closed = once.select(*names).unionByName(twice.select(*names))
    stands = F.element_at(F.array(*[F.lit(float(x)) for x in STANDS_FOR]), F.col("level") + 1)
    p = LAMBDA * F.least(F.lit(1.0), stands / F.greatest(F.col("m"), F.lit(1))) + (1 - LAMBDA) * (F.col("n") + 0.1) / F.lit(float(frequent.scale))
    late = F.col("count") < 0
    added = closed.select(
        "row", *(F.lit(None).cast(parts.schema[k].dataType).alias(k) for k in ("doc_id", "held_out", "n_tokens")),
        F.when(late & (F.col("n") > 0), F.col("times")).otherwise(F.lit(0)).alias("known"),
        F.when(late, F.col("times") * F.log10(F.col("n") + 0.1)).otherwise(F.lit(0.0)).alias("base"),
        (F.col("times") * F.log10(p)).alias("part"),
    )
    heads = parts.drop("open")
    summed = heads.unionByName(added).groupBy("row").agg(*(F.max(k).alias(k) for k in ("doc_id", "held_out", "n_tokens")), F.sum("known").alias("n_known"), F.sum("base").alias("base"), F.sum("part").alias("score"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(frequent.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(frequent.scale)))).alias("base_score"), "score")


def digest(df: DataFrame) -> DataFrame:
    """The contract's row per document."""
    held_out = id_remainder(10) == 0
    return score(df, train(df.where(~held_out)), held_out)
