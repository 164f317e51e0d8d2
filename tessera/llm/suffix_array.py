"""Benchmark decontamination by suffix arrays of the training text.

Each task turns its documents into shards of about SHARD_BYTES and sorts all suffixes of a shard (as sequences of word
hashes, by DEPTH words; documents end in a mark that no test has). The suffixes of the test items are sorted too, and
each distinct window among them is looked up in the shard by binary search: the range of suffixes that begin with it
gives all its occurrences, however many items share it. Where an occurrence begins, the longest verbatim match of that
document suffix stands beside it among the sorted test suffixes. Windows are compared as words where hashes agree.
Documents with an occurrence of any window are affected, and `clean(df, items)` removes them.

Words are runs of letters, digits and all that isn't ASCII, A-Z lowered. A window is WINDOW consecutive words of an item;
an item of fewer words, but not none, is one window.

`matches(df, items)` gives per document: n_words, hits (merged [start, end) word ranges inside occurrences), items (ids,
ascending) and longest (words, place and item of the longest verbatim match, the first of several; null without a hit).

Defined results: a null text has no words; an item with a null text or without words has no window; a null item_id is no
id (its windows still hit); items of equal text are all reported, but are searched once; repeated rows of documents stay;
no items means no hits; columns named as the outputs are replaced, but clean() returns all columns as they were. Test
windows go to the workers in blocks of BLOCK_BYTES of item text, one block at a time, however many items there are;
with several blocks df is written once and each block takes a pass over it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import byte_blocks, map_batches, masked, schema_of, stored
from .words import ALPHANUMERIC, Words, scan

WINDOW, DEPTH = 10, 16
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 16 << 20
#: What an item weighs besides its text.
ROW_BYTES = 256
_U = np.uint64
_END, _BASE = _U(0), _U(0x9E3779B97F4A7C15)


def suffix_array(h: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Starts of all suffixes of h, sorted by their first depth values (at least); doubling over unresolved groups."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    # rank: the place in order where a suffix's group begins.
    new = np.ones(n, bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    heads = np.flatnonzero(new)
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    rank[n] = -1
    done = 1
    open_ = np.arange(n)
    while done < depth:
        # Places whose group still has several suffixes.
        group = rank[order[open_]]
        many = np.zeros(len(open_), bool)
        same = group[1:] == group[:-1]
        many[1:] |= same
        many[:-1] |= same
        open_ = open_[many]
        if not open_.size:
            break
        at, group = order[open_], group[many]
        key = (group + 1) * (n + 1) + rank[np.minimum(at + done, n)] + 1
        by = np.argsort(key, kind="stable")
        order[open_] = at = at[by]
        key = key[by]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(new)
        rank[at] = np.repeat(open_[heads], np.diff(np.append(heads, len(at))))
        done *= 2
    return order


def _prefix_sums(h: np.ndarray) -> np.ndarray:
    """Sums of h[j] * _BASE ** j below each place, by which ranges of words are compared."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, _U), np.cumsum(h * _powers(len(h)), dtype=_U)])


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, _U), np.full(max(n - 1, 0), _BASE, _U)]), dtype=_U)[:n]


@dataclass
class Tests:
    """Suffixes of all items of distinct words, laid end to end, each with an end mark.

    Place s has the word words[s] of hash h[s]; its item ends at stop[s] and is number item[s], and order sorts all
    places by what follows. Window k, distinct from all others, is the size[k] words from which[k] on; the places that
    begin with it are order[low[k]:high[k]], and the ids of all items that hold it are sets[ids[k]].
    """

    words: list[bytes]
    h: np.ndarray
    stop: np.ndarray
    item: np.ndarray
    order: np.ndarray
    named: list[int | None]
    which: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    ids: np.ndarray
    sets: list[list[int]]

    @classmethod
    def of(cls, ids: list[int | None], texts: list[str | None], width: int = WINDOW) -> Tests:
        found = scan(pa.array([t or "" for t in texts], pa.string()), ALPHANUMERIC)
        every = [found.data[a:b].tobytes() for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
        hashed = found.hashes()
        hashed[hashed == _END] = _U(1)
        # Items of the same words are one, whatever their number.
        same: dict[tuple[bytes, ...], list[int]] = {}
        place: list[int] = []
        for i, (a, b) in enumerate(zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)):
            if a < b:
                own = same.setdefault(tuple(every[a:b]), [])
                if not own:
                    place += [a, b]
                own.append(i)
        owners = [sorted({ids[i] for i in own} - {None}) for own in same.values()]
        n = np.array([b - a for a, b in zip(place[0::2], place[1::2], strict=True)], np.int64)
        words = [w for own in same for w in (*own, b"")]
        h = np.concatenate([np.append(hashed[a:b], _END) for a, b in zip(place[0::2], place[1::2], strict=True)]) if place else np.zeros(0, _U)
        item = np.repeat(np.arange(len(n)), n + 1)
        stop = np.repeat(np.cumsum(n + 1) - 1, n + 1)
        order = suffix_array(h, int(n.max(initial=0)) + 1) if len(h) else np.zeros(0, np.int64)
        left = stop - np.arange(len(h))
        whole = np.repeat(n, n + 1)
        window = np.where(left >= width, width, np.where((whole < width) & (left == whole), whole, 0))
        # Windows of full width are runs of the sorted places, an item that is shorter is one of its own.
        at = np.flatnonzero(window[order] == width)
        new = np.zeros(len(at), bool)
        new[:1] = True
        for d in range(width if len(at) else 0):
            new[1:] |= h[order[at[1:]] + d] != h[order[at[:-1]] + d]
        heads = np.append(np.flatnonzero(new), len(at))
        low = [int(at[i]) for i in heads[:-1]]
        high = [int(at[j - 1]) + 1 for j in heads[1:]]
        short = np.flatnonzero((window[order] > 0) & (window[order] < width)).tolist()
        low, high = np.array(low + short, np.int64), np.array(high + [k + 1 for k in short], np.int64)
        sets: dict[tuple[int, ...], int] = {}
        chosen = [sets.setdefault(tuple(np.unique(item[order[a:b]]).tolist()), len(sets)) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
        named = [own[0] if own else None for own in owners]
        members = [sorted({i for k in own for i in owners[k]}) for own in sets]
        which = order[low] if len(low) else low
        return cls(words, h, stop, item, order, named, which, window[which] if len(which) else which, low, high, np.array(chosen, np.int64), members)


def _bound(h: np.ndarray, order: np.ndarray, tests: Tests, which: np.ndarray, size: np.ndarray, upper: bool) -> np.ndarray:
    """For each test suffix the first place whose suffix is not below its first size words (upper: is above them)."""
    low, high = np.zeros(len(which), np.int64), np.full(len(which), len(order), np.int64)
    depth = int(size.max(initial=0))
    while (go := low < high).any():
        mid = (low + high) >> 1
        at = order[np.minimum(mid, len(order) - 1)]
        below = np.zeros(len(which), bool)
        same = go.copy()
        for d in range(depth):
            i = np.flatnonzero(same & (size > d))
            if not i.size:
                break
            a, b = h[np.minimum(at[i] + d, len(h) - 1)], tests.h[np.minimum(which[i] + d, len(tests.h) - 1)]
            a = np.where(at[i] + d < len(h), a, _END)
            below[i[a < b]] = True
            same[i[a != b]] = False
        if upper:
            below |= same
        low, high = np.where(go & below, mid + 1, low), np.where(go & ~below, mid, high)
    return low


class Agreement:
    """How many words of a shard's and of the tests' suffixes agree, by sums over ranges, whatever their length."""

    def __init__(self, h: np.ndarray, stop: np.ndarray, tests: Tests):
        self.h, self.stop, self.tests = h, stop, tests
        self.own, self.theirs = _prefix_sums(h), _prefix_sums(tests.h)
        self.powers = _powers(max(len(h), len(tests.h)))

    def lengths(self, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """From at in the shard and from place in the tests, within document and item."""
        low, high = np.zeros(len(at), np.int64), np.minimum(self.stop[at] - at, self.tests.stop[place] - place)
        with np.errstate(over="ignore"):
            while (low < high).any():
                mid = (low + high + 1) >> 1
                a = (self.own[at + mid] - self.own[at]) * self.powers[place]
                b = (self.theirs[place + mid] - self.theirs[place]) * self.powers[at]
                low, high = np.where(a == b, mid, low), np.where(a == b, high, mid - 1)
        return low

    def longest(self, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest agreement of each suffix at with those at tests.order[first:last], sorted, and whose it is: it is next to where at belongs."""
        low, high = first.copy(), last.copy()
        while (go := low < high).any():
            mid = np.minimum((low + high) >> 1, last - 1)
            place = self.tests.order[mid]
            n = self.lengths(at, place)
            below = self.tests.h[place + n] < self.h[at + n]
            low, high = np.where(go & below, mid + 1, low), np.where(go & ~below, mid, high)
        left, right = self.tests.order[np.maximum(low - 1, first)], self.tests.order[np.minimum(low, last - 1)]
        one, two = self.lengths(at, left), self.lengths(at, right)
        return np.maximum(one, two), np.where(one >= two, left, right)


def search(found: Words, tests: Tests) -> list[dict]:
    """The result of every row of a shard."""
    docs = len(found.first) - 1
    n = np.diff(found.first)
    rows = [{"n_words": int(k), "hits": [], "items": [], "longest": None} for k in n.tolist()]
    if not len(found.start) or not len(tests.which):
        return rows
    # Each document's words and one end mark; hashes are never the mark.
    own = found.hashes()
    own[own == _END] = _U(1)
    doc = np.repeat(np.arange(docs), n)
    base = found.first[:-1] + np.arange(docs)
    h = np.full(len(own) + docs, _END, _U)
    h[np.arange(len(own)) + doc] = own
    order = suffix_array(h)
    low, high = _bound(h, order, tests, tests.which, tests.size, False), _bound(h, order, tests, tests.which, tests.size, True)
    # All occurrences as (distinct window, place in the shard): a place begins one window of each size at most.
    some = np.flatnonzero(high > low)
    if not some.size:
        return rows
    count = high[some] - low[some]
    window = np.repeat(some, count)
    at = order[np.repeat(low[some] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    row = np.searchsorted(base, at, "right") - 1
    size = tests.size[window]
    # Confirmed on the words themselves.
    start, end, data = found.start, found.end, found.data
    same = np.ones(len(at), bool)
    for i, (s, k, w) in enumerate(zip(tests.which[window].tolist(), size.tolist(), (at - row).tolist(), strict=True)):
        same[i] = all(data[a:b].tobytes() == t for a, b, t in zip(start[w : w + k].tolist(), end[w : w + k].tolist(), tests.words[s : s + k], strict=True))
    window, at, row, size = window[same], at[same], row[same], size[same]
    if not len(at):
        return rows
    length, place = size.copy(), tests.which[window].copy()
    full = np.flatnonzero(size == WINDOW)
    if full.size:
        agreement = Agreement(h, np.repeat(base + n, n + 1), tests)
        length[full], place[full] = agreement.longest(at[full], tests.low[window[full]], tests.high[window[full]])
    begin = at - base[row]
    by = np.lexsort((place, begin, -length, row))
    heads = by[np.flatnonzero(np.concatenate([[True], row[by][1:] != row[by][:-1]]))]
    for i in heads.tolist():
        item = tests.named[int(tests.item[place[i]])]
        rows[int(row[i])]["longest"] = {"words": int(length[i]), "at": int(begin[i]), "item_id": item}
    by = np.lexsort((begin, row))
    cut = np.flatnonzero(np.concatenate([[True], row[by][1:] != row[by][:-1], [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        mine = by[a:b]
        result = rows[int(row[mine[0]])]
        result["hits"] = [{"start": x, "end": y} for x, y in merged(list(zip(begin[mine].tolist(), (begin + size)[mine].tolist(), strict=True)))]
        sets = [tests.sets[k] for k in np.unique(tests.ids[window[mine]]).tolist()]
        result["items"] = sets[0] if len(sets) == 1 else sorted(set().union(*sets))
    return rows


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_LONGEST_TYPE = pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item_id", pa.int64())])
_HITS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUTPUT_NAMES = ("n_words", "hits", "items", "longest")
OUTPUTS = "n_words long, hits array<struct<start:bigint,end:bigint>>, items array<bigint>, longest struct<words:bigint,at:bigint,item_id:bigint>"


def _blocks(items: DataFrame) -> tuple[int, Callable[[int], Tests]]:
    """How many blocks the items make, and one of them by its number: each is collected by itself, and its text is bounded."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")).distinct()
    # Items without words have no windows; others weigh as what the driver holds of them.
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))

    def block(b: int) -> Tests:
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        got = part.collect()
        return Tests.of([r["item_id"] for r in got], [r["text"] for r in got])

    return blocks, block


def _searched(rows: DataFrame, shared: Broadcast, names: list[str], hits_only: bool = False) -> DataFrame:
    """The named columns of rows, which have a text, with the outputs; hits_only leaves out rows without a hit."""

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        filled = batch.set_column(batch.schema.get_field_index("text"), "text", batch.column("text").fill_null(""))
        first = 0
        for block in byte_blocks(filled, "text", SHARD_BYTES):
            found = search(scan(block.column("text"), ALPHANUMERIC), shared.value)
            own, first = batch.slice(first, len(found)), first + len(found)
            if hits_only:
                kept = [i for i, r in enumerate(found) if r["hits"]]
                found, own = [found[i] for i in kept], own.take(pa.array(kept, pa.int64()))
            yield {c: own.column(c) for c in names} | {
                "n_words": pa.array([r["n_words"] for r in found], pa.int64()),
                "hits": pa.array([r["hits"] for r in found], _HITS_TYPE),
                "items": pa.array([r["items"] for r in found], pa.list_(pa.int64())),
                "longest": pa.array([r["longest"] for r in found], _LONGEST_TYPE),
            }

    return map_batches(rows, step, f"{schema_of(rows.select(*names))}, {OUTPUTS}")


def matches(df: DataFrame, items: DataFrame, keep_text: bool = True) -> DataFrame:
    """df (without columns named as the outputs) with n_words, hits, items and longest."""
    kept = df.drop("n_words", "hits", "items", "longest")
    plain = masked(kept, "text")
    names = [c for c in plain.columns if keep_text or c != "text"]
    back = [c for c in kept.columns if keep_text or c != "text"]
    context = df.sparkSession.sparkContext
    blocks, block = _blocks(items)
    if blocks == 1:
        return _searched(plain, context.broadcast(block(0)), names).toDF(*back, *_OUTPUT_NAMES)
    # Several blocks of tests: one action and one broadcast at a time; rows are known by their place in a written table.
    numbered = stored(plain.withColumn("row", F.monotonically_increasing_id()), "decontaminated")
    each = []
    for b in range(blocks):
        shared = context.broadcast(block(b))
        each.append(stored(_searched(numbered.select("row", "text"), shared, ["row"], hits_only=b > 0), "block-matches"))
        shared.destroy()
    found = functools.reduce(DataFrame.unionByName, each).groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        merged_column(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max_by("longest", F.struct(F.col("longest.words"), -F.col("longest.at"))).alias("longest"),
    )
    return numbered.select("row", *names).join(found, "row").drop("row").toDF(*back, *_OUTPUT_NAMES)


def merged_column(hits):
    """Overlapping and touching ranges of an array as one."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(hits), start, add)


def clean(df: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of df without any occurrence of a window of the items; all columns as they are."""
    plain = masked(df, "text")
    return matches(plain, items).where(F.size("hits") == 0).select(*plain.columns).toDF(*df.columns)


def digest(df: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's row per document; longest_match (in words) is extra."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return matches(df.select("doc_id", "text"), items, keep_text=False).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.col("longest.words"), F.lit(0)).alias("longest_match"),
    )


#: The same rows by DuckDB: all windows of all documents, joined with those of the items; runs of pairs are matches.
ORACLE_SQL = r"""
WITH i AS (SELECT item_id, row_number() OVER () AS t, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT item_id, t, least(len(w), 10) AS z, k, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT r, z, k, array_to_string(w[k : k + z - 1], ' ') AS x FROM (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM d, (SELECT DISTINCT z FROM iw) WHERE len(w) >= z)),
h AS (SELECT dw.r, dw.k, dw.z, iw.item_id, iw.t, iw.k AS j FROM dw JOIN iw ON dw.z = iw.z AND dw.x = iw.x),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + z)) AS p FROM (SELECT DISTINCT r, k, z FROM h)) GROUP BY 1),
g AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1),
m AS (SELECT r, max(n + z - 1) AS longest FROM (SELECT r, t, z, count(*) AS n FROM (SELECT *, k - j AS diagonal, k - row_number() OVER (PARTITION BY r, t, k - j ORDER BY k) AS run FROM h) GROUP BY r, t, z, diagonal, run) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest, 0) AS longest_match
FROM d LEFT JOIN c USING (r) LEFT JOIN g USING (r) LEFT JOIN m USING (r)
"""
