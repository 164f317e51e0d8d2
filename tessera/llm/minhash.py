"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct runs of `shingle` words (the whole sequence if it has fewer words), each a 64-bit hash.
Documents of equal sets are one class. Signatures of BANDS x ROWS minimum hashes put classes into buckets, one per band;
classes that share a bucket are candidates. A candidate pair's signatures are compared batch by batch; after each batch
the pair is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold is below
MISS. Survivors are verified on their full sets by integers: 100 * |A and B| >= percent * |A or B|.

A group of copies never becomes all its pairs:
1. every class is tried against one centre of its buckets; links give components;
2. in buckets that still hold several components, classes outside the first one are tried against one of it and one of
   themselves; links give components again;
3. what remains are pairs of different components in one bucket. In each bucket the classes outside its largest
   component meet the others in blocks of BLOCK by BLOCK, each pair in the first bucket that both share: a first pass
   prunes by signatures, a second verifies the full sets of the classes that have a pair left, and gives one link per two
   components of a block at most.
Pairs inside a component are never looked at: a link between them would change nothing. So the result is that of testing
all candidates. A candidate pair of similarity s exactly is missed with probability (1 - s ** ROWS) ** BANDS: 5e-6 at
0.8. Components come from distributed label propagation.

`near_duplicates(df, shingle)` gives per row doc_id, n_shingles, component_id (least doc_id reachable) and kept.

Defined results: null, empty and blank texts have no set, are linked with nothing and kept; texts of any length are used
whole; equal sets are linked; rows that share doc_id and text are one document, all kept or none; of the documents of a
component that share its least id one is kept (by a hash of id and text); a null doc_id is an id like others, but never the
least one unless its component has no other; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components, looked_up
from .runtime import byte_blocks, dropped, give_back, map_batches, masked, stored, text_or_empty
from .words import NOT_BLANK, mix, runs, scan

ROWS, BANDS = 6, 40
HASHES = ROWS * BANDS
MISS, BATCH, BLOCK = 1e-6, 24, 128
#: Rows of ids (16 bytes each) that may be broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 1_000_000
#: The same for rows of an id, a key and a flag.
WIDE_ROWS = 100_000
_U, _V = np.uint64, np.uint32
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 32, HASHES, dtype=_V) | _V(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=_V)


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found = scan(texts, NOT_BLANK)
    values, at = runs(found.hashes(), found.first, shingle)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        v = np.sort(values[a:b])
        out.append(v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) > 1 else v)
    return out


def class_key(values: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64)))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The low 16 bits of the minimum of HASHES hash functions over each (non-empty) set."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.empty((len(sets), HASHES), _V)
    first = 0
    while first < len(sets):
        # A run of sets that stays in cache; a longer set is a run of its own.
        last = max(first + 1, first + int(np.searchsorted(np.cumsum(size[first:]), 1 << 17, "right")))
        x = np.concatenate(sets[first:last])
        x = (x >> _U(32)).astype(_V) ^ x.astype(_V)
        at = np.concatenate([[0], np.cumsum(size[first : last - 1])])
        work = np.empty_like(x)
        for i in range(HASHES):
            np.multiply(x, _A[i], out=work)
            np.add(work, _B[i], out=work)
            out[first:last, i] = np.minimum.reduceat(work, at)
        first = last
    return out.astype("<u2")


def bands(sig: np.ndarray) -> np.ndarray:
    """A signed key per band; the band's number is part of it."""
    out = np.empty((len(sig), BANDS), _U)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, _U)
        for i in range(b * ROWS, (b + 1) * ROWS):
            h = mix(h * _U(0x9E3779B97F4A7C15) + sig[:, i].astype(_U))
        out[:, b] = h
    return out.view(np.int64)


@functools.lru_cache
def least_matches(percent: int, miss: float = MISS) -> dict[int, int]:
    """For each number n of compared hashes the fewest matches that keep P(similarity >= percent) at miss or more."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            p = np.exp(log - log.max())
            if p[grid >= percent / 100].sum() >= miss * p.sum():
                out[n] = m
                break
    return out


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (left[i], right[j]) of signatures pass every batch's posterior bound."""
    alive = np.arange(len(i))
    match = np.zeros(len(i), np.int64)
    for n, least in least_matches(percent).items():
        match[alive] += (left[i[alive], n - BATCH : n] == right[j[alive], n - BATCH : n]).sum(axis=1)
        alive = alive[match[alive] >= least]
        if not alive.size:
            break
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough, by exact counts."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if 100 * small < percent * large:
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= percent * (len(a) + len(b) - both)


def _row_key(df: DataFrame) -> Column:
    """A signed 64-bit hash of all columns: the same for equal rows, whenever df is read."""
    return F.xxhash64(*(F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema))


def _described(df: DataFrame, shingle: int) -> DataFrame:
    """doc_id, key (of the row), n_shingles, node (key of the set; null without one) and keys of its bands."""
    kept = df.select("doc_id", _row_key(df).alias("key"), text_or_empty().alias("text"))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in byte_blocks(batch, "text"):
            sets = shingle_sets(block.column("text"), shingle)
            full = [s for s in sets if len(s)]
            keys = bands(signatures(full)) if full else np.zeros((0, BANDS), np.int64)
            has = np.array([len(s) > 0 for s in sets])
            ends = np.concatenate([[0], np.cumsum(np.where(has, BANDS, 0))]).astype(np.int32)
            yield {
                "doc_id": block.column("doc_id"),
                "key": block.column("key"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()),
                "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1))),
            }

    return map_batches(kept, step, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, key long, n_shingles long, node long, bands array<long>")


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast df if a count shows that it may be."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _full_sets(df: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, signature (binary) and set (binary) of the wanted classes (node, doc_id, key), each from one row of that id and key."""
    wanted = _small(wanted)
    keyed = df.select("doc_id", _row_key(df).alias("key"), text_or_empty().alias("text"))
    kept = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["key"] == wanted["key"]))
    # Equal rows share id and key: one of them is enough.
    kept = kept.groupBy("node").agg(F.any_value("text").alias("text"))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        for block in byte_blocks(batch, "text"):
            sets = list(zip(block.column("node").to_pylist(), shingle_sets(block.column("text"), shingle), strict=True))
            sig = signatures([s for _, s in sets])
            yield {
                "node": pa.array([k for k, _ in sets], pa.int64()),
                "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                "set": pa.array([s.tobytes() for _, s in sets], pa.binary()),
            }

    return map_batches(kept.select("text", "node"), step, "node long, sig binary, set binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are links: sequential Bayesian pruning of signatures, then full sets."""
    pairs = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "pairs")
    few = _small(pairs)
    left = sets.join(few, sets["node"] == few["u"]).select("u", "v", F.col("sig").alias("su"), F.col("set").alias("tu"))
    right = sets.join(few, sets["node"] == few["v"]).select("u", "v", F.col("sig").alias("sv"), F.col("set").alias("tv"))

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        su, sv = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in ("su", "sv"))
        each = np.arange(batch.num_rows)
        kept = [i for i in surviving(su, sv, each, each, percent).tolist() if linked(*(np.frombuffer(batch.column(c)[i].as_buffer(), _U) for c in ("tu", "tv")), percent)]
        yield {c: batch.column(c).take(pa.array(kept, pa.int64())) for c in ("u", "v")}

    # Rebalanced: a few links from many tasks would be as many files.
    links = stored(map_batches(left.join(right, ["u", "v"]), step, "u long, v long").hint("rebalance"), "links")
    dropped(pairs)
    return links


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their labels, of buckets that hold several components; first is the least label there."""
    rows = members.join(labels, "node", "left").select("bucket", "band", "node", F.coalesce("label", "node").alias("label"))
    # The member of the first component and the one outside it that later steps try others against.
    first = rows.groupBy("bucket").agg(F.min(F.struct("label", "node")).alias("low"), F.max("label").alias("high")).where("low.label < high")
    return rows.join(first, "bucket").select("bucket", "band", "node", "label", F.col("low.label").alias("first"), F.col("low.node").alias("centre"))


def _second_pairs(rows: DataFrame) -> DataFrame:
    outside = rows.where("label <> first")
    own = outside.groupBy("bucket").agg(F.min("node").alias("other"))
    return outside.select(F.col("node").alias("u"), F.col("centre").alias("v")).union(outside.join(own, "bucket").select("node", "other"))


class Block:
    """Classes of one bucket, some of them outside its largest component, compared with those in the block."""

    def __init__(self, band: int, nodes: list, labels: list, out: list, sigs: list, percent: int):
        self.node, self.percent, self.band = np.array(nodes, np.int64), percent, band
        self.outside = np.array(out, bool)
        self.inside = np.flatnonzero(~self.outside)
        self.sig = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, HASHES)
        self.root = np.unique(np.array(labels, np.int64), return_inverse=True)[1]

    def candidates(self, i: int) -> np.ndarray:
        """The classes of other components that outlast the posterior bound beside class i; each pair in its first common band only."""
        j = self.inside[self.root[self.inside] != self.root[i]]
        if self.band and len(j):
            below = slice(0, self.band * ROWS)
            j = j[~(self.sig[j, below] == self.sig[i, below]).reshape(len(j), self.band, ROWS).all(axis=2).any(axis=1)]
        return j[surviving(self.sig, self.sig, np.full(len(j), i), j, self.percent)] if len(j) else j

    def survivors(self) -> np.ndarray:
        """Classes that have a pair left to verify."""
        found = np.zeros(len(self.node), bool)
        for i in np.flatnonzero(self.outside).tolist():
            j = self.candidates(i)
            found[j] = True
            found[i] |= len(j) > 0
        return np.flatnonzero(found)

    def links(self, sets: list) -> tuple[list, list]:
        """Links between components, verified on full sets: of several between two components, one is enough."""
        values = [np.frombuffer(x, _U) for x in sets]
        u, v = [], []
        for i in np.flatnonzero(self.outside).tolist():
            j = self.candidates(i)
            if not len(j):
                continue
            size = np.array([len(values[k]) for k in j.tolist()], np.int64)
            place = np.searchsorted(values[i], every := np.concatenate([values[k] for k in j.tolist()]))
            found = values[i][np.minimum(place, len(values[i]) - 1)] == every
            both = np.add.reduceat(found.astype(np.int64), np.cumsum(size) - size)
            for k in j[100 * both >= self.percent * (size + len(values[i]) - both)].tolist():
                if self.root[k] != self.root[i]:
                    u.append(int(self.node[i]))
                    v.append(int(self.node[k]))
                    self.root[self.root == self.root[k]] = self.root[i]
        return u, v


def _blocks(keyed: DataFrame, columns: list[str], schema: str, work: Callable[[tuple, list[list]], dict]) -> DataFrame:
    """work() on the rows of each (bucket, x, y), which has classes outside and others; held one block at a time."""
    keys = ["bucket", "band", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, [[] for _ in columns]
        out = columns.index("out")

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None and any(held[out]) and not all(held[out]):
                yield pa.RecordBatch.from_pydict(work(key, held))

        for batch in batches:
            for *at, row in zip(*(batch.column(c).to_pylist() for c in keys), zip(*(batch.column(c).to_pylist() for c in columns), strict=True), strict=True):
                if tuple(at) != key:
                    yield from done()
                    key, held = tuple(at), [[] for _ in columns]
                for into, value in zip(held, row, strict=True):
                    into.append(value)
        yield from done()
        give_back()

    # The blocks of one large bucket go to many tasks.
    return keyed.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *columns).mapInArrow(run, schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """Every class of a mixed bucket in the blocks (x, y) in which it meets others: out as one outside the largest component, else as any."""
    sizes = rows.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    sizes = sizes.select("bucket", F.col("most.label").alias("largest"), blocks(F.col("n")).alias("wide"), blocks(F.col("n") - F.col("most.n")).alias("high"))
    spot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base = looked_up(rows, sizes, "bucket").withColumn("outside", F.col("label") != F.col("largest"))
    across = base.select("bucket", "band", "node", "label", F.lit(False).alias("out"), spot(F.col("wide")).alias("x"), every(F.col("high")).alias("y"))
    down = base.where("outside").select("bucket", "band", "node", "label", F.lit(True).alias("out"), spot(F.col("high")).alias("y"), every(F.col("wide")).alias("x"))
    return across.unionByName(down)


def _remaining_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components whose classes share a bucket, found bucket by bucket.

    In each bucket the classes outside its largest component meet all others in blocks of BLOCK by BLOCK: signatures
    first, then full sets of the classes that have a pair left.
    """
    rows = stored(rows.select("bucket", "band", "node", "label"), "unsettled")
    keyed = _dealt(rows)

    def surviving_nodes(key: tuple, held: list[list]) -> dict:
        node, label, out, sig = held
        kept = Block(key[1], node, label, out, sig, percent).survivors().tolist()
        types = {"bucket": pa.int64(), "band": pa.int32(), "x": pa.int32(), "y": pa.int32()}
        return {**{k: pa.array([v] * len(kept), t) for (k, t), v in zip(types.items(), key, strict=True)}, "node": pa.array([node[i] for i in kept], pa.int64()), "label": pa.array([label[i] for i in kept], pa.int64()), "out": pa.array([out[i] for i in kept], pa.bool_())}

    def links(key: tuple, held: list[list]) -> dict:
        node, label, out, sig, values = held
        u, v = Block(key[1], node, label, out, sig, percent).links(values)
        return {"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())}

    signed = keyed.join(sets.select("node", "sig"), "node")
    left = stored(_blocks(signed, ["node", "label", "out", "sig"], "bucket long, band int, x int, y int, node long, label long, out boolean", surviving_nodes).hint("rebalance"), "survivors")
    dropped(rows)
    if not left.limit(1).count():
        return left.select(F.col("node").alias("u"), F.col("node").alias("v"))
    full = left.join(sets, "node")
    out = stored(_blocks(full, ["node", "label", "out", "sig", "set"], "u long, v long", links).hint("rebalance"), "links")
    dropped(left)
    return out


def _grouped(df: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, key (of the row), n_shingles, component_id and kept of every row of df; kept are the rows of one key in each component."""
    rows = stored(_described(df, shingle), "described")
    # The row that stands for a class or component: that of the least id (null comes last), then of the least key.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    classes = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("least"), F.any_value("bands").alias("bands")), "classes")
    banded = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    centres = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1").drop("n")
    members = stored(banded.join(centres, "bucket").select("bucket", "band", "node", "centre").hint("rebalance"), "members")
    wanted = classes.select("node", "least.doc_id", "least.key").join(members.select("node").distinct(), "node", "left_semi")
    wanted = stored(wanted, "wanted")
    sets = stored(_full_sets(df, wanted, shingle), "sets")

    found = [_verified(members.groupBy("node").agg(F.min("centre").alias("centre")).toDF("u", "v"), sets, percent)]
    labels = components(found[0])
    for further in (lambda rows: _verified(_second_pairs(rows), sets, percent), lambda rows: _remaining_links(rows, sets, percent)):
        found.append(further(_labelled(members, labels)))
        dropped(labels)
        labels = components(functools.reduce(DataFrame.union, found))

    own = classes.select("node", "least")
    least = labels.join(own, "node").groupBy("label").agg(F.min("least").alias("least"))
    joined = own.join(looked_up(labels, least, "label").select("node", F.col("least").alias("joined")), "node", "left").select("node", F.coalesce("joined", "least").alias("least"))
    # A class may be a third of all rows: its documents are joined where they are.
    joined = stored(joined, "joined")
    out = looked_up(rows.select("doc_id", "key", "n_shingles", "node"), joined, "node", "left", most=WIDE_ROWS)
    alone = F.col("node").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key")))
    out = stored(out.select("doc_id", "key", "n_shingles", component.alias("component_id"), kept.alias("kept")), "duplicates")
    for done in (rows, classes, members, wanted, sets, *found, labels, joined):
        dropped(done)
    return out


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of df."""
    return _grouped(df.select("doc_id", "text"), shingle, percent).drop("key")


def deduplicated(df: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that stay: one of each group (of the least doc_id, then by a hash of the whole row), and those without a set; of equal rows one."""
    plain = masked(df, "doc_id", "text")
    found = _grouped(plain, shingle, percent)
    names = [F.col(f"d.{c}") for c in plain.columns]
    keyed = plain.withColumn("row_key", _row_key(plain)).alias("d")

    def match(other: DataFrame) -> Column:
        return F.col("d.doc_id").eqNullSafe(other["doc_id"]) & (F.col("d.row_key") == other["key"])

    gone = _small(found.where("not kept").select("doc_id", "key").distinct())
    twice = stored(found.where("kept").groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeated")
    out = keyed.join(gone, match(gone), "left_anti")
    # Only rows that are there several times are shuffled.
    if not twice.limit(1).count():
        return out.select(*names).toDF(*df.columns)
    twice = _small(twice)
    once = out.join(twice, match(twice), "left_anti").select(*names)
    return once.unionByName(keyed.join(twice, match(twice), "left_semi").dropDuplicates(["doc_id", "row_key"]).select(*names)).toDF(*df.columns)


def digest(df: DataFrame, shingle: int = 4) -> DataFrame:
    """The contract's row per document, with its own shingle width; kept says whether the id is its component's, whatever rows share it."""
    return near_duplicates(df.select("doc_id", "text"), shingle).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same rows by DuckDB, for tables without repeated or null ids: shared shingles of all pairs, then reachability.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS x FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 80 * (a.n + b.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.v FROM r JOIN l ON r.b = l.u),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
