"""Language ID by prediction by partial matching over bytes, under frozen statistics.

For each language, counts of every byte after every context of 0 to ORDER bytes are learned from a bounded sample of
labelled texts. The code length of a byte is found in the longest context that the language has seen: the byte's own
share there, or the escape's share (method C: as many escapes as distinct bytes) and the next shorter context; below the
empty context all 256 bytes are equal. A document costs the sum over its lowered text; the language with the shortest
code wins, ties going to the name that sorts first.

Code lengths are integers of 1/4096 bit, so sums do not depend on batches or partitions.

Defined results: `und` with score 0 where the text is null, has no letter, or nothing could be learned; texts of any
length are scored whole; repeated rows get equal results; other columns pass through, but columns named as the outputs
are replaced (accepted() returns all columns as they were); an empty table gives an empty one. A letter is a character of
Unicode's category L. Of each language texts are learned in order of a hash of doc_id and text until they have
SAMPLE_BYTES (one at least, and SAMPLE_BYTES letters of one text at most); MOST_LANGUAGES bounds the languages (more are
an error).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .probe_table import ProbeTable
from .runtime import id_remainder, map_batches, masked, schema_of

ORDER, SAMPLE_BYTES, MOST_LANGUAGES = 3, 1 << 19, 200
#: Bits of the hash by which sizes are first summed.
PREFIX_BITS = 12
BIT = 4096
_U = np.uint64
#: The same class of letters as in _sample(): Unicode's category L.
_LETTER = regex.compile(r"\p{L}")
_SEPARATOR = b"\n"
#: Positions that are scored at a time.
_SPAN = 1 << 18


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    """The bytes that end at each position from width - 1 on, as one number each."""
    out = np.zeros(len(data) - width + 1, _U)
    for i in range(width):
        out = (out << _U(8)) | data[i : len(data) - width + 1 + i].astype(_U)
    return out


@dataclass
class ContextTrees:
    """Frozen statistics of all languages. costs[k] and escapes[k] have a row per known gram or context, a column per language."""

    languages: list[str]
    order: int
    grams: list[ProbeTable] = field(default_factory=list)
    costs: list[np.ndarray] = field(default_factory=list)
    contexts: list[ProbeTable] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def learn(cls, samples: dict[str, list[bytes]], order: int = ORDER) -> ContextTrees:
        trees = cls(sorted(samples), order)
        n = len(trees.languages)
        pad = _SEPARATOR * order
        data = [np.frombuffer(pad + pad.join(samples[name]), np.uint8) for name in trees.languages]
        for k in range(order + 1):
            counted = [np.unique(_grams(d, k + 1), return_counts=True) for d in data]
            keys = np.unique(np.concatenate([g for g, _ in counted]))
            counts = np.zeros((len(keys), n), np.int64)
            for j, (g, c) in enumerate(counted):
                counts[np.searchsorted(keys, g), j] = c
            owner = keys >> _U(8)
            contexts, at = np.unique(owner, return_inverse=True)
            total, kinds = np.zeros((len(contexts), n), np.int64), np.zeros((len(contexts), n), np.int64)
            np.add.at(total, at, counts)
            np.add.at(kinds, at, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
                own = np.log2((total + kinds)[at] / counts)
            lower = trees._shorter(keys, k)
            cost = np.where(counts > 0, np.rint(np.where(counts > 0, own, 0) * BIT).astype(np.int64), np.rint(escape[at] * BIT).astype(np.int64) + lower)
            trees.grams.append(ProbeTable(keys))
            trees.costs.append(cost.astype(np.int32))
            trees.contexts.append(ProbeTable(contexts))
            trees.escapes.append(np.rint(escape * BIT).astype(np.int32))
        return trees

    def _shorter(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Costs of the grams' last bytes in contexts of k - 1 bytes."""
        if k == 0:
            return np.full((len(keys), len(self.languages)), 8 * BIT, np.int64)
        return self.cost(keys & _U((1 << 8 * k) - 1), k - 1)

    def cost(self, grams: np.ndarray, k: int) -> np.ndarray:
        """Code lengths of the last byte of each gram of k + 1 bytes, a column per language."""
        row = self.grams[k].find(grams)
        out = self.costs[k][np.maximum(row, 0)].astype(np.int64)
        miss = np.flatnonzero(row < 0)
        if miss.size:
            g = grams[miss]
            context = self.contexts[k].find(g >> _U(8))
            escape = np.where((context < 0)[:, None], 0, self.escapes[k][np.maximum(context, 0)])
            out[miss] = escape + self._shorter(g, k)
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in 1/BIT bit, a column per language."""
        pad = _SEPARATOR * self.order
        data = np.frombuffer(pad + pad.join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        first = np.concatenate([[0], np.cumsum(size + self.order)[:-1]])
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for a in range(0, len(data) - self.order, _SPAN):
            b = min(a + _SPAN, len(data) - self.order)
            cost = self.cost(_grams(data[a : b + self.order], self.order + 1), self.order)
            # Position p is a byte of text i if first[i] <= p < first[i] + size[i]; what follows are separators.
            rows = np.flatnonzero((first < b) & (first + size > a) & (size > 0))
            if rows.size:
                bounds = np.empty(2 * rows.size, np.int64)
                bounds[0::2], bounds[1::2] = np.maximum(first[rows], a) - a, np.minimum(first[rows] + size[rows], b) - a
                tail = bounds[-1] == b - a
                out[rows] += np.add.reduceat(cost, bounds[:-1] if tail else bounds, axis=0)[0::2]
        return out


def _reached(rows: DataFrame) -> dict[str, int]:
    """Per language the hash up to which its rows have SAMPLE_BYTES (the largest if they don't), rounded up to a prefix of few SAMPLE_BYTES.

    A round counts bytes by the next PREFIX_BITS of the hash in the prefix that the last one ended in, of languages whose prefix still
    holds much: so the rows that are sorted later are as few in a large corpus as in a small one.
    """
    done: dict[str, int] = {}
    # Of each open language: its prefix and the bytes before it.
    open_: dict[str, tuple[int, int]] | None = None
    bits = 0
    while open_ is None or open_:
        bits += PREFIX_BITS
        near, carried = rows, F.lit(0)
        if open_ is not None:
            at = F.create_map(*[F.lit(x) for lang, (prefix, _) in open_.items() for x in (lang, prefix)])
            near = rows.where(F.col("lang").isin(list(open_)) & (F.shiftright("u", 63 - bits + PREFIX_BITS) == at[F.col("lang")]))
            carried = F.create_map(*[F.lit(x) for lang, (_, before) in open_.items() for x in (lang, before)])[F.col("lang")]
        parts = near.groupBy("lang", F.shiftright("u", 63 - bits).alias("part")).agg(F.sum("size").alias("size"))
        before = carried + F.coalesce(F.sum("size").over(Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = parts.withColumn("before", before).where(F.col("before") < SAMPLE_BYTES)
        found = reached.groupBy("lang").agg(F.max(F.struct("part", "before", "size")).alias("last")).select("lang", "last.*").limit(MOST_LANGUAGES + 1).collect()
        if len(found) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
        open_ = {}
        for r in found:
            if r["size"] > 8 * SAMPLE_BYTES and bits + PREFIX_BITS < 63:
                open_[r["lang"]] = (r["part"], r["before"])
            else:
                done[r["lang"]] = ((r["part"] + 1) << (63 - bits)) - 1
    return done


def _sample(df: DataFrame, learned: Column) -> dict[str, list[bytes]]:
    """Lowered texts of each language, the first ones by a hash until they have SAMPLE_BYTES; of a longer text as many letters."""
    rows = df.where(learned & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.octet_length("text").cast("long")
    order = F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string"), "text")
    rows = rows.select(F.shiftrightunsigned(order, 1).alias("u"), order.alias("o"), "lang", "text", F.least(size, F.lit(SAMPLE_BYTES)).alias("size"))
    last = _reached(rows)
    if not last:
        return {}
    bound = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    cut = F.when(F.col("size") < SAMPLE_BYTES, F.col("text")).otherwise(F.substring("text", 1, SAMPLE_BYTES))
    # Equal rows have equal hashes and are sent once, with their number.
    near = rows.where(F.col("u") <= bound[F.col("lang")]).groupBy("lang", "u", "o", "size", cut.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    order_in = Window.partitionBy("lang").orderBy("u", "o", "text").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(order_in), F.lit(0))).where(F.col("before") < SAMPLE_BYTES)
    found: dict[str, list[bytes]] = {}
    for lang, _, text, each, n, held in sorted(near.select("lang", "before", "text", "size", "n", "before").collect()):
        found.setdefault(lang, []).extend([text.lower().encode()] * min(n, -(-(SAMPLE_BYTES - held) // each)))
    return found


def learn(df: DataFrame, learned: Column, order: int = ORDER) -> ContextTrees | None:
    samples = _sample(df, learned)
    return ContextTrees.learn(samples, order) if samples else None


def identify(df: DataFrame, trees: ContextTrees | None, keep_text: bool = True) -> DataFrame:
    """df with lang_pred, score (the best language's share of 2 ** -length) and bits_per_byte (of its code)."""
    kept = df.drop("lang_pred", "score", "bits_per_byte")
    names = [c for c in kept.columns if keep_text or c != "text"]
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        trees = shared.value
        for first, texts in _lowered(batch.column("text").fill_null("")):
            n = len(texts)
            langs, scores, bits = ["und"] * n, np.zeros(n), [None] * n
            lettered = [i for i, t in enumerate(texts) if trees is not None and _LETTER.search(t)]
            if lettered:
                coded = [texts[i].encode() for i in lettered]
                length = trees.lengths(coded)
                best = length.argmin(axis=1)
                least = length[np.arange(len(best)), best]
                share = 1 / np.exp2(-np.minimum((length - least[:, None]) / BIT, 1000)).sum(axis=1)
                for i, b, s, c, t in zip(lettered, best.tolist(), share.tolist(), least.tolist(), coded, strict=True):
                    langs[i], scores[i], bits[i] = trees.languages[b], s, c / BIT / len(t)
            block = batch.slice(first, n)
            yield {c: block.column(c) for c in names} | {"lang_pred": pa.array(langs), "score": pa.array(scores), "bits_per_byte": pa.array(bits, pa.float64())}

    return map_batches(kept, step, f"{schema_of(kept if keep_text else kept.drop('text'))}, lang_pred string, score double, bits_per_byte double")


def _lowered(values: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The first row and lowered texts of runs that hold about limit letters (one text at least)."""
    first, texts, size = 0, [], 0
    for i in range(len(values)):
        texts.append(values[i].as_py().lower())
        size += len(texts[-1])
        if size >= limit:
            yield first, texts
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts


def accepted(df: DataFrame, trees: ContextTrees | None) -> DataFrame:
    """The rows of df whose text is in some learned language: not `und`, and coded in fewer than the 8 bits a byte of no language."""
    plain = masked(df, "text")
    return identify(plain, trees).where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") < 8)).select(*plain.columns).toDF(*df.columns)


def learned_rows() -> Column:
    """Documents that may be learned from."""
    return id_remainder(4) != 2


def digest(df: DataFrame) -> DataFrame:
    """The contract's row per document; bits_per_byte is extra."""
    trees = learn(df.select("doc_id", "text", "lang"), learned_rows())
    found = identify(df.select("doc_id", "text"), trees, keep_text=False)
    return found.select("doc_id", (id_remainder(4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")
