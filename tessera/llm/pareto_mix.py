"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's share of the mix follows from its weight and stops at MOST times its size, so each of its documents is due
target / size copies. The whole part of that number is certain. The rest is an inclusion probability p, and documents are
drawn in order of (u / (1 - u)) / (p / (1 - p)), where u is a number from the hash of the document: random odds over inclusion
odds. Odds differ from source to source and, with `preference`, from document to document. Two samples of fixed size are
drawn in each source: of documents of at least its mean size a fixed number of documents, and of the shorter ones as many
as bring the words nearest to what is left of the target, so long documents don't decide how near the mix comes.

No source is sorted in one task: sums over 65,536 bins of the order show the bin in which a sample ends, and only the rows
of that bin (of each source) are ranked. Numbers come from hashes, so reruns agree.

Null texts have size 0, sources of size 0 have target 0 and take nothing. A null source is a source, the last one. Rows
of equal id, source and text are ranked next to each other, in any order; the same rows give the same taken sizes. Columns of any name
pass through `mixed`. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import looked_up
from .runtime import masked, stored, text_or_empty

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix over words there are, and the most copies of a document.
SHARE, MOST = 1.5, 2
SEED = "2024"
#: Bins of a source's order; a sample ends in one of them.
BINS = 1 << 16
_BLANK = r"[^\x20\x09-\x0D]+"


def ordered(df: DataFrame, by: list[str]) -> DataFrame:
    """df with `position`, its place (from 0) in the order of the columns: places within ranges, and the sizes of lesser ranges."""
    placed = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_place", 33)
    # One row for each partition of the range.
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_place")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (src, n, source_size) with `target`: words by weight, none above most times the size, the excess reshared by weight.

    A round sums over the sources that are not full yet; it fills at least one more, or is the last.
    """
    table = stored(ordered(sources, ["src"]).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))), "sources")
    limit = F.col("source_size") * float(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = F.lit(0.0)
    full = F.lit(False)
    found = -1
    while total:
        row = table.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("w"))), F.sum(full.cast("long"))).first()
        if row[2] == found or not row[1]:
            break
        found = row[2]
        level = F.col("w") * F.lit(share * total - row[0]) / F.lit(float(row[1]))
        full = level >= limit
    return table.select("src", "n", "source_size", F.least(level, limit).alias("target"))


def _ends(rows: DataFrame, amount: Column, wanted: DataFrame) -> DataFrame:
    """Per source the bin in which the sample ends and the amount before it. wanted: src, want."""
    bins = rows.groupBy("src", "bin").agg(F.sum(amount).alias("here"))
    upto = F.sum("here").over(Window.partitionBy("src").orderBy("bin"))
    return bins.withColumn("upto", upto).join(wanted, "src").where("upto >= want").groupBy("src").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("here")).alias("before")), "bin").alias("e")).select("src", F.col("e.bin").alias("end"), F.col("e.before").alias("before"))


def _drawn(rows: DataFrame, amount: Column, wanted: DataFrame) -> DataFrame:
    """rows with `extra`: 1 for those in order of (q, id, size) whose amounts come nearest to the source's `want`, else 0."""
    ends = stored(wanted.join(_ends(rows, amount, wanted), "src", "left").select("src", "want", F.coalesce("end", F.lit(BINS)).alias("end"), F.coalesce("before", F.lit(0)).alias("before")), "ends")
    at = looked_up(rows.withColumn("amount", amount), ends, "src")
    clear = at.where("bin <> end").withColumn("extra", F.when(F.col("want") > 0, (F.col("bin") < F.col("end")).cast("long")).otherwise(F.lit(0).cast("long")))
    last = at.where("bin = end").withColumn("upto", F.col("before") + F.sum("amount").over(Window.partitionBy("src").orderBy("q", "id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    near = last.withColumn("extra", ((F.col("want") > 0) & (2 * F.col("upto") - F.col("amount") <= 2 * F.col("want"))).cast("long")).drop("upto")
    return clear.unionByName(near).drop("want", "end", "before", "amount")


def _copies(docs: DataFrame, carried: list[str], source: str, doc_id: str, text: str, preference: str | None, seed: str) -> DataFrame:
    """The carried columns, size, source_size, target and copies of every row."""
    src = F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.sha2(F.concat_ws("\0", F.lit(seed), shown(doc_id), F.sha2(text_or_empty(text), 256)), 256)
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rows = stored(
        docs.select(F.struct(*carried).alias("row"), shown(doc_id).alias("id"), src.alias("src"), F.regexp_count(text_or_empty(text), F.lit(_BLANK)).cast("long").alias("size"), u.alias("u"), (F.lit(1.0) if preference is None else F.col(preference).cast("double")).alias("likes")), "sizes"
    )
    sources = targets(rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size")))
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = stored(sources.withColumn("due", due).withColumn("whole", F.floor("due")).withColumn("p", F.col("due") - F.col("whole")), "targets")
    q = F.when((F.col("p") > 0) & (F.col("likes") > 0), F.col("u") / (1 - F.col("u")) / (F.col("likes") * F.col("p") / (1 - F.col("p")))).otherwise(F.lit(1e300))
    each = looked_up(rows, sources, "src").withColumn("q", q).withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("long"))
    each = stored(each.withColumn("long", F.col("size") * F.col("n") >= F.col("source_size")), "odds")
    longer, shorter = each.where("long"), each.where("NOT long")
    number = longer.groupBy("src").agg(F.floor(F.max("p") * F.count(F.lit(1)) + 0.5).cast("double").alias("want"))
    first = stored(_drawn(longer, F.lit(1).cast("long"), number), "longer")
    words = first.groupBy("src").agg(F.sum(F.col("extra") * F.col("size")).alias("got"))
    left = sources.join(words, "src", "left").select("src", (F.col("target") - F.col("whole") * F.col("source_size") - F.coalesce("got", F.lit(0))).alias("want"))
    both = first.unionByName(_drawn(shorter, F.col("size"), left))
    return both.select("row.*", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"))


def mixed(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", preference: str | None = None, seed: str = SEED) -> DataFrame:
    """docs with `copies`, how often the mix holds each row, between 0 and 2; use explode(sequence) or a sampler's counts to repeat rows.

    preference: a column that multiplies a row's inclusion odds (positive; null, zero and less come last).
    """
    names = docs.columns
    kept = masked(docs, source, doc_id, text, *([preference] if preference else []))
    out = _copies(kept, kept.columns, source, doc_id, text, preference, seed)
    return out.select(*kept.columns, "copies").toDF(*names, "copies")


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken."""
    out = _copies(docs.select("doc_id", "source", "text"), ["doc_id"], "source", "doc_id", "text", None, SEED)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS id, coalesce('0' || source, '1') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST(('0x' || substr(sha256('2024' || chr(0) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(0) || sha256(coalesce(text, ''))), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT src, count(*) AS n, CAST(sum(size) AS BIGINT) AS z FROM d GROUP BY src),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY src) - 1) % 3 AS BIGINT) + 1] AS w FROM s),
c AS (SELECT *, sum(w) OVER (ORDER BY 2.0::DOUBLE * z / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_w,
  1.5::DOUBLE * sum(z) OVER () - 2.0::DOUBLE * coalesce(sum(z) OVER (ORDER BY 2.0::DOUBLE * z / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_z FROM w),
l AS (SELECT left_z::DOUBLE AS left_z, left_w::DOUBLE AS left_w FROM c WHERE 2.0::DOUBLE * z >= w * left_z / left_w ORDER BY left_w DESC LIMIT 1),
t AS (SELECT src, n, z, least(w * (SELECT left_z FROM l) / (SELECT left_w FROM l), 2.0::DOUBLE * z) AS target FROM w),
r AS (SELECT *, floor(due) AS whole, due - floor(due) AS p FROM (SELECT *, CASE WHEN z > 0 THEN target / z ELSE 0 END AS due FROM t)),
q AS (SELECT d.*, r.z, r.target, r.whole, r.p, d.size * r.n >= r.z AS long, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p)) ELSE 1e300 END AS q FROM d JOIN r USING (src)),
a AS (SELECT *, count(*) OVER (PARTITION BY src, long) AS m, row_number() OVER (PARTITION BY src, long ORDER BY q, id, size) AS k FROM q),
f AS (SELECT *, CASE WHEN long AND floor(p * m + 0.5) > 0 AND 2 * k - 1 <= 2 * floor(p * m + 0.5) THEN 1 ELSE 0 END AS extra FROM a),
g AS (SELECT *, target - whole * z - sum(CASE WHEN long THEN extra * size ELSE 0 END) OVER (PARTITION BY src) AS want, sum(size) OVER (PARTITION BY src, long ORDER BY q, id, size ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT doc_id, size, z AS source_size, target, CAST(size * (whole + CASE WHEN long THEN extra WHEN want > 0 AND 2 * upto - size <= 2 * want THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM g
"""
