"""Queries over authored structures, spread over the part table, and streaming forms over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structures
from ..operators import chemistry
from ..streaming import events as streaming
from .catalog import query, table

#: Authored texts; parts take them in turn by their key.
AUTHORED = ("CCO", "OCC", "c1ccccc1", "C1=CC=CC=C1", "CC(=O)OCC", "CC(=O)NC", "Oc1ccccc1", "CC1CCCCC1", "C[N+](=O)[O-]", "[Na+].[Cl-]", "not a structure")
REPEATS = ("*CC*", "*CCCC*", "*CCO*", "*COC*", "*OCCOCC*")


def _parts(spark: SparkSession, sf_dir: str, texts: tuple[str, ...] = AUTHORED) -> DataFrame:
    chosen = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", chosen.alias("smiles"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _texts(texts: tuple[str, ...]) -> str:
    return f"t AS (SELECT * FROM (VALUES {_values(list(enumerate(texts)))}) v(i, smiles)), p AS (SELECT p_partkey, smiles FROM part JOIN t ON p_partkey % {len(texts)} = i)"


# Worked out by hand, per authored text.
_GROUPS = [("CCO", "alcohol", 1), ("CCO", "saturated_c", 2), ("OCC", "alcohol", 1), ("OCC", "saturated_c", 2), ("c1ccccc1", "aromatic_c", 6), ("C1=CC=CC=C1", "aromatic_c", 6), ("CC(=O)OCC", "ester", 1), ("CC(=O)OCC", "saturated_c", 3), ("CC(=O)NC", "amide", 1), ("CC(=O)NC", "saturated_c", 2), ("Oc1ccccc1", "phenol", 1), ("Oc1ccccc1", "aromatic_c", 6), ("CC1CCCCC1", "saturated_c", 7), ("C[N+](=O)[O-]", "amine", 1), ("C[N+](=O)[O-]", "saturated_c", 1), ("[Na+].[Cl-]", "halogen", 1)]
_SCOPE = [(t, "") for t in AUTHORED[:8]] + [(AUTHORED[8], "ionic_not_validated|incomplete_atom_coverage"), (AUTHORED[9], "mixture_or_salt_not_validated|ionic_not_validated|element_not_supported|incomplete_atom_coverage"), (AUTHORED[10], "unreadable")]


@query(f"WITH {_texts(AUTHORED)}, g AS (SELECT * FROM (VALUES {_values(_GROUPS)}) v(smiles, name, n)) SELECT name, count(*) AS parts, CAST(sum(n) AS BIGINT) AS matches FROM p JOIN g USING (smiles) GROUP BY 1")
def owned_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chemistry.with_ownership(_parts(spark, sf_dir)).select(F.explode("counts").alias("name", "n"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("matches"))


@query(f"WITH {_texts(AUTHORED)}, s AS (SELECT * FROM (VALUES {_values(_SCOPE)}) v(smiles, reasons)) SELECT reasons, count(*) AS n FROM p JOIN s USING (smiles) GROUP BY 1")
def scope_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.when(F.col("structure_fault").isNotNull(), "unreadable").otherwise(F.array_join("scope", "|"))
    return chemistry.with_scope(_parts(spark, sf_dir)).groupBy(reasons.alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_texts(REPEATS)} SELECT CASE WHEN smiles IN ('*CC*', '*CCCC*') THEN 2 ELSE 3 END AS texts, count(*) AS parts FROM p GROUP BY 1")
def periodic_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five written repeat units are two endless chains."""
    found = chemistry.with_periodic_alias(_parts(spark, sf_dir, REPEATS))
    return found.groupBy("periodic").agg(F.count_distinct("smiles").alias("texts"), F.count(F.lit(1)).alias("parts")).select(F.col("texts").cast("int").alias("texts"), "parts")


@query(f"""WITH {_texts(AUTHORED[:8])}, f AS (SELECT *, CASE WHEN smiles IN ('CCO', 'OCC', 'CC(=O)OCC', 'CC(=O)NC') THEN 0 WHEN smiles IN ('c1ccccc1', 'C1=CC=CC=C1', 'Oc1ccccc1', 'CC1CCCCC1') THEN 1 END AS family FROM p)
SELECT min(p_partkey) AS "group", count(*) AS rows FROM f GROUP BY family""")
def structure_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acyclic texts share one scaffold; rings of six share a topology."""
    return chemistry.families(_parts(spark, sf_dir, AUTHORED[:8]), "p_partkey").groupBy("group").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT CAST(n AS INT) AS units, round(CAST(30.07 + 28.054 * n AS DOUBLE), 3) AS mass, CAST(2 * n + 2 AS INT) AS saturated_c FROM (SELECT unnest([1, 2, 16, 64]) n)")
def chain_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masses and carbons of capped chains, joined unit by unit."""
    del sf_dir
    rows = [(n, round(structures.weight(m), 3), structures.owned_groups(m).counts["saturated_c"]) for n in (1, 2, 16, 64) for m in [structures.chain("*CC*", n, "*C", "*C")]]
    return spark.createDataFrame(rows, "units int, mass double, saturated_c int")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: daily windows of a stream, all of them (complete mode)."""
    events = streaming.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = streaming.drained(streaming.windowed_counts(events, "ts", "1 day", "1 hour", ["event_type"]), "counts", "complete")
    last = out.groupBy("start", "event_type").agg(F.max("n").alias("n"))
    return last.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: the first event of each user and type of a stream, with a watermark longer than the stream."""
    events = streaming.source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_type", "ts")
    out = streaming.drained(streaming.first_per_key(events, ["user_id", "event_type"], "ts", "3650 days"), "first")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("users"))
