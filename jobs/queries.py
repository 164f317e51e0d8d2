"""The jobs as queries: each runs twice into a new folder below spark.checkpoint.dir and gives the rows that are there then."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.storage import fresh_path

from . import family_release, text_intake


def job1_family_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "job1")
    for _ in range(2):
        family_release.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    rows = spark.read.parquet(f"{out}/rows")
    return rows.selectExpr("doc_id", "quality", "reason", "family", "round(predicted, 6) AS predicted", "round(low, 6) AS low", "round(high, 6) AS high", "status", "split")


def job2_text_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fresh_path(spark, "job2")
    for _ in range(2):
        text_intake.run(spark, f"{sf_dir}/documents.parquet", f"{base}/out", f"{base}/checkpoint")
    return text_intake.accepted(spark, f"{base}/out")


_RELEASE = r"""
WITH RECURSIVE k AS (SELECT doc_id, min(text) AS text, count(DISTINCT coalesce(text, chr(0))) > 1 AS several FROM documents GROUP BY 1),
f AS (SELECT doc_id, several, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words FROM k),
m AS (SELECT DISTINCT doc_id, CAST(quality AS DOUBLE) AS quality FROM labels),
c AS (SELECT m.doc_id, quality, text, words, CASE WHEN f.doc_id IS NULL THEN 'unknown_document' WHEN several THEN 'ambiguous_document' WHEN quality IS NULL THEN 'missing_label' WHEN words = 0 THEN 'blank_text' END AS r,
  ln(1 + words) AS x, CASE WHEN words > 0 THEN length(text)::DOUBLE / words END AS z FROM m LEFT JOIN f ON m.doc_id = f.doc_id),
j AS (SELECT *, coalesce(r, CASE WHEN count(*) FILTER (r IS NULL) OVER (PARTITION BY doc_id) > 1 AND r IS NULL THEN 'conflicting' END) AS reason FROM c),
g AS (SELECT * FROM j WHERE reason IS NULL),
al AS (SELECT doc_id, 't:' || sha256(text) AS a FROM g UNION SELECT doc_id, 'l:' || sha256(lower(split_part(text, chr(10), 1))) FROM g),
h AS (SELECT a, min(doc_id) AS u FROM al GROUP BY 1), e0 AS (SELECT DISTINCT doc_id AS v, u FROM al JOIN h USING (a) WHERE doc_id <> u), e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0),
o AS (SELECT doc_id AS node, doc_id AS label FROM g UNION SELECT e.v, o.label FROM o JOIN e ON e.u = o.node AND o.label < e.v),
fam AS (SELECT node AS doc_id, min(label) AS family FROM o GROUP BY 1),
fs AS (SELECT DISTINCT family FROM fam), n AS (SELECT count(*) AS n FROM fs),
ra AS (SELECT family, row_number() OVER (ORDER BY sha256('42' || chr(0) || family::VARCHAR), family) - 1 AS k FROM fs),
rb AS (SELECT family, row_number() OVER (ORDER BY sha256('43' || chr(0) || family::VARCHAR), family) - 1 AS k FROM ra, n WHERE ra.k >= ceil(n * 0.2)),
s AS (SELECT family, 'test' AS split FROM ra, n WHERE k < ceil(n * 0.2) UNION ALL SELECT family, CASE WHEN k < ceil((n - ceil(n * 0.2)) * 0.25) THEN 'calibration' ELSE 'train' END FROM rb, n),
d AS (SELECT g.*, family, split FROM g JOIN fam USING (doc_id) JOIN s USING (family)),
t AS (SELECT *, 1.0::DOUBLE / ((SELECT count(DISTINCT family) FROM d WHERE split = 'train') * count(*) OVER (PARTITION BY family)) AS w FROM d WHERE split = 'train'),
q AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * z) / sum(w) AS mz, sum(w * quality) / sum(w) AS my, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM t),
v AS (SELECT sqrt(sum(w * (x - mx) ** 2)) AS sx, sqrt(sum(w * (z - mz) ** 2)) AS sz, sum(w * (x - mx) * (z - mz)) AS xz, sum(w * (x - mx) * (quality - my)) AS xy, sum(w * (z - mz) * (quality - my)) AS zy FROM t, q),
b AS (SELECT sx, sz, ((xy / sx) * 1.01 - (xz / sx / sz) * (zy / sz)) / (1.01 * 1.01 - (xz / sx / sz) ** 2) AS bx, ((zy / sz) * 1.01 - (xz / sx / sz) * (xy / sx)) / (1.01 * 1.01 - (xz / sx / sz) ** 2) AS bz FROM v),
p AS (SELECT d.*, my + (x - mx) / sx * bx + (z - mz) / sz * bz AS predicted, (x < x0 - 1e-8 OR x > x1 + 1e-8 OR z < z0 - 1e-8 OR z > z1 + 1e-8) AS outside FROM d, q, b),
ce AS (SELECT max(abs(quality - predicted)) AS e FROM p WHERE split = 'calibration' GROUP BY family),
rk AS (SELECT e, row_number() OVER (ORDER BY e) AS k FROM ce),
rad AS (SELECT max(e) AS radius FROM rk WHERE k = (SELECT ceil(round((count(*) + 1) * 0.8, 9)) FROM ce))
SELECT doc_id, quality, CAST(NULL AS VARCHAR) AS reason, family, round(predicted, 6) AS predicted, round(predicted - radius, 6) AS low, round(predicted + radius, 6) AS high,
  CASE WHEN outside THEN 'out_of_domain' WHEN predicted < 0 THEN 'invalid_model_output' ELSE 'synthetic_demo' END AS status, split FROM p, rad
UNION ALL SELECT doc_id, quality, reason, NULL, NULL, NULL, NULL, 'unsupported', 'refused' FROM j WHERE reason IS NOT NULL
"""

_INTAKE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_words,
  sha256(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS digest FROM documents),
g AS (SELECT *, count(*) AS rows FROM d GROUP BY ALL),
c AS (SELECT *, CASE WHEN doc_id IS NULL THEN 'missing_id' WHEN digest IS NULL THEN 'missing_text' WHEN n_words < 5 THEN 'too_short' END AS r FROM g),
i AS (SELECT *, CASE WHEN r IS NULL AND digest > min(digest) OVER (PARTITION BY doc_id, r IS NULL) THEN 'conflicting_id' ELSE r END AS r2 FROM c),
t AS (SELECT *, CASE WHEN r2 IS NULL THEN row_number() OVER (PARTITION BY digest, r2 IS NULL ORDER BY doc_id, coalesce(source, ''), source IS NULL) END AS k FROM i),
e AS (SELECT * FROM t, (SELECT unnest([0, 1]) AS part))
SELECT doc_id, source, n_words, digest, CASE WHEN k = 1 AND part = 0 THEN 1 WHEN k = 1 THEN rows - 1 ELSE rows END AS rows,
  CASE WHEN k = 1 AND part = 0 THEN 'accepted' WHEN k IS NOT NULL THEN 'repeated_text' ELSE r2 END AS reason, 0 AS batch
FROM e WHERE (part = 0 OR k = 1) AND (part = 0 OR rows > 1)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_family_release, job2_text_intake)}


def oracle_sql() -> dict[str, str]:
    return {"job1_family_release": _RELEASE, "job2_text_intake": _INTAKE}
