"""Queries of the core operators over the driver's tables, each beside the SQL that it is compared with.

Doubles that depend on the order of additions are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import diagnostics, domain, grouping, heads, metrics, refuse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mean(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with its own mean of a column on every row: one row is broadcast."""
    return df.join(F.broadcast(df.agg(F.avg(column).alias(name))))


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ------------------------------------------------------------------------------------------------------------- metrics


@query("""
WITH m AS (SELECT avg(o_totalprice) p FROM orders)
SELECT o_orderpriority, count(*) AS rows, round(avg(abs(p - o_totalprice)), 4) AS mae, round(sqrt(avg((p - o_totalprice) ** 2)), 4) AS rmse,
  round(CASE WHEN count(*) >= 2 AND min(o_totalprice) < max(o_totalprice) THEN 1 - sum((p - o_totalprice) ** 2) / (var_pop(o_totalprice) * count(*)) END, 6) AS r2
FROM orders, m GROUP BY 1
""")
def group_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _mean(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", "p")
    out = metrics.component_metrics(orders, F.col("o_totalprice"), F.col("p"), ["o_orderpriority"])
    return _rounded(_rounded(out, 4, "mae", "rmse"), 6, "r2")


_BOUNDS = """b AS (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) e0, max(l_extendedprice) e1 FROM lineitem WHERE l_linenumber = 1 AND l_quantity BETWEEN 5 AND 45)"""


@query(f"""
WITH m AS (SELECT avg(l_extendedprice) p FROM lineitem), {_BOUNDS},
t AS (SELECT l_extendedprice y, p, (l_quantity < q0 - 1e-8 OR l_quantity > q1 + 1e-8 OR l_extendedprice < e0 - 1e-8 OR l_extendedprice > e1 + 1e-8) AS extrapolation, l_discount < 0.02 AS ood FROM lineitem, m, b),
u AS (SELECT y, p, CASE WHEN extrapolation THEN 'extrapolation' ELSE 'non_extrapolation' END AS subset FROM t UNION ALL SELECT y, p, CASE WHEN ood THEN 'ood' ELSE 'non_ood' END FROM t)
SELECT subset, count(*) AS rows, round(avg(abs(p - y)), 3) AS mae, round(sqrt(avg((p - y) ** 2)), 3) AS rmse FROM u GROUP BY 1
""")
def subset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    train = rows.where("l_linenumber = 1 AND l_quantity BETWEEN 5 AND 45")
    low = train.agg(F.min("l_quantity").alias("q0"), F.max("l_quantity").alias("q1"), F.min("l_extendedprice").alias("e0"), F.max("l_extendedprice").alias("e1"))
    b = low.first()
    flags = {"extrapolation": refuse.out_of_range([F.col("l_quantity"), F.col("l_extendedprice")], [b["q0"], b["e0"]], [b["q1"], b["e1"]], 1e-8), "ood": F.col("l_discount") < 0.02}
    out = metrics.subset_metrics(_mean(rows, "l_extendedprice", "p").withColumns(flags), F.col("l_extendedprice"), F.col("p"), list(flags))
    return _rounded(out, 3, "mae", "rmse").drop("r2")


_RADIUS = """
WITH m AS (SELECT avg(p_retailprice) v FROM part), s AS (SELECT p_brand, max(abs(p_retailprice - v)) score FROM part, m GROUP BY 1),
r AS (SELECT score, row_number() OVER (ORDER BY score) k FROM s), n AS (SELECT count(*) g, CAST(ceil(round((count(*) + 1) * {keep}, 9)) AS BIGINT) k FROM s)
SELECT 'price' AS component, CAST(g AS BIGINT) AS groups, n.k AS rank, round((SELECT max(score) FROM r WHERE r.k = n.k), 6) AS radius FROM n
"""


def _radius(spark: SparkSession, sf_dir: str, alpha: float) -> DataFrame:
    part = _mean(table(spark, sf_dir, "part").select("p_brand", "p_retailprice"), "p_retailprice", "v")
    return _rounded(metrics.conformal_radius(part, "p_brand", {"price": F.col("p_retailprice") - F.col("v")}, alpha), 6, "radius")


@query(_RADIUS.format(keep="0.8"))
def conformal_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radius(spark, sf_dir, 0.2)


@query(_RADIUS.format(keep="0.99"))
def conformal_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _radius(spark, sf_dir, 0.01)


@query("""
WITH m AS (SELECT avg(p_retailprice) v FROM part), c AS (SELECT p_brand, CAST(abs(p_retailprice - v) <= 30 AS INT) hit FROM part, m),
g AS (SELECT p_brand, min(hit) a, sum(hit) h, count(*) n FROM c GROUP BY 1)
SELECT round(sum(h) / sum(n), 9) AS row_coverage, round(avg(a), 9) AS group_coverage, 60.0::DOUBLE AS interval_width, CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups FROM g
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _mean(table(spark, sf_dir, "part").select("p_brand", "p_retailprice"), "p_retailprice", "v")
    return _rounded(metrics.coverage(part, "p_brand", F.col("p_retailprice") - F.col("v"), F.lit(30.0)), 9, "row_coverage", "group_coverage")


@query("""
WITH m AS (SELECT avg(o_totalprice) p FROM orders), f AS (SELECT o_orderstatus, o_custkey, avg(abs(p - o_totalprice)) w FROM orders, m GROUP BY 1, 2)
SELECT o_orderstatus, round(avg(w), 4) AS macro_mae, count(*) AS families FROM f GROUP BY 1
""")
def family_macro_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _mean(table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_totalprice"), "o_totalprice", "p")
    return _rounded(metrics.family_macro_mae(orders, ["o_custkey"], F.col("p") - F.col("o_totalprice"), ["o_orderstatus"]), 4, "macro_mae")


@query("""
WITH m AS (SELECT avg(l_quantity) p FROM lineitem), f AS (SELECT l_suppkey, avg((p - l_quantity) ** 2) w FROM lineitem, m GROUP BY 1)
SELECT round(avg(w), 6) AS balanced_mse, count(*) AS families FROM f
""")
def balanced_family_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mean(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), "l_quantity", "p")
    return _rounded(metrics.balanced_mse(rows, "l_suppkey", F.col("p") - F.col("l_quantity")), 6, "balanced_mse")


@query("""
WITH r AS (SELECT l.doc_id, quality y, 0.002 * (least(n_chars, 2000) - 1000) eta, 1.0 w FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL),
p AS (SELECT y, w, eta, 1 / (1 + exp(-eta)) p FROM r), h AS (SELECT *, CAST(CAST(p >= 0.5 AS INT) = y AS DOUBLE) hit FROM p)
SELECT round(sum(w * (p - y) ** 2) / sum(w), 9) AS brier, round(sum(w * (greatest(eta, 0) + ln(1 + exp(-abs(eta))) - y * eta)) / sum(w), 9) AS log_loss,
 round((sum(CASE WHEN y = 1 THEN w * hit END) / sum(CASE WHEN y = 1 THEN w END) + sum(CASE WHEN y = 0 THEN w * hit END) / sum(CASE WHEN y = 0 THEN w END)) / 2, 9) AS balanced_accuracy,
 count(*) AS rows, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM h
""")
def logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").where("quality IS NOT NULL")
    logit = F.lit(0.002) * (F.least(F.col("n_chars"), F.lit(2000)) - 1000)
    return _rounded(metrics.binary_scores(rows, logit, F.col("quality"), F.lit(1.0)), 9, "brier", "log_loss", "balanced_accuracy")


@query("SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.status_counts(table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("date").cast("string").alias("day")), "event_type", "day")


@query("""
WITH v AS (SELECT l_quantity x, l_extendedprice / 1000 y, l_discount z, 1 + l_tax w FROM lineitem)
SELECT round(covar_pop(x, x), 6) AS c_x_x, round(covar_pop(x, y), 6) AS c_x_y, round(covar_pop(x, z), 6) AS c_x_z, round(covar_pop(y, y), 5) AS c_y_y, round(covar_pop(y, z), 6) AS c_y_z, round(covar_pop(z, z), 6) AS c_z_z,
 round(covar_pop(x, x) + covar_pop(y, y) + covar_pop(z, z), 5) AS trace, round(1 + 0.5 * (covar_pop(x, x) + covar_pop(y, y) + covar_pop(z, z)) / avg(w), 5) AS response FROM v
""")
def vector_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("z"), (1 + F.col("l_tax")).alias("w"))
    out = metrics.vector_covariance(rows, ["x", "y", "z"], "w", 0.5).drop("mean_x", "mean_y", "mean_z", "mean_volume")
    return _rounded(_rounded(out, 6, "c_x_x", "c_x_y", "c_x_z", "c_y_z", "c_z_z"), 5, "c_y_y", "trace", "response")


@query("""
WITH e AS (SELECT user_id, count(*) n, avg(value) v FROM events GROUP BY 1)
SELECT n, count(*) AS users, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_sd FROM e GROUP BY 1
""")
def spread_over_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return _rounded(each.groupBy("n").agg(F.count(F.lit(1)).alias("users"), F.avg("v").alias("v_mean"), F.stddev_pop("v").alias("v_sd")), 6, "v_mean", "v_sd")


@query("""
WITH c AS (SELECT l_orderkey, l_quantity v, l_extendedprice p FROM lineitem), g AS (SELECT l_orderkey, count(*) records, avg(v) a, stddev_pop(v) b, avg(p) c, stddev_pop(p) d FROM c GROUP BY 1)
SELECT l_orderkey, records, round(a, 6) AS l_quantity_mean, round(b, 6) AS l_quantity_sd, round(c, 4) AS l_extendedprice_mean, round(d, 4) AS l_extendedprice_sd FROM g WHERE records = 3
""")
def conformer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.conformer_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_quantity", "l_extendedprice"])
    return _rounded(_rounded(out, 6, "l_quantity_mean", "l_quantity_sd"), 4, "l_extendedprice_mean", "l_extendedprice_sd")


@query("""
SELECT c_nationkey, round(sum(p * v), 6) AS expected FROM (SELECT c_nationkey, c_custkey % 7 AS v, count(*) / sum(count(*)) OVER (PARTITION BY c_nationkey) AS p FROM customer GROUP BY 1, 2) GROUP BY 1
""")
def weighted_expected_pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 7).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    # Seven bins per nation at most.
    packed = bins.groupBy("c_nationkey").agg(F.sum("n").alias("total"), F.collect_list(F.struct(F.col("v").cast("double").alias("value"), F.col("n").alias("n"))).alias("bins"))
    pmf = F.transform("bins", lambda b: F.struct(b["value"].alias("value"), (b["n"] / F.col("total")).alias("p")))
    return packed.select("c_nationkey", F.round(metrics.expected_population(pmf), 6).alias("expected"))


# ------------------------------------------------------------------------------------------------------------ grouping


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority, o_orderstatus, count(*) r FROM orders GROUP BY 1, 2, 3), p AS (SELECT o_custkey, count(*) p FROM c GROUP BY 1), f AS (SELECT count(*) f FROM p)
SELECT o_orderkey, round(1.0 / f / p / r, 12) AS weight FROM orders JOIN c USING (o_custkey, o_orderpriority, o_orderstatus) JOIN p USING (o_custkey), f
""")
def family_pair_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return grouping.family_pair_weights(rows, "o_custkey", ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", F.round("weight", 12).alias("weight"))


@query("""
SELECT l_suppkey, round(1.0 / ((SELECT count(DISTINCT l_suppkey) FROM lineitem) * count(*)), 12) AS weight, count(*) AS rows FROM lineitem GROUP BY 1
""")
def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouping.balanced_weights(table(spark, sf_dir, "lineitem").select("l_suppkey"), "l_suppkey")
    return rows.groupBy("l_suppkey").agg(F.round(F.max("weight"), 12).alias("weight"), F.count(F.lit(1)).alias("rows"))


@query("""
SELECT o_custkey, (row_number() OVER (ORDER BY sha256('compatibility-42' || chr(0) || o_custkey::VARCHAR), o_custkey) - 1) % 5 AS fold FROM (SELECT DISTINCT o_custkey FROM orders)
""")
def hash_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.hash_folds(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 5, 42)


_SPLIT = """g AS (SELECT DISTINCT o_custkey FROM orders), n AS (SELECT count(*) n FROM g),
a AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('42' || chr(0) || o_custkey::VARCHAR), o_custkey) - 1 k FROM g),
b AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('43' || chr(0) || o_custkey::VARCHAR), o_custkey) - 1 k FROM a, n WHERE a.k >= ceil(n * 0.2)),
s AS (SELECT o_custkey, 'test' AS split FROM a, n WHERE k < ceil(n * 0.2) UNION ALL SELECT o_custkey, CASE WHEN k < ceil((n - ceil(n * 0.2)) * 0.25) THEN 'calibration' ELSE 'train' END FROM b, n)"""


@query(f"WITH {_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT o_custkey) AS groups FROM orders JOIN s USING (o_custkey) GROUP BY 1")
def shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey")
    return grouping.split_report(orders.join(grouping.group_split(orders, "o_custkey", 42), "o_custkey"), "split", "o_custkey")


_ALIASES = """al AS (SELECT doc_id, 't:' || md5(text) a FROM documents UNION SELECT doc_id, 'l:' || md5(lower(split_part(text, chr(10), 1))) FROM documents UNION SELECT doc_id, 'p:' || md5(substr(text, 1, 40)) FROM documents),
h AS (SELECT a, min(doc_id) u FROM al GROUP BY 1), e0 AS (SELECT DISTINCT doc_id v, u FROM al JOIN h USING (a) WHERE doc_id <> u), e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0),
r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node AND r.label < e.v),
c AS (SELECT node AS doc_id, min(label) AS "group" FROM r GROUP BY 1)"""


def _aliases() -> Column:
    text = F.col("text")
    return F.array(F.concat(F.lit("t:"), F.md5(text)), F.concat(F.lit("l:"), F.md5(F.lower(F.split_part(text, F.lit("\n"), F.lit(1))))), F.concat(F.lit("p:"), F.md5(F.substring(text, 1, 40))))


@query(f'WITH RECURSIVE {_ALIASES} SELECT doc_id, "group" FROM c')
def alias_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.alias_components(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", _aliases())


@query(f"""WITH RECURSIVE {_ALIASES}, s AS (SELECT doc_id, "group", doc_id % 3 AS split FROM c),
k AS (SELECT "group", count(DISTINCT split) n FROM s GROUP BY 1) SELECT count(*) AS groups, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS leaking FROM k""")
def group_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alias_components(spark, sf_dir).withColumn("split", F.col("doc_id") % 3)
    each = found.groupBy("group").agg(F.count_distinct("split").alias("n"))
    return each.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("leaking"))


@query("""
WITH held AS (SELECT text FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT text FROM benchmark)
SELECT doc_id FROM documents d WHERE doc_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM held h WHERE md5(h.text) = md5(d.text)) AND NOT EXISTS (SELECT 1 FROM held h WHERE md5(lower(split_part(h.text, chr(10), 1))) = md5(lower(split_part(d.text, chr(10), 1))))
""")
def embargo_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.where("doc_id % 10 = 0").select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    line = F.md5(F.lower(F.split_part(F.col("text"), F.lit("\n"), F.lit(1))))
    return grouping.embargo(docs.where("doc_id % 10 <> 0"), "doc_id", [F.md5("text"), line], [held.select(F.md5("text")), held.select(line)]).select("doc_id")


@query("""SELECT 'orders' AS side, count(*) AS shared FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)""")
def overlap_assertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return grouping.overlap(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), "o_custkey").agg(F.lit("orders").alias("side"), F.count(F.lit(1)).alias("shared"))


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS families FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def pair_family_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.pairs_in_several_families(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


# -------------------------------------------------------------------------------------------------------------- domain


@query("""
WITH b AS (SELECT vec_id, CAST(list_sum([CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END FOR i IN range(63)]) AS BIGINT) bits FROM embeddings)
SELECT q.vec_id, round(max(bit_count(q.bits & t.bits) / greatest(bit_count(q.bits | t.bits), 1)), 9) AS similarity, max(bit_count(q.bits & t.bits) / greatest(bit_count(q.bits | t.bits), 1)) < 0.35 AS ood
FROM b q, b t WHERE q.vec_id % 50 = 0 AND t.vec_id <> q.vec_id GROUP BY 1
""")
def nearest_tanimoto(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = table(spark, sf_dir, "embeddings").select("vec_id", scalar.sign_bits(F.col("embedding")).alias("bits"))
    return _rounded(domain.nearest_tanimoto(bits, bits.where("vec_id % 50 = 0"), "vec_id", "bits", own=True), 9, "similarity")


@query("""
SELECT q.vec_id, round(sum(exp(-0.5 * list_sum([(q.embedding[i]::DOUBLE - t.embedding[i]::DOUBLE) ** 2 FOR i IN range(1, 65)]) / 64)), 6) AS kernel_sum FROM embeddings q, embeddings t WHERE q.vec_id % 50 = 0 GROUP BY 1
""")
def rbf_kernel_rowsum(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return _rounded(domain.kernel_sums(vectors, vectors.where("vec_id % 50 = 0"), "vec_id", "embedding", 0.5, 64), 6, "kernel_sum")


# --------------------------------------------------------------------------------------------------------------- heads


@query("""
SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS z_p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part), 6) AS z_p_retailprice FROM part
""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return _rounded(heads.standardised(rows, ["p_size", "p_retailprice"]).drop("p_size", "p_retailprice"), 6, "z_p_size", "z_p_retailprice")


@query("""
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END v FROM events), m AS (SELECT median(v) m FROM e)
SELECT event_id, round(coalesce(v, m), 9) AS v, CAST(v IS NULL AS INT) AS missing_v FROM e, m
""")
def median_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return _rounded(heads.median_imputed(rows, ["v"]), 9, "v")


@query("""
WITH m AS (SELECT count(*) n, avg(l_quantity) mx, stddev_pop(l_quantity) sx, avg(l_extendedprice) my, covar_pop(l_quantity, l_extendedprice) c FROM lineitem)
SELECT round(n * c / sx / (n + 10.0), 3) AS coef, round(my, 4) AS intercept, CAST(n AS BIGINT) AS rows FROM m
""")
def ridge_closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    head = heads.fit_ridge(rows, ["l_quantity"], ["l_extendedprice"], 10.0)
    return rows.agg(F.round(F.lit(head.coef[0][0]), 3).alias("coef"), F.round(F.lit(head.intercept[0]), 4).alias("intercept"), F.count(F.lit(1)).alias("rows"))


@query("""
WITH f AS (SELECT l_suppkey, (row_number() OVER (ORDER BY sha256('selection-42' || chr(0) || l_suppkey::VARCHAR), l_suppkey) - 1) % 5 fold FROM (SELECT DISTINCT l_suppkey FROM lineitem)),
r AS (SELECT fold, l_suppkey, l_quantity x, l_extendedprice y FROM lineitem JOIN f USING (l_suppkey)),
k AS (SELECT DISTINCT fold FROM f), t AS (SELECT k.fold, count(*) n, avg(x) mx, stddev_pop(x) sx, avg(y) my, covar_pop(x, y) c FROM k, r WHERE r.fold <> k.fold GROUP BY 1),
a AS (SELECT * FROM (VALUES (0, NULL), (1, 100000.0), (2, 1000.0), (3, 1.0)) v(i, alpha)),
e AS (SELECT i, l_suppkey, avg(abs(CASE WHEN alpha IS NULL THEN my ELSE my + (x - mx) / sx * (n * c / sx / (n + alpha)) END - y)) w FROM r JOIN t USING (fold), a GROUP BY 1, 2)
SELECT CAST(i AS INT) AS candidate, round(avg(w), 3) AS macro_mae FROM e GROUP BY 1
""")
def ridge_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice")
    found = heads.select_ridge(rows, ["l_quantity"], ["l_extendedprice"], "l_suppkey", (100000.0, 1000.0, 1.0))
    return spark.createDataFrame([(i, round(s, 3)) for i, s in enumerate(found.scores["l_extendedprice"])], "candidate int, macro_mae double")


# -------------------------------------------------------------------------------------------------- refusal and evidence


@query("""
WITH f AS (SELECT user_id, event_type, date_trunc('day', ts) AS day, min(event_id) event_id FROM events GROUP BY 1, 2, 3)
SELECT e.event_id, e.user_id, e.event_type, round(e.value, 9) AS value FROM events e JOIN f ON e.event_id = f.event_id
""")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.date_trunc("day", "ts").alias("day"))
    return refuse.one_per_key(rows, ["user_id", "event_type", "day"], ["event_id"]).select("event_id", "user_id", "event_type", F.round("value", 9).alias("value"))


@query("""
WITH v AS (SELECT user_id, min(event_id) h FROM events WHERE value >= 50 GROUP BY 1)
SELECT event_id, coalesce(event_id > h, false) AS repeated FROM events LEFT JOIN v USING (user_id)
""")
def repeated_after_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return refuse.first_valid_wins(rows, ["user_id"], ["event_id"], F.col("value") >= 50).select("event_id", "repeated")


@query("""
WITH d AS (SELECT md5(text) k, doc_id, toxic::DOUBLE t FROM documents JOIN labels USING (doc_id)), f AS (SELECT k, arg_min(t, doc_id) t0, min(doc_id) h FROM d GROUP BY 1),
x AS (SELECT d.k, max(CASE WHEN (t IS NULL) <> (t0 IS NULL) OR abs(t - t0) > 1e-8 THEN 1 ELSE 0 END) c FROM d JOIN f USING (k) GROUP BY 1)
SELECT doc_id, CASE WHEN c = 1 THEN 'conflicting' WHEN doc_id = h THEN 'kept' ELSE 'duplicate' END AS verdict FROM d JOIN f USING (k) JOIN x USING (k)
""")
def conflict_drop_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("k")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("t")), "doc_id")
    return refuse.consolidated(rows, ["k"], ["doc_id"], ["t"]).select("doc_id", "verdict")


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_discount > 0.08 THEN 'discount_out_of_bounds' WHEN l_quantity < 2 THEN 'too_few' WHEN l_shipdate < TIMESTAMP '1993-01-01' THEN 'too_old' ELSE 'prepared' END AS reason FROM lineitem) GROUP BY 1
""")
def reason_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("returned", F.col("l_returnflag") == "R"), ("discount_out_of_bounds", F.col("l_discount") > 0.08), ("too_few", F.col("l_quantity") < 2), ("too_old", F.col("l_shipdate") < F.expr("TIMESTAMP_NTZ '1993-01-01'"))]
    return metrics.status_counts(table(spark, sf_dir, "lineitem").select(F.coalesce(refuse.first_reason(rules), F.lit("prepared")).alias("reason")), "reason")


@query("""
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 THEN 'size_outside_scope' END, CASE WHEN p_retailprice > 1500 THEN 'price_outside_scope' END, CASE WHEN p_type LIKE '%STEEL%' THEN 'material_not_supported' END, CASE WHEN p_brand LIKE '%5' THEN 'brand_not_validated' END], lambda x: x IS NOT NULL), '|') AS reasons FROM part
""")
def scope_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("size_outside_scope", F.col("p_size") > 40), ("price_outside_scope", F.col("p_retailprice") > 1500), ("material_not_supported", F.col("p_type").contains("STEEL")), ("brand_not_validated", F.col("p_brand").endswith("5"))]
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(refuse.all_reasons(rules), "|").alias("reasons"))


@query("""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unsupported' WHEN c_nationkey < 3 OR c_acctbal > 9000 THEN 'out_of_domain' WHEN c_acctbal < 0 THEN 'invalid_model_output' WHEN c_custkey % 2 = 0 THEN 'synthetic_demo' ELSE 'research_only' END AS status FROM customer) GROUP BY 1
""")
def prediction_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("c_custkey") % 2 == 0, "synthetic").otherwise("experimental")
    status = refuse.prediction_status(F.col("c_mktsegment") != "MACHINERY", F.col("c_nationkey") < 3, F.col("c_acctbal") > 9000, [F.col("c_acctbal")], kind)
    return metrics.status_counts(table(spark, sf_dir, "customer").select(status.alias("status")), "status")


@query("""
SELECT o_orderkey FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END s FROM orders) WHERE s IS NULL AND o_orderpriority = (SELECT min(o_orderpriority) FROM orders)
""")
def three_state_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("s", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")))
    first = orders.agg(F.min("o_orderpriority")).first()[0]
    return refuse.matching(orders, {"s": None, "o_orderpriority": first}, ["s", "o_orderpriority", "o_custkey"]).select("o_orderkey")


@query("""SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS outcomes, count(*) AS rows, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY 1, 2""")
def conflict_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refuse.conflicts(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


@query("""
WITH t AS (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS present FROM orders)
SELECT count(DISTINCT CASE WHEN present THEN o_custkey END) AS present, count(DISTINCT CASE WHEN NOT present THEN o_custkey END) AS absent, count(DISTINCT CASE WHEN present IS NULL THEN o_custkey END) AS unknown FROM t
""")
def formulation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus") == "F")
    rows = table(spark, sf_dir, "orders").select("o_custkey", present.alias("present"))
    return rows.agg(*[F.count_distinct(F.when(c, F.col("o_custkey"))).alias(n) for n, c in (("present", F.col("present")), ("absent", ~F.col("present")), ("unknown", F.col("present").isNull()))])


@query("""
WITH e AS (SELECT l_orderkey k FROM lineitem WHERE l_linenumber = 1), f AS (SELECT o_orderkey k FROM orders WHERE o_orderkey % 5 <> 0)
SELECT (SELECT count(*) FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM f)) AS missing, (SELECT count(*) FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM e)) AS unexpected
""")
def origin_bijection(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return refuse.bijection(expected, table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("k")))


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity ced, sqrt(l_quantity) * 1.01 total, l_tax * 10 vdw, l_discount * 60 ele FROM lineitem)
SELECT flags, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN total * total > ced + 1e-6 THEN 'total_exceeds_mean_energy' END, CASE WHEN vdw * vdw + ele * ele > ced + 1e-6 THEN 'parts_exceed_mean_energy' END], lambda x: x IS NOT NULL), '|') AS flags FROM s) GROUP BY 1
""")
def md_prepare_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prepare import energy_flags

    q = F.col("l_quantity")
    flags = energy_flags(q, F.sqrt(q) * 1.01, F.col("l_tax") * 10, F.col("l_discount") * 60)
    return metrics.status_counts(table(spark, sf_dir, "lineitem").select(F.array_join(flags, "|").alias("flags")), "flags")


@query("""
WITH p AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS VARCHAR) t FROM part), d AS (SELECT p_partkey, ltrim(replace(t, '.', ''), '0') g FROM p), k AS (SELECT p_partkey, rtrim(g, '0') k, len(g) - len(rtrim(g, '0')) - 2 e FROM d)
SELECT p_partkey, CASE WHEN k = '' THEN '0' ELSE k || CASE WHEN e = 0 THEN '' ELSE 'E' || e END END AS number_key FROM k
""")
def canonical_number_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.canonical_number_column(text).alias("number_key"))


@query("""SELECT l_returnflag, round(sum(greatest(x, 0) + ln(1 + exp(-abs(x)))), 4) AS softplus_sum, round(sum(1 / (1 + exp(-x))), 4) AS expit_sum FROM (SELECT l_returnflag, (l_quantity - 25) / 5 x FROM lineitem) GROUP BY 1""")
def scalar_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("l_quantity") - 25) / 5
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(metrics.softplus(x)), 4).alias("softplus_sum"), F.round(F.sum(scalar.expit(x)), 4).alias("expit_sum"))


@query("""
SELECT p_partkey, round(CASE WHEN p_size > 0 THEN p_retailprice / p_size END, 6) AS d, round(CASE WHEN p_size > 0 THEN sqrt(p_retailprice ** 2 + 9) / p_size END, 6) AS p, round(CASE WHEN p_size > 0 THEN sqrt(p_retailprice / p_size) END, 6) AS h FROM part
""")
def polar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    d, p, h = scalar.polar_parts(price, F.array(price, F.lit(3.0)), price, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(d, 6).alias("d"), F.round(p, 6).alias("p"), F.round(h, 6).alias("h"))


# --------------------------------------------------------------------------------------------------------- diagnostics

#: All hours from the first event's to the last one's, filled up to a multiple of ten.
HOURS = """h AS (SELECT min(x) h0, CAST(ceil((max(x) - min(x) + 1) / 10.0) * 10 AS BIGINT) n FROM (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) x FROM events)), g AS (SELECT unnest(range(n)) i FROM h)"""
_TRACE = f"""{HOURS}, s AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) - h0 i, sum(value) v FROM events, h GROUP BY 1), t AS (SELECT g.i, coalesce(v, 0) v FROM g LEFT JOIN s ON g.i = s.i)"""
_MOMENTS = """b AS (SELECT i // (n // 10) k, avg(v) m FROM t, h GROUP BY 1),
w AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, avg(v) FILTER (i < h.n // 2) AS first_half_mean, avg(v) FILTER (i >= h.n - h.n // 2) AS last_half_mean, regr_slope(v, i / (h.n - 1)) AS trend, (SELECT var_samp(m) FROM b) AS block_variance FROM t, h)"""
_ACF = """m AS (SELECT avg(v) m FROM t), c AS (SELECT i, v - m c FROM t, m), l AS (SELECT b.i - a.i lag, sum(a.c * b.c) s FROM c a, c b, h WHERE b.i - a.i BETWEEN 0 AND h.n // 2 GROUP BY 1),
r AS (SELECT lag, s / (SELECT s FROM l WHERE lag = 0) acf FROM l), p AS (SELECT lag // 2 k, sum(acf) s FROM r, h WHERE lag < 2 * ((h.n // 2 + 1) // 2) GROUP BY 1),
x AS (SELECT coalesce(min(k), (SELECT max(k) + 1 FROM p)) x, min(k) IS NOT NULL AS truncated FROM p WHERE s <= 0), y AS (SELECT k, min(s) OVER (ORDER BY k) s FROM p, x WHERE k < x), z AS (SELECT count(*) pairs, 2 * sum(s) - 1 raw_g FROM y),
e AS (SELECT pairs, truncated, raw_g, greatest(1, least(h.n, raw_g)) g, h.n / greatest(1, least(h.n, raw_g)) ess, raw_g < 1 OR raw_g > h.n AS ess_bound_applied FROM z, x, h)"""


def hourly_trace(spark: SparkSession, sf_dir: str, by: bool = False) -> DataFrame:
    """Hourly sums of event values from the first event's hour to the last one's, filled up to a multiple of ten hours; hours without events are 0. by: a replicate per event type."""
    events = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    first, hours = events.agg(F.min(hour), F.ceil((F.max(hour) - F.min(hour) + 1) / 10) * 10).first()
    replicate = F.col("event_type") if by else F.lit("all")
    sums = events.groupBy(replicate.alias("replicate"), (hour - F.lit(first)).alias("i")).agg(F.sum("value").alias("v"))
    names = events.select(replicate.alias("replicate")).distinct()
    grid = names.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours).cast("long") - 1)))
    return grid.join(sums, ["replicate", "i"], "left").select("replicate", F.lit("value").alias("observable"), F.col("i").cast("int").alias("i"), F.col("i").cast("double").alias("t"), F.coalesce("v", F.lit(0.0)).alias("value"))


@query(f"""
WITH {_TRACE}, {_MOMENTS}
SELECT n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(last_half_mean - first_half_mean, 4) AS half_shift, round(trend, 3) AS trend, round(block_variance, 3) AS block_variance, 'descriptive_only' AS status FROM w
""")
def trace_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.trace_moments(hourly_trace(spark, sf_dir), 10).select("n", "mean", "sd", "half_shift", "trend", "block_variance", "status")
    return _rounded(_rounded(out, 4, "mean", "sd", "half_shift"), 3, "trend", "block_variance")


@query(f"""
WITH {_TRACE}, {_ACF}
SELECT pairs, round(raw_g, 6) AS raw_g, round(g, 6) AS g, round(ess, 4) AS ess FROM e
""")
def trace_acf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.trace_correlations(hourly_trace(spark, sf_dir)).select("pairs", "raw_g", "g", "ess")
    return _rounded(_rounded(out, 6, "raw_g", "g"), 4, "ess")


@query(f"""
WITH {HOURS}, k AS (SELECT DISTINCT event_type FROM events), s AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) - h0 i, sum(value) v FROM events, h GROUP BY 1, 2),
t AS (SELECT k.event_type, coalesce(v, 0) v FROM k CROSS JOIN g LEFT JOIN s ON g.i = s.i AND k.event_type = s.event_type), m AS (SELECT event_type, avg(v) m FROM t GROUP BY 1)
SELECT 'value' AS observable, count(*) AS replicates, round(avg(m), 6) AS mean_of_means, round(var_samp(m), 6) AS between_variance, round(sqrt(var_samp(m) / count(*)), 6) AS standard_error FROM m
""")
def replicate_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = diagnostics.diagnose_replicates(diagnostics.trace_moments(hourly_trace(spark, sf_dir, by=True), 10))
    return _rounded(out, 6, "mean_of_means", "between_variance", "standard_error")


@query(f"""
WITH {_TRACE}, {_MOMENTS}, {_ACF}
SELECT 'all' AS replicate, 'value' AS observable, w.n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(first_half_mean, 4) AS first_half_mean, round(last_half_mean, 4) AS last_half_mean, round(last_half_mean - first_half_mean, 4) AS half_shift,
  round(trend, 3) AS trend, round(block_variance, 3) AS block_variance, round(sqrt(block_variance / 10), 4) AS block_se, 'descriptive_only' AS status, pairs, truncated, round(raw_g, 6) AS raw_g, round(g, 6) AS g, round(ess, 4) AS ess, ess_bound_applied, round(sd / sqrt(ess), 4) AS acf_se,
  array_to_string(list_filter([CASE WHEN abs(last_half_mean - first_half_mean) / sd > 0.5 OR abs(trend / sd) > 1 THEN 'large_descriptive_drift' END, CASE WHEN ess < 20 THEN 'low_estimated_effective_sample_size' END,
    CASE WHEN w.n / 10 < 10 * g THEN 'blocks_short_relative_to_estimated_correlation' END, CASE WHEN NOT truncated THEN 'positive_sequence_reaches_available_lag_window' END], lambda x: x IS NOT NULL), '|') AS warnings, false AS accuracy_validated
FROM w, e
""")
def trace_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All diagnostics of the hourly trace."""
    out = diagnostics.diagnose_trace(hourly_trace(spark, sf_dir), 10).withColumn("warnings", F.array_join("warnings", "|"))
    out = _rounded(out, 4, "mean", "sd", "first_half_mean", "last_half_mean", "half_shift", "block_se", "ess", "acf_se")
    return _rounded(_rounded(out, 3, "trend", "block_variance"), 6, "raw_g", "g")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of orders by priority beside a conformal radius over customers and its coverage."""
    orders = _mean(table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_totalprice"), "o_totalprice", "p")
    error = F.col("o_totalprice") - F.col("p")
    radius = metrics.conformal_radius(orders, "o_custkey", {"price": error}, 0.2).select("groups", "rank", "radius")
    covered = metrics.coverage(orders.join(F.broadcast(radius.select("radius"))), "o_custkey", error, F.col("radius")).select("row_coverage", "group_coverage")
    out = metrics.component_metrics(orders, F.col("o_totalprice"), F.col("p"), ["o_orderpriority"])
    return out.join(F.broadcast(radius.join(F.broadcast(covered)))).withColumn("accuracy_validated", F.lit(False))
