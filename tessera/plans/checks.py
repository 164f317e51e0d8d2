"""More queries of single operators: lookups, selections, validators and order statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import diagnostics, metrics, refuse
from ..sources import contracts
from .catalog import HOURS, hourly_trace, query, table


@query("""
WITH s AS (SELECT p_brand, p_size, max(p_retailprice) s FROM part GROUP BY 1, 2), m AS (SELECT p_brand, min(s) m FROM s GROUP BY 1)
SELECT p_brand, min(p_size) AS p_size FROM s JOIN m USING (p_brand) WHERE s <= m + 1e-12 GROUP BY 1
""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("s"))
    return metrics.best_candidate(scores, "s", "p_size", by=["p_brand"]).select("p_brand", "p_size")


@query("""
SELECT array_to_string(list_filter([CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 0 END, CASE WHEN l_discount < 0.01 OR l_discount > 0.09 THEN 1 END, CASE WHEN l_tax < 0.01 OR l_tax > 0.07 THEN 2 END], lambda x: x IS NOT NULL), ',') AS places, count(*) AS n FROM lineitem GROUP BY 1
""")
def offending_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = refuse.offending([F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")], [5.0, 0.01, 0.01], [45.0, 0.09, 0.07])
    return table(spark, sf_dir, "lineitem").select(F.array_join(F.transform(places, lambda i: i.cast("string")), ",").alias("places")).groupBy("places").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def must_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line has to find its part: a missing one refuses all."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    found = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")
    refuse.asserted(found, "part", F.col("p_brand").isNull())
    return found.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT n_name, count(*) AS unsupported FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY 1")
def support_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    rows = table(spark, sf_dir, "customer").join(allowed, "c_nationkey", "left_anti")
    return rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("unsupported"))


@query(f"WITH {HOURS} SELECT 'all' AS replicate, 'value' AS observable, n, 0.0::DOUBLE AS t0, CAST(n - 1 AS DOUBLE) AS t1, CAST(NULL AS VARCHAR) AS fault FROM h")
def trace_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.checked_trace(hourly_trace(spark, sf_dir), 10)


@query("SELECT p_partkey, round(p_size * 10.0 + p_retailprice / 100, 6)::DOUBLE AS value, true AS certified FROM part")
def moment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Populations slope * n + offset at 4, 16 and 64 units, continued to n = 10."""
    raw = lambda n: F.col("p_size") * F.lit(float(n)) + F.col("p_retailprice") / 100
    value, certified = scalar.moment_line(raw(4), raw(16), raw(64), F.lit(10.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(value, 6).alias("value"), certified.alias("certified"))


@query("""
SELECT reasons, count(*) AS n FROM (SELECT CASE WHEN v IS NOT NULL AND u IS NULL THEN 'value_without_unit' WHEN v IS NULL AND u IS NOT NULL THEN 'unit_without_value' WHEN u = 'wt%' AND (v < 0 OR v > 100) THEN 'weight_percent_out_of_range' ELSE '' END AS reasons
FROM (SELECT CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity * 3 END v, CASE WHEN l_linenumber % 3 <> 0 THEN 'wt%' END u FROM lineitem)) GROUP BY 1
""")
def quantity_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    q = F.struct(F.when(line % 5 != 0, F.col("l_quantity") * 3).alias("value"), F.when(line % 3 != 0, "wt%").alias("unit"), F.lit(None).cast("string").alias("qualifier"))
    rows = table(spark, sf_dir, "lineitem").select(q.alias("q")).select(F.array_join(contracts.quantity_reasons(F.col("q")), "|").alias("reasons"))
    return rows.groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH f AS (SELECT l_orderkey, list(l_discount) f FROM lineitem GROUP BY 1) SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN len(f) < 2 THEN 'too_few_components' END, CASE WHEN len(list_filter(f, lambda x: x <= 0)) > 0 THEN 'fraction_not_positive' END, CASE WHEN abs(list_sum(f) - 1) > 1e-6 THEN 'fractions_do_not_sum_to_one' END], lambda x: x IS NOT NULL), '|') AS reasons FROM f) GROUP BY 1
""")
def mixture_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An order has seven lines at most.
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("f"))
    reasons = contracts.mixture_reasons(F.col("f"), F.col("f"))
    return rows.select(F.array_join(reasons, "|").alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT o_totalprice v, row_number() OVER (ORDER BY o_totalprice) k FROM orders), n AS (SELECT CAST(ceil((count(*) + 1) * 0.9) AS BIGINT) k FROM orders) SELECT n.k AS rank, v AS radius FROM r JOIN n ON r.k = n.k")
def order_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_totalprice")
    rank = math.ceil((orders.count() + 1) * 0.9)
    return metrics.kth_smallest(orders, "o_totalprice", rank).select(F.lit(rank).cast("long").alias("rank"), F.col("o_totalprice").alias("radius"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity x FROM lineitem), a AS (SELECT a.l_orderkey, count(*) AS pairs FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber WHERE abs(a.x - b.x) BETWEEN 3 AND 7 GROUP BY 1)
SELECT pairs, count(*) AS orders FROM a GROUP BY 1
""")
def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one order's lines whose quantities are 3 to 7 apart: a band join inside a key."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"))
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, "l_orderkey").where((F.col("a.l_linenumber") != F.col("b.l_linenumber")) & F.abs(F.col("a.x") - F.col("b.x")).between(3, 7))
    return pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs")).groupBy("pairs").agg(F.count(F.lit(1)).alias("orders"))
