"""Queries of scans, sinks, ladders, heads and structures, each beside its SQL."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import cells, chemistry, cohesion, evidence, forests, grouping, heads, kernels, metrics, models, nested, prepare, refuse, sparse, trees
from ..sources import contracts, gate, singlepoint
from ..storage import dropped, shared_folder, stored
from .catalog import query, table
from .structures import _parts, _texts, _values


def _file(spark: SparkSession, folder: str) -> str:
    """The one data file below a folder, as a URI."""
    path = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path").first()[0]
    return path if "://" in path else path.replace(":/", ":///", 1)


def _counted(values: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {_values(values)}) v({names}))"


# ----------------------------------------------------------------------------------------------------- scans and sinks

#: Authored texts that are within scope.
WITHIN = ("CCO", "CCC", "c1ccccc1", "CC(C)=O", "CCOC(C)=O")
MANIFEST = {"dataset_id": "parts", "label_kind": "synthetic", "source": "tables", "license": "MIT", "rights_status": "approved", "permission_evidence": "own tables", "approved_by": "owner", "training_allowed": True, "derived_weights_allowed": True}


@query("SELECT 'synthetic' AS label_kind, count(*) AS rows, round(sum(p_size), 4)::DOUBLE AS delta_d, round(sum(p_retailprice / 100), 4) AS delta_p, 298.15::DOUBLE AS temperature_k FROM part")
def labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a labelled CSV file: its manifest, digest, structures and rows are checked before anything is returned."""
    part = table(spark, sf_dir, "part").join(_parts(spark, sf_dir, WITHIN), "p_partkey")
    rows = part.select(F.concat(F.lit("p"), "p_partkey").alias("sample_id"), "smiles", F.col("p_size").cast("double").alias("delta_d"), (F.col("p_retailprice") / 100).alias("delta_p"), F.lit(1.0).alias("delta_h"), F.lit("synthetic").alias("label_kind"))
    folder = shared_folder(spark, "labelled")
    rows.coalesce(1).write.option("header", True).csv(folder)
    uri = _file(spark, folder)
    out = gate.labelled_table(spark, uri, MANIFEST | {"sha256": gate.file_digest(uri)})
    return out.groupBy("label_kind").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("delta_d"), 4).alias("delta_d"), F.round(F.sum("delta_p"), 4).alias("delta_p"), F.max("temperature_k").alias("temperature_k"))


@query("""
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_size % 7 = 0 THEN 'dataset manifest lacks source' WHEN p_size % 3 <> 0 THEN 'rights are not approved' WHEN p_size % 2 <> 0 OR p_size % 5 = 0 THEN 'training and derived-weight permissions are needed' ELSE 'authorised' END AS outcome FROM part) GROUP BY 1
""")
def manifest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest per part, parsed and authorised; the first rule that refuses it."""
    size = F.col("p_size")
    fixed = {k: F.lit(v) for k, v in MANIFEST.items() if k not in ("rights_status", "training_allowed", "derived_weights_allowed", "source")} | {"sha256": F.lit("0" * 64)}
    changing = {"rights_status": F.element_at(F.array(F.lit("approved"), F.lit("pending"), F.lit("denied")), (size % 3 + 1).cast("int")), "training_allowed": size % 2 == 0, "derived_weights_allowed": size % 5 != 0, "source": F.when(size % 7 != 0, "tables")}
    text = table(spark, sf_dir, "part").select(F.to_json(F.struct(*[v.alias(k) for k, v in (fixed | changing).items()])).alias("manifest"))

    def run(batches):
        for batch in batches:
            out = []
            for m in batch["manifest"]:
                try:
                    contracts.DATASET.authorize(contracts.DATASET.parse(m), "train")
                    out.append("authorised")
                except contracts.Refused as e:
                    out.append(str(e))
            yield pd.DataFrame({"outcome": out})

    return text.mapInPandas(run, "outcome string").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT status, count(*) AS rows, count(CASE WHEN status = 'research_only' THEN 1 END) AS valued, count(CASE WHEN status <> 'research_only' THEN 1 END) AS reasoned
FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN 'unsupported' WHEN o_totalprice > 200000 THEN 'out_of_domain' ELSE 'research_only' END AS status FROM orders) GROUP BY 1
""")
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guarded predictions written as the fixed table and read back: refused rows have blank values."""
    price = F.col("o_totalprice")
    status = refuse.prediction_status(F.col("o_orderstatus") != "F", price > 200000, F.lit(False), [price], F.lit("experimental"))
    reasons = refuse.prediction_reasons(F.when(F.col("o_orderstatus") == "F", F.array(F.lit("status_not_supported"))).otherwise(F.array().cast("array<string>")), price > 200000, F.lit(False), F.lit(False))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), status.alias("status"), reasons.alias("reasons"), F.when(status == "research_only", price).alias("price"), F.lit("MPa^0.5").alias("units"))
    blank = {c: F.lit(None).cast("string") for c in gate.PREDICTION if c not in rows.columns}
    values = {f"{t}{s}": F.col("price") for t in gate.TARGETS for s in ("", "_lower", "_upper")}
    path = f"{shared_folder(spark, 'predictions')}/table"
    gate.write_predictions(rows.withColumns(blank | values), path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy("status").agg(F.count(F.lit(1)).alias("rows"), F.count(F.nullif("delta_d_upper", F.lit(""))).alias("valued"), F.count(F.nullif("reasons", F.lit(""))).alias("reasoned"))


@query("SELECT p_brand, count(*) AS rows, round(sum(p_retailprice), 4) AS price, (SELECT count(*) FROM part) AS reported, false AS training_allowed, 'pending' AS rights_status FROM part GROUP BY 1")
def rows_and_bundle_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with a report, and a bundle whose permissions are withdrawn; both are read back."""
    part = table(spark, sf_dir, "part").select("p_brand", "p_retailprice")
    base = shared_folder(spark, "sinks")
    gate.write_rows(part, f"{base}/lines", {"rows": part.count()})
    gate.write_bundle(spark.read.json(f"{base}/lines/observations"), f"{base}/bundle", MANIFEST, {})
    report = spark.read.option("multiLine", True).json(f"{base}/lines/report.json").select(F.col("rows").alias("reported"))
    manifest = spark.read.option("multiLine", True).json(f"{base}/bundle/manifest.json").select("training_allowed", "rights_status")
    out = spark.read.parquet(f"{base}/bundle/rows").groupBy("p_brand").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("p_retailprice"), 4).alias("price"))
    return out.join(F.broadcast(report)).join(F.broadcast(manifest))


@query("SELECT p_brand AS key, count(*) AS rows, count(CASE WHEN p_size % 7 <> 0 AND p_size % 11 <> 0 THEN 1 END) AS finite, round(sum(CASE WHEN p_size % 7 <> 0 AND p_size % 11 <> 0 THEN p_size + 0.5 END), 2)::DOUBLE AS total FROM part GROUP BY 1")
def column_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as one object of columns with bare NaN and Infinity, read by its two columns; what isn't finite is null."""
    value = F.when(F.col("p_size") % 7 == 0, "NaN").when(F.col("p_size") % 11 == 0, "-Infinity").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5")))
    # The file format itself is one object, written by one task; it gets lines of 4,096 parts that others have joined, in order.
    placed = table(spark, sf_dir, "part").select("p_partkey", "p_brand", value.alias("v")).repartitionByRange("p_partkey").sortWithinPartitions("p_partkey").withColumn("at", F.monotonically_increasing_id())
    joined = lambda c, by: F.array_join(F.transform(F.sort_array("a"), lambda x: x[c]), by)
    chunks = placed.groupBy(F.shiftright("at", 12).alias("chunk")).agg(F.collect_list(F.struct("at", "p_brand", "v")).alias("a"))
    lines = stored(chunks.select("chunk", joined("p_brand", '", "').alias("keys"), joined("v", ", ").alias("values")), "column-lines")
    first = lines.agg(F.min("chunk")).first()[0]
    comma = F.when(F.col("chunk") == F.lit(first), "").otherwise(", ")
    marks = spark.createDataFrame([(0, -1, '{"SMILES": ['), (2, -1, '], "OTHER": {"x": [1, NaN, "] a", {}]}, "SOLVATION": {"water": ['), (4, -1, "]}}")], "section int, chunk long, value string")
    keys = lines.select(F.lit(1).alias("section"), "chunk", F.concat(comma, F.lit('"'), "keys", F.lit('"')).alias("value"))
    values = lines.select(F.lit(3).alias("section"), "chunk", F.concat(comma, "values").alias("value"))
    folder = shared_folder(spark, "columns")
    marks.unionByName(keys).unionByName(values).repartition(1).sortWithinPartitions("section", "chunk").select("value").write.text(folder)
    dropped(lines)
    out = gate.column_json(spark, _file(spark, folder), "SMILES", "SOLVATION").withColumn("v", F.col("value")["water"])
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("finite"), F.round(F.sum("v"), 2).alias("total"))


def _record() -> dict:
    """A consistent single point of three atoms; ALPHA stands for one printed scalar."""
    z, x = [8, 1, 1], [[0.0, 0.0, 0.1], [0.0, 0.75, -0.4], [0.0, -0.75, -0.4]]
    q, own = np.array([-0.6, 0.3, 0.3]), np.array([[0.0, 0.0, 0.01], [0.0, 0.002, 0.0], [0.0, -0.002, 0.0]])
    charges = q @ (np.array(x) / singlepoint.BOHR)
    whole = charges + own.sum(0)
    line = lambda v: " ".join(f"{a:.3f}" for a in v)
    setup = [f" : {k} {v}{' K' if k == 'electronic temp.' else ''} :" for k, v in singlepoint.PROTOCOL.items()]
    people = [f"{i + 1} {n} {'O' if n == 8 else 'H'} 1.0 {c:.3f} 2.0 3.0" for i, (n, c) in enumerate(zip(z, q, strict=True))]
    printed = [*setup, " convergence criteria satisfied after 9 iterations", " #   Z  covCN  q  C6AA  α(0)", *people, "", " Mol. C6AA /au·bohr⁶ : 44.5", " Mol. C8AA /au·bohr⁸ : 7.9D+02", " Mol. α(0) /au : ALPHA", f" q only: {line(charges)}", f" full: {line(whole)} {np.linalg.norm(whole) * singlepoint.DEBYE:.3f}"]
    body = {"method": "GFN2-xTB", "xtb version": singlepoint.VERSION, "number of electrons": 8, "number of unpaired electrons": 0, "partial charges": q.tolist(), "dipole / a.u.": whole.tolist(), "atomic dipole moments": own.tolist(), "HOMO-LUMO gap / eV": 14.4}
    return {"out": "\n".join(printed), "json": json.dumps(body), "z": z, "x": x, "mu": float(np.linalg.norm(whole) * singlepoint.DEBYE)}


@query(f"""
SELECT p_size % 5 = 0 AS refused, count(*) AS records, round(sum(CASE WHEN p_size % 5 <> 0 THEN p_size / 4.0 END), 4)::DOUBLE AS alpha, CASE WHEN p_size % 5 <> 0 THEN 790.0::DOUBLE END AS c8, CASE WHEN p_size % 5 <> 0 THEN round({_record()["mu"]}::DOUBLE, 9) END AS mu_debye FROM part GROUP BY 1, 4, 5
""")
def singlepoint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A printed record per part; those that did not end normally are refused."""
    r = _record()
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.replace(F.lit(r["out"]), F.lit("ALPHA"), F.format_string("%.2f", size / 4)).alias("stdout"), F.when(size % 5 == 0, "").otherwise("normal termination of xtb").alias("stderr"), F.lit(r["json"]).alias("json"),
        F.array(*[F.lit(k) for k in r["z"]]).alias("atomic_numbers"), F.array(*[F.array(*[F.lit(c) for c in p]) for p in r["x"]]).alias("positions"),
    )
    return singlepoint.singlepoints(rows).groupBy(F.col("fault").isNotNull().alias("refused")).agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("alpha"), 4).alias("alpha"), F.max("c8").alias("c8"), F.round(F.max("mu_debye"), 9).alias("mu_debye"))


# ------------------------------------------------------------------------------------------------------------- ladders


@query("""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c.c_custkey IS NULL THEN 'unknown_source_key' WHEN o_orderstatus <> 'O' THEN 'wrong_status' WHEN o_totalprice > 200000 THEN 'price_out_of_bounds' WHEN c_mktsegment = 'BUILDING' THEN 'segment_unsupported' ELSE 'accepted' END AS reason
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey) GROUP BY 1
""")
def exact_state_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    support = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    rules = [("wrong_status", F.col("o_orderstatus") != "O"), ("price_out_of_bounds", F.col("o_totalprice") > 200000), ("segment_unsupported", F.col("c_mktsegment") == "BUILDING")]
    found = prepare.exact_state(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), support, "c_custkey", rules)
    return found.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS parts FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def group_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.split_groups(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("SELECT o_orderpriority, round(sum(o_totalprice - 1000), 2) AS lower, round(sum(o_totalprice + 1000), 2) AS upper FROM orders GROUP BY 1")
def interval_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower, upper = refuse.interval(F.col("o_totalprice"), F.lit(1000.0))
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.sum(lower), 2).alias("lower"), F.round(F.sum(upper), 2).alias("upper"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END v, o_orderpriority = '1-URGENT' present FROM orders),
m AS (SELECT * FROM r WHERE v = 1), c AS (SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 clash FROM m GROUP BY 1)
SELECT count(*) AS outcome_records, count(DISTINCT o_custkey) AS formulations, count(DISTINCT CASE WHEN present THEN o_custkey END) AS present_formulations, count(DISTINCT CASE WHEN NOT present THEN o_custkey END) AS control_formulations, (SELECT max(clash) FROM c) AS conflicting FROM m
""")
def ledger_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact query over orders as a reviewed ledger: a dose of one, whatever the rest."""
    dose = F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 3).cast("double"))
    unit = F.when(dose.isNotNull(), "wt%")
    records = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct(dose.alias("value"), unit.alias("unit"), F.when(dose.isNotNull(), "exact").alias("qualifier"), unit.alias("unit_as_reported")).alias("dose"), (F.col("o_orderpriority") == "1-URGENT").alias("present"))
    review = {"ledger_sha256": "0" * 64, "source_sha256": "0" * 64, "license": "own", "reviewed_by": "owner", "row_count": records.count(), "lookup_allowed": True}
    book = evidence.Ledger.open(records, review, records.select("o_orderkey"), ["o_orderkey"], {"o_orderstatus": records.select("o_orderstatus").distinct()}, ("dose",), ("o_custkey", "o_orderstatus"), "o_orderstatus")
    found = book.lookup({"dose": {"value": 1.0, "unit": "wt%", "qualifier": "exact"}}, "o_custkey", "o_custkey", "present")
    names = ["outcome_records", "formulations", "present_formulations", "control_formulations", "conflicting_outcomes_at_same_conditions"]
    return spark.createDataFrame([tuple(found[n] for n in names)], "outcome_records long, formulations long, present_formulations long, control_formulations long, conflicting boolean")


# ------------------------------------------------------------------------------------------------------------- scalars


@query("""
WITH e AS (SELECT embedding e0 FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round(0.4 * exp(-0.5 * list_sum([(embedding[i]::DOUBLE - e0[i]::DOUBLE) ** 2 FOR i IN range(1, 65)]) / 64) + 0.6 * list_sum([embedding[i]::DOUBLE * e0[i]::DOUBLE FOR i IN range(1, 65)]), 6) AS kernel FROM embeddings, e
""")
def kernel_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    one = rows.agg(F.min_by("embedding", "vec_id").alias("e0"))
    e = F.col("embedding")
    mixed = scalar.mixed([(0.4, scalar.rbf(e, F.col("e0"), 0.5, 64)), (0.6, scalar.dot(e, F.col("e0")))])
    return rows.join(F.broadcast(one)).select("vec_id", F.round(mixed, 6).alias("kernel"))


@query("""
SELECT p_partkey, CASE WHEN (p_retailprice - 2.016) / (p_size + 400) >= 1 THEN round((p_retailprice - 2.016) / (p_size + 400), 9) END AS repeats, abs(p_retailprice - (p_retailprice * 1.005 + p_size % 3 * 5)) <= greatest(abs(p_retailprice * 1.005 + p_size % 3 * 5) * 0.01, 0.1) AS consistent,
  round(p_retailprice / (p_size + 1) * (1e24 / 6.02214076e23), 6) AS density, CASE WHEN p_size % 4 <> 3 THEN 1.5 * 10 ** (p_size % 4) END::DOUBLE AS number FROM part
""")
def chain_physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean repeats, agreement of masses, energy densities and numbers whose exponent is written with D."""
    price, size = F.col("p_retailprice"), F.col("p_size")
    text = F.when(size % 4 == 3, "none").otherwise(F.concat(F.lit("1.5D0"), (size % 4).cast("string")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(scalar.mean_repeats(price, F.lit(2.016), size + 400), 9).alias("repeats"), scalar.mass_consistent(price, price * 1.005 + size % 3 * 5).alias("consistent"),
        F.round(scalar.energy_density(price, size + 1), 6).alias("density"), scalar.exponent_number(text).alias("number"),
    )


@query("""SELECT p_partkey, sha256('{"brand":"' || p_brand || '","key":' || p_partkey || ',"size":' || p_size || '}') AS digest FROM part""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalar.canonical_digest_column({"size": F.col("p_size"), "key": F.col("p_partkey"), "brand": F.col("p_brand")}).alias("digest"))


# --------------------------------------------------------------------------------------------------------------- heads


@query("""
WITH r AS (SELECT l_linenumber % 3 f, l_quantity x, l_extendedprice y FROM lineitem), k AS (SELECT DISTINCT f FROM r),
s AS (SELECT k.f, count(*) n, avg(x) mx, stddev_pop(x) sx, avg(y) my, covar_pop(x, y) c FROM k JOIN r ON r.f <> k.f GROUP BY 1)
SELECT CAST(r.f AS INT) AS fold, count(*) AS rows, round(avg(my + (x - mx) / sx * (n * c / sx / (n + 10))), 4) AS predicted FROM r JOIN s ON r.f = s.f GROUP BY 1
""")
def out_of_fold_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line predicted once, by the ridge of the other folds."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).alias("fold"), "l_quantity", "l_extendedprice")
    held = heads.out_of_fold(rows, ["l_quantity"], ["l_extendedprice"], 10.0, "fold")
    return held.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("oof_l_extendedprice"), 4).alias("predicted"))


@query("""
SELECT min(l_quantity) AS low_quantity, max(l_quantity) AS high_quantity, min(l_discount) AS low_discount, max(l_discount) AS high_discount, round(avg(l_tax), 9) AS predicted, count(*) AS rows FROM lineitem
""")
def model_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trained model after its state went through JSON: training bounds, and predictions whose mean is the target's."""
    rows = table(spark, sf_dir, "lineitem")
    model = models.Model.restore(json.loads(json.dumps(models.train(rows, "A", ["l_quantity", "l_discount"], [], ["l_tax"], "l_suppkey", "synthetic").state())))
    bounds = [F.lit(v).alias(n) for n, v in zip(("low_quantity", "low_discount", "high_quantity", "high_discount"), [*model.low, *model.high], strict=True)]
    return rows.agg(F.round(F.avg(model.predict()["l_tax"]), 9).alias("predicted"), F.count(F.lit(1)).alias("rows")).select("*", *bounds)


@query("""
WITH f AS (SELECT p_brand, 1.0 / count(*) / (SELECT count(DISTINCT p_brand) FROM part) w FROM part GROUP BY 1), r AS (SELECT w, p_size x, ln(p_retailprice) y FROM part JOIN f USING (p_brand)),
m AS (SELECT sum(w * x) mx, sum(w * y) my, sum(w * x * x) - sum(w * x) ** 2 vx, sum(w * x * y) - sum(w * x) * sum(w * y) c FROM r)
SELECT round(any_value(c / sqrt(vx) / 1.1), 7) AS coef, round(any_value(my), 7) AS intercept, round(avg(exp(my + (x - mx) / sqrt(vx) * (c / sqrt(vx) / 1.1))), 5) AS predicted FROM r, m
""")
def scalar_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge of the logarithm under weights by which brands count alike, and its positive predictions."""
    part = table(spark, sf_dir, "part")
    head = models.fit_scalar(part, ["p_size"], "p_retailprice", "p_brand", "ridge", 0.1)
    return part.agg(F.round(F.avg(head.column()), 5).alias("predicted")).select(F.round(F.lit(head.linear.coef[0][0]), 7).alias("coef"), F.round(F.lit(head.linear.intercept[0]), 7).alias("intercept"), "predicted")


@query("""
WITH s AS (SELECT avg(p_size) ma, stddev_pop(p_size) sa, avg(p_retailprice) mb, stddev_pop(p_retailprice) sb FROM part)
SELECT p_partkey, round((p_size - ma) / sa, 6) AS z_p_size, round((p_retailprice - mb) / sb, 6) AS pc0 FROM part, s
""")
def fusion_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled features beside scaled components: of one column the component is the column."""
    part = table(spark, sf_dir, "part")
    found = models.Fusion.fit(part, ["p_size"], ["p_retailprice"]).columns()
    return part.select("p_partkey", *[F.round(v, 6).alias(n) for n, v in found.items()])


@query("""
WITH s AS (SELECT count(*) n, avg(n_nationkey) mx, stddev_pop(n_nationkey) sx, avg(n_regionkey) my, covar_pop(n_nationkey, n_regionkey) c FROM nation)
SELECT n_name, round(my + (n_nationkey - mx) / sx * (n * c / sx) / (n + 2), 7) AS predicted FROM nation, s
""")
def kernel_head_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual ridge over a linear kernel of one column: the same line as from sums."""
    rows = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").cast("double").alias("x"), F.col("n_regionkey").cast("double").alias("y"))
    head = kernels.KernelHead({"p": ["x"]}, [("p", "linear", 1.0)], 1.0, 2.0).fit(rows, ["y"])
    return head.predict(rows, ["y"]).select("n_name", F.round("pred_y", 7).alias("predicted"))


@query("SELECT round(ln(sum(l_tax + 0.01) FILTER (l_returnflag = 'R') / sum(l_tax + 0.01) FILTER (l_returnflag <> 'R')), 3) AS intercept, count(*) AS rows FROM lineitem")
def logistic_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted logistic regression without features: the logarithm of the weights' odds."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_tax") + 0.01).alias("w"))
    head = heads.fit_logistic(rows, [], "y", "w", 0.1)
    return rows.agg(F.round(F.lit(head.intercept), 3).alias("intercept"), F.count(F.lit(1)).alias("rows"))


@query("""
WITH r AS (SELECT l_suppkey, l_suppkey % 2 AS odd, (l_returnflag = 'R')::INT AS y FROM lineitem)
SELECT l_suppkey, sum(y) AS positives, count(*) AS lines FROM r GROUP BY 1
""")
def logistic_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature and a category of many values, almost without penalty: each category's chances add up to its positive rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_suppkey") % 2).alias("odd"), (F.col("l_returnflag") == "R").cast("int").alias("y"), F.lit(1.0).alias("w"))
    head = sparse.fit_categories(rows, ["odd"], "y", "w", 1e-9, "l_suppkey")
    return head.predict(rows).groupBy("l_suppkey").agg(F.round(F.sum(1 / (1 + F.exp(-F.col("logit"))))).cast("long").alias("positives"), F.count(F.lit(1)).alias("lines"))


_TREES = {
    "features": ["p_size", "p_retailprice"], "weights": [0.5, 2.0],
    "trees": [
        {"left": [1, -1, 3, -1, -1], "right": [2, -1, 4, -1, -1], "feature": [0, 0, 1, 0, 0], "threshold": [10.0, 0.0, 1000.0, 0.0, 0.0], "value": [0.0, 1.0, 0.0, 2.0, 3.0]},
        {"left": [1, -1, -1], "right": [2, -1, -1], "feature": [1, 0, 0], "threshold": [950.0, 0.0, 0.0], "value": [0.0, -1.0, 1.0]},
    ],
}


@query("SELECT value, count(*) AS parts FROM (SELECT (0.5 * CASE WHEN p_size <= 10 THEN 1 WHEN p_retailprice::FLOAT <= 1000 THEN 2 ELSE 3 END + 2.0 * CASE WHEN p_retailprice::FLOAT <= 950 THEN -1 ELSE 1 END)::DOUBLE AS value FROM part) GROUP BY 1")
def stored_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.predict_trees(table(spark, sf_dir, "part"), _TREES, "value").groupBy("value").agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT p_size > 25 AS large, count(*) AS parts, round(avg(p_retailprice), 6) AS mean, round(sqrt(avg(p_retailprice * p_retailprice)), 6) AS root, round(avg(p_retailprice), 6) AS boosted FROM part GROUP BY 1")
def two_leaf_forests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Randomised trees over one column of two values: whatever threshold is drawn, leaves are the means (or roots of mean squares) of both sides."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("large"), (F.col("p_size") > 25).cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    out = part
    (state,) = forests.fit_leafwise(part, ["x"], ["y"], trees=1, leaves=2, rate=1.0)
    out = forests.predicted(out, json.loads(json.dumps(state))).withColumnRenamed("pred_y", "boosted")
    for name, squared in (("mean", False), ("root", True)):
        (state,) = forests.fit_positive_forests(part, ["x"], ["y"], squared=squared, trees=3)
        out = forests.predicted(out, json.loads(json.dumps(state))).withColumnRenamed("pred_y", name)
    return out.groupBy("large").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("mean"), 6).alias("mean"), F.round(F.avg("root"), 6).alias("root"), F.round(F.avg("boosted"), 6).alias("boosted"))


@query("""
WITH v AS (SELECT 0 AS f, l_quantity::DOUBLE AS x, l_extendedprice AS y FROM lineitem UNION ALL SELECT 1, l_discount, l_extendedprice FROM lineitem UNION ALL SELECT 2, l_tax, l_extendedprice FROM lineitem),
g AS (SELECT f, x, count(*) AS n, sum(y) AS s FROM v GROUP BY 1, 2),
c AS (SELECT f, x, lead(x) OVER w AS nx, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER (PARTITION BY f) AS s FROM g WINDOW w AS (PARTITION BY f ORDER BY x)),
b AS (SELECT * FROM c WHERE nx IS NOT NULL ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, f, x LIMIT 1)
SELECT ['l_quantity', 'l_discount', 'l_tax'][f + 1] AS feature, round((x + nx) / 2, 5) AS threshold, CAST(nl AS BIGINT) AS lines, round(sl / nl, 4) AS low, round((s - sl) / (n - nl), 4) AS high FROM b
""")
def boosted_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of a boosted tree over three columns: the feature and threshold of the largest gain, and both sides' means."""
    names = ["l_quantity", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select(*[F.col(n).cast("double").alias(n) for n in names], F.col("l_extendedprice").cast("double").alias("y"))
    (state,) = forests.fit_leafwise(rows, names, ["y"], trees=1, leaves=2, least=1, rate=1.0)
    tree = state["trees"][0]
    low = F.col(names[tree["feature"][0]]) <= F.lit(tree["threshold"][0])
    out = forests.predicted(rows, json.loads(json.dumps(state)))
    return out.agg(F.lit(names[tree["feature"][0]]).alias("feature"), F.lit(round(tree["threshold"][0], 5)).alias("threshold"), F.count(F.when(low, 1)).alias("lines"), F.round(F.avg(F.when(low, F.col("pred_y"))), 4).alias("low"), F.round(F.avg(F.when(~low, F.col("pred_y"))), 4).alias("high"))


@query("""
WITH l AS (SELECT l_orderkey f, l_linenumber p, (l_linenumber + 1) // 2 m, CASE WHEN l_linenumber % 2 = 0 THEN 0.1 ELSE -0.1 END s, l_tax, l_quantity / 10 x, l_discount * 10 y, l_linenumber * 1.0 z FROM lineitem),
q AS (SELECT *, CASE WHEN abs(sum(s) OVER (PARTITION BY f, m)) < 1e-9 THEN s ELSE 0 END c, 0.2 + l_tax e FROM l),
d AS (SELECT a.f, sqrt(a.e * b.e) e, a.c * b.c c, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) r FROM q a JOIN q b ON a.f = b.f AND a.p < b.p AND a.m <> b.m AND NOT (a.p = 1 AND b.p = 3))
SELECT count(DISTINCT f) AS frames, round(sum(4 * e * ((0.3 / r) ** 12 - (0.3 / r) ** 6)), 6) AS lj, round(sum(138.935458 * c / r), 5) AS coulomb FROM d
""")
def cell_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells, lines as particles, two lines a molecule: pair energies between molecules, but for an excluded pair."""
    from pyspark.sql import Window

    line = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), line.alias("place"), F.floor((line + 1) / 2).alias("molecule"), F.when(line % 2 == 0, 0.1).otherwise(-0.1).alias("s"), F.lit(0.3).alias("sigma"), (F.col("l_tax") + 0.2).alias("epsilon"),
        (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 10).alias("y"), line.cast("double").alias("z"),
    )
    whole = F.abs(F.sum("s").over(Window.partitionBy("frame", "molecule"))) < 1e-9
    out = models.frame_cohesion(rows.withColumn("charge", F.when(whole, F.col("s")).otherwise(0.0)), spark.createDataFrame([(1, 3)], "place_a int, place_b int"), 1.0)
    return out.agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("lj"), 6).alias("lj"), F.round(F.sum("coulomb"), 5).alias("coulomb"))


# ---------------------------------------------------------------------------------------------------------- structures

_CHARGES = [("CCCC", "none", True), ("CC(C)C", "none", True), ("C[N+](=O)[O-]", "nitro_or_nitrate", False), ("[Na+].[Cl-]", "unreviewed", False), ("CCO", "none", False), ("C1CCC1", "none", False), ("C[NH3+]", "unreviewed", False)]


@query(f"WITH {_texts(tuple(r[0] for r in _CHARGES))}, c AS {_counted([(t, c, str(s)) for t, c, s in _CHARGES], 'smiles, charges, saturated')} SELECT charges, saturated = 'True' AS saturated, count(*) AS parts FROM p JOIN c USING (smiles) GROUP BY 1, 2")
def charge_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charge classes and saturated chains, by hand on the other side."""
    return chemistry.with_charges(_parts(spark, sf_dir, tuple(r[0] for r in _CHARGES))).groupBy("charges", "saturated").agg(F.count(F.lit(1)).alias("parts"))


_SOURCE = [("CCO", "methyl", 1), ("CCO", "methylene", 1), ("CCO", "alcohol", 1), ("CC(C)C", "methyl", 3), ("CC(C)C", "methine", 1), ("CC(=O)OC", "ester", 1), ("CC(=O)OC", "methyl", 2), ("CC=CC", "methyl", 2), ("CC=CC", "vinyl_methine", 2)]
_SOURCED = ("CCO", "CC(C)C", "CC(=O)OC", "CC=CC", "CCN")


@query(f"WITH {_texts(_SOURCED)}, g AS {_counted(_SOURCE, 'smiles, name, n')} SELECT coalesce(name, 'refused') AS name, count(*) AS parts, CAST(coalesce(sum(n), 0) AS BIGINT) AS groups FROM p LEFT JOIN g USING (smiles) GROUP BY 1")
def source_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chemistry.with_source_groups(_parts(spark, sf_dir, _SOURCED)).select(F.explode(F.coalesce("source_groups", F.create_map(F.lit("refused"), F.lit(0)))).alias("name", "n"))
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("groups"))


_SPELLED = [("CCO", 1), ("OCC", 1), ("C(O)C", 1), ("c1ccccc1", 2), ("C1=CC=CC=C1", 2), ("CC(=O)C", 3), ("CC(C)=O", 3), ("not a structure", 4)]


@query(f"WITH {_texts(tuple(r[0] for r in _SPELLED))}, c AS {_counted(_SPELLED, 'smiles, form')} SELECT min(p_partkey) AS first_part, count(*) AS parts, count(DISTINCT smiles) AS texts, form = 4 AS refused FROM p JOIN c USING (smiles) GROUP BY form")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one structure share their canonical text and fingerprint, and no others do."""
    rows = chemistry.with_canonical(_parts(spark, sf_dir, tuple(r[0] for r in _SPELLED)))
    return rows.groupBy("canonical", "bits").agg(F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("parts"), F.count_distinct("smiles").alias("texts"), F.max(F.col("structure_fault").isNotNull()).alias("refused")).drop("canonical", "bits")


_TAUTOMERS = [("CC(C)=O", 1), ("CC(O)=C", 1), ("CC(=O)N", 2), ("CC(O)=N", 2), ("CC(=O)CC(C)=O", 3), ("CC(O)=CC(C)=O", 3), ("O=C1C=CC=CN1", 4), ("Oc1ccccn1", 4), ("O=C1CC=CC=C1", 5), ("Oc1ccccc1", 5), ("CCO", 6), ("N[C@@H](C)C(=O)O", 7), ("N[C@H](C)C(=O)O", 7)]


@query(f"WITH {_texts(tuple(r[0] for r in _TAUTOMERS))}, c AS {_counted(_TAUTOMERS, 'smiles, form')} SELECT min(p_partkey) AS first_part, count(*) AS parts, count(DISTINCT smiles) AS texts FROM p JOIN c USING (smiles) GROUP BY form")
def tautomer_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms that shifts of hydrogen connect have one parent (mirror images too, since parents have no marks)."""
    rows = chemistry.with_tautomer_parent(_parts(spark, sf_dir, tuple(r[0] for r in _TAUTOMERS)))
    return rows.groupBy("parent").agg(F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("parts"), F.count_distinct("smiles").alias("texts")).drop("parent")


_MARKED = [("N[C@@H](C)C(=O)O", 1), ("C[C@H](N)C(=O)O", 1), ("N[C@H](C)C(=O)O", 2), ("F/C=C/F", 3), ("C(\\F)=C/F", 3), ("F/C=C\\F", 4), ("C[C@H](C)O", 5), ("CC(C)O", 5)]


@query(f"WITH {_texts(tuple(r[0] for r in _MARKED))}, c AS {_counted(_MARKED, 'smiles, form')} SELECT min(p_partkey) AS first_part, count(*) AS parts, count(DISTINCT smiles) AS texts FROM p JOIN c USING (smiles) GROUP BY form")
def marked_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirror images and sides of double bonds are told apart, spellings are not."""
    rows = chemistry.with_canonical(_parts(spark, sf_dir, tuple(r[0] for r in _MARKED)))
    return rows.groupBy("canonical").agg(F.min("p_partkey").alias("first_part"), F.count(F.lit(1)).alias("parts"), F.count_distinct("smiles").alias("texts")).drop("canonical")


_SIZES = [("CCO", 46.069, 3, 0, 1, 0), ("c1ccccc1", 78.114, 6, 1, 0, 0), ("CC(=O)OCC", 88.106, 6, 0, 0, 2), ("CC1CCCCC1", 98.189, 7, 1, 0, 0)]


@query(f"WITH {_texts(tuple(r[0] for r in _SIZES))}, c AS {_counted(_SIZES, 'smiles, w, h, r, d, o')} SELECT smiles, count(*) AS parts, w::DOUBLE AS weight, h::DOUBLE AS heavy, r::DOUBLE AS rings, d::DOUBLE AS donors, o::DOUBLE AS rotatable FROM p JOIN c USING (smiles) GROUP BY ALL")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.structures import FEATURES

    at = lambda name: F.col("features")[FEATURES.index(name)]
    rows = chemistry.with_features(_parts(spark, sf_dir, tuple(r[0] for r in _SIZES)))
    rows = rows.select("smiles", F.round(at("molecular_weight"), 3).alias("weight"), at("heavy_atoms").alias("heavy"), at("rings").alias("rings"), at("hbond_donors").alias("donors"), at("rotatable_bonds").alias("rotatable"))
    return rows.groupBy("smiles", "weight", "heavy", "rings", "donors", "rotatable").agg(F.count(F.lit(1)).alias("parts"))


_ATOMS = [("CCO", 6, 2, 2), ("CCO", 8, 1, 2), ("c1ccccc1", 6, 6, 6), ("C[N+](=O)[O-]", 6, 1, 3), ("C[N+](=O)[O-]", 7, 1, 3), ("C[N+](=O)[O-]", 8, 2, 3)]


@query(f"WITH {_texts(('CCO', 'c1ccccc1', 'C[N+](=O)[O-]', 'not a structure'))}, a AS {_counted(_ATOMS, 'smiles, number, n, bonds')} SELECT number, CAST(sum(n) AS BIGINT) AS atoms, (SELECT CAST(sum(b) AS BIGINT) FROM (SELECT p_partkey, max(bonds) b FROM p JOIN a USING (smiles) GROUP BY 1)) AS bonds FROM p JOIN a USING (smiles) GROUP BY 1")
def atoms_and_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table functions over structures, joined laterally."""
    chemistry.register(spark)
    rows = _parts(spark, sf_dir, ("CCO", "c1ccccc1", "C[N+](=O)[O-]", "not a structure"))
    atoms = spark.sql("SELECT a.number, count(*) AS atoms FROM {parts} p, LATERAL atoms_of(p.smiles) a GROUP BY 1", parts=rows)
    return atoms.join(F.broadcast(spark.sql("SELECT count(*) AS bonds FROM {parts} p, LATERAL bonds_of(p.smiles) b", parts=rows)))


@query("""
SELECT p_size % 4 AS eo, p_size % 3 AS po, count(*) AS parts, round(16.043 + 44.053 * (p_size % 4 * 100) + 58.08 * (p_size % 3 * 50) + 14.027, 3)::DOUBLE AS mn, (2 + 3.0 * (p_size % 4 * 100) + 4.0 * (p_size % 3 * 50))::DOUBLE AS heavy, p_size % 3 > 0 AS tacticity_open
FROM part WHERE p_size % 4 + p_size % 3 > 0 GROUP BY ALL
""")
def block_surfactants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of two units between methyl caps: masses and sizes of chains too long to be built, on a certified plane."""
    size = F.col("p_size")
    part = table(spark, sf_dir, "part").where((size % 4 + size % 3) > 0).select((size % 4).alias("eo"), (size % 3).alias("po"), F.lit("*C").alias("tail_smiles"), F.lit("*C").alias("head_smiles"), (size % 4 * 100).cast("double").alias("eo_mean"), (size % 3 * 50).cast("double").alias("po_mean"), F.lit("eo_then_po").alias("block_order"))
    found = chemistry.with_surfactant(part)
    tacticity = F.array_contains("issues", "regiochemistry_and_tacticity_of_po_unspecified")
    return found.groupBy("eo", "po", F.round("mn", 3).alias("mn"), F.round("mean_heavy_atoms", 6).alias("heavy"), tacticity.alias("tacticity_open")).agg(F.count(F.lit(1)).alias("parts"))


@query("""
WITH r AS (SELECT p_size % 5 k, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'C' END tail, p_size % 3 = 0 ionic, CASE WHEN p_size % 2 = 0 THEN 'Na' END ion, p_size % 4 e, p_size % 7 p FROM part)
SELECT reasons, count(*) AS n FROM (SELECT array_to_string(list_filter([CASE WHEN tail = '' THEN 'head_or_tail_missing' END, CASE WHEN ion IS NOT NULL AND NOT ionic THEN 'counterion_without_charge' END, CASE WHEN e + p = 0 THEN 'chain_is_empty' END], lambda x: x IS NOT NULL), '|') AS reasons FROM r) GROUP BY 1
""")
def surfactant_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    s = F.struct(F.lit("s").alias("series_id"), F.lit("C").alias("head_smiles"), F.when(size % 5 == 0, "").otherwise("C").alias("tail_smiles"), F.lit(None).cast("double").alias("mn_g_mol"), (size % 3 == 0).alias("ionic"), F.when(size % 2 == 0, "Na").alias("counterion_smiles"), F.lit(298.15).alias("temperature_k"))
    d = F.struct((size % 4).cast("double").alias("eo_mean"), (size % 7).cast("double").alias("po_mean"), *[F.lit(None).cast("double").alias(n) for n in ("eo_std", "po_std")], F.lit("block").alias("sequence"), F.lit("eo_then_po").alias("block_order"), F.lit("unknown").alias("distribution"), F.lit(None).cast("array<struct<eo:int,po:int,p:double>>").alias("joint_pmf"))
    rows = table(spark, sf_dir, "part").select(s.alias("s"), d.alias("d"))
    return rows.select(F.array_join(contracts.surfactant_reasons(F.col("s"), F.col("d")), "|").alias("reasons")).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


_UNITS = ("*CC*", "*CCO*", "*CC(C)*")


def _reference_model(size: int) -> dict:
    """Heads that give 20 - 5 / dp and 1 + log(1 + dp), by the features that hold them."""
    names = [f"x{i}" for i in range(size)]
    coef = [[0.0] * size, [0.0] * size]
    coef[0][-2], coef[1][-4] = -5.0, 1.0
    head = heads.LinearHead(names, ["vdw", "ele"], [0.0] * size, [1.0] * size, coef, [20.0, 1.0]).state()
    body = {"targets": ["vdw", "ele"], "low": [-1.0] * size, "high": [1e6] * size, "heads": {"A": head}, "radii": {"A": [0.5, 0.25]}}
    return body | {"digest": scalar.canonical_digest(body)}


@query("""
WITH r AS (SELECT p_partkey, p_size + 1 AS dp, CASE WHEN p_partkey % 11 = 0 THEN 'unsupported_source_protocol' WHEN p_partkey % 7 = 0 THEN 'unsupported_molecular_weight_distribution' WHEN p_partkey % 5 = 0 THEN 'unregistered_source_material'
  WHEN p_partkey % 13 = 0 THEN 'unsupported_end_groups' WHEN p_partkey % 17 = 0 THEN 'registered_material_state_mismatch' ELSE 'none' END AS reason FROM part)
SELECT reason, count(*) AS requests, round(sum(CASE WHEN reason = 'none' THEN 20 - 5.0 / dp - 0.5 END), 5)::DOUBLE AS vdw_lower, round(sum(CASE WHEN reason = 'none' THEN 1 + ln(1 + dp) END), 5) AS ele FROM r GROUP BY 1
""")
def registered_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per part against a registry of four parts in five: exact matches are predicted, all others refused by name."""
    key = F.col("p_partkey")
    unit = F.element_at(F.array(*[F.lit(t) for t in _UNITS]), (key % len(_UNITS) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("source_uuid"), unit.alias("repeat_unit_smiles"), (F.col("p_size") + 1).cast("long").alias("dp"), F.when(key % 2 == 0, "atactic").otherwise("none").alias("tacticity"), F.lit("*C").alias("left_cap"), F.lit("*C").alias("right_cap"))
    built = cohesion.with_chain_state(rows)
    support = built.where(key % 5 != 0).select("source_uuid", F.col("state.unit").alias("repeat_smiles"), F.col("state.capped").alias("capped_smiles"), "tacticity", "dp", F.col("state.mass").alias("mn_g_mol"), F.col("state.rebuilt").alias("features"), F.array(F.lit(0.0)).alias("embeddings"))
    protocol = {k: F.lit(v) for k, v in cohesion.PROTOCOL.items()} | {"temperature_k": F.when(key % 11 == 0, 310.0).otherwise(300.0)}
    asked = built.select(*rows.columns, F.col("state.mass").alias("mn_g_mol")).withColumns(protocol | {"dispersity": F.when(key % 7 == 0, 1.2).otherwise(1.0), "right_cap": F.when(key % 13 == 0, "*CC").otherwise("*C"), "mn_g_mol": F.col("mn_g_mol") + F.when(key % 17 == 0, 1.0).otherwise(0.0)})
    size = len(cohesion.chain_state("*CC*", "*C", "*C", 2, "none")["rebuilt"])
    out = cohesion.predicted(asked, support, _reference_model(size), "A")
    return out.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("vdw_lower"), 5).alias("vdw_lower"), F.round(F.sum("ele"), 5).alias("ele"))


_TOTALS = [("CCO", -0.0014, 12.7598, 0.333333, 0.333333, 1), ("c1ccccc1", 1.6866, 26.442, 0.0, 0.0, 1), ("Oc1ccccc1", 1.3922, 28.1068, 0.142857, 0.142857, 1), ("NC(N)=O", -0.9762, 13.7708, 0.5, 0.25, 1), ("C[NH3+]", None, None, None, None, 0)]


@query(f"""WITH {_texts(tuple(r[0] for r in _TOTALS))}, c AS (SELECT * FROM (VALUES {_values([(t, *('NULL' if x is None else x for x in r)) for t, *r in _TOTALS]).replace("'NULL'", "NULL")}) v(smiles, l, m, d, a, s))
SELECT smiles, count(*) AS parts, CASE WHEN s = 1 THEN l::DOUBLE END AS log_p, CASE WHEN s = 1 THEN m::DOUBLE END AS refraction, CASE WHEN s = 1 THEN d::DOUBLE END AS donors, CASE WHEN s = 1 THEN a::DOUBLE END AS acceptors FROM p JOIN c USING (smiles) GROUP BY ALL""")
def structure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published contributions and site counts per heavy atom, worked out by hand on the other side."""
    rows = chemistry.with_totals(_parts(spark, sf_dir, tuple(r[0] for r in _TOTALS)))
    known = F.col("sites").isNotNull()
    rows = rows.select("smiles", F.when(known, F.round("log_p", 4)).alias("log_p"), F.when(known, F.round("refraction", 4)).alias("refraction"), F.round(F.col("sites")["donors"], 6).alias("donors"), F.round(F.col("sites")["acceptors"], 6).alias("acceptors"))
    return rows.groupBy("smiles", "log_p", "refraction", "donors", "acceptors").agg(F.count(F.lit(1)).alias("parts"))


@query("""
WITH k AS (SELECT s_suppkey f, 0.3 + s_nationkey % 5 * 0.1 q FROM supplier)
SELECT count(*) AS frames, round(avg(-138.935458 * q * q * 8 * 1.7475645946 / 0.25 / 2 + 4 * 138.935458 * q * q / 0.25), 4) AS coulomb FROM k
""")
def periodic_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rock salt cells of eight ions with charges by supplier: the lattice's energy less that of its four pairs."""
    charges = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("frame"), (0.3 + F.col("s_nationkey") % 5 * 0.1).alias("q"))
    ions = [(4 * i + 2 * j + k, 2 * i + j, float((-1) ** (i + j + k)), i * 0.25, j * 0.25, k * 0.25) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    lattice = spark.createDataFrame(ions, "place int, molecule int, sign double, x double, y double, z double")
    rows = charges.join(F.broadcast(lattice)).select("frame", "place", "molecule", (F.col("q") * F.col("sign")).alias("charge"), F.lit(0.1).alias("sigma"), F.lit(0.0).alias("epsilon"), "x", "y", "z")
    out = cells.periodic_cohesion(rows, (0.5, 0.5, 0.5), 0.24, tolerance=1e-10)
    return out.agg(F.count(F.lit(1)).alias("frames"), F.round(F.avg("coulomb"), 4).alias("coulomb"))


# ------------------------------------------------------------------------------------------------------- named archives


def _archive(spark: SparkSession, arrays: dict) -> str:
    """A NumPy archive in a fresh folder below the shared one."""
    folder = shared_folder(spark, "archive")
    fs, path = gate.located(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/a.npz", compression=None) as f:
        buffer = io.BytesIO()
        np.savez(buffer, **arrays)
        f.write(buffer.getvalue())
    return f"{folder}/a.npz".replace("file:/", "file:///") if folder.startswith("file:/") and not folder.startswith("file://") else f"{folder}/a.npz"


@query("SELECT n_regionkey AS region, count(*) AS rows, CAST(sum(n_nationkey) AS DOUBLE) AS first, CAST(sum(n_nationkey * n_regionkey) AS DOUBLE) AS second FROM nation GROUP BY 1")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a gated archive of structures and targets."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    uri = _archive(spark, {"smiles": np.array([f"C{'C' * r[1]}" for r in rows]), "targets": np.array([[float(r[0]), float(r[0] * r[1])] for r in rows]), "target_names": np.array(["first", "second"])})
    manifest = {k: v for k, v in MANIFEST.items() if k not in ("label_kind", "approved_by")} | {"sha256": gate.file_digest(uri), "target_names": ["first", "second"], "target_units": ["1", "1"]}
    out = gate.auxiliary_table(spark, uri, manifest)
    return out.groupBy((F.length("smiles") - 1).alias("region")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("targets")[0]).alias("first"), F.sum(F.col("targets")[1]).alias("second"))


@query("SELECT tacticity, count(*) AS rows, CAST(sum(n_nationkey + 1) AS BIGINT) AS dp, round(sum(100.5 + n_regionkey), 6)::DOUBLE AS mass, CAST(sum(n_regionkey) AS DOUBLE) AS feature FROM (SELECT *, CASE WHEN n_nationkey % 2 = 0 THEN 'atactic' ELSE 'none' END AS tacticity FROM nation) GROUP BY 1")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a registry of materials: named arrays, their kinds and the metadata are checked as a whole."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").orderBy("n_nationkey").collect()
    key, region = (np.array([r[i] for r in rows]) for i in (0, 1))
    arrays = {"source_uuid": key.astype(str), "repeat_smiles": np.array(["*CC*"] * len(rows)), "capped_smiles": np.array(["CCCC"] * len(rows)), "tacticity": np.where(key % 2 == 0, "atactic", "none"), "dp": key + 1, "mn_g_mol": 100.5 + region, "features": np.column_stack([region, key]).astype(float), "embeddings": np.zeros((len(rows), 2))}
    found = cohesion.registry(spark, _archive(spark, arrays | {"metadata_json": np.array('{"source": "nations"}')}), {"source": "nations"})
    return found.groupBy("tacticity").agg(F.count(F.lit(1)).alias("rows"), F.sum("dp").alias("dp"), F.round(F.sum("mn_g_mol"), 6).alias("mass"), F.sum(F.col("features")[0]).alias("feature"))


@query("SELECT p_brand, count(*) AS rows, CAST(sum(n_nationkey) AS DOUBLE) AS first, CAST(sum(n_regionkey) AS DOUBLE) AS second FROM part JOIN nation ON p_size % 25 = n_nationkey GROUP BY 1")
def vector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frozen vectors of nations' structures from a CSV file; every part has to find its own."""
    folder = shared_folder(spark, "vectors")
    chain = lambda n: F.repeat(F.lit("C"), (n + 1).cast("int"))
    table(spark, sf_dir, "nation").select(chain(F.col("n_nationkey")).alias("smiles"), F.col("n_nationkey").alias("e0"), F.col("n_regionkey").alias("e1")).coalesce(1).write.option("header", True).csv(folder)
    vectors = gate.vector_table(spark, _file(spark, folder), 2)
    found = table(spark, sf_dir, "part").select("p_brand", chain(F.col("p_size") % 25).alias("smiles")).join(vectors, "smiles", "left")
    refuse.asserted(found, "vector", F.col("vector").isNull())
    return found.groupBy("p_brand").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("vector")[0]).alias("first"), F.sum(F.col("vector")[1]).alias("second"))


# ------------------------------------------------------------------------------------------------------ folds and jobs


@query("""
WITH RECURSIVE s AS (SELECT p_brand, count(*) n FROM part GROUP BY 1), o AS (SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) k FROM s),
r AS (SELECT CAST(0 AS BIGINT) k, [CAST(0 AS BIGINT), 0, 0, 0] load, CAST(NULL AS VARCHAR) p_brand, CAST(-1 AS BIGINT) fold UNION ALL
  SELECT o.k, list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN o.n ELSE 0 END), o.p_brand, list_position(load, list_min(load)) - 1 FROM r JOIN o ON o.k = r.k + 1)
SELECT p_brand, fold FROM r WHERE k > 0
""")
def size_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands dealt to four folds, the largest first, each to the fold with the fewest parts."""
    return grouping.size_balanced_folds(table(spark, sf_dir, "part"), "p_brand", 4).select("p_brand", "fold")


@query("""
WITH b AS (SELECT p_brand, (row_number() OVER (ORDER BY sha256('residual-42' || chr(0) || p_brand), p_brand) - 1) % 4 f FROM (SELECT DISTINCT p_brand FROM part)),
r AS (SELECT f, CAST(p_size AS DOUBLE) x, CAST(p_partkey % 7 AS DOUBLE) e, p_retailprice y FROM part JOIN b USING (p_brand)), k AS (SELECT DISTINCT f FROM r),
s AS (SELECT k.f, count(*) n, avg(x) mx, stddev_pop(x) sx, avg(y) my, covar_pop(x, y) c FROM k JOIN r ON r.f <> k.f GROUP BY 1),
d AS (SELECT e, y - (my + (x - mx) / sx * (n * c / sx / (n + 1))) z FROM r JOIN s ON r.f = s.f),
w AS (SELECT count(*) n, avg(x) mx, stddev_pop(x) sx, avg(y) my, covar_pop(x, y) c FROM r), v AS (SELECT count(*) n, avg(e) me, stddev_pop(e) se, avg(z) mz, covar_pop(e, z) c FROM d)
SELECT round(w.n * w.c / sx / (w.n + 1), 5) AS first_coef, round(my, 5) AS first_level, round(v.n * v.c / se / (v.n + 10), 5) AS second_coef, round(mz, 5) AS second_level FROM w, v
""")
def residual_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ridge, and another of its out-of-fold residuals (folds of brands by hash) on another column."""
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), (F.col("p_partkey") % 7).cast("double").alias("e"), F.col("p_retailprice").alias("y"))
    head = heads.fit_residual(part, ["x"], ["e"], ["y"], "p_brand")
    values = [head.first.coef[0][0], head.first.intercept[0], head.second.coef[0][0], head.second.intercept[0]]
    return spark.createDataFrame([tuple(round(float(v), 5) for v in values)], "first_coef double, first_level double, second_coef double, second_level double")


@query("""
WITH t AS (SELECT * FROM part WHERE p_brand <> 'Brand#11' AND p_size <> 7), g AS (SELECT p_brand, row_number() OVER (ORDER BY sha256('42' || chr(0) || p_brand), p_brand) - 1 k FROM (SELECT DISTINCT p_brand FROM t)),
n AS (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) n FROM g) SELECT (SELECT count(*) FROM t) AS rows, count(*) AS held FROM t JOIN g USING (p_brand), n WHERE k < n
""")
def auxiliary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts clear of reserved brands and sizes, a fifth of the brands held out for the metrics of a ridge."""
    part = table(spark, sf_dir, "part").withColumns({"x": F.col("p_size").cast("double"), "brand": F.col("p_brand")})
    reserved = [spark.createDataFrame([("Brand#11",)], "v string"), spark.createDataFrame([("7",)], "v string")]
    found = models.auxiliary_fit(part, "p_partkey", ["x"], ["p_retailprice"], [F.col("brand"), F.col("p_size").cast("string")], reserved, "p_brand")
    return spark.createDataFrame([(found["rows"], found["metrics"]["p_retailprice"]["rows"])], "rows long, held long")


_GC = {"methyl": (400, 0, 0, 30), "methylene": (270, 0, 0, 16), "methine": (80, 0, 0, -1), "alcohol": (210, 500, 20000, 10), "ester": (390, 490, 7000, 18), "vinyl_methine": (200, 0, 0, 13)}
_GC_SUMS = [("CCO", 880, 500.0, 20000, 56), ("CC(C)C", 1280, 0.0, 0, 89), ("CC(=O)OC", 1190, 490.0, 7000, 78), ("CC=CC", 1200, 0.0, 0, 86)]


@query(f"WITH {_texts(_SOURCED)}, c AS {_counted(_GC_SUMS, 'smiles, d, p, e, v')} SELECT smiles, count(*) AS parts, round(d / v::DOUBLE, 9) AS delta_d, round(c.p / v::DOUBLE, 9)::DOUBLE AS delta_p, round(sqrt(e / v::DOUBLE), 9) AS delta_h FROM p JOIN c USING (smiles) GROUP BY ALL")
def group_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of solubility from counted groups and a table of coefficients; structures with an uncounted atom have none."""
    coefficients = spark.createDataFrame([(k, *map(float, v)) for k, v in _GC.items()], "name string, fd double, fp double, eh double, volume double")
    rows = chemistry.with_source_groups(_parts(spark, sf_dir, _SOURCED))
    found = rows.select("p_partkey", "smiles", F.explode("source_groups").alias("name", "n")).join(F.broadcast(coefficients), "name")
    n = F.col("n")
    sums = found.groupBy("p_partkey", "smiles").agg(F.sum(n * F.col("fd")).alias("fd"), F.sum(n * F.col("fp") * F.col("fp")).alias("fp2"), F.sum(n * F.col("eh")).alias("eh"), F.sum(n * F.col("volume")).alias("v"))
    d, p, h = scalar.polar_parts(F.col("fd"), F.array(F.sqrt("fp2")), F.col("eh"), F.col("v"))
    return sums.groupBy("smiles", F.round(d, 9).alias("delta_d"), F.round(p, 9).alias("delta_p"), F.round(h, 9).alias("delta_h")).agg(F.count(F.lit(1)).alias("parts"))


@query("SELECT 2 AS rank, true AS positive, true AS reconstructed, count(*) AS rows FROM nation")
def spectral_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A softplus response over a kernel of two columns: its rank, its responses above zero and the kernel rebuilt from its spectrum."""
    rows = heads.standardised(table(spark, sf_dir, "nation"), ["n_nationkey", "n_regionkey"])
    x = [F.col("z_n_nationkey"), F.col("z_n_regionkey")]
    found, told = kernels.fit_softplus(kernels.packed(rows, x, [F.col("n_regionkey") + 1]), 2, kernels.Mix(((0, 2, "linear", 1.0, 0.5),)), 0.5)
    response = found.predicted(rows, x, "eta").select(metrics.softplus(F.col("eta")[0]).alias("r"))
    return response.agg(F.lit(told["rank"]).alias("rank"), (F.min("r") > 0).alias("positive"), F.lit(told["reconstruction_error"] < 1e-9).alias("reconstructed"), F.count(F.lit(1)).alias("rows"))


@query("""
WITH r AS (SELECT p_brand AS f, p_retailprice AS y, p_size::DOUBLE AS e FROM part),
o AS (SELECT f, (row_number() OVER (ORDER BY sha256('outer-42' || chr(0) || f), f) - 1) % 5 AS o FROM (SELECT DISTINCT f FROM r)),
i AS (SELECT f, k, (row_number() OVER (PARTITION BY k ORDER BY sha256('inner-42' || chr(0) || f), f) - 1) % 4 AS j FROM o, (SELECT unnest(range(5)) AS k) WHERE o <> k),
s AS (SELECT k, j, count(*) AS n, sum(y) AS y FROM r JOIN i USING (f) GROUP BY 1, 2), w AS (SELECT k, sum(n) AS n, sum(y) AS y FROM s GROUP BY 1),
d AS (SELECT k, e, r.y - (w.y - s.y) / (w.n - s.n) AS v FROM r JOIN i USING (f) JOIN s USING (k, j) JOIN w USING (k)),
g AS (SELECT k, count(*) AS n, avg(e) AS e, stddev_pop(e) AS se, avg(v) AS v, covar_pop(e, v) AS c FROM d GROUP BY 1),
h AS (SELECT f, r.y - w.y / w.n AS off, g.v, (r.e - g.e) / g.se * g.n * g.c / g.se AS z, g.n FROM r JOIN o USING (f) JOIN w ON o.o = w.k JOIN g ON o.o = g.k),
m AS (SELECT f, avg(abs(off)) AS a, avg(abs(off - v)) AS b, avg(abs(off - v - z / (n + 100))) AS c, avg(abs(off - v - z / (n + 1))) AS d FROM h GROUP BY 1),
t AS (SELECT unnest([{'at': 0, 'candidate': 'none', 'score': avg(a)}, {'at': 1, 'candidate': 'constant', 'score': avg(b)}, {'at': 2, 'candidate': '100.0', 'score': avg(c)}, {'at': 3, 'candidate': '1.0', 'score': avg(d)}]) AS t FROM m)
SELECT t.candidate AS candidate, round(t.score, 6) AS score, row_number() OVER (ORDER BY CASE WHEN t.score <= (SELECT min(t.score) FROM t) + 1e-12 THEN 0 ELSE 1 END, t."at") = 1 AS chosen FROM t
""")
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested selection of a residual on parts' sizes by folds of folds of brands; the chemistry head has a constant feature, so it gives means."""
    part = table(spark, sf_dir, "part").select("p_brand", F.lit(1.0).alias("x"), F.col("p_size").cast("double").alias("e"), F.col("p_retailprice").alias("y"))
    found = nested.select_hybrid(part, ["x"], ["e"], ["y"], "p_brand", (100.0, 1.0))
    rows = [(str(c), round(s, 6), c == found["residual"]["y"]["candidate"]) for c, s in zip(found["candidates"], found["scores"]["y"], strict=True)]
    return spark.createDataFrame(rows, "candidate string, score double, chosen boolean")


@query("""
WITH r AS (SELECT l_linenumber > 3 AS late, l_quantity AS y FROM lineitem), m AS (SELECT avg(y) AS y, avg(late::INT) AS p FROM r),
g AS (SELECT late, count(*) AS n, sum(r.y - m.y) AS s FROM r, m GROUP BY 1), k AS (SELECT exp(-0.5 / (p * (1 - p))) AS k, y FROM m),
d AS (SELECT a.n AS n0, b.n AS n1, (a.s * (5 + b.n) - a.n * k * b.s) / ((5 + a.n) * (5 + b.n) - a.n * b.n * k * k) AS d0, ((5 + a.n) * b.s - b.n * k * a.s) / ((5 + a.n) * (5 + b.n) - a.n * b.n * k * k) AS d1, k, y FROM g a, g b, k WHERE NOT a.late AND b.late)
SELECT false AS late, n0 AS lines, round(d0 + k * d1 + y, 6) AS predicted FROM d UNION ALL SELECT true, n1, round(k * d0 + d1 + y, 6) FROM d
""")
def kernel_head_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual ridge over an RBF kernel of all lines: with two values of the feature the system of all rows is one of two sums."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") > 3).alias("late"), F.col("l_quantity").cast("double").alias("y")).withColumn("x", F.col("late").cast("double"))
    head = kernels.KernelHead({"p": ["x"]}, [("p", "rbf", 1.0)], 0.5, 5.0).fit(rows, ["y"])
    return head.predict(rows, ["y"]).groupBy("late").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg("pred_y"), 6).alias("predicted"))


@query("SELECT l_linestatus, count(*) AS lines, round(avg(l_quantity), 4) AS response FROM lineitem GROUP BY 1")
def softplus_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nonnegative response over an RBF kernel of all lines: almost without penalty it gives the means of both values."""
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.col("l_quantity").cast("double").alias("y"))
    x = [(F.col("l_linestatus") == "O").cast("double")]
    packed = kernels.packed(rows, x, [F.col("y")])
    found, _ = kernels.fit_softplus(packed, 1, kernels.Mix(((0, 1, "rbf", 1.0, 0.5),)), 1e-6)
    dropped(packed)
    return found.predicted(rows, x, "eta").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("lines"), F.round(F.avg(metrics.softplus(F.col("eta")[0])), 4).alias("response"))


@query("""
WITH f AS (SELECT p_size > 25 AS large, ln(p_retailprice) AS y, 1.0::DOUBLE / count(*) OVER (PARTITION BY p_brand) / (SELECT count(DISTINCT p_brand) FROM part) AS w FROM part),
g AS (SELECT large, count(*) AS n, sum(w) AS w, sum(w * y) AS s FROM f GROUP BY 1), c AS (SELECT a.n AS n0, b.n AS n1, a.w AS w0, b.w AS w1, a.s AS s0, b.s AS s1, 1 - exp(-1 / (a.w * b.w)) AS c FROM g a, g b WHERE NOT a.large AND b.large),
d AS (SELECT *, (s0 * w1 - w0 * s1) / ((0.1 + w0 * c) * w1 + w0 * (0.1 + w1 * c)) AS d, ((0.1 + w0 * c) * s1 + (0.1 + w1 * c) * s0) / ((0.1 + w0 * c) * w1 + w0 * (0.1 + w1 * c)) AS b FROM c)
SELECT false AS large, n0 AS parts, round(exp(d * c + b), 5) AS predicted FROM d UNION ALL SELECT true, n1, round(exp(b - d * c), 5) FROM d
""")
def scalar_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positive target by a kernel of its logarithm under families' weights, with a free level: two values of the feature, a system of two sums."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("large"), (F.col("p_size") > 25).cast("double").alias("x"), "p_retailprice", "p_brand")
    head = models.fit_scalar(part, ["x"], "p_retailprice", "p_brand", "rbf", 0.1)
    return head.predicted(part, "predicted").groupBy("large").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("predicted"), 5).alias("predicted"))


@query("SELECT column_name AS name, row_number() OVER () - 1 AS place FROM (DESCRIBE part)")
def schema_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of parts as JSON, read again."""
    fields = json.loads(json.dumps(gate.schema_json(table(spark, sf_dir, "part"))))["fields"]
    return spark.createDataFrame([(f["name"], i) for i, f in enumerate(fields)], "name string, place long")


@query("SELECT p_size > 25 AS large, count(*) AS parts, round(avg(p_retailprice), 1) AS predicted FROM part GROUP BY 1")
def two_point_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network over one column of two values: at the least squares it gives both sides' means."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") > 25).alias("large"), (F.col("p_size") > 25).cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    state = forests.fit_network(part, ["x"], ["y"], width=2, alpha=0.0, gate=1e-7, rounds=300)
    return forests.predicted(part, json.loads(json.dumps(state))).groupBy("large").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("pred_y"), 1).alias("predicted"))
