"""Verbs on files: `python -m tessera.cli VERB ...`. Refusals and missing files end with status 2 and one line on stderr."""

from __future__ import annotations

import argparse
import json
import math
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import blocks, structures
from .operators import chemistry, cohesion, evidence, models, prepare
from .sources import contracts, gate


#: Authored cores of the synthetic table: chains, and rings of many topologies, so that there are families to split.
CORES = (
    "CCO", "CCC", "CC(C)=O", "CCOC(C)=O", "CCN", "CCOCC", "CC#N", "CCS", "CC(=O)NC", "C1CC1C", "C1CCC1C", "C1CCCC1C", "c1ccccc1", "C1CCCCCC1C", "c1ccoc1", "c1ccsc1", "C1CCNC1",
    "c1ccncc1", "C1CCOCC1", "C1COCCN1", "c1ccc2ccccc2c1", "c1ccc(cc1)-c1ccccc1", "c1cnc[nH]1", "c1ccc2[nH]ccc2c1", "C1CC2CCC1C2", "C1CCSCC1",
)


def session() -> SparkSession:
    return SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _emit(value: object, out: str | None) -> None:
    if out:
        gate.write_json(out, value)
    else:
        print(json.dumps(value, indent=2, allow_nan=False, ensure_ascii=False))


def _featured(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Labelled rows with a column per feature and the family of their structure."""
    made = chemistry.with_features(df)
    if made.where("structure_fault IS NOT NULL").limit(1).count():
        raise contracts.Refused("a structure cannot be read or has an atom without group")
    rows = made.withColumn("row", F.xxhash64("sample_id"))
    rows = rows.join(chemistry.families(df.withColumn("row", F.xxhash64("sample_id")), "row").withColumnRenamed("group", "family"), "row")
    names = [f"x_{n}" for n in structures.FEATURES]
    return rows.withColumns({c: F.col("features")[i] for i, c in enumerate(names)}), names


def synthetic(a: argparse.Namespace) -> None:
    """Authored cores and substituents with formulas for labels; the labels mean nothing physical."""
    gate.fresh(a.out)
    spark = session()
    cores = spark.createDataFrame([(c,) for c in CORES], "core string")
    prefixes = F.explode(F.array(*[F.lit(p) for p in ("", "C", "CC", "CCC", "C(C)", "OC", "FC", "ClC")]))
    rows = cores.withColumn("head", prefixes).select(F.concat("head", "core").alias("smiles")).union(spark.range(1, 9).select(F.concat(F.repeat(F.lit("C"), F.col("id").cast("int")), F.lit("O")))).distinct()
    made = chemistry.with_scope(chemistry.with_features(rows).drop("structure_fault")).where("supported").dropDuplicates(["canonical"])
    f = lambda n: F.col("features")[structures.FEATURES.index(n)]
    noise = lambda k: F.randn(a.seed + k) * 0.08
    labels = {"delta_d": 15 + 0.02 * f("molecular_weight") + 0.3 * f("rings"), "delta_p": 1 + 0.1 * f("tpsa") + 0.5 * f("halogen"), "delta_h": 2 + 3 * f("alcohol") + 1.5 * f("amine") + f("hbond_acceptors")}
    ranked = made.withColumn("n", F.row_number().over(Window.orderBy("canonical")) - 1)
    out = ranked.select(F.format_string("syn-%04d", "n").alias("sample_id"), F.col("canonical").alias("smiles"), *[F.greatest(v + noise(i), F.lit(0.0)).alias(t) for i, (t, v) in enumerate(labels.items())], F.lit("synthetic").alias("label_kind"))
    out.coalesce(1).write.mode("errorifexists").option("header", True).csv(a.out)


def train(a: argparse.Namespace) -> None:
    df, names = _featured(gate.labelled_table(session(), a.data, Path(a.manifest).read_bytes()))
    contracts.DATASET.authorize(contracts.DATASET.parse(Path(a.manifest).read_bytes()), "evaluate")
    kind = df.first()["label_kind"]
    bits = [f"b{i}" for i in range(256)]
    if "B" in a.modes or "C" in a.modes:
        df = df.withColumns({c: F.array_contains("bits", F.lit(i)).cast("double") for i, c in enumerate(bits)})
    out = models.train_and_report(df, names, bits, list(gate.TARGETS), "family", kind, tuple(a.modes), a.seed)
    gate.write_json(a.model, {m: v["state"] for m, v in out["models"].items()})
    gate.write_json(a.report, {"split": out["split"], "models": {m: v["report"] for m, v in out["models"].items()}})


def predict(a: argparse.Namespace) -> None:
    spark = session()
    model = models.Model.restore(json.loads(Path(a.model).read_text())[a.mode])
    rows = gate.csv_table(spark, a.data, ("sample_id", "smiles"))
    made = chemistry.with_scope(chemistry.with_features(rows).drop("structure_fault"))
    made = made.withColumns({f"x_{n}": F.col("features")[i] for i, n in enumerate(structures.FEATURES)} | {f"b{i}": F.array_contains("bits", F.lit(i)).cast("double") for i in range(256)})
    made = made.withColumn("scope", F.when(F.col("structure_fault").isNotNull(), F.array(F.lit("invalid_input"))).otherwise(F.col("scope")))
    out = models.predictions(model, made)
    out = out.withColumns({"canonical_smiles": F.col("canonical"), "nearest_training_tanimoto": F.lit(None).cast("double")} | {t: F.col(f"{t}_value") for t in model.targets})
    gate.write_predictions(out, a.out, tuple(model.targets))


def features(a: argparse.Namespace) -> None:
    owned = structures.owned_groups(structures.read(structures.canonical(a.smiles)))
    _emit({"canonical": structures.canonical(a.smiles), "groups": owned.counts, "unassigned": owned.unassigned, "scope": structures.scope_reasons(a.smiles), "features": dict(zip(structures.FEATURES, structures.features(a.smiles), strict=True)) if not owned.unassigned else None}, a.out)


def chain_features(a: argparse.Namespace) -> None:
    _emit(structures.moments(a.smiles, a.left, a.right, a.mn), a.out)


def reference_gc(a: argparse.Namespace) -> None:
    """Components of solubility from a table of group coefficients: Fd / V, root of summed Fp squared / V, root of Eh / V."""
    review = contracts.COEFFICIENTS.authorize(contracts.COEFFICIENTS.parse(Path(a.review).read_bytes()), "calculate")
    if gate.file_digest(a.table) != review["sha256"]:
        raise contracts.Refused("the table does not match its checksum")
    table = contracts.strict_json(Path(a.table).read_bytes())["groups"]
    counts = {k: n for k, n in structures.source_groups(a.smiles).items() if n}
    if missing := counts.keys() - table.keys():
        raise contracts.Refused(f"no coefficients for {sorted(missing)}")
    total = lambda c: sum(n * table[k][c] for k, n in counts.items())
    volume = total("volume")
    if volume <= 0 or total("eh") < 0:
        raise contracts.Refused("a positive volume and a nonnegative energy are needed")
    polar = math.sqrt(sum(n * table[k]["fp"] ** 2 for k, n in counts.items()))
    _emit({"groups": counts, "delta_d": total("fd") / volume, "delta_p": polar / volume, "delta_h": math.sqrt(total("eh") / volume), "physical_accuracy_validated": False}, a.out)


def schema(a: argparse.Namespace) -> None:
    _emit({"dataset": {k: f.kind for k, f in contracts.DATASET.fields.items()}, "prediction_columns": list(gate.PREDICTION)}, a.out)


def validate(a: argparse.Namespace) -> None:
    df = gate.labelled_table(session(), a.data, Path(a.manifest).read_bytes(), "evaluate")
    _emit({"rows": df.count()}, a.out)


def cohesion_prepare(a: argparse.Namespace) -> None:
    spark = session()
    gate.gated(a.source, Path(a.review).read_bytes(), contracts.SOURCE_REVIEW, "prepare")
    need = ("UUID", "temp", "press", "check_eq", "smiles_list", "forcefield", "RadonPy_ver", "preset_sp_ver", "sp_ced", "sp_total", "sp_vdw", "sp_ele")
    raw = gate.csv_table(spark, a.source, need).withColumn("source_row", F.monotonically_increasing_id())
    rows = prepare.cohesion_rows(raw, "source_row", ["UUID", "smiles_list", "forcefield", "RadonPy_ver", "preset_sp_ver"])
    number = {c: F.col(c).try_cast("double") for c in ("sp_ced", "sp_total", "sp_vdw", "sp_ele")}
    flagged = rows.withColumn("flags", prepare.energy_flags(*number.values()))
    counts = {r["reason"]: r["n"] for r in prepare.accounting(rows).collect()}
    contexts = [r.asDict() for r in prepare.contexts(rows, ["temp", "press", "forcefield", "preset_sp_ver"]).collect()]
    gate.write_rows(flagged.where("reason IS NULL").drop("reason", "source_row"), a.out, {"counts": counts, "contexts": contexts, "material_identity_qualified": False})


def evaluate(a: argparse.Namespace) -> None:
    """A model on an independent table; its label kind decides what may be said."""
    gate.fresh(a.report)
    manifest = Path(a.manifest).read_bytes()
    df, _ = _featured(gate.labelled_table(session(), a.data, manifest, "evaluate"))
    df = df.withColumns({f"b{i}": F.array_contains("bits", F.lit(i)).cast("double") for i in range(256)})
    model = models.Model.restore(json.loads(Path(a.model).read_text())[a.mode])
    gate.write_json(a.report, models.evaluate(model, df, "family", contracts.DATASET.parse(manifest)["label_kind"]))


def _reserved(spark: SparkSession, path: str) -> DataFrame:
    """The aliases of all structures of a JSON object with `smiles` and, if need be, `series` beside them."""
    record = contracts.strict_json(Path(path).read_bytes())
    texts = record["smiles"]
    df = spark.createDataFrame([(t,) for t in texts], "smiles string") if texts else spark.createDataFrame([], "smiles string")
    made = chemistry.with_aliases(df)
    if made.where("structure_fault IS NOT NULL").limit(1).count():
        raise contracts.Refused("a reserved structure cannot be read")
    return made.select(F.explode("aliases").alias("alias")).distinct()


def auxiliary_fit(a: argparse.Namespace) -> None:
    """Auxiliary targets of structures that share no alias with reserved ones; a fifth of the families is held out."""
    gate.fresh(a.model)
    gate.fresh(a.report)
    spark = session()
    manifest = contracts.AUXILIARY.parse(Path(a.manifest).read_bytes())
    names = list(manifest["target_names"])
    rows = gate.auxiliary_table(spark, a.data, Path(a.manifest).read_bytes()).withColumn("sample_id", F.xxhash64("smiles").cast("string"))
    df, features = _featured(rows)
    df = chemistry.with_aliases(df.drop("structure_fault")).withColumns({f"y_{t}": F.col("targets")[i] for i, t in enumerate(names)})
    most = df.agg(F.max(F.size("aliases"))).first()[0]
    taken = _reserved(spark, a.reserved)
    out = models.auxiliary_fit(df, "sample_id", features, [f"y_{t}" for t in names], [F.get("aliases", F.lit(i)) for i in range(most)], [taken] * most, "family", a.seed)
    gate.write_json(a.model, out.pop("head"))
    gate.write_json(a.report, out | {"units": dict(zip(names, manifest["target_units"], strict=True)), "source": manifest["source"]})


def solquest_prepare(a: argparse.Namespace) -> None:
    """Solvation targets of a column-oriented source: rows are prepared or skipped with one reason each."""
    spark = session()
    review = gate.gated(a.source, Path(a.review).read_bytes(), contracts.AUXILIARY, "train")
    names = list(review["target_names"])
    rows = gate.column_json(spark, a.source, "SMILES", "SOLVATION").withColumnRenamed("key", "smiles")
    rows = rows.withColumns({f"y{i}": F.col("value")[t] for i, t in enumerate(names)}).drop("value")
    made = chemistry.with_scope(chemistry.with_aliases(chemistry.with_canonical(rows).drop("structure_fault")).drop("structure_fault"))
    scope = lambda word: F.exists("scope", lambda r: r.contains(word))
    taken = _reserved(spark, a.reserved).withColumn("_taken", F.lit(True))
    held = made.select("position", F.explode("aliases").alias("alias")).join(taken, "alias").select("position").distinct().withColumn("reserved", F.lit(True))
    checks = [("invalid_or_unstable_structure", F.col("canonical").isNull()), ("charged_or_disconnected", scope("ionic") | scope("mixture")), ("radical_or_port", scope("radical") | scope("dummy")), ("outside_scope", ~F.col("supported")), ("reserved_identity", F.col("reserved").isNotNull())]
    found = prepare.solvation_rows(made.join(held, "position", "left"), "position", "canonical", [f"y{i}" for i in range(len(names))], checks)
    counts = {r["reason"]: r["n"] for r in prepare.accounting(found).collect()}
    out = found.where("reason IS NULL").select(F.col("canonical").alias("smiles"), F.array(*[F.col(f"y{i}") for i in range(len(names))]).alias("targets"))
    gate.write_bundle(out, a.out, review, {"counts": counts, "target_names": names, "independent_accuracy_validated": False})


def cohesion_predict(a: argparse.Namespace) -> None:
    """Computed references of registered materials; anything that isn't exactly registered is refused by name."""
    gate.fresh(a.out)
    spark = session()
    review = contracts.SOURCE_REVIEW.authorize(contracts.SOURCE_REVIEW.parse(Path(a.review).read_bytes()), "prepare")
    if gate.file_digest(a.support) != review["sha256"]:
        raise contracts.Refused("the registry does not match its checksum")
    model = contracts.strict_json(Path(a.model).read_bytes())
    support = cohesion.registry(spark, a.support, {"source": review["source"]})
    rows = cohesion.predicted(cohesion.requests_of(spark, Path(a.input).read_bytes()), support, model, a.mode)
    gate.write_json(a.out, [json.loads(r["row"]) for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).collect()])


def checkpoint_fetch(a: argparse.Namespace) -> None:
    _emit({"files": gate.fetched(Path(a.review).read_bytes(), a.out)}, None)


def licence_inventory(a: argparse.Namespace) -> None:
    gate.write_json(a.out, gate.licence_inventory())


def surfactant_features(a: argparse.Namespace) -> None:
    _emit(blocks.surfactant(contracts.strict_json(Path(a.input).read_bytes())), a.out)


def lookup(a: argparse.Namespace) -> None:
    """Exact filter over a reviewed ledger of JSON lines; the query is one JSON object."""
    spark = session()
    review = contracts.OBSERVATION_REVIEW.authorize(contracts.OBSERVATION_REVIEW.parse(Path(a.review).read_bytes()), "lookup")
    if gate.file_digest(a.ledger) != review["ledger_sha256"]:
        raise contracts.Refused("the ledger does not match its checksum")
    records = spark.read.option("mode", "FAILFAST").json(a.ledger)
    quantities = tuple(f.name for f in records.schema if f.dataType.typeName() == "struct" and "value" in f.dataType.names)
    plain = tuple(c for c in records.columns if c not in quantities)
    book = evidence.Ledger(records, review, quantities, plain, a.outcome)
    found = book.lookup(contracts.strict_json(a.query), a.subject, a.formulation, a.present)
    print(evidence.report(found))


VERBS: dict[str, tuple[Callable[[argparse.Namespace], None], tuple[str, ...]]] = {
    "synthetic": (synthetic, ("--out", "--seed=42")),
    "features": (features, ("--smiles", "--out=")),
    "chain-features": (chain_features, ("--smiles", "--left", "--right", "--mn:float", "--out=")),
    "reference-gc": (reference_gc, ("--smiles", "--table", "--review", "--out=")),
    "schema": (schema, ("--out=",)),
    "validate": (validate, ("--data", "--manifest", "--out=")),
    "train": (train, ("--data", "--manifest", "--model", "--report", "--modes=A", "--seed=42")),
    "compare": (train, ("--data", "--manifest", "--model", "--report", "--modes=ABC", "--seed=42")),
    "predict": (predict, ("--data", "--model", "--out", "--mode=A")),
    "surfactant-features": (surfactant_features, ("--input", "--out=")),
    "evaluate": (evaluate, ("--model", "--data", "--manifest", "--report", "--mode=A")),
    "auxiliary-fit": (auxiliary_fit, ("--data", "--manifest", "--reserved", "--model", "--report", "--seed=42")),
    "solquest-prepare": (solquest_prepare, ("--source", "--review", "--reserved", "--out")),
    "md-cohesion-predict": (cohesion_predict, ("--model", "--review", "--support", "--input", "--out", "--mode=A")),
    "checkpoint-fetch": (checkpoint_fetch, ("--review", "--out")),
    "licence-inventory": (licence_inventory, ("--out",)),
    "md-cohesion-prepare": (cohesion_prepare, ("--source", "--review", "--out")),
    "formulation-lookup": (lookup, ("--ledger", "--review", "--query", "--subject", "--formulation", "--present", "--outcome")),
    "material-lookup": (lookup, ("--ledger", "--review", "--query", "--subject", "--formulation", "--present", "--outcome")),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description="Verbs on files; synthetic metrics are no real accuracy.")
    commands = parser.add_subparsers(dest="verb", required=True)
    for name, (_, options) in VERBS.items():
        sub = commands.add_parser(name)
        for o in options:
            flag, given, default = o.partition("=")
            flag, _, kind = flag.partition(":")
            number = default.isdigit()
            sub.add_argument(flag, required=not given, default=(int(default) if number else default or None) if given else None, type=float if kind else int if number else str)
    a = parser.parse_args(argv)
    try:
        VERBS[a.verb][0](a)
    except (ValueError, OSError, ImportError, PySparkException) as e:
        print(f"{a.verb}: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
