"""Preparation of simulation and solvation tables: rows are prepared or skipped with one named reason each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .refuse import all_reasons, consolidated, finite, first_reason, first_valid_wins

SLACK = 1e-6


def energy_flags(ced: Column, total: Column, vdw: Column, ele: Column) -> Column:
    """Names of what exceeds the mean cohesive energy density by more than SLACK."""
    return all_reasons([("total_exceeds_mean_energy", total * total > ced + SLACK), ("parts_exceed_mean_energy", vdw * vdw + ele * ele > ced + SLACK)])


def cohesion_rows(df: DataFrame, row: str, required: list[str]) -> DataFrame:
    """df with `reason`: null where a row is prepared.

    In order: equilibrium not declared; required metadata missing; an earlier row of the same UUID was prepared; a
    missing, nonfinite or negative observable or impossible conditions. Only prepared rows reserve their UUID.
    """
    number = {c: F.col(c).try_cast("double") for c in ("temp", "press", "sp_ced", "sp_total", "sp_vdw", "sp_ele")}
    ok = lambda c: F.coalesce(finite(number[c]), F.lit(False))
    bad = ~ok("temp") | ~ok("press") | F.coalesce(number["temp"] <= 0, F.lit(True)) | F.coalesce(number["press"] <= 0, F.lit(True))
    for c in ("sp_ced", "sp_total", "sp_vdw", "sp_ele"):
        bad = bad | ~ok(c) | F.coalesce(number[c] < 0, F.lit(True))
    missing = F.lit(False)
    for c in required:
        missing = missing | F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    declared = F.coalesce(F.col("check_eq") == "True", F.lit(False))
    marked = first_valid_wins(df, ["UUID"], [row], declared & ~missing & ~bad)
    reason = first_reason([("equilibrium_not_declared", ~declared), ("required_source_metadata_missing", missing), ("repeated_uuid_refused", F.col("repeated")), ("missing_nonfinite_negative_observable_or_invalid_conditions", bad)])
    return marked.withColumn("reason", reason).drop("repeated")


def solvation_rows(df: DataFrame, row: str, key: str, targets: list[str], checks: list[tuple[str, Column]]) -> DataFrame:
    """df with `reason`: the first failing check, nonfinite targets, then repeats (duplicate) and conflicts of the key.

    Rows that fail a check take no part in the consolidation of repeats.
    """
    bad = F.lit(False)
    for t in targets:
        bad = bad | ~F.coalesce(finite(F.col(t)), F.lit(False))
    checked = df.withColumn("_reason", first_reason([*checks, ("nonfinite_target", bad)]))
    settled = consolidated(checked.where("_reason IS NULL"), [key], [row], targets)
    settled = settled.withColumn("reason", F.when(F.col("verdict") != "kept", F.col("verdict"))).drop("verdict", "_reason")
    return settled.unionByName(checked.where("_reason IS NOT NULL").withColumnRenamed("_reason", "reason"))


def accounting(df: DataFrame) -> DataFrame:
    """Rows per reason (`prepared` for null); the counts add up to the rows read."""
    return df.groupBy(F.coalesce("reason", F.lit("prepared")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def contexts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where("reason IS NULL").groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).orderBy(*columns)


def exact_state(rows: DataFrame, support: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """rows looked up by exact key, with the first failing rule as `reason`; an unknown key fails first."""
    known = support.withColumn("_known", F.lit(True))
    return rows.join(known, key, "left").withColumn("reason", first_reason([("unknown_source_key", F.col("_known").isNull()), *rules])).drop("_known")


def source_rows(df: DataFrame, order: list[str], name: str = "source_row") -> DataFrame:
    """Ordinals by explicit order within `file`, since file order is no guarantee."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy("file").orderBy(*order)) - 1)
