"""Rows are refused with named reasons, never repaired: ladders, accumulating reasons and assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, else null. A null condition does not hold."""
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in rules])


def all_reasons(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]))


def out_of_range(values: list[Column], low: list[float], high: list[float], slack: float) -> Column:
    """Whether any value is below its low - slack, above its high + slack, or not finite."""
    out = F.lit(False)
    for v, a, b in zip(values, low, high, strict=True):
        out = out | ~F.coalesce(finite(v), F.lit(False)) | (v < a - slack) | (v > b + slack)
    return out


def offending(values: list[Column], low: list[float], high: list[float]) -> Column:
    """Indices of values strictly outside [low, high] or not finite."""
    tests = [F.when(~F.coalesce(finite(v), F.lit(False)) | (v < a) | (v > b), F.lit(i)) for i, (v, a, b) in enumerate(zip(values, low, high, strict=True))]
    return F.array_compact(F.array(*tests))


def prediction_status(supported: Column, ood: Column, extrapolation: Column, values: list[Column], label_kind: Column) -> Column:
    """unsupported, out_of_domain, invalid_model_output, then synthetic_demo or research_only."""
    invalid = F.lit(False)
    for v in values:
        invalid = invalid | ~F.coalesce(finite(v), F.lit(False)) | (v < 0)
    return (
        F.when(~supported, "unsupported")
        .when(ood | extrapolation, "out_of_domain")
        .when(invalid, "invalid_model_output")
        .when(label_kind == "synthetic", "synthetic_demo")
        .otherwise("research_only")
    )


def prediction_reasons(scope: Column, ood: Column, extrapolation: Column, stale: Column) -> Column:
    """Scope's reasons, else those of the domain, else that no interval fits the policy."""
    domain = all_reasons([("low_training_similarity", ood), ("feature_extrapolation", extrapolation)])
    return F.when(F.size(scope) > 0, scope).when(F.size(domain) > 0, domain).otherwise(all_reasons([("calibration_policy_stale", stale)]))


def interval(value: Column, radius: Column) -> tuple[Column, Column]:
    return value - radius, value + radius


def first_valid_wins(df: DataFrame, key: list[str], order: list[str], valid: Column) -> DataFrame:
    """df with `repeated`: a row after the first valid row of its key, whether itself valid or not.

    An invalid row before the first valid one reserves nothing.
    """
    spot = F.struct(*order)
    heads = df.where(valid).groupBy(*key).agg(F.min(spot).alias("_head"))
    out = df.join(heads, key, "left")
    return out.withColumn("repeated", F.coalesce(spot > F.col("_head"), F.lit(False))).drop("_head")


def one_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by order; a partial aggregate, not a sort of whole keys."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*key, "_row.*").select(*df.columns)


def consolidated(df: DataFrame, key: list[str], order: list[str], targets: list[str], slack: float = 1e-8) -> DataFrame:
    """Repeated keys: rows within slack of their first row leave that row; any further one excludes all of them.

    Adds `verdict`: kept, duplicate or conflicting.
    """
    first = df.groupBy(*key).agg(F.min(F.struct(*order, *[F.col(t).alias(f"_t_{t}") for t in targets])).alias("_f"))
    each = df.join(first, key)
    far = F.lit(False)
    for t in targets:
        own, head = F.col(t), F.col(f"_f._t_{t}")
        far = far | (own.isNull() != head.isNull()) | F.coalesce(F.abs(own - head) > slack, F.lit(False))
    bad = each.withColumn("_far", far).groupBy(*key).agg(F.max("_far").alias("_conflict"))
    head = F.struct(*order) == F.struct(*[F.col(f"_f.{o}") for o in order])
    verdict = F.when(F.col("_conflict"), "conflicting").when(head, "kept").otherwise("duplicate")
    return each.join(bad, key).withColumn("verdict", verdict).drop("_f", "_conflict")


def conflicts(df: DataFrame, key: list[str], outcome: str) -> DataFrame:
    """Per key the number of distinct outcomes and whether there are several."""
    return df.groupBy(*key).agg(F.count_distinct(outcome).alias("outcomes"), F.count(F.lit(1)).alias("rows")).withColumn("conflict", F.col("outcomes") > 1)


def matching(df: DataFrame, query: dict[str, object], known: list[str]) -> DataFrame:
    """Three-state exact filter: a field left out matches all, None only unreported values, a value only its equals."""
    if unknown := set(query) - set(known):
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    out = df
    for name, value in query.items():
        out = out.where(F.col(name).isNull() if value is None else F.col(name) == F.lit(value))
    return out


def bijection(expected: DataFrame, found: DataFrame) -> DataFrame:
    """missing and unexpected counts of origins, repeats included; both have to be 0."""
    missing, unexpected = expected.exceptAll(found), found.exceptAll(expected)
    return missing.agg(F.count(F.lit(1)).alias("missing")).join(F.broadcast(unexpected.agg(F.count(F.lit(1)).alias("unexpected"))))


def asserted(df: DataFrame, name: str, violation: Column) -> DataFrame:
    """df, after checking that no row violates; the whole table is refused otherwise."""
    if bad := df.where(violation).limit(1).count():
        raise ValueError(f"{name}: {bad} or more rows are refused")
    return df


def unique(df: DataFrame, key: list[str]) -> DataFrame:
    """df, after checking that keys are unique."""
    if df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{', '.join(key)} has repeated values")
    return df


def row_number_of(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
