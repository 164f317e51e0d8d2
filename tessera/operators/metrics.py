"""Error metrics, conformal calibration, coverage and selection, all as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def component_metrics(df: DataFrame, truth: Column, prediction: Column, by: list[str]) -> DataFrame:
    """rows, mae, rmse and r2 per group; r2 is null for fewer than two rows or a constant truth (least = greatest)."""
    error = prediction - truth
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("sse"),
        (F.var_pop(truth) * F.count(F.lit(1))).alias("sst"),
        (F.min(truth) < F.max(truth)).alias("varies"),
    )
    r2 = F.when((F.col("rows") >= 2) & F.col("varies"), 1 - F.try_divide("sse", "sst"))
    return sums.select(*by, "rows", "mae", "rmse", r2.alias("r2"))


def subset_metrics(df: DataFrame, truth: Column, prediction: Column, flags: list[str]) -> DataFrame:
    """component_metrics of the rows with and without each flag, in one pass: subset is `flag` or `non_flag`."""
    tagged = df.withColumn("subset", F.explode(F.array(*[F.when(F.col(f), f).otherwise(f"non_{f}") for f in flags])))
    return component_metrics(tagged, truth, prediction, ["subset"])


#: Distinct values that one task may rank.
RANKED = 100_000


def kth_smallest(df: DataFrame, value: str, k: Column | int) -> DataFrame:
    """One row with `value` of rank k (from 1), null if there are fewer rows.

    A sketch brackets the rank, again and again, until few distinct values are left inside: only those are ranked, so no
    task sorts the column however long it is.
    """
    df = df.select(value).where(F.col(value).isNotNull())
    n = df.count()
    rank = k if isinstance(k, int) else df.sparkSession.range(1).select(k.alias("k")).first()[0]
    if not 1 <= rank <= n:
        return df.sparkSession.range(1).select(F.lit(None).cast(df.schema[value].dataType).alias(value))
    near, below, width, v = df, 0, 1e-4, F.col(value)
    while near.distinct().limit(RANKED + 1).count() > RANKED:
        share = (rank - below) / n
        low, high = near.approxQuantile(value, [max(0.0, share - 2 * width), min(1.0, share + 2 * width)], width)
        # The rank is found among four parts; ties with the bracket's ends are answers, so each round has fewer rows.
        parts = [v < low, v == low, (v > low) & (v < high), (v == high) & F.lit(high > low), v > high]
        counts = near.agg(*[F.count(F.when(p, 1)) for p in parts]).first()
        at = 0
        while rank > below + counts[at]:
            below += counts[at]
            at += 1
        near, n = near.where(parts[at]), counts[at]
        if at in (1, 3):
            break
    counts = near.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(value)) + below
    return counts.withColumn("upto", upto).where(F.col("upto") >= rank).agg(F.min(value).alias(value))


def order_statistics(df: DataFrame, wanted: dict[str, list[int]]) -> dict[str, list[object]]:
    """Per column the values of its ranks (from 1; null where there are fewer values), of all columns and ranks together.

    Every round narrows all brackets by two aggregates over the table, whatever their number: sketches of what lies in each bracket, then
    counts below, at and between the sketched values. Brackets of at most RANKED rows are ranked together at the end.
    """
    columns = list(wanted)
    total = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first() if columns else []
    n_of = dict(zip(columns, total, strict=True))
    out: dict[tuple[str, int], object] = {(c, k): None for c in columns for k in wanted[c]}
    # low and high are exclusive; below counts the values up to low.
    open_ = {(c, k): (None, None, 0, n_of[c]) for c, k in out if 1 <= k <= n_of[c]}
    small: dict[tuple[str, int], tuple] = {}

    def inside(c: str, low: object, high: object) -> Column:
        test = F.col(c).isNotNull()
        test = test if low is None else test & (F.col(c) > F.lit(low))
        return test if high is None else test & (F.col(c) < F.lit(high))

    while open_:
        small |= {key: b for key, b in open_.items() if b[3] <= RANKED}
        open_ = {key: b for key, b in open_.items() if b[3] > RANKED}
        if not open_:
            break
        width = 1e-4
        sketches = []
        for (c, k), (low, high, below, n) in open_.items():
            share = (k - below) / n
            ends = F.array(F.lit(max(0.0, share - 2 * width)), F.lit(min(1.0, share + 2 * width)))
            sketches.append(F.percentile_approx(F.when(inside(c, low, high), F.col(c)), ends, F.lit(int(1 / width))))
        ends_of = dict(zip(open_, df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sketches)]).first(), strict=True))
        counts = []
        for (c, k), (low, high, _, _) in open_.items():
            a, b = ends_of[c, k]
            v, here = F.col(c), inside(c, low, high)
            counts += [F.count(F.when(here & p, 1)) for p in (v < a, v == a, (v > a) & (v < b), (v == b) & F.lit(b > a))]
        row = list(df.agg(*[x.alias(f"c{i}") for i, x in enumerate(counts)]).first())
        after = {}
        for i, ((c, k), (low, high, below, n)) in enumerate(open_.items()):
            a, b = ends_of[c, k]
            less, same, between, last = row[4 * i : 4 * i + 4]
            edges = [(less, low, a), (same, a, None), (between, a, b), (last, b, None), (n - less - same - between - last, b, high)]
            for part, (m, first, end) in enumerate(edges):
                if k <= below + m:
                    break
                below += m
            if part in (1, 3):
                out[c, k] = first
            else:
                after[c, k] = (first, end, below, m)
        open_ = after
    if small:
        keys = list(small)
        entries = [F.when(inside(c, small[c, k][0], small[c, k][1]), F.struct(F.lit(i).alias("at"), F.col(c).cast("double").alias("v"))) for i, (c, k) in enumerate(keys)]
        rows = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.at", "e.v").agg(F.count(F.lit(1)).alias("n"))
        rank = F.element_at(F.array(*[F.lit(k - small[c, k][2]) for c, k in keys]), F.col("at") + 1)
        upto = F.sum("n").over(Window.partitionBy("at").orderBy("v"))
        for r in rows.withColumn("upto", upto).where(F.col("upto") >= rank).groupBy("at").agg(F.min("v").alias("v")).collect():
            out[keys[r["at"]]] = r["v"]
    return {c: [out[c, k] for k in wanted[c]] for c in columns}


def conformal_radius(df: DataFrame, group: str, errors: dict[str, Column], alpha: float) -> DataFrame:
    """One row per component: groups, rank = ceil((groups + 1)(1 - alpha)) and the radius of that rank.

    A group's score is its largest error. The radius is null where the rank exceeds the number of groups.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie strictly between 0 and 1")
    scores = df.groupBy(group).agg(*[F.max(F.abs(e)).alias(name) for name, e in errors.items()])
    groups = scores.count()
    rank = math.ceil(round((groups + 1) * (1 - alpha), 9))
    parts = [kth_smallest(scores, name, rank).select(F.lit(name).alias("component"), F.lit(groups).cast("long").alias("groups"), F.lit(rank).cast("long").alias("rank"), F.col(name).cast("double").alias("radius")) for name in errors]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coverage(df: DataFrame, group: str, error: Column, radius: Column) -> DataFrame:
    """row_coverage, group_coverage (groups with all rows covered) and interval_width."""
    covered = (F.abs(error) <= radius).cast("int")
    each = df.groupBy(group).agg(F.sum(covered).alias("hits"), F.count(F.lit(1)).alias("rows"), F.min(covered).alias("all"), F.max(2 * radius).alias("width"))
    return each.agg((F.sum("hits") / F.sum("rows")).alias("row_coverage"), F.avg("all").alias("group_coverage"), F.max("width").alias("interval_width"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("groups"))


def family_macro_mae(df: DataFrame, family: list[str], error: Column, by: list[str]) -> DataFrame:
    """Mean over families of the mean absolute error within each."""
    within = df.groupBy(*by, *family).agg(F.avg(F.abs(error)).alias("within"))
    return within.groupBy(*by).agg(F.avg("within").alias("macro_mae"), F.count(F.lit(1)).alias("families"))


def balanced_mse(df: DataFrame, family: str, error: Column) -> DataFrame:
    """Sum of squared errors under the weights 1 / (families * rows of the family): families count alike."""
    within = df.groupBy(family).agg(F.avg(error * error).alias("within"))
    return within.agg(F.avg("within").alias("balanced_mse"), F.count(F.lit(1)).alias("families"))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def binary_scores(df: DataFrame, logit: Column, label: Column, weight: Column) -> DataFrame:
    """Weighted Brier score, log loss and balanced accuracy (p >= 0.5 votes for 1; null with one class), with supports."""
    p = 1 / (1 + F.exp(-logit))
    hit = ((p >= 0.5).cast("int") == label).cast("double")
    sums = df.select(weight.alias("w"), p.alias("p"), label.alias("y"), hit.alias("hit"), (softplus(logit) - label * logit).alias("loss"))
    one, zero = F.col("y") == 1, F.col("y") == 0
    recall = lambda c: F.try_divide(F.sum(F.when(c, F.col("w") * F.col("hit"))), F.sum(F.when(c, F.col("w"))))
    return sums.agg(
        (F.sum(F.col("w") * (F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))) / F.sum("w")).alias("brier"),
        (F.sum(F.col("w") * F.col("loss")) / F.sum("w")).alias("log_loss"),
        ((recall(one) + recall(zero)) / 2).alias("balanced_accuracy"),
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(one, 1).otherwise(0)).alias("positives"),
    )


def best_candidate(df: DataFrame, score: str, position: str, slack: float = 1e-12, by: list[str] | None = None) -> DataFrame:
    """The first candidate, by position, whose score is within slack of the least one (per group)."""
    by = by or []
    least = df.groupBy(*by).agg(F.min(score).alias("_least")) if by else df.agg(F.min(score).alias("_least"))
    near = (df.join(least, by) if by else df.join(F.broadcast(least))).where(F.col(score) <= F.col("_least") + slack)
    fields = [c for c in df.columns if c not in by]
    first = near.groupBy(*by).agg(F.min_by(F.struct(*fields), position).alias("_first"))
    return first.select(*by, "_first.*")


def status_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def vector_covariance(df: DataFrame, columns: list[str], volume: str, factor: float) -> DataFrame:
    """Population covariance of a vector, its trace and response = 1 + factor * trace / mean volume."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    out = df.agg(*[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs], *[F.avg(c).alias(f"mean_{c}") for c in columns], F.avg(volume).alias("mean_volume"))
    trace = sum((F.col(f"c_{c}_{c}") for c in columns[1:]), F.col(f"c_{columns[0]}_{columns[0]}"))
    return out.withColumn("trace", trace).withColumn("response", 1 + F.lit(factor) * F.col("trace") / F.col("mean_volume"))


def conformer_summary(df: DataFrame, key: list[str], values: list[str], needed: int = 3) -> DataFrame:
    """Mean and population deviation of each value over exactly `needed` records per key; other keys are left out."""
    each = df.groupBy(*key).agg(F.count(F.lit(1)).alias("records"), *[f(v).alias(f"{v}_{n}") for v in values for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))])
    return each.where(F.col("records") == needed)


def expected_population(bins: Column) -> Column:
    """Sum of p * value over an array of structs (value, p)."""
    return F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + b["p"] * b["value"])
