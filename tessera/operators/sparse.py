"""Weighted logistic regression over features and a category of any number of values.

Coefficients of categories are a table. A Newton step needs only sums by category and sums over them: the Hessian of the categories is a
diagonal, so it is eliminated (Schur's complement) and the driver solves a system of the size of the features. Categories that many rows
share are looked up where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored
from .components import looked_up
from .heads import MOST_FEATURES, Gram, grams
from .metrics import softplus
from .refuse import finite, first_reason

ROUNDS, GATE = 60, 1e-5


@dataclass
class CategoryHead:
    """logit = intercept + coefficients of standardised features + the coefficient of the row's category, from the table `table` (category, coef)."""

    features: list[str]
    category: str
    mean: list[float]
    scale: list[float]
    coef: list[float]
    intercept: float
    rounds: int = 0
    gradient: float = 0.0
    table: DataFrame | None = field(default=None, repr=False)

    def _z(self) -> list[Column]:
        return [(F.col(c).cast("double") - m) / s if s else F.lit(0.0) for c, m, s in zip(self.features, self.mean, self.scale, strict=True)]

    def predict(self, df: DataFrame) -> DataFrame:
        """df with logit and reason: nonfinite_query_features or unsupported_category (a category that was not learned, or none), else null."""
        key = F.col(self.category).cast("string")
        out = looked_up(df.withColumn("_category", key), self.table.select(F.col("category").alias("_category"), F.col("coef").alias("_coef")), "_category", "left")
        total = F.lit(self.intercept) + F.col("_coef")
        bad = F.lit(False)
        for c, z, w in zip(self.features, self._z(), self.coef, strict=True):
            total = total + z * F.lit(w)
            bad = bad | ~F.coalesce(finite(F.col(c).cast("double")), F.lit(False))
        out = out.withColumn("reason", first_reason([("nonfinite_query_features", bad), ("unsupported_category", F.col("_coef").isNull()), ("nonfinite_logit", ~finite(total))]))
        return out.withColumn("logit", F.when(F.col("reason").isNull(), total)).drop("_category", "_coef")


def fit_categories(df: DataFrame, features: list[str], label: str, weight: str, alpha: float, category: str) -> CategoryHead:
    """Minimises sum(w * logloss) / sum(w) + alpha / 2 |coef|^2 (all but the intercept), by Newton steps.

    A round is one aggregate of the rows by category and a few over the categories. Refused: missing categories, values that
    are not finite, labels of one class, and fits that do not reach the gate. Penalties have to be positive.
    """
    if not alpha > 0 or len(features) > MOST_FEATURES:
        raise ValueError(f"a positive penalty and at most {MOST_FEATURES} features are needed")
    p = len(features)
    x = [F.col(c).cast("double") for c in features]
    y, w = F.col(label).cast("double"), F.col(weight).cast("double")
    bad = ~finite(y) | ~finite(w) | (w <= 0)
    for c in x:
        bad = bad | ~finite(c)
    stats = df.agg(
        F.count_distinct(label).alias("classes"), F.sum(w).alias("w"), F.count(F.when(F.coalesce(bad, F.lit(True)), 1)).alias("bad"), F.count(F.when(F.col(category).isNull(), 1)).alias("missing"),
        *[f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    if stats["bad"]:
        raise ValueError("nonfinite or missing values in a fit")
    if stats["missing"]:
        raise ValueError("missing categories in a fit")
    if stats["classes"] != 2:
        raise ValueError("both classes are needed")
    head = CategoryHead(features, category, [stats[f"m{i}"] for i in range(p)], [stats[f"s{i}"] if stats[f"s{i}"] > 1e-12 else 0.0 for i in range(p)], [0.0] * p, 0.0)
    names = ["z0", *[f"z{i + 1}" for i in range(p)]]
    rows = stored(df.select(F.col(category).cast("string").alias("category"), y.alias("y"), (w / F.lit(float(stats["w"]))).alias("w"), F.lit(1.0).alias("z0"), *[z.alias(n) for z, n in zip(head._z(), names[1:], strict=True)]), "logistic-rows")
    table = stored(rows.select("category").distinct().withColumn("coef", F.lit(0.0)), "logistic-categories")
    theta, way, share, before = np.zeros(p + 1), None, 1.0, np.inf
    ridge = alpha * np.append([0.0], np.ones(p))
    known, held = table.count(), None
    for head.rounds in range(1, ROUNDS + 1):
        at = looked_up(rows, table, "category", known=known)
        eta = F.col("coef")
        for n, v in zip(names, theta.tolist(), strict=True):
            eta = eta + F.col(n) * F.lit(v)
        chance = 1 / (1 + F.exp(-eta))
        at = at.withColumns({"loss": F.col("w") * (softplus(eta) - F.col("y") * eta), "r": F.col("w") * (chance - F.col("y")), "h": F.col("w") * chance * (1 - chance)})
        here = at.groupBy("category").agg(F.max("coef").alias("coef"), F.sum("loss").alias("loss"), F.sum("h").alias("h"), *[F.sum(F.col("r") * F.col(n)).alias(f"r_{n}") for n in names], *[F.sum(F.col("h") * F.col(n)).alias(f"h_{n}") for n in names])
        here = stored(here.withColumns({"g": F.col("r_z0") + alpha * F.col("coef"), "d": F.col("h") + alpha}), "logistic-sums")
        told = here.agg(F.sum("loss"), F.sum(F.col("coef") * F.col("coef")), F.max(F.abs("g")), *[F.sum(f"r_{n}") for n in names]).first()
        value = told[0] + alpha / 2 * (told[1] + float(theta[1:] @ theta[1:]))
        slope = np.array(told[3:], float) + ridge * theta
        head.gradient = max(float(np.abs(slope).max()), told[2])
        if head.gradient <= GATE * 1e-3 or not np.isfinite(value):
            break
        if way is not None and value > before + 1e-12 * abs(before) and share > 1e-6:
            # Half the last step: from the place before, whose sums are still there.
            share /= 2
            dropped(here)
            dropped(table)
            theta = held[0] + share * way[0]
            table = stored(held[1].select("category", (F.col("coef") + share * F.col("step")).alias("coef")), "logistic-categories")
            continue
        whole = grams(at, names, weight="h")[None]
        # Sums over categories of h h' / d and h g / d: what elimination takes from the features' system.
        cut: Gram = grams(here.withColumn("over", 1 / F.col("d")), [*[f"h_{n}" for n in names], "g"], weight="over")[None]
        system = whole.product + np.diag(ridge) - cut.product[:-1, :-1]
        right = -slope + cut.product[:-1, -1]
        delta = np.linalg.lstsq(system, right, rcond=None)[0]
        step = -F.col("g") / F.col("d")
        for n, v in zip(names, delta.tolist(), strict=True):
            step = step - F.col(f"h_{n}") / F.col("d") * F.lit(v)
        if held:
            dropped(held[1])
        held = (theta, stored(here.select("category", "coef", step.alias("step")), "logistic-steps"))
        dropped(here)
        dropped(table)
        way, share, before = (delta,), 1.0, value
        theta = theta + delta
        table = stored(held[1].select("category", (F.col("coef") + F.col("step")).alias("coef")), "logistic-categories")
    dropped(rows)
    if not head.gradient <= GATE:
        raise ValueError("the fit did not reach its gradient gate")
    head.coef, head.intercept, head.table = theta[1:].tolist(), float(theta[0]), table
    return head
