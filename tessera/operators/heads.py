"""Model heads: fitted from aggregates over training rows, small states, predictions as expressions.

Sums over rows (moments, Gram matrices, cross products) are one aggregate each; the driver solves systems whose size is
the number of features. Kernel heads are in `kernels`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest
from ..storage import dropped, stored
from .grouping import hash_folds
from .metrics import order_statistics
from .refuse import finite

MOST_FEATURES = 2000
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0)
TIE = 1e-12


# ---------------------------------------------------------------------------------------------------- linear heads


@dataclass
class Gram:
    """Weighted sums over rows, for features and targets together: n, sums and products."""

    weight: float
    total: np.ndarray
    product: np.ndarray

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.weight + other.weight, self.total + other.total, self.product + other.product)

    def __sub__(self, other: Gram) -> Gram:
        return Gram(self.weight - other.weight, self.total - other.total, self.product - other.product)


def grams(df: DataFrame, columns: list[str], by: str | None = None, weight: str | None = None) -> dict[object, Gram]:
    """A Gram per value of `by` (or one under None). Batches are reduced where they are read; only sums are shuffled."""
    if len(columns) > MOST_FEATURES:
        raise ValueError(f"at most {MOST_FEATURES} columns")
    k = len(columns)
    key = F.col(by).cast("string") if by else F.lit("")
    rows = df.select(key.alias("key"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), object)
            w = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(k)])
            if not (np.isfinite(x).all() and np.isfinite(w).all()):
                raise ValueError("nonfinite or missing values in a fit")
            for name in set(keys.tolist()):
                own = keys == name
                wx = x[own] * w[own][:, None]
                part = np.concatenate([[w[own].sum()], wx.sum(0), (wx.T @ x[own]).ravel()])
                held[name] = held.get(name, 0) + part
        for name, part in held.items():
            yield pa.RecordBatch.from_pydict({"key": [name], "part": pa.array([part.tolist()], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "key string, part array<double>").select("key", F.posexplode("part").alias("at", "v")).groupBy("key", "at").agg(F.sum("v").alias("v"))
    out: dict[object, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["key"], np.zeros(1 + k + k * k))[r["at"]] = r["v"]
    return {name if by else None: Gram(v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)) for name, v in out.items()}


def exact_gram(df: DataFrame, columns: list[str], weight: str) -> Gram:
    """The same sums by decimals of 18 places, which add up to the same digits in any order: reruns of a fit agree to the last bit.

    For few columns whose weighted products lie well within 1e-9 and 1e20.
    """
    k, x = len(columns), [F.col(c).cast("double") for c in columns]
    w = F.col(weight).cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    bad = F.lit(False)
    for c in [w, *x]:
        bad = bad | ~F.coalesce(finite(c), F.lit(False))
    exact = lambda v: F.sum(F.when(~bad, v).cast("decimal(38,18)"))
    row = df.agg(F.count(F.when(bad, 1)), exact(w), *[exact(w * c) for c in x], *[exact(w * x[i] * x[j]) for i, j in pairs]).first()
    if row[0] or row[1] is None:
        raise ValueError("nonfinite or missing values in a fit, or no rows")
    sums = np.array([float(v) for v in row[1:]])
    product = np.zeros((k, k))
    for (i, j), v in zip(pairs, sums[1 + k :], strict=True):
        product[i, j] = product[j, i] = v
    return Gram(float(sums[0]), sums[1 : 1 + k], product)


@dataclass
class LinearHead:
    """predict = sum((x - mean) / scale * coef) + intercept, a row of coef per target."""

    features: list[str]
    targets: list[str]
    mean: list[float]
    scale: list[float]
    coef: list[list[float]]
    intercept: list[float]

    @classmethod
    def solve(cls, g: Gram, features: list[str], targets: list[str], alpha: float) -> LinearHead:
        """Ridge on features standardised by population deviation (1 where constant); the intercept is free."""
        p = len(features)
        mean = g.total / g.weight
        centred = g.product - np.outer(g.total, g.total) / g.weight
        variance = np.diag(centred)[:p] / g.weight
        floor = 1e-14 * np.maximum(np.diag(g.product)[:p] / g.weight, 1e-300)
        scale = np.where(variance > floor, np.sqrt(np.maximum(variance, 0)), 1.0)
        xx = centred[:p, :p] / np.outer(scale, scale)
        xy = centred[:p, p:] / scale[:, None]
        coef = np.linalg.solve(xx + alpha * np.eye(p), xy).T
        return cls(features, targets, mean[:p].tolist(), scale.tolist(), coef.tolist(), mean[p:].tolist())

    def predict(self, columns: list[Column] | None = None) -> dict[str, Column]:
        """A column per target."""
        x = columns or [F.col(c) for c in self.features]
        out = {}
        for t, row, b in zip(self.targets, self.coef, self.intercept, strict=True):
            total = F.lit(b)
            for c, m, s, w in zip(x, self.mean, self.scale, row, strict=True):
                total = total + (c - F.lit(m)) / F.lit(s) * F.lit(w)
            out[t] = total
        return out

    def state(self) -> dict:
        body = asdict(self)
        return body | {"digest": canonical_digest(body)}

    @classmethod
    def restore(cls, state: dict) -> LinearHead:
        body = {k: v for k, v in state.items() if k != "digest"}
        if canonical_digest(body) != state.get("digest"):
            raise ValueError("the state does not match its digest")
        return cls(**body)


def fit_ridge(df: DataFrame, features: list[str], targets: list[str], alpha: float, weight: str | None = None) -> LinearHead:
    found = grams(df, [*features, *targets], weight=weight)
    if not found:
        raise ValueError("no training rows")
    return LinearHead.solve(found[None], features, targets, alpha)


@dataclass
class Selection:
    head: LinearHead
    candidates: list[float | None]
    scores: dict[str, list[float]]
    selected: dict[str, float | None]


def select_ridge(df: DataFrame, features: list[str], targets: list[str], family: str, alphas: tuple[float, ...] = ALPHAS, folds: int = 5, seed: int = 42) -> Selection:
    """Per target the constant or the penalty with the least family-macro error out of fold; ties within TIE go to the
    constant, then to the larger penalty. A fold's head is solved from the sums of the other folds; then all rows are fitted.
    """
    penalties = sorted({float(a) for a in alphas}, reverse=True)
    if not penalties or any(not np.isfinite(a) or a <= 0 for a in penalties):
        raise ValueError("finite positive penalties are needed")
    # Written once: sums and errors read it, and folds are ranks over all families.
    dealt = stored(df.select(*dict.fromkeys([family, *features, *targets])).join(hash_folds(df, family, folds, seed, "selection"), family), "selection-folds")
    parts = grams(dealt, [*features, *targets], by="fold")
    if dealt.select(family).distinct().limit(3).count() < 3:
        raise ValueError("selection needs at least three families")
    whole = sum(list(parts.values())[1:], next(iter(parts.values())))
    candidates: list[float | None] = [None, *penalties]
    predictions = []
    for i, alpha in enumerate(candidates):
        for t, target in enumerate(targets):
            total = F.lit(None).cast("double")
            for fold, g in parts.items():
                rest = whole - g
                p = F.lit(float(rest.total[len(features) + t] / rest.weight)) if alpha is None else LinearHead.solve(rest, features, targets, alpha).predict()[target]
                total = F.when(F.col("fold").cast("string") == fold, p).otherwise(total)
            predictions.append((i, target, F.abs(total - F.col(target)).alias(f"e{i}_{t}")))
    errors = dealt.select(family, *[e for _, _, e in predictions])
    names = errors.columns[1:]
    within = errors.groupBy(family).agg(*[F.avg(n).alias(n) for n in names])
    macro = within.agg(*[F.avg(n).alias(n) for n in names]).first()
    dropped(dealt)
    scores = {target: [macro[f"e{i}_{t}"] for i in range(len(candidates))] for t, target in enumerate(targets)}
    chosen = {target: next(i for i, s in enumerate(v) if s <= min(v) + TIE) for target, v in scores.items()}
    heads = {i: LinearHead.solve(whole, features, targets, candidates[i] or 1.0) for i in set(chosen.values())}
    base = next(iter(heads.values()))
    coef = [[0.0] * len(features) if candidates[chosen[t]] is None else heads[chosen[t]].coef[k] for k, t in enumerate(targets)]
    return Selection(LinearHead(features, targets, base.mean, base.scale, coef, base.intercept), candidates, scores, {t: candidates[chosen[t]] for t in targets})


def out_of_fold(df: DataFrame, features: list[str], targets: list[str], alpha: float, fold: str) -> DataFrame:
    """df with `oof_<target>`: every row predicted once, by the head of the other folds."""
    parts = grams(df, [*features, *targets], by=fold)
    whole = sum(list(parts.values())[1:], next(iter(parts.values())))
    out = {t: F.lit(None).cast("double") for t in targets}
    for name, g in parts.items():
        p = LinearHead.solve(whole - g, features, targets, alpha).predict()
        out = {t: F.when(F.col(fold).cast("string") == name, p[t]).otherwise(c) for t, c in out.items()}
    return df.withColumns({f"oof_{t}": c for t, c in out.items()})


@dataclass
class ResidualHead:
    """A chemistry head plus a head of its out-of-fold residuals on other features."""

    first: LinearHead
    second: LinearHead

    def predict(self) -> dict[str, Column]:
        more = self.second.predict()
        return {t: c + more[f"residual_{t}"] for t, c in self.first.predict().items()}


def fit_residual(df: DataFrame, features: list[str], more: list[str], targets: list[str], family: str, alpha: float = 1.0, residual_alpha: float = 10.0, folds: int = 4, seed: int = 42) -> ResidualHead:
    dealt = df.join(hash_folds(df, family, folds, seed, "residual"), family)
    held = out_of_fold(dealt, features, targets, alpha, "fold")
    held = held.withColumns({f"residual_{t}": F.col(t) - F.col(f"oof_{t}") for t in targets})
    return ResidualHead(fit_ridge(df, features, targets, alpha), fit_ridge(held, more, [f"residual_{t}" for t in targets], residual_alpha))


# ---------------------------------------------------------------------------------------------- scaling, missing values


def standardised(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """df with `z_<column>` by mean and population deviation of the training rows (deviation 0 counts as 1)."""
    rows = df if train is None else df.where(train)
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(z).drop(*stats.columns)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Per column the mean of its two middle values (null without any), by ranks of all columns together."""
    total = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)]).first() if columns else []
    middle = order_statistics(df, {c: [(n + 1) // 2, n // 2 + 1] for c, n in zip(columns, total, strict=True)})
    return {c: None if low is None else (float(low) + float(high)) / 2 for c, (low, high) in middle.items()}


def median_imputed(df: DataFrame, columns: list[str], train: Column | None = None) -> DataFrame:
    """Columns with the training median in place of nulls, and `missing_<column>`; columns without any training value go."""
    found = medians(df if train is None else df.where(train), columns)
    kept = [c for c in columns if found[c] is not None]
    out = df.withColumns({f"missing_{c}": F.col(c).isNull().cast("int") for c in kept})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(found[c])) for c in kept}).drop(*[c for c in columns if c not in kept])


# ------------------------------------------------------------------------------------------------------- gradient heads


def lbfgs(value_and_gradient, start: np.ndarray, gate: float = 1e-5, rounds: int = 500, memory: int = 20, required: bool = True) -> np.ndarray:
    """Limited-memory BFGS with backtracking; refused unless the gradient's largest entry passes the gate (if that is required)."""
    x = start.astype(float)
    value, g = value_and_gradient(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max(initial=0) <= gate * 1e-3:
            break
        d, a = -g.copy(), []
        for s, y in reversed(steps):
            k = s @ d / (y @ s)
            a.append(k)
            d -= k * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), k in zip(steps, reversed(a), strict=True):
            d += (k - y @ d / (y @ s)) * s
        if d @ g >= 0:
            d, steps = -g.copy(), []
        t = 1.0
        while t > 1e-20:
            after, h = value_and_gradient(x + t * d)
            if np.isfinite(after) and after <= value + 1e-4 * t * (d @ g):
                break
            t /= 2
        else:
            break
        s, y = t * d, h - g
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            steps = [*steps[-memory + 1 :], (s, y)]
        x, value, g = x + s, after, h
    if required and np.abs(g).max(initial=0) > gate:
        raise ValueError("the fit did not reach its gradient gate")
    return x


@dataclass
class LogisticHead:
    """Weighted logistic regression: standardised features and one-hot categories, penalty on all but the intercept."""

    features: list[str]
    category: str | None
    categories: list[str]
    mean: list[float]
    scale: list[float]
    coef: list[float]
    intercept: float
    low: list[float]
    high: list[float]

    def design(self) -> list[Column]:
        z = [(F.col(c) - m) / s if s else F.lit(0.0) for c, m, s in zip(self.features, self.mean, self.scale, strict=True)]
        return z + [(F.col(self.category) == v).cast("double") for v in self.categories]

    def logit(self) -> Column:
        total = F.lit(self.intercept)
        for c, w in zip(self.design(), self.coef, strict=True):
            total = total + c * F.lit(w)
        return total

    def reasons(self) -> Column:
        """First of: nonfinite_query_features, unsupported_category, nonfinite_logit; null where a prediction is valid."""
        from .refuse import first_reason

        bad = F.lit(False)
        for c in self.features:
            bad = bad | ~F.coalesce(finite(F.col(c).cast("double")), F.lit(False))
        rules = [("nonfinite_query_features", bad)]
        if self.category:
            rules.append(("unsupported_category", ~F.coalesce(F.col(self.category).isin(self.categories), F.lit(False))))
        return first_reason([*rules, ("nonfinite_logit", ~finite(self.logit()))])


def fit_logistic(df: DataFrame, features: list[str], label: str, weight: str, alpha: float, category: str | None = None) -> LogisticHead:
    """Minimises sum(w * logloss) / sum(w) + alpha / 2 |coef|^2; every step is one aggregate of gradients over batches."""
    stats = df.agg(F.count_distinct(label).alias("classes"), F.sum(weight).alias("w"), *[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]).first()
    if stats["classes"] != 2:
        raise ValueError("both classes are needed")
    known = df.select(category).where(F.col(category).isNotNull()).distinct().limit(MOST_FEATURES + 1).collect() if category else []
    if len(known) + len(features) > MOST_FEATURES:
        raise ValueError(f"at most {MOST_FEATURES} features and categories")
    if category and df.where(F.col(category).isNull()).limit(1).count():
        raise ValueError("missing categories in a fit")
    categories = sorted(r[0] for r in known)
    scale = [stats[f"s_{c}"] if stats[f"s_{c}"] > 1e-12 else 0.0 for c in features]
    head = LogisticHead(features, category, categories, [stats[f"m_{c}"] for c in features], scale, [0.0] * (len(features) + len(categories)), 0.0, [stats[f"lo_{c}"] for c in features], [stats[f"hi_{c}"] for c in features])
    p = len(head.coef)
    rows = df.select(F.col(label).cast("double").alias("y"), (F.col(weight) / F.lit(float(stats["w"]))).alias("w"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(head.design())]).persist()

    def value_and_gradient(theta: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(p + 2)
            for batch in batches:
                y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                x = np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(p)]) if p else np.zeros((len(y), 0))
                eta = x @ theta[:p] + theta[p]
                r = w * (1 / (1 + np.exp(-np.clip(eta, -700, 700))) - y)
                out += np.concatenate([[(w * (np.logaddexp(0, eta) - y * eta)).sum()], x.T @ r, [r.sum()]])
            yield pa.RecordBatch.from_pydict({"part": pa.array([out.tolist()], pa.list_(pa.float64()))})

        sums = rows.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(p + 2)
        for r in sums:
            out[r["at"]] = r["v"]
        return float(out[0] + alpha / 2 * (theta[:p] @ theta[:p])), out[1:] + np.append(alpha * theta[:p], 0.0)

    try:
        theta = lbfgs(value_and_gradient, np.zeros(p + 1), rounds=60)
    finally:
        rows.unpersist()
    head.coef, head.intercept = theta[:p].tolist(), float(theta[p])
    return head


# --------------------------------------------------------------------------------------------------------------- trees


def tree_values(x: np.ndarray, left: np.ndarray, right: np.ndarray, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Leaves' values of one tree from arrays (left = -1 marks a leaf); features are compared as float32.

    A child that does not follow its parent would allow cycles and is refused.
    """
    inner = left >= 0
    node = np.arange(len(left))
    if (inner & ((left <= node) | (right <= node) | (left >= len(left)) | (right >= len(left)))).any():
        raise ValueError("the tree's links are not ordered")
    x = x.astype(np.float32)
    at = np.zeros(len(x), np.int64)
    while (go := inner[at]).any():
        i = np.flatnonzero(go)
        here = at[i]
        at[i] = np.where(x[i, feature[here]] <= threshold[here], left[here], right[here])
    return value[at]
