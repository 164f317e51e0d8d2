"""Whole jobs over labelled tables: train, calibrate, evaluate, predict; hybrids, fusion, scalar and auxiliary heads."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest, energy_density
from ..storage import dropped, stored
from . import grouping, heads, kernels, metrics, refuse

#: Penalties of the chemistry, embedding and residual heads, and of auxiliary targets.
ALPHA = {"A": 1.0, "B": 5.0, "C": 10.0, "auxiliary": 100.0}
RANGE_SLACK, SIMILARITY = 1e-8, 0.35


@dataclass
class Model:
    """mode A (chemistry), B (embedding) or C (chemistry and residual on embedding), with bounds and calibration."""

    mode: str
    features: list[str]
    embedding: list[str]
    targets: list[str]
    head: dict
    residual: dict | None
    low: list[float]
    high: list[float]
    label_kind: str
    radius: dict[str, float | None] | None = None

    def predict(self) -> dict[str, Column]:
        first = heads.LinearHead.restore(self.head).predict()
        if self.residual is None:
            return first
        more = heads.LinearHead.restore(self.residual).predict()
        return {t: c + more[f"residual_{t}"] for t, c in first.items()}

    def state(self) -> dict:
        body = {k: v for k, v in self.__dict__.items()}
        return body | {"digest": canonical_digest(body)}

    @classmethod
    def restore(cls, state: dict) -> Model:
        body = {k: v for k, v in state.items() if k != "digest"}
        if canonical_digest(body) != state.get("digest"):
            raise ValueError("the model does not match its digest")
        return cls(**body)


def train(df: DataFrame, mode: str, features: list[str], embedding: list[str], targets: list[str], family: str, label_kind: str) -> Model:
    """A model of all rows of df, which have to be training rows."""
    residual = None
    if mode == "A":
        head = heads.fit_ridge(df, features, targets, ALPHA["A"])
    elif mode == "B":
        head = heads.fit_ridge(df, embedding, targets, ALPHA["B"])
    elif mode == "C":
        both = heads.fit_residual(df, features, embedding, targets, family, ALPHA["A"], ALPHA["C"])
        head, residual = both.first, both.second.state()
    else:
        raise ValueError("mode is A, B or C")
    b = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return Model(mode, features, embedding, targets, head.state(), residual, [b[f"lo_{c}"] for c in features], [b[f"hi_{c}"] for c in features], label_kind)


def isolated(train_rows: DataFrame, other: DataFrame, keys: list[str]) -> None:
    """Refuses sides that share any key (identity, family, alias)."""
    for key in keys:
        if grouping.overlap(train_rows, other, key).limit(1).count():
            raise ValueError(f"training and held rows share {key}")


def calibrate(model: Model, df: DataFrame, family: str, label_kind: str, alpha: float = 0.2) -> Model:
    """The model with a radius per target: the group-max order statistic of the calibration rows, or null."""
    if label_kind != model.label_kind:
        raise ValueError("calibration and training labels have to be of one kind")
    predicted = model.predict()
    rows = metrics.conformal_radius(df, family, {t: F.col(t) - predicted[t] for t in model.targets}, alpha).collect()
    model.radius = {r["component"]: r["radius"] for r in rows}
    return model


def domain(model: Model, similarity: str | None = None) -> tuple[Column, Column]:
    """ood (similarity below the threshold; false where no similarity is given) and extrapolation beyond the training range."""
    beyond = refuse.out_of_range([F.col(c) for c in model.features], model.low, model.high, RANGE_SLACK)
    return (F.coalesce(F.col(similarity) < SIMILARITY, F.lit(True)) if similarity else F.lit(False)), beyond


def evaluate(model: Model, df: DataFrame, family: str, label_kind: str, similarity: str | None = None) -> dict:
    """Metrics of all rows and of the subsets, and coverage where there is a radius; accuracy is never called validated."""
    if label_kind not in (model.label_kind, "experimental", "published_reference"):
        raise ValueError("labels of the training kind, or independent ones, are needed")
    predicted = model.predict()
    ood, beyond = domain(model, similarity)
    rows = df.withColumns({"ood": ood, "extrapolation": beyond} | {f"p_{t}": c for t, c in predicted.items()})
    out: dict = {"label_kind": label_kind, "real_accuracy_validated": False, "components": {}, "subsets": {}, "coverage": {}}
    for t in model.targets:
        one = metrics.component_metrics(rows.withColumn("_all", F.lit(1)), F.col(t), F.col(f"p_{t}"), ["_all"]).drop("_all").collect()
        out["components"][t] = one[0].asDict() if one else None
        out["subsets"][t] = {r["subset"]: r.asDict() for r in metrics.subset_metrics(rows, F.col(t), F.col(f"p_{t}"), ["ood", "extrapolation"]).collect()}
        if model.radius and model.radius[t] is not None:
            out["coverage"][t] = metrics.coverage(rows, family, F.col(t) - F.col(f"p_{t}"), F.lit(model.radius[t])).first().asDict()
    return out


def predictions(model: Model, df: DataFrame, scope: str = "scope", similarity: str | None = None) -> DataFrame:
    """One guarded row per input: status, reasons, values and intervals; refused rows have no values."""
    predicted = model.predict()
    ood, beyond = domain(model, similarity)
    supported = F.coalesce(F.size(scope) == 0, F.lit(False))
    values = [predicted[t] for t in model.targets]
    status = refuse.prediction_status(supported, ood, beyond, values, F.lit(model.label_kind))
    rows = df.withColumns({"status": status, "ood": ood, "extrapolation": beyond, "reasons": refuse.prediction_reasons(F.coalesce(F.col(scope), F.array(F.lit("invalid_input"))), ood, beyond, F.lit(model.radius is None))})
    ok = F.col("status").isin("synthetic_demo", "research_only")
    columns = {}
    for t in model.targets:
        r = (model.radius or {}).get(t)
        columns[f"{t}_value"] = F.when(ok, predicted[t])
        low, high = refuse.interval(predicted[t], F.lit(r).cast("double"))
        columns |= {f"{t}_lower": F.when(ok, low), f"{t}_upper": F.when(ok, high)}
    return rows.withColumns(columns | {"label_kind": F.lit(model.label_kind), "units": F.lit("MPa^0.5"), "real_accuracy_validated": F.lit(False)})


def train_and_report(df: DataFrame, features: list[str], embedding: list[str], targets: list[str], family: str, label_kind: str, modes: tuple[str, ...] = ("A", "B", "C"), seed: int = 42) -> dict:
    """One split for all modes: fit on train, calibrate on calibration, then evaluate on test, once."""
    split = stored(df.join(grouping.group_split(df, family, seed), family), "split")
    if grouping.leaks(split, family, "split").limit(1).count():
        raise ValueError("a family is in several splits")
    part = {s: split.where(F.col("split") == s) for s in ("train", "calibration", "test")}
    out: dict = {"split": {r["split"]: r.asDict() for r in grouping.split_report(split, "split", family).collect()}, "models": {}}
    for mode in modes:
        model = calibrate(train(part["train"], mode, features, embedding, targets, family, label_kind), part["calibration"], family, label_kind)
        out["models"][mode] = {"state": model.state(), "report": evaluate(model, part["test"], family, label_kind)}
    return out


def auxiliary_fit(df: DataFrame, row: str, features: list[str], targets: list[str], aliases: list[Column], reserved: list[DataFrame], family: str, seed: int = 42) -> dict:
    """Ridge on rows clear of all reserved aliases; a fifth of the families is held out for the metrics."""
    kept = stored(grouping.embargo(df, row, aliases, reserved), "embargo")
    split = kept.join(grouping.group_split(kept, family, seed, calibration=0.0), family)
    head = heads.fit_ridge(split.where("split = 'train'"), features, targets, ALPHA["auxiliary"])
    test = split.where("split = 'test'").withColumn("_all", F.lit(1))
    found = {t: metrics.component_metrics(test, F.col(t), p, ["_all"]).drop("_all").first().asDict() for t, p in head.predict().items()}
    return {"head": head.state(), "rows": kept.count(), "metrics": found, "independent_accuracy_validated": False}


# -------------------------------------------------------------------------------------------------------------- fusion


@dataclass
class Fusion:
    """Scaled chemistry beside at most eight scaled principal components of the scaled embedding."""

    features: list[str]
    embedding: list[str]
    mean: list[float]
    scale: list[float]
    components: list[list[float]]
    spread: list[float]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], embedding: list[str], most: int = 8) -> Fusion:
        names = [*features, *embedding]
        g = heads.grams(df, names)[None]
        if g.weight < 3:
            raise ValueError("at least three rows are needed")
        mean = g.total / g.weight
        cov = g.product / g.weight - np.outer(mean, mean)
        scale = np.where(np.diag(cov) > 1e-14 * np.maximum(np.diag(g.product) / g.weight, 1e-300), np.sqrt(np.maximum(np.diag(cov), 0)), 1.0)
        p = len(features)
        value, vector = np.linalg.eigh((cov / np.outer(scale, scale))[p:, p:])
        k = min(most, int(g.weight) - 1, len(embedding))
        order = np.argsort(value)[::-1][:k]
        # Components have no sign of their own: the largest entry is made positive.
        v = vector[:, order] * np.sign(vector[np.abs(vector[:, order]).argmax(0), order])
        spread = np.where(value[order] > 1e-14, np.sqrt(np.maximum(value[order], 0)), 1.0)
        return cls(features, embedding, mean.tolist(), scale.tolist(), v.T.tolist(), spread.tolist())

    def columns(self) -> dict[str, Column]:
        z = [(F.col(c) - m) / s for c, m, s in zip([*self.features, *self.embedding], self.mean, self.scale, strict=True)]
        out = {f"z_{c}": v for c, v in zip(self.features, z, strict=False)}
        for i, (w, s) in enumerate(zip(self.components, self.spread, strict=True)):
            total = F.lit(0.0)
            for c, x in zip(z[len(self.features) :], w, strict=True):
                total = total + c * F.lit(x)
            out[f"pc{i}"] = total / F.lit(s)
        return out


# -------------------------------------------------------------------------------------------------------------- scalar

#: Kinds and penalties in order of preference.
SCALAR_GRID = (("ridge", 0.1), ("ridge", 1.0), ("ridge", 10.0), ("rbf", 0.1), ("rbf", 1.0), ("rbf", 10.0))


@dataclass
class ScalarHead:
    """exp(correction) of a positive target, from features standardised under weights by which families count alike.

    Kind `ridge` holds a linear head of the logarithm. Kind `rbf` holds the solution of the kernel exp(-d2 / features) and an
    intercept that isn't penalised, of any number of rows.
    """

    kind: str
    alpha: float
    linear: heads.LinearHead
    active: list[str]
    solution: kernels.Solution | None = None

    def _scaled(self) -> list[Column]:
        at = {c: (m, s) for c, m, s in zip(self.linear.features, self.linear.mean, self.linear.scale, strict=True)}
        return [(F.col(c) - F.lit(at[c][0])) / F.lit(at[c][1]) for c in self.active]

    def mix(self) -> kernels.Mix:
        return kernels.Mix(((0, len(self.active), "rbf", 1.0, 1 / len(self.linear.features)),))

    def predicted(self, df: DataFrame, name: str) -> DataFrame:
        """df with the prediction as column `name`."""
        if self.kind == "ridge":
            return df.withColumn(name, self.column())
        return self.solution.predicted(df, self._scaled(), name).withColumn(name, F.exp(F.col(name)[0]))

    def column(self) -> Column:
        """The prediction of a ridge as an expression."""
        return F.exp(self.linear.predict()[self.linear.targets[0]])


def _log_rows(df: DataFrame, features: list[str], target: str, family: str) -> DataFrame:
    """Features, target, its logarithm, family and the share of one row of its family; refused unless all is finite and positive."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(target).cast("double").alias("y"), F.col(family).cast("string").alias("family"))
    bad = functools.reduce(operator.or_, [~refuse.finite(F.col(c)) for c in [*features, "y"]], F.col("family").isNull() | (F.col("y") <= 0))
    if rows.where(F.coalesce(bad, F.lit(True))).limit(1).count():
        raise ValueError("finite features, positive targets and families are needed")
    sizes = rows.groupBy("family").agg((1 / F.count(F.lit(1))).alias("share"))
    return rows.join(sizes, "family").withColumn("log_y", F.log("y"))


def _linear(g: heads.Gram, features: list[str], alpha: float) -> tuple[heads.LinearHead, list[str]]:
    """The ridge of sums whose weights are made to add up to one, and the features that vary."""
    one = heads.Gram(1.0, g.total / g.weight, g.product / g.weight)
    spread = np.diag(one.product)[: len(features)] - one.total[: len(features)] ** 2
    active = [c for c, v, p in zip(features, spread, np.diag(one.product), strict=False) if v > 1e-14 * max(p, 1e-300)]
    if not active:
        raise ValueError("no feature varies")
    return heads.LinearHead.solve(one, features, ["log_y"], alpha), active


def _packed(head: ScalarHead, rows: DataFrame, weight: float) -> DataFrame:
    return kernels.packed(rows, head._scaled(), [F.col("log_y")], F.col("share") / F.lit(float(weight)))


def fit_scalar(df: DataFrame, features: list[str], target: str, family: str, kind: str, alpha: float) -> ScalarHead:
    """One head of all rows, of any number."""
    rows = _log_rows(df, features, target, family)
    g = heads.grams(rows, [*features, "log_y"], weight="share")
    if not g:
        raise ValueError("no training rows")
    head = ScalarHead(kind, alpha, *_linear(g[None], features, alpha))
    if kind == "ridge":
        return head
    packed = _packed(head, rows, g[None].weight)
    head.solution = kernels.solve(packed, len(head.active), 1, head.mix(), alpha, True)
    dropped(packed)
    return head


def select_scalar(df: DataFrame, features: list[str], target: str, family: str, grid: tuple[tuple[str, float], ...] = SCALAR_GRID) -> tuple[ScalarHead, list[float]]:
    """The head of the grid with the least family-balanced squared error out of five folds, in the target's own unit.

    Ridges come from the folds' sums; a fold's kernels share their landmarks.
    """
    rows = _log_rows(df, features, target, family)
    folds = grouping.size_balanced_folds(rows, "family", 5).select("family", F.col("fold").cast("int").alias("fold"))
    if folds.limit(5).count() < 5:
        raise ValueError("five families are needed")
    dealt = stored(rows.join(folds, "family"), "scalar-folds")
    parts = {int(k): g for k, g in heads.grams(dealt, [*features, "log_y"], by="fold", weight="share").items()}
    whole = sum(list(parts.values())[1:], next(iter(parts.values())))
    errors = {}
    for i, (kind, alpha) in enumerate(grid):
        if kind == "ridge":
            p = F.lit(None).cast("double")
            for k, g in parts.items():
                p = F.when(F.col("fold") == k, ScalarHead(kind, alpha, *_linear(whole - g, features, alpha)).column()).otherwise(p)
            errors[i] = (p - F.col("y")) * (p - F.col("y"))
    scores: dict[int, float] = {}
    if errors:
        names = [f"e{i}" for i in errors]
        within = dealt.groupBy("family").agg(*[F.avg(e).alias(n) for n, e in zip(names, errors.values(), strict=True)])
        scores |= dict(zip(errors, within.agg(*[F.avg(n) for n in names]).first(), strict=True))
    if wanted := [i for i in range(len(grid)) if i not in errors]:
        each = []
        for k, g in parts.items():
            rest, base, held = whole - g, None, dealt.where(F.col("fold") == k)
            for i in wanted:
                head = ScalarHead(*grid[i], *_linear(rest, features, grid[i][1]))
                packed = packed if base else _packed(head, dealt.where(F.col("fold") != k), rest.weight)
                base = base or kernels.landmarks(packed, len(head.active), head.mix())
                head.solution = kernels.solve(packed, len(head.active), 1, head.mix(), grid[i][1], True, base)
                held = head.predicted(held, f"p{i}")
            each.append(held.groupBy("family").agg(*[F.avg((F.col(f"p{i}") - F.col("y")) ** 2).alias(f"e{i}") for i in wanted]))
        found = functools.reduce(DataFrame.unionByName, each).agg(*[F.avg(f"e{i}") for i in wanted]).first()
        scores |= dict(zip(wanted, found, strict=True))
    best = min(scores, key=lambda i: (scores[i], i))
    return fit_scalar(df, features, target, family, *grid[best]), [scores[i] for i in range(len(grid))]


# ---------------------------------------------------------------------------------------------- simulation cells and sites


def site_bands(donors: DataFrame, acceptors: DataFrame, molecule: str, bonds: tuple[int, int] = (3, 7), reach: float = 3.5) -> DataFrame:
    """Per molecule the donor-acceptor pairs whose path has 3 to 7 bonds, and those within 3.5 of each other.

    Both tables have the molecule, an atom's place and x, y, z; `path` of a donor is an array of bond distances by place.
    The join is by molecule, so a pair costs a row only within its molecule.
    """
    d, a = donors.alias("d"), acceptors.alias("a")
    pairs = d.join(a, molecule).where(F.col("d.place") != F.col("a.place"))
    steps = F.element_at(F.col("d.path"), F.col("a.place") + 1)
    gap = F.sqrt(sum(((F.col(f"d.{c}") - F.col(f"a.{c}")) * (F.col(f"d.{c}") - F.col(f"a.{c}")) for c in "yz"), (F.col("d.x") - F.col("a.x")) * (F.col("d.x") - F.col("a.x"))))
    return pairs.groupBy(molecule).agg(F.sum(F.when(steps.between(*bonds), 1).otherwise(0)).alias("paths_in_band"), F.sum(F.when(gap <= reach, 1).otherwise(0)).alias("close"))


def frame_cohesion(particles: DataFrame, excluded: DataFrame, volume_nm3: float) -> DataFrame:
    """Per frame the pair energies between molecules of an isolated (not periodic) cell, and their densities.

    particles: frame, place, molecule, charge, sigma, epsilon, x, y, z (nm, kJ/mol); excluded: molecule pairs' places within
    a molecule are not needed, since only pairs of different molecules count: bulk minus isolated leaves exactly those.
    excluded (place_a, place_b) names further pairs to leave out. Every molecule has to be neutral within 1e-4.
    """
    if particles.groupBy("frame", "molecule").agg(F.abs(F.sum("charge")).alias("q")).where("q > 1e-4").limit(1).count():
        raise ValueError("a molecule's charges do not add up to zero")
    a, b = particles.alias("a"), particles.alias("b")
    pairs = a.join(b, "frame").where((F.col("a.place") < F.col("b.place")) & (F.col("a.molecule") != F.col("b.molecule")))
    pairs = pairs.join(excluded, (F.col("a.place") == F.col("place_a")) & (F.col("b.place") == F.col("place_b")), "left_anti")
    r2 = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "yz"), (F.col("a.x") - F.col("b.x")) * (F.col("a.x") - F.col("b.x")))
    s6 = F.pow((F.col("a.sigma") + F.col("b.sigma")) / 2, 6) / F.pow(r2, 3)
    lj = 4 * F.sqrt(F.col("a.epsilon") * F.col("b.epsilon")) * (s6 * s6 - s6)
    coulomb = F.lit(138.935458) * F.col("a.charge") * F.col("b.charge") / F.sqrt(r2)
    sums = pairs.groupBy("frame").agg(F.sum(lj).alias("lj"), F.sum(coulomb).alias("coulomb"))
    return sums.select("frame", "lj", "coulomb", energy_density(-F.col("lj"), F.lit(volume_nm3)).alias("lj_mpa"), energy_density(-F.col("coulomb"), F.lit(volume_nm3)).alias("coulomb_mpa"))
