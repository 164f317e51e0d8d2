"""Nested selection of a hybrid head from four passes over the rows, instead of a fit for each fold of each fold.

Chemistry plus a residual on the embedding, whose strength is chosen by nested family folds. Of the families there are 30 training sets:
for each of five outer folds (and for none) the rest, and the rest without one of its four inner folds. Each is cut in five for
the choice of its own penalty. A pass gathers the sums of all 150 parts; a training set's sums are those of its parts, less
the one left out. Families' places in all of these are worked out once, by ranks of hashes within each set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped, stored
from . import heads
from .components import looked_up
from .forests import Rows
from .grouping import hash_folds

OUTER, INNER, PARTS = 5, 4, 5
SETS = (OUTER + 1) * (INNER + 1)


def _folds_within(rows: DataFrame, group: str, family: str, folds: int, salt: str, name: str) -> DataFrame:
    """rows with `name`: their families dealt round in order of their hashes, in each group by itself."""
    digest = F.sha2(F.concat(F.lit(salt), F.lit("\0"), F.col(family).cast("string")), 256)
    each = rows.withColumn("_digest", digest).withColumn("_prefix", F.substring("_digest", 1, 4))
    sizes = each.groupBy(group, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(group, "_prefix", (F.sum("_n").over(Window.partitionBy(group).orderBy("_prefix")) - F.col("_n")).alias("_start"))
    local = F.row_number().over(Window.partitionBy(group, "_prefix").orderBy("_digest", family)) - 1
    out = each.withColumn("_local", local).join(starts, [group, "_prefix"])
    return out.withColumn(name, ((F.col("_start") + F.col("_local")) % folds).cast("int")).drop("_digest", "_prefix", "_start", "_local")


def _places(df: DataFrame, family: str, seed: int) -> DataFrame:
    """family, number, outer, inner (by outer fold left out, the last for none) and part (by training set); -1 where a family is not in it."""
    families = df.select(family).distinct()
    outer = stored(hash_folds(families, family, OUTER, seed, "outer").withColumnRenamed("fold", "outer").withColumn("number", F.monotonically_increasing_id()), "nested-outer")
    without = outer.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(OUTER)))).where("outer <> k")
    inner = stored(_folds_within(without, "k", family, INNER, "inner-42", "inner"), "nested-inner")
    sets = inner.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(INNER)))).where("inner <> j").withColumn("set", F.col("k") * (INNER + 1) + F.col("j"))
    parts = stored(_folds_within(sets, "set", family, PARTS, f"selection-{seed}", "part"), "nested-parts")
    if parts.groupBy("set").agg(F.count(F.lit(1)).alias("n")).where("n < 3").limit(1).count():
        raise ValueError("selection needs at least three families")

    def spread(rows: DataFrame, at: str, value: str, n: int, name: str) -> DataFrame:
        known = rows.groupBy(family).agg(F.map_from_entries(F.collect_list(F.struct(at, value))).alias("_m"))
        return known.select(family, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(-1))).alias(name))

    return stored(outer.join(spread(inner, "k", "inner", OUTER + 1, "inner"), family).join(spread(parts, "set", "part", SETS, "part"), family), "nested-places")


def _line(head: heads.LinearHead) -> tuple[np.ndarray, np.ndarray]:
    """Weights (a row per feature) and constants of a head."""
    w = np.array(head.coef).reshape(len(head.targets), len(head.features)).T / np.array(head.scale)[:, None]
    return w, np.array(head.intercept) - np.array(head.mean) @ w


def _macro(rows: Rows, n: int, work: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> dict[int, np.ndarray]:
    """Per set the mean over families of their mean errors. work gives (set, families' numbers, n errors) of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, number, errors in work(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])):
                if not len(number):
                    continue
                own, at = np.unique(number, return_inverse=True)
                sums = np.zeros((len(own), n + 1))
                np.add.at(sums, at, np.column_stack([errors, np.ones(len(number))]))
                yield pa.RecordBatch.from_pydict({"k": pa.array(np.full(len(own), k, np.int32)), "number": pa.array(own.astype(np.int64))} | {f"e{i}": pa.array(sums[:, i]) for i in range(n)} | {"n": pa.array(sums[:, n])})

    schema = ", ".join(["k int", "number long", *(f"e{i} double" for i in range(n)), "n double"])
    within = rows.rows.mapInArrow(run, schema).groupBy("k", "number").agg(*[(F.sum(f"e{i}") / F.sum("n")).alias(f"e{i}") for i in range(n)])
    return {r["k"]: np.array(r[1:]) for r in within.groupBy("k").agg(*[F.avg(f"e{i}") for i in range(n)]).collect()}


def _first(scores: np.ndarray) -> int:
    return int(np.flatnonzero(scores <= scores.min() + heads.TIE)[0])


def select_hybrid(df: DataFrame, features: list[str], embedding: list[str], targets: list[str], family: str, alphas: tuple[float, ...] = heads.ALPHAS, seed: int = 42) -> dict:
    """Chemistry plus a residual on the embedding whose strength is chosen by nested family folds.

    Candidates per target: none, constant, then penalties from the largest. In each of five outer folds the chemistry
    head selects its own penalty on the other folds, whose residuals come from four inner folds. Ties within 1e-12 go to
    the earlier candidate.
    """
    penalties = sorted({float(a) for a in alphas}, reverse=True)
    if not penalties or any(not np.isfinite(a) or a <= 0 for a in penalties):
        raise ValueError("finite positive penalties are needed")
    if df.select(family).distinct().limit(OUTER).count() < OUTER:
        raise ValueError("nested selection needs at least five families")
    places = _places(df, family, seed)
    names = [*features, *embedding, *targets]
    p, q, t = len(features), len(embedding), len(targets)
    joined = looked_up(df.select(family, *names), places, family)
    held = stored(joined.select(*names, "number", "outer", *[F.col("inner")[k].alias(f"inner{k}") for k in range(OUTER + 1)], *[F.col("part")[s].alias(f"part{s}") for s in range(SETS)]), "nested-rows")
    rows = Rows(held, held.columns)
    number, outer, inner, part = p + q + t, p + q + t + 1, p + q + t + 2, p + q + t + 3 + OUTER
    of = lambda d: (d[:, :p], d[:, p : p + q], d[:, p + q : p + q + t])

    def gram(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])

    def unpacked(v: np.ndarray, k: int) -> heads.Gram:
        return heads.Gram(v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k))

    def by_part(d: np.ndarray) -> dict[int, np.ndarray]:
        x, _, y = of(d)
        both = np.column_stack([x, y])
        return {s * PARTS + f: gram(both[own]) for s in range(SETS) for f in range(PARTS) if (own := d[:, part + s] == f).any()}

    sums = {k: unpacked(v, p + t) for k, v in rows.total(by_part, 1 << 30).items()}
    parts = [{f: sums[s * PARTS + f] for f in range(PARTS) if s * PARTS + f in sums} for s in range(SETS)]
    wholes = [sum(list(g.values())[1:], next(iter(g.values()))) for g in parts]
    choices: list[float | None] = [None, *penalties]

    def constant(g: heads.Gram) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros((p, t)), g.total[p:] / g.weight

    lines = {}
    for s in range(SETS):
        for f, g in parts[s].items():
            rest = wholes[s] - g
            each = [constant(rest) if a is None else _line(heads.LinearHead.solve(rest, features, targets, a)) for a in choices]
            lines[s, f] = np.concatenate([w for w, _ in each], axis=1), np.concatenate([b for _, b in each])

    def left_out(d: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x, _, y = of(d)
        for (s, f), (w, b) in lines.items():
            own = d[:, part + s] == f
            yield s, d[own, number], np.abs(x[own] @ w + b - np.tile(y[own], len(choices)))

    macro = _macro(rows, len(choices) * t, left_out)
    chosen = []
    for s in range(SETS):
        best = [_first(macro[s].reshape(len(choices), t)[:, j]) for j in range(t)]
        solved = {i: heads.LinearHead.solve(wholes[s], features, targets, choices[i] or 1.0) for i in {*best, 1}}
        coef = [[0.0] * p if choices[i] is None else solved[i].coef[j] for j, i in enumerate(best)]
        chosen.append(heads.LinearHead(features, targets, solved[1].mean, solved[1].scale, coef, solved[1].intercept))
    base = [_line(h) for h in chosen]

    def residual_sums(d: np.ndarray) -> dict[int, np.ndarray]:
        x, e, y = of(d)
        out = {}
        for k in range(OUTER + 1):
            for j in range(INNER):
                own = d[:, inner + k] == j
                if own.any():
                    w, b = base[k * (INNER + 1) + j]
                    v = gram(np.column_stack([e[own], y[own] - x[own] @ w - b]))
                    out[k] = out[k] + v if k in out else v
        return out

    residuals = {k: unpacked(v, q + t) for k, v in rows.total(residual_sums, 1 << 30).items()}
    called = [f"residual_{c}" for c in targets]
    candidates: list[object] = ["none", "constant", *penalties]
    extra = {}
    for k in range(OUTER):
        g = residuals[k]
        each = [(np.zeros((q, t)), np.zeros(t)), (np.zeros((q, t)), g.total[q:] / g.weight), *[_line(heads.LinearHead.solve(g, embedding, called, a)) for a in penalties]]
        extra[k] = np.concatenate([w for w, _ in each], axis=1), np.concatenate([b for _, b in each])

    def outer_errors(d: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        x, e, y = of(d)
        for k, (w, b) in extra.items():
            own = d[:, outer] == k
            v, a = base[k * (INNER + 1) + INNER]
            off = y[own] - x[own] @ v - a
            yield 0, d[own, number], np.abs(np.tile(off, len(candidates)) - e[own] @ w - b)

    scores = _macro(rows, len(candidates) * t, outer_errors)[0].reshape(len(candidates), t)
    rows.close()
    for done in (held, places):
        dropped(done)
    found = {}
    for j, c in enumerate(targets):
        pick = candidates[_first(scores[:, j])]
        h = heads.LinearHead.solve(residuals[OUTER], embedding, called, pick if isinstance(pick, float) else 1.0)
        coef = h.coef[j] if isinstance(pick, float) else [0.0] * q
        found[c] = {"candidate": pick, "coef": coef, "intercept": 0.0 if pick == "none" else h.intercept[j]}
    return {"base": chosen[-1].state(), "residual": found, "embedding": {"mean": h.mean, "scale": h.scale}, "candidates": candidates, "scores": {c: scores[:, j].tolist() for j, c in enumerate(targets)}, "independent_accuracy_validated": False}
