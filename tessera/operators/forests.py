"""Randomised, positive and boosted trees and one-layer networks, fitted from sums over rows.

Each pass over the rows is one aggregate: a batch gives partial sums (and minima), which are added (or minimised) by key.
States are plain lists and go through JSON unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest
from .heads import lbfgs, tree_values

#: Trees that one pass grows together; tasks whose sums the driver adds.
TOGETHER, FEW_TASKS = 16, 16

Work = Callable[[np.ndarray], dict[int, np.ndarray]]
#: Of rows that are summed over again and again, in one task.
TASK_BYTES = 64 << 20


class Rows:
    """Numeric columns of a table, to be summed over as often as need be. Missing and nonfinite values are refused."""

    def __init__(self, df: DataFrame, columns: list[str]):
        rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
        bad = rows.where(" OR ".join(f"c{i} IS NULL OR isnan(c{i}) OR abs(c{i}) = double('Infinity')" for i in range(len(columns))))
        if bad.limit(1).count():
            raise ValueError("nonfinite or missing values in a fit")
        self.count = rows.count()
        if not self.count:
            raise ValueError("no training rows")
        # Files of few bytes may hold many rows: each task gets about TASK_BYTES of doubles.
        tasks = -(-self.count * len(columns) * 8 // TASK_BYTES)
        self.rows = (rows.repartition(tasks) if tasks > rows.rdd.getNumPartitions() else rows).persist()
        self.tasks = self.rows.rdd.getNumPartitions()

    def close(self) -> None:
        self.rows.unpersist()

    def total(self, work: Work, summed: int) -> dict[int, np.ndarray]:
        """work of all rows: the first `summed` entries of each key's array are added, the others minimised."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for key, part in work(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])).items():
                    if key in held:
                        held[key][:summed] += part[:summed]
                        held[key][summed:] = np.minimum(held[key][summed:], part[summed:])
                    else:
                        held[key] = part
            for key, part in held.items():
                yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.int64()), "part": pa.array([part.tolist()], pa.list_(pa.float64()))})

        each = self.rows.mapInArrow(run, "key long, part array<double>")
        if self.tasks <= FEW_TASKS:
            # Sums of so few tasks are added without a shuffle.
            few: dict[int, np.ndarray] = {}
            for batch in each.toArrow().to_batches():
                for key, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    value = part.values.to_numpy()
                    few[key] = value if key not in few else np.concatenate([few[key][:summed] + value[:summed], np.minimum(few[key][summed:], value[summed:])])
            return few
        parts = each.select("key", F.posexplode("part").alias("at", "v"))
        sums = parts.groupBy("key", "at").agg(F.when(F.col("at") < summed, F.sum("v")).otherwise(F.min("v")).alias("v")).toArrow()
        keys, places, values = (sums.column(i).to_numpy() for i in range(3))
        out: dict[int, np.ndarray] = {}
        for key in np.unique(keys).tolist():
            own = keys == key
            out[key] = np.zeros(int(places[own].max()) + 1)
            out[key][places[own]] = values[own]
        return out


# -------------------------------------------------------------------------------------------------------------- forests


def _leaves(x: np.ndarray, tree: dict) -> np.ndarray:
    """The node of each row in a growing tree."""
    nodes = np.arange(len(tree["left"]))
    return tree_values(x, *(np.array(tree[k]) for k in ("left", "right", "feature", "threshold")), nodes)


def _by_node(at: np.ndarray, open_: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each open node that has rows, with their places."""
    order = np.argsort(at, kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0, [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if (node := int(at[order[a]])) in open_:
            yield node, order[a:b]


def _spread(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Sums of squared deviations, over all targets."""
    return squares - (total * total).sum(axis=-1) / np.maximum(n, 1)


def _grown(rows: Rows, p: int, k: int, trees: list[int], depth: int, leaf: int, tries: int, seed: int) -> list[dict]:
    """Trees (by number) grown together, level by level: two passes a level, for ranges and for the drawn splits."""
    grown = [{"left": [-1], "right": [-1], "feature": [0], "threshold": [0.0], "value": [[0.0] * k]} for _ in trees]
    open_: list[set[int]] = [{0} for _ in trees]
    for level in range(depth + 1):
        if not any(open_):
            break

        def ranges(data: np.ndarray) -> dict[int, np.ndarray]:
            x, y = data[:, :p].astype(np.float32), data[:, p:]
            out = {}
            for i, tree in enumerate(grown):
                for node, mine in _by_node(_leaves(x, tree), open_[i]) if open_[i] else ():
                    own, t = x[mine], y[mine]
                    out[i << 32 | node] = np.concatenate([[len(mine)], t.sum(0), [(t * t).sum()], own.min(0), -own.max(0)])
            return out

        found = rows.total(ranges, 2 + k)
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for key, s in found.items():
            i, node = key >> 32, key & 0xFFFFFFFF
            grown[i]["value"][node] = (s[1 : 1 + k] / s[0]).tolist()
            low, high = s[2 + k : 2 + k + p], -s[2 + k + p :]
            varied = np.flatnonzero(low < high)
            if level < depth and s[0] >= 2 * leaf and varied.size and _spread(s[0], s[1 : 1 + k], s[1 + k]) > 1e-12 * max(s[1 + k], 1e-300):
                rng = np.random.default_rng([seed, trees[i], node])
                chosen = rng.permutation(varied)[:tries]
                drawn[key] = chosen, rng.uniform(low[chosen], high[chosen])

        def splits(data: np.ndarray) -> dict[int, np.ndarray]:
            x, y = data[:, :p].astype(np.float32), data[:, p:]
            out = {}
            for i, tree in enumerate(grown):
                for node, mine in _by_node(_leaves(x, tree), open_[i]) if open_[i] else ():
                    if (key := i << 32 | node) in drawn:
                        feature, threshold = drawn[key]
                        left = (x[mine][:, feature] <= threshold).astype(float)
                        t = y[mine]
                        out[key] = np.column_stack([left.sum(0), left.T @ t, left.T @ (t * t).sum(1)]).ravel()
            return out

        sides = rows.total(splits, 1 << 30) if drawn else {}
        open_ = [set() for _ in trees]
        for key, (feature, threshold) in sorted(drawn.items()):
            i, node = key >> 32, key & 0xFFFFFFFF
            s, side = found[key], sides[key].reshape(len(feature), 2 + k)
            n = side[:, 0]
            after = _spread(n, side[:, 1 : 1 + k], side[:, 1 + k]) + _spread(s[0] - n, s[1 : 1 + k] - side[:, 1 : 1 + k], s[1 + k] - side[:, 1 + k])
            after = np.where((n >= leaf) & (s[0] - n >= leaf), after, np.inf)
            # Splits that part the rows alike differ by the rounding of sums only: the first drawn is taken.
            best = int(np.argmax(after <= after.min() + 1e-9 * s[1 + k]))
            if np.isfinite(after[best]):
                tree = grown[i]
                at = len(tree["left"])
                tree["left"][node], tree["right"][node] = at, at + 1
                tree["feature"][node], tree["threshold"][node] = int(feature[best]), float(threshold[best])
                for name, empty in (("left", -1), ("right", -1), ("feature", 0), ("threshold", 0.0)):
                    tree[name] += [empty, empty]
                tree["value"] += [[0.0] * k, [0.0] * k]
                open_[i] |= {at, at + 1}
    return grown


def fit_extra_trees(df: DataFrame, features: list[str], targets: list[str], trees: int = 128, depth: int = 12, leaf: int = 1, tries: int | None = None, seed: int = 42) -> dict:
    """Every tree sees all rows; a node draws `tries` features (all by default) and one threshold each within its range, and keeps the best."""
    rows = Rows(df, [*features, *targets])
    try:
        grown = [t for a in range(0, trees, TOGETHER) for t in _grown(rows, len(features), len(targets), list(range(a, min(a + TOGETHER, trees))), depth, leaf, tries or len(features), seed)]
    finally:
        rows.close()
    body = {"kind": "extra_trees", "features": features, "targets": targets, "trees": grown, "root": False}
    return body | {"digest": canonical_digest(body)}


def fit_positive_forests(df: DataFrame, features: list[str], targets: list[str], squared: bool = False, **settings) -> list[dict]:
    """A forest per target that isn't negative, of the target or its square: leaf means are never negative and nothing is clipped."""
    if df.where(" OR ".join(f"`{t}` < 0" for t in targets)).limit(1).count():
        raise ValueError("targets must not be negative")
    out = []
    for t in targets:
        found = fit_extra_trees(df.withColumn(t, F.col(t) * F.col(t)) if squared else df, features, [t], **settings)
        body = {k: v for k, v in found.items() if k != "digest"} | {"root": squared}
        out.append(body | {"digest": canonical_digest(body)})
    return out


# ------------------------------------------------------------------------------------------------------------- boosting


def edges_of(df: DataFrame, feature: str, bins: int) -> np.ndarray:
    """At most bins - 1 thresholds: between neighbouring values if there are few, else quantiles up to a quarter of a bin."""
    values = df.select(F.col(feature).cast("double").alias("v")).where("v IS NOT NULL")
    few = [r[0] for r in values.distinct().limit(bins + 1).collect()]
    if len(few) <= bins:
        v = np.sort(np.array(few, np.float32)).astype(float)
        return np.unique((v[1:] + v[:-1]) / 2)
    return np.unique(np.array(values.approxQuantile("v", [k / bins for k in range(1, bins)], 0.25 / bins), np.float32).astype(float))


class _Booster:
    """Trees of one target, each grown from the residuals of those before it, the leaf of the largest gain first."""

    def __init__(self, rows: Rows, p: int, target: int, edges: list[np.ndarray], leaves: int, least: int, rate: float):
        self.rows, self.p, self.target, self.edges, self.leaves, self.least, self.rate = rows, p, target, edges, leaves, least, rate
        self.width = max(len(e) for e in edges) + 1
        sums = rows.total(lambda d: {0: np.array([len(d), d[:, target].sum()])}, 2)[0]
        self.base, self.trees = float(sums[1] / sums[0]), []

    def sums(self, tree: dict, nodes: set[int]) -> dict[int, np.ndarray]:
        """Of each node counts and residuals by feature and bin; residuals follow from the trees so far."""
        edges, p, width, target, base, trees = self.edges, self.p, self.width, self.target, self.base, list(self.trees)

        def work(data: np.ndarray) -> dict[int, np.ndarray]:
            x, out = data[:, :p].astype(np.float32).astype(float), {}
            r = data[:, target] - base - sum(_values(x, t) for t in trees)
            for node, mine in _by_node(_leaves(x, tree), nodes):
                held = np.zeros((p, width, 2))
                for f in range(p):
                    at = np.searchsorted(edges[f], x[mine, f])
                    held[f, :, 0], held[f, :, 1] = np.bincount(at, minlength=width), np.bincount(at, r[mine], minlength=width)
                out[node] = held.ravel()
            return out

        return {k: v.reshape(p, width, 2) for k, v in self.rows.total(work, 1 << 30).items()}

    def best(self, held: np.ndarray) -> tuple[float, int, int]:
        """The largest gain of a split, its feature and its edge; ties (up to rounding) go to the first."""
        left = held.cumsum(axis=1)[:, :-1]
        whole = held.sum(axis=1, keepdims=True)
        right = whole - left
        if not left.size:
            return 0.0, 0, 0
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - whole[..., 1] ** 2 / whole[..., 0]
        gain = np.where((left[..., 0] >= self.least) & (right[..., 0] >= self.least) & (np.arange(left.shape[1]) < np.array([len(e) for e in self.edges])[:, None]), gain, 0.0)
        f, k = divmod(int(np.argmax(gain >= gain.max() * (1 - 1e-9))), gain.shape[1])
        return float(gain.max()), f, k

    def _split(self, tree: dict[str, list], node: int, f: int, k: int) -> int:
        """Splits a leaf; the left child's number, which the right one's follows."""
        at = len(tree["left"])
        tree["left"][node], tree["right"][node], tree["feature"][node], tree["threshold"][node] = at, at + 1, f, float(self.edges[f][k])
        for name, empty in (("left", -1), ("right", -1), ("feature", 0), ("threshold", 0.0), ("value", 0.0)):
            tree[name] += [empty, empty]
        return at

    def _left_sums(self, tree: dict[str, list], splits: dict[int, tuple[float, int, int]]) -> dict[int, np.ndarray]:
        trial = {name: list(values) for name, values in tree.items()}
        at = {node: self._split(trial, node, f, k) for node, (_, f, k) in splits.items()}
        found = self.sums(trial, set(at.values()))
        return {node: found[left] for node, left in at.items()}

    def grow(self) -> bool:
        """One tree more; False if nothing can be split."""
        tree: dict[str, list] = {"left": [-1], "right": [-1], "feature": [0], "threshold": [0.0], "value": [0.0]}
        held = self.sums(tree, {0})
        found = {0: self.best(held[0])}
        # Sums of the left side of each leaf's best split: those of all leaves are gathered in one pass, before it is known which is split.
        lefts: dict[int, np.ndarray] = {}
        while len(found) < self.leaves:
            most = max(v[0] for v in found.values())
            node = min(n for n, v in found.items() if v[0] >= most * (1 - 1e-9))
            if found[node][0] <= 1e-12:
                break
            if node not in lefts:
                lefts |= self._left_sums(tree, {n: v for n, v in found.items() if v[0] > 1e-12 and n not in lefts})
            _, f, k = found.pop(node)
            at = self._split(tree, node, f, k)
            # The right child has what the left one leaves.
            held[at] = lefts.pop(node)
            held[at + 1] = held.pop(node) - held[at]
            found |= {n: self.best(held[n]) for n in (at, at + 1)}
        for node in found:
            n, total = held[node][0].sum(axis=0)
            tree["value"][node] = float(self.rate * total / n)
        if len(found) == 1:
            return False
        self.trees.append(tree)
        return True


def _values(x: np.ndarray, tree: dict) -> np.ndarray:
    return tree_values(x, *(np.array(tree[k]) for k in ("left", "right", "feature", "threshold", "value")))


def fit_leafwise(df: DataFrame, features: list[str], targets: list[str], trees: int = 80, leaves: int = 7, least: int = 8, rate: float = 0.1, bins: int = 255) -> list[dict]:
    """A boosted ensemble per target, least squares over binned features: each tree has `leaves` leaves of `least` rows at least."""
    rows = Rows(df, [*features, *targets])
    out = []
    try:
        edges = [edges_of(df, f, bins) for f in features]
        for i, t in enumerate(targets):
            booster = _Booster(rows, len(features), len(features) + i, edges, leaves, least, rate)
            while len(booster.trees) < trees and booster.grow():
                pass
            body = {"kind": "leafwise", "features": features, "targets": [t], "base": booster.base, "trees": booster.trees}
            out.append(body | {"digest": canonical_digest(body)})
    finally:
        rows.close()
    return out


# ------------------------------------------------------------------------------------------------------------- networks


@dataclass
class _Shape:
    p: int
    width: int
    k: int

    def parts(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First weights and offsets, second weights and offsets."""
        a, b, c = self.p * self.width, self.width, self.width * self.k
        return theta[:a].reshape(self.p, self.width), theta[a : a + b], theta[a + b : a + b + c].reshape(self.width, self.k), theta[a + b + c :]

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        one, two = np.sqrt(6 / (self.p + self.width)), np.sqrt(6 / (self.width + self.k))
        return np.concatenate([rng.uniform(-one, one, (self.p + 1) * self.width), rng.uniform(-two, two, (self.width + 1) * self.k)])


def fit_network(df: DataFrame, features: list[str], targets: list[str], width: int, alpha: float, seed: int = 42, rounds: int = 600, gate: float = 1e-5) -> dict:
    """One layer of tanh units on standardised columns: least squares plus alpha times squared weights, per row, by L-BFGS.

    The budget of rounds is fixed; whether the gradient passed the gate within it is part of the state.
    """
    rows = Rows(df, [*features, *targets])
    p, k, n = len(features), len(targets), rows.count
    s = rows.total(lambda d: {0: np.concatenate([d.sum(0), (d * d).sum(0)])}, 1 << 30)[0] / n
    mean, shape = s[: p + k], _Shape(p, width, k)
    # Columns that do not vary are only centred.
    variance = np.maximum(s[p + k :] - mean * mean, 0)
    scale = np.where(variance > 1e-14 * np.maximum(s[p + k :], 1e-300), np.sqrt(variance), 1.0)

    def value_and_gradient(theta: np.ndarray) -> tuple[float, np.ndarray]:
        w, b, v, c = shape.parts(theta)

        def work(data: np.ndarray) -> dict[int, np.ndarray]:
            z = (data - mean) / scale
            h = np.tanh(z[:, :p] @ w + b)
            r = h @ v + c - z[:, p:]
            back = (r @ v.T) * (1 - h * h)
            return {0: np.concatenate([[0.5 * (r * r).sum()], (z[:, :p].T @ back).ravel(), back.sum(0), (h.T @ r).ravel(), r.sum(0)])}

        found = rows.total(work, 1 << 30)[0] / n
        penalty = np.concatenate([w.ravel(), np.zeros(width), v.ravel(), np.zeros(k)]) * alpha / n
        return float(found[0] + 0.5 * (penalty @ theta)), found[1:] + penalty

    try:
        theta = lbfgs(value_and_gradient, shape.start(seed), gate=gate, rounds=rounds, required=False)
        value, gradient = value_and_gradient(theta)
    finally:
        rows.close()
    w, b, v, c = shape.parts(theta)
    body = {"kind": "network", "features": features, "targets": targets, "mean": mean.tolist(), "scale": scale.tolist(), "weights": [w.tolist(), v.tolist()], "offsets": [b.tolist(), c.tolist()], "loss": value, "converged": bool(np.abs(gradient).max() <= gate)}
    return body | {"digest": canonical_digest(body)}


# ----------------------------------------------------------------------------------------------------------- prediction


def predicted(df: DataFrame, state: dict) -> DataFrame:
    """df with `pred_<target>`, from a state of this module; a state that doesn't match its digest is refused."""
    if canonical_digest({k: v for k, v in state.items() if k != "digest"}) != state.get("digest"):
        raise ValueError("the state does not match its digest")
    names, features, targets = df.columns, state["features"], state["targets"]
    shared = df.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        if s["kind"] == "network":
            p = len(features)
            mean, scale = np.array(s["mean"]), np.array(s["scale"])
            (w, v), (b, c) = (np.array(s["weights"][0]), np.array(s["weights"][1])), map(np.array, s["offsets"])
        else:
            trees = [tuple(np.array(t[k]) for k in ("left", "right", "feature", "threshold", "value")) for t in s["trees"]]
            boosted = s["kind"] == "leafwise"
        for batch in batches:
            x = np.column_stack([np.array(batch.column(names.index(f)).to_numpy(zero_copy_only=False), float) for f in features])
            if s["kind"] == "network":
                out = (np.tanh((x - mean[:p]) / scale[:p] @ w + b) @ v + c) * scale[p:] + mean[p:]
            elif boosted:
                out = (np.full(len(x), s["base"]) + sum(tree_values(x, *t) for t in trees)).reshape(-1, 1)
            else:
                out = sum(tree_values(x, *t) for t in trees) / len(trees)
                out = np.sqrt(out) if s["root"] else out
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(out[:, i]) for i in range(len(targets))]], names=[*names, *[f"pred_{t}" for t in targets]])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"`pred_{t}` double" for t in targets)])
    return df.mapInArrow(run, schema)
