"""Kernel systems over any number of rows: (K + alpha / w) dual + b = values, and what follows from their solutions.

Training rows are packed into blocks in the shared folder; no row but the landmarks is ever on the driver. Rows of a task that are equal
in all but their weights are one row with the sum of their weights, which has the same solution: the fit costs what distinct rows cost.

1. Landmarks. Rows with the largest residual diagonal are added, twice as many each time, chosen by pivoted Cholesky within blocks and
   then among the blocks' candidates, until K = F F' up to CAPTURED of its trace, F = K(rows, landmarks) W^-1/2. A smooth or linear
   kernel is captured by few landmarks however many rows there are; at most MOST_RANK are taken.
2. If it is captured, the solution is a ridge on F: one pass of sums over the rows. The residual of the whole system is bounded by what
   is left of the trace; where that bound is above VERIFIED, it is worked out, one pass of products of all pairs of blocks (never
   needed for linear kernels). The head is the landmarks and their weights.
3. Otherwise, or if that residual is too large, conjugate gradients solve the whole system, with (F F' + alpha / w)^-1 as preconditioner:
   a pass of block products a round, until the exact residual is TOLERANCE of the values. The head is the table of all rows' duals.

The driver holds landmarks, matrices of MOST_RANK squared and scalars. Weights w are positive; a kernel that isn't positive
semidefinite is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, stored

#: Rows of a block, rows of it that are multiplied at a time, and bytes of partial products that a task holds.
BLOCK, STRIP, HELD = 4096, 512, 64 << 20
FIRST_RANK, MOST_RANK = 64, 1024
#: Shares of the trace and of the values' norm.
CAPTURED, VERIFIED, TOLERANCE = 1e-9, 1e-6, 1e-10
ROUNDS = 500
#: Rows in which a task looks for equal ones at a time; fewer than a share of DISTINCT are held for the next.
MERGED, DISTINCT = 16 * BLOCK, 0.5


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


@dataclass(frozen=True)
class Mix:
    """A sum of kernels, each of some columns: (first, end, kind, weight, factor), kind `linear` (weight * factor * x'y) or `rbf` (weight * exp(-factor * d2))."""

    parts: tuple[tuple[int, int, str, float, float], ...]

    def values(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for first, end, kind, weight, factor in self.parts:
            x, t = a[:, first:end], b[:, first:end]
            out += weight * (factor * x @ t.T if kind == "linear" else np.exp(-factor * distances(x, t)))
        return out

    def diagonal(self, a: np.ndarray) -> np.ndarray:
        return sum(weight * (factor * (a[:, first:end] ** 2).sum(1) if kind == "linear" else np.ones(len(a))) for first, end, kind, weight, factor in self.parts)

    @property
    def linear(self) -> bool:
        return all(kind == "linear" for _, _, kind, _, _ in self.parts)


def _array(value, columns: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.float64).reshape(-1, columns)


def merged(parts: list[np.ndarray]) -> list[np.ndarray]:
    """x, y, w and key of rows, those of equal x and y once, with the sum of their weights."""
    x, y, w, key = parts
    # -0.0 and 0.0 are equal.
    both = np.ascontiguousarray(np.column_stack([x, y]) + 0.0)
    _, first, at = np.unique(both.view(np.dtype((np.void, both.dtype.itemsize * both.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return [x[first], y[first], np.bincount(at.ravel(), w[:, 0], len(first))[:, None], key[first]]


def packed(df: DataFrame, x: list[Column], y: list[Column], w: Column | None = None, key: Column | None = None) -> DataFrame:
    """Blocks of rows: block, x, y, w (binaries of doubles, row by row) and key (of longs), in the shared folder. Without a key, equal rows of a task may be one."""
    number = lambda c: c.cast("double")
    rows = df.select(F.array(*map(number, x)).alias("x"), F.array(*map(number, y)).cast("array<double>").alias("y"), (F.lit(1.0) if w is None else number(w)).alias("w"), (F.lit(0) if key is None else key).cast("long").alias("key"))
    p, t, equal = len(x), len(y), key is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, most = TaskContext.get().partitionId() << 32, [], 0, MERGED if equal else BLOCK

        def checked(parts: list[np.ndarray]) -> list[np.ndarray]:
            if not all(np.isfinite(a).all() for a in parts[:3]):
                raise ValueError("finite rows are needed")
            return merged(parts)

        def done(parts: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            if not all(np.isfinite(a).all() for a in parts[:3]):
                raise ValueError("finite rows are needed")
            return pa.RecordBatch.from_pydict({"block": [number]} | {n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("x", "y", "w", "key"), parts, strict=True)})

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[:2]]
            held.append([flat[0].astype(float).reshape(batch.num_rows, p), flat[1].astype(float).reshape(batch.num_rows, t), batch.column(2).to_numpy(zero_copy_only=False)[:, None].astype(float), batch.column(3).to_numpy(zero_copy_only=False)])
            size += batch.num_rows
            if size < most:
                continue
            whole = [np.concatenate(a) for a in zip(*held, strict=True)]
            if equal:
                whole = checked(whole)
                # Where few are equal, they are packed and others are looked at.
                if len(whole[0]) <= DISTINCT * MERGED:
                    held, size = [whole], len(whole[0])
                    continue
            while len(whole[0]) >= BLOCK:
                yield done([a[:BLOCK] for a in whole])
                whole = [a[BLOCK:] for a in whole]
            held, size = [whole], len(whole[0])
        if size:
            whole = [np.concatenate(a) for a in zip(*held, strict=True)]
            if equal:
                whole = checked(whole)
            for i in range(0, len(whole[0]), BLOCK):
                yield done([a[i : i + BLOCK] for a in whole])

    return stored(rows.mapInArrow(run, "block long, x binary, y binary, w binary, key binary"), "kernel-rows")


def _each(table: DataFrame, step: Callable[[dict], Iterator[dict]], schema: str) -> DataFrame:
    """step over rows of blocks, whose columns are Arrow scalars, to columns of the schema (of simple names)."""
    names, order = table.columns, [c.split()[0].strip("`") for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for out in step(dict(zip(names, row, strict=True))):
                    yield pa.RecordBatch.from_pydict({k: pa.array(out[k]) if isinstance(out[k], list) else pa.array([out[k]], pa.binary()) for k in order})

    return table.mapInArrow(run, schema)


def total(table: DataFrame, work: Callable[[dict], np.ndarray], fan: int = 16) -> np.ndarray | float:
    """The sum of work(block) over all blocks: of each task's blocks where they are read, then of `fan` tasks' sums at a time."""
    names = table.columns

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                part = work(dict(zip(names, row, strict=True)))
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([np.asarray(out, float).tobytes()], pa.binary())})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for part in batch.column(0):
                value = np.frombuffer(part.as_buffer(), np.float64)
                out = value.copy() if out is None else out + value
        if out is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([out.tobytes()], pa.binary())})

    parts = stored(table.mapInArrow(first, "part binary"), "kernel-sums")
    n = parts.count()
    while n > fan:
        n = -(-n // fan)
        parts = stored(parts.repartition(n).mapInArrow(again, "part binary"), "kernel-sums")
    values = [np.frombuffer(r[0], np.float64) for r in parts.collect()]
    dropped(parts)
    return sum(values[1:], values[0].copy()) if values else np.zeros(0)


def _products(left: DataFrame, right: DataFrame, p: int, t: int, mix: Mix, both: bool) -> DataFrame:
    """Per block of left the product K(left, right) v (block, v). left: block, x; right: block, x, v. both: the sides are the same rows (left has v too), so each pair of blocks is met once."""
    slots = max(1, right.count())
    slotted = right.select(F.col("block").alias("other"), F.col("x").alias("x2"), F.col("v").alias("v2"), F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot"))
    spread = left.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).join(slotted, "slot")
    pairs = (spread.where("other >= block") if both else spread.withColumn("v", F.lit(None).cast("binary"))).select("block", "x", "v", "other", "x2", "v2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int64()), "part": pa.array([v.tobytes() for v in held.values()], pa.binary())})
            held.clear()

        for batch in batches:
            for block, x, v, other, x2, v2 in zip(*batch.columns, strict=True):
                a, b, right = _array(x, p), _array(x2, p), _array(v2, t)
                mirrored = both and block.as_py() != other.as_py()
                out, back = np.empty((len(a), t)), np.zeros((len(b), t))
                own = _array(v, t) if mirrored else None
                for i in range(0, len(a), STRIP):
                    k = mix.values(a[i : i + STRIP], b)
                    out[i : i + STRIP] = k @ right
                    if mirrored:
                        back += k.T @ own[i : i + STRIP]
                for name, part in ((block.as_py(), out), (other.as_py(), back if mirrored else None)):
                    if part is not None:
                        held[name] = held[name] + part if name in held else part
            if sum(v.nbytes for v in held.values()) > HELD:
                yield from sent()
        yield from sent()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, parts in zip(*batch.columns, strict=True):
                out = sum(np.frombuffer(v.as_buffer(), np.float64) for v in parts.values)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block.as_py()], pa.int64()), "v": pa.array([out.tobytes()], pa.binary())})

    partial = pairs.mapInArrow(run, "block long, part binary")
    return partial.groupBy("block").agg(F.collect_list("part").alias("parts")).mapInArrow(add, "block long, v binary")


@dataclass
class Landmarks:
    """Chosen rows x and half = W^-1/2 of their kernel: features(a) features(b)' is near K(a, b), exactly so if captured."""

    mix: Mix
    x: np.ndarray
    half: np.ndarray
    trace: float = 0.0
    left: float = 0.0
    #: What is left of the trace, rows counted by their weights.
    weighted: float = 0.0

    @property
    def captured(self) -> bool:
        return self.left <= CAPTURED * self.trace

    def features(self, a: np.ndarray) -> np.ndarray:
        return self.mix.values(a, self.x) @ self.half if len(self.x) else np.zeros((len(a), 0))

    def with_rows(self, more: np.ndarray) -> Landmarks:
        x = np.concatenate([self.x, more])
        value, vector = np.linalg.eigh(self.mix.values(x, x))
        if value[0] < -1e-9 * max(1.0, value[-1]):
            raise ValueError("the kernel is not positive semidefinite")
        kept = value > 1e-13 * max(value[-1], 1e-300)
        return Landmarks(self.mix, x, vector[:, kept] / np.sqrt(value[kept]))

    def pivots(self, a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the rows that pivoted Cholesky takes of the residual kernel, and each one's residual when taken."""
        f = self.features(a)
        rest, scale = self.mix.diagonal(a) - (f * f).sum(1), max(float(self.mix.diagonal(a).max(initial=0)), 1e-300)
        done = np.zeros((len(a), 0))
        at, size = [], []
        while len(at) < min(most, len(a)):
            i = int(rest.argmax())
            if rest[i] <= 1e-12 * scale:
                break
            at.append(i)
            size.append(float(rest[i]))
            column = self.mix.values(a, a[i : i + 1])[:, 0] - f @ f[i] - done @ done[i]
            done = np.column_stack([done, column / np.sqrt(rest[i])])
            rest = rest - done[:, -1] ** 2
        return np.array(at, np.int64), np.array(size)


def landmarks(rows: DataFrame, p: int, mix: Mix) -> Landmarks:
    """Landmarks of the packed rows, until they capture the kernel or are MOST_RANK."""
    found, more = Landmarks(mix, np.zeros((0, p)), np.zeros((0, 0))), FIRST_RANK
    while True:
        here = found

        def step(row: dict, here: Landmarks = here, most: int = more) -> Iterator[dict]:
            a = _array(row["x"], p)
            f = here.features(a)
            d = here.mix.diagonal(a)
            if (d < -1e-12).any():
                raise ValueError("the kernel is not positive semidefinite")
            # Residuals below rounding are none.
            rest = np.maximum(d - (f * f).sum(1), 0)
            yield {"size": [-1.0], "sums": np.array([d.sum(), rest.sum(), _array(row["w"], 1)[:, 0] @ rest]).tobytes(), "x": b""}
            at, size = here.pivots(a, most)
            for i, s in zip(at, size, strict=True):
                yield {"size": [s], "sums": b"", "x": a[i].tobytes()}

        told = stored(_each(rows.select("x", "w"), step, "size double, sums binary, x binary"), "kernel-candidates")
        sums = total(told.where("size < 0").select("sums"), lambda row: np.frombuffer(row["sums"].as_buffer(), np.float64))
        found.trace, found.left, found.weighted = map(float, sums) if len(sums) else (0.0, 0.0, 0.0)
        best = [] if found.captured or len(found.x) >= MOST_RANK else told.where("size > 0").orderBy(F.desc("size"), "x").limit(4 * more).select("x").collect()
        dropped(told)
        if not best:
            return found
        a = np.array([np.frombuffer(r[0], np.float64) for r in best])
        at, _ = found.pivots(a, min(more, MOST_RANK - len(found.x)))
        if not len(at):
            return found
        found = found.with_rows(a[at])
        more = min(len(found.x), MOST_RANK)


@dataclass
class Solution:
    """values(x) = K(x, points) weights + intercept; the points are landmarks, or all rows of the table `duals` (block, x, v)."""

    mix: Mix
    columns: int
    intercept: np.ndarray
    points: np.ndarray | None = None
    weights: np.ndarray | None = None
    duals: DataFrame | None = field(default=None, repr=False)
    rank: int = 0
    rounds: int = 0
    residual: float = 0.0

    def values(self, a: np.ndarray) -> np.ndarray:
        return self.mix.values(a, self.points) @ self.weights + self.intercept

    def predicted(self, df: DataFrame, x: list[Column], name: str) -> DataFrame:
        """df with the column `name`, an array of doubles."""
        t, p = len(self.intercept), self.columns
        if self.duals is None:
            head, kept = self, df.columns
            schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{name}` array<double>"])
            points = df.withColumn(name, F.array(*[c.cast("double") for c in x]))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    a = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)
                    out = np.concatenate([head.values(a[i : i + STRIP]) for i in range(0, len(a), STRIP)] or [np.zeros((0, t))])
                    column = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * t), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=[*kept, name])

            return points.mapInArrow(run, schema)
        numbered = stored(df.withColumn("_row", F.monotonically_increasing_id()), "kernel-asked")
        asked = packed(numbered, x, [], key=F.col("_row"))
        found = _products(asked.select("block", "x"), self.duals, p, t, self.mix, False)
        level = self.intercept

        def back(row: dict) -> Iterator[dict]:
            values = _array(row["v"], t) + level
            yield {"_row": np.frombuffer(row["key"].as_buffer(), np.int64).tolist(), name: values.tolist()}

        each = _each(asked.select("block", "key").join(found, "block"), back, f"_row long, `{name}` array<double>")
        return numbered.join(each, "_row").drop("_row")


def solve(rows: DataFrame, p: int, t: int, mix: Mix, alpha: float, intercept: bool, base: Landmarks | None = None) -> Solution:
    """Of packed rows with t values each. intercept: b is free and the duals sum to 0; else b is 0."""
    base = base or landmarks(rows, p, mix)
    r = base.half.shape[1]

    def sums(row: dict) -> np.ndarray:
        f, y, w = base.features(_array(row["x"], p)), _array(row["y"], t), _array(row["w"], 1)
        f = np.column_stack([f, np.ones(len(f)), y])
        return (f.T @ (w * f)).ravel()

    g = total(rows, sums)
    if not len(g):
        raise ValueError("no training rows")
    g = g.reshape(r + 1 + t, r + 1 + t)
    q = r + intercept
    system = g[:q, :q] + alpha * np.diag([1.0] * r + [0.0] * (q - r))
    theta = np.linalg.solve(system, g[:q, r + 1 :]) if q else np.zeros((0, t))
    level = theta[r] if intercept else np.zeros(t)
    near = Solution(mix, p, level, base.x, base.half @ theta[:r], rank=r)
    if base.captured and mix.linear:
        return near
    size = np.sqrt(np.maximum(np.diag(g)[r + 1 :], 1e-300))

    def start(row: dict) -> Iterator[dict]:
        x, y, w = _array(row["x"], p), _array(row["y"], t), _array(row["w"], 1)
        yield {"block": [row["block"].as_py()], "v": (w * (y - base.features(x) @ theta[:r] - level) / alpha).tobytes()}

    def bounds(row: dict) -> np.ndarray:
        x, y, w = _array(row["x"], p), _array(row["y"], t), _array(row["w"], 1)
        v = w * (y - base.features(x) @ theta[:r] - level) / alpha
        return np.append((v * v).sum(0), (w**8).sum())

    if base.captured:
        # K - F F' is positive semidefinite, so its norm is at most its trace; the largest weight is at most the root of the sum of powers.
        *norm, most = total(rows, bounds)
        near.residual = float((base.left * np.sqrt(np.array(norm)) * most ** (1 / 16) / size).max())
        if near.residual <= VERIFIED:
            return near
        duals = stored(rows.join(_each(rows, start, "block long, v binary"), "block"), "kernel-duals")
        product = _products(duals.select("block", "x", "v"), duals.select("block", "x", "v"), p, t, mix, True).withColumnRenamed("v", "k")

        def off(row: dict) -> np.ndarray:
            y, w = _array(row["y"], t), _array(row["w"], 1)
            miss = y - level - _array(row["k"], t) - alpha / w * _array(row["v"], t)
            return (w * miss * miss).sum(0)

        near.residual = float((np.sqrt(total(duals.join(product, "block"), off)) / size).max())
        dropped(duals)
        if near.residual <= VERIFIED:
            return near
    return _conjugate(rows, p, t, mix, alpha, intercept, base, g[:r, :r])


def _conjugate(rows: DataFrame, p: int, t: int, mix: Mix, alpha: float, intercept: bool, base: Landmarks, g: np.ndarray) -> Solution:
    """Conjugate gradients for all values (and for ones, if an intercept is to be found), preconditioned by the landmarks."""
    r, n = base.half.shape[1], t + intercept
    inner = np.linalg.inv(g + alpha * np.eye(r)) if r else np.zeros((0, 0))
    names = "block long, x binary, w binary, d binary, r binary, p binary"

    def begin(row: dict) -> Iterator[dict]:
        y = _array(row["y"], t)
        y = np.column_stack([y, np.ones(len(y))]) if intercept else y
        zero = np.zeros_like(y).tobytes()
        yield {"block": [row["block"].as_py()], "x": row["x"].as_py(), "w": row["w"].as_py(), "d": zero, "r": np.ascontiguousarray(y).tobytes(), "p": zero}

    def norms(row: dict) -> np.ndarray:
        """w r'r by column, then F'W r."""
        v, w = _array(row["r"], n), _array(row["w"], 1)
        return np.concatenate([(w * v * v).sum(0), (base.features(_array(row["x"], p)).T @ (w * v)).ravel()])

    state = stored(_each(rows, begin, names), "kernel-state")
    sums = total(state, norms)
    goal, beta, before, rounds = None, np.zeros(n), None, 0
    while True:
        size, u = sums[:n], sums[n:].reshape(r, n)
        goal = size * TOLERANCE**2 if goal is None else goal
        if (size <= goal).all() or rounds == ROUNDS:
            break
        rounds += 1
        s = inner @ u
        # The preconditioned residual's product with the residual follows from the sums; so does the next direction's weight.
        rz = (size - (u * s).sum(0)) / alpha
        beta = np.zeros(n) if before is None else np.where(before > 0, rz / np.maximum(before, 1e-300), 0.0)

        def turn(row: dict, s: np.ndarray = s, beta: np.ndarray = beta) -> Iterator[dict]:
            w = _array(row["w"], 1)
            z = w / alpha * (_array(row["r"], n) - base.features(_array(row["x"], p)) @ s)
            yield {k: row[k].as_py() for k in ("x", "w", "d", "r")} | {"block": [row["block"].as_py()], "p": (z + beta * _array(row["p"], n)).tobytes()}

        turned = stored(_each(state, turn, names).select("block", "x", "w", "d", "r", "p"), "kernel-state")
        way = turned.select("block", "x", F.col("p").alias("v"))
        both = stored(turned.join(_products(way, way, p, n, mix, True), "block"), "kernel-products")

        def along(row: dict) -> np.ndarray:
            v = _array(row["p"], n)
            return (v * (_array(row["v"], n) + alpha / _array(row["w"], 1) * v)).sum(0)

        pq = total(both, along)
        if ((pq <= 0) & (size > goal)).any():
            raise ValueError("the kernel is not positive semidefinite")
        step = np.where(size > goal, rz / np.maximum(pq, 1e-300), 0.0)

        def move(row: dict, step: np.ndarray = step) -> Iterator[dict]:
            v = _array(row["p"], n)
            q = _array(row["v"], n) + alpha / _array(row["w"], 1) * v
            yield {"block": [row["block"].as_py()], "x": row["x"].as_py(), "w": row["w"].as_py(), "d": (_array(row["d"], n) + step * v).tobytes(), "r": (_array(row["r"], n) - step * q).tobytes(), "p": row["p"].as_py()}

        after = stored(_each(both, move, names), "kernel-state")
        for done in (state, turned, both):
            dropped(done)
        state, before, sums = after, rz, total(after, norms)
    residual = float(np.sqrt(sums[:n] / np.maximum(goal / TOLERANCE**2, 1e-300)).max())
    if residual > VERIFIED:
        raise ValueError("the kernel system did not converge")
    level = np.zeros(t)
    if intercept:
        whole = total(state, lambda row: _array(row["d"], n).sum(0))
        level = whole[:t] / whole[t]

    def close(row: dict) -> Iterator[dict]:
        d = _array(row["d"], n)
        yield {"block": [row["block"].as_py()], "x": row["x"].as_py(), "v": np.ascontiguousarray(d[:, :t] - (d[:, t:] * level if intercept else 0.0)).tobytes()}

    duals = stored(_each(state, close, "block long, x binary, v binary").select("block", "x", "v"), "kernel-duals")
    dropped(state)
    return Solution(mix, p, level, duals=duals, rank=r, rounds=rounds, residual=residual)


def fit_softplus(rows: DataFrame, p: int, mix: Mix, alpha: float, gate: float = 1e-5, rounds: int = 200) -> tuple[Solution, dict]:
    """The nonnegative response log(1 + exp(eta)), eta of the kernel's span plus a free level, and the kernel's spectrum.

    Minimises half the squared error (by the rows' weights) plus alpha / 2 of eta's squared norm, by damped Newton steps on the landmarks' features
    from the ridge of the inverse responses; a step is one pass of sums. The kernel has to be captured by MOST_RANK landmarks,
    however many rows there are, and the gradient's largest entry has to pass the gate.
    """
    base = landmarks(rows, p, mix)
    if not base.captured:
        raise ValueError(f"the kernel has more than {MOST_RANK} dimensions")
    r = base.half.shape[1]

    def begin(row: dict) -> np.ndarray:
        f, y, w = base.features(_array(row["x"], p)), _array(row["y"], 1), _array(row["w"], 1)
        f = np.column_stack([f, np.ones(len(f)), np.log(np.expm1(np.maximum(y, 1e-6)))])
        return (f.T @ (w * f)).ravel()

    g = total(rows, begin)
    if not len(g):
        raise ValueError("no training rows")
    g = g.reshape(r + 2, r + 2)
    ridge = alpha * np.diag([1.0] * r + [0.0])
    theta = np.linalg.solve(g[:-1, :-1] + ridge, g[:-1, -1])

    def at(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(row: dict) -> np.ndarray:
            f, y, w = base.features(_array(row["x"], p)), _array(row["y"], 1)[:, 0], _array(row["w"], 1)[:, 0]
            f = np.column_stack([f, np.ones(len(f))])
            eta = f @ theta
            off, s = np.logaddexp(0, eta) - y, 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
            bend = w * np.maximum(s * s + off * s * (1 - s), 1e-3 * s * s)
            return np.concatenate([[0.5 * float(w @ (off * off))], f.T @ (w * off * s), (f.T @ (bend[:, None] * f)).ravel()])

        v = total(rows, sums)
        return float(v[0] + alpha / 2 * (theta[:-1] @ theta[:-1])), v[1 : r + 2] + ridge @ theta, v[r + 2 :].reshape(r + 1, r + 1) + ridge

    value, slope, bend = at(theta)
    n = 0
    while np.abs(slope).max() > gate * 1e-2 and n < rounds:
        way, t = -np.linalg.solve(bend + 1e-12 * np.trace(bend) / (r + 1) * np.eye(r + 1), slope), 1.0
        while True:
            n += 1
            after = at(theta + t * way)
            if after[0] <= value + 1e-4 * t * (way @ slope) or t < 1e-10:
                break
            t /= 2
        if after[0] > value:
            break
        theta, (value, slope, bend) = theta + t * way, after
    if np.abs(slope).max() > gate:
        raise ValueError("the fit did not reach its gradient gate")
    spectrum = np.linalg.eigvalsh(g[:r, :r]) if r else np.zeros(1)
    kept = spectrum > 1e-12 * max(spectrum[-1], 1e-300)
    told = {"rank": int(kept.sum()), "least_eigenvalue": float(spectrum[kept].min(initial=np.inf)), "largest_eigenvalue": float(spectrum[-1]), "reconstruction_error": base.weighted, "passes": n}
    return Solution(mix, p, theta[r:], base.x, (base.half @ theta[:r])[:, None], rank=r), told


@dataclass
class KernelHead:
    """Centred dual ridge over a weighted mix of linear and RBF kernels of blocks of columns.

    mix: (block, kind, weight); a linear kernel is divided by its block's mean squared row norm, an RBF uses
    exp(-gamma d2 / columns). Columns are standardised on training rows; constant columns count as 0, blocks of them as nothing.
    """

    blocks: dict[str, list[str]]
    mix: list[tuple[str, str, float]]
    gamma: float
    alpha: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    level: np.ndarray | None = None
    solution: Solution | None = None

    @property
    def columns(self) -> list[str]:
        return [c for b in self.blocks.values() for c in b]

    def _scaled(self) -> list[Column]:
        return [(F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)]

    def fit(self, df: DataFrame, targets: list[str]) -> KernelHead:
        from .heads import grams

        names = self.columns
        g = grams(df, [*names, *targets]).get(None)
        if g is None:
            raise ValueError("no training rows")
        mean, n = g.total / g.weight, len(names)
        spread = np.diag(g.product) / g.weight - mean**2
        floor = 1e-14 * np.maximum(np.diag(g.product) / g.weight, 1e-300)
        live = (spread > floor)[:n]
        self.mean, self.level = mean[:n], mean[n:]
        self.scale = np.where(live, np.sqrt(np.maximum(spread[:n], 0)), 1.0)
        parts, first = {}, 0
        for name, own in self.blocks.items():
            parts[name] = (first, first + len(own), int(live[first : first + len(own)].sum()))
            first += len(own)
        # After standardising, a block's mean squared row norm is the number of its columns that vary.
        mix = tuple((a, b, kind, weight, 1 / k if kind == "linear" else self.gamma / (b - a)) for name, kind, weight in self.mix for a, b, k in [parts[name]] if k)
        if not mix:
            raise ValueError("every block of this kernel is inactive")
        rows = packed(df, self._scaled(), [F.col(t) - F.lit(float(m)) for t, m in zip(targets, self.level, strict=True)])
        self.solution = solve(rows, n, len(targets), Mix(mix), self.alpha, False)
        dropped(rows)
        return self

    def predict(self, df: DataFrame, targets: list[str]) -> DataFrame:
        """df with `pred_<target>`."""
        out = self.solution.predicted(df, self._scaled(), "_kernel")
        return out.withColumns({f"pred_{t}": F.col("_kernel")[i] + F.lit(float(m)) for i, (t, m) in enumerate(zip(targets, self.level, strict=True))}).drop("_kernel")
