"""Nested selection in a few passes, against a fit for every fold of every fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import components, grouping, heads, nested
from tessera.storage import stored


def by_fits(df, features: list[str], embedding: list[str], targets: list[str], family: str, alphas: tuple[float, ...] = heads.ALPHAS, seed: int = 42) -> dict:
    """A fit for every fold of every fold, one after another."""
    if df.select(family).distinct().limit(5).count() < 5:
        raise ValueError("nested selection needs at least five families")
    candidates: list[object] = ["none", "constant", *sorted({float(a) for a in alphas}, reverse=True)]
    dealt = stored(df.join(grouping.hash_folds(df, family, 5, seed, "outer"), family), "outer-folds")

    def residuals(rows) -> tuple[heads.LinearHead, object]:
        """The selected chemistry head of rows, and rows with their out-of-fold residuals."""
        inner = stored(rows.join(grouping.hash_folds(rows, family, 4, 42, "inner").withColumnRenamed("fold", "inner"), family), "inner-folds")
        out = None
        for k in range(4):
            p = heads.select_ridge(inner.where(F.col("inner") != k).drop("fold"), features, targets, family, alphas, seed=seed).head.predict()
            held = inner.where(F.col("inner") == k).withColumns({f"residual_{t}": F.col(t) - p[t] for t in targets})
            out = held if out is None else out.unionByName(held)
        return heads.select_ridge(rows.drop("fold"), features, targets, family, alphas, seed=seed).head, out.drop("inner")

    errors = []
    for k in range(5):
        base, rest = residuals(dealt.where(F.col("fold") != k))
        g = heads.grams(rest, [*embedding, *[f"residual_{t}" for t in targets]])[None]
        p = base.predict()
        held = dealt.where(F.col("fold") == k)
        columns = {}
        for i, c in enumerate(candidates):
            extra = heads.LinearHead.solve(g, embedding, [f"residual_{t}" for t in targets], c).predict() if isinstance(c, float) else None
            for j, t in enumerate(targets):
                more = F.lit(0.0) if c == "none" else F.lit(float(g.total[len(embedding) + j] / g.weight)) if c == "constant" else extra[f"residual_{t}"]
                columns[f"e{i}_{j}"] = F.abs(F.col(t) - p[t] - more)
        errors.append(held.select(family, *[v.alias(n) for n, v in columns.items()]))
    every = errors[0]
    for e in errors[1:]:
        every = every.unionByName(e)
    names = every.columns[1:]
    macro = every.groupBy(family).agg(*[F.avg(n).alias(n) for n in names]).agg(*[F.avg(n).alias(n) for n in names]).first()
    scores = {t: [macro[f"e{i}_{j}"] for i in range(len(candidates))] for j, t in enumerate(targets)}
    chosen = {t: next(i for i, s in enumerate(v) if s <= min(v) + heads.TIE) for t, v in scores.items()}
    base, rest = residuals(dealt)
    g = heads.grams(rest, [*embedding, *[f"residual_{t}" for t in targets]])[None]
    found = {}
    for j, t in enumerate(targets):
        c = candidates[chosen[t]]
        h = heads.LinearHead.solve(g, embedding, [f"residual_{t}" for t in targets], c if isinstance(c, float) else 1.0)
        coef = h.coef[j] if isinstance(c, float) else [0.0] * len(embedding)
        found[t] = {"candidate": c, "coef": coef, "intercept": 0.0 if c == "none" else h.intercept[j]}
    return {"base": base.state(), "residual": found, "candidates": candidates, "scores": scores, "independent_accuracy_validated": False}


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    x, family = r.normal(size=(160, 4)), r.integers(0, 24, 160)
    u, v = x[:, 0] * 2 + x[:, 2] * 1.5 + r.normal(size=160) * 0.2, r.normal(size=160) + 3
    return spark.createDataFrame([(*map(float, a), float(b), float(c), f"f{k}") for a, b, c, k in zip(x, u, v, family, strict=True)], "a double, b double, e0 double, e1 double, u double, v double, family string").repartition(3)


def test_same_choice_as_by_fits(spark, rows, monkeypatch):
    arguments = (["a", "b"], ["e0", "e1"], ["u", "v"], "family", (100.0, 0.1))
    want, got = by_fits(rows, *arguments), nested.select_hybrid(rows, *arguments)
    assert got["base"]["coef"] == [pytest.approx(c) for c in want["base"]["coef"]] and got["candidates"] == want["candidates"]
    for t in ("u", "v"):
        assert got["scores"][t] == pytest.approx(want["scores"][t])
        assert got["residual"][t]["candidate"] == want["residual"][t]["candidate"] and got["residual"][t]["coef"] == pytest.approx(want["residual"][t]["coef"])
    # Hot families are looked up where their rows are.
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "HEAVY", 10)
    assert nested.select_hybrid(rows, *arguments)["scores"]["u"] == pytest.approx(want["scores"]["u"])


def test_refusals(rows):
    for bad, message in ((rows.withColumn("family", F.lit("one")), "five families"), (rows.withColumn("a", F.lit(float("nan"))), "nonfinite")):
        with pytest.raises(ValueError, match=message):
            nested.select_hybrid(bad, ["a"], ["e0"], ["u"], "family")
    with pytest.raises(ValueError, match="penalties"):
        nested.select_hybrid(rows, ["a"], ["e0"], ["u"], "family", alphas=())


def test_rows_are_spread_by_their_size(spark, monkeypatch):
    from tessera.operators import forests

    monkeypatch.setattr(forests, "TASK_BYTES", 8000, raising=False)
    rows = forests.Rows(spark.range(0, 5000, 1, 1).selectExpr("id AS a", "id % 3 AS b"), ["a", "b"])
    assert rows.tasks == 10 and rows.total(lambda d: {0: d.sum(0)}, 1 << 30)[0].tolist() == [5000 * 4999 / 2, 4999]
    rows.close()
