"""Kernel heads at any number of rows, against dense solves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import kernels


def table(spark, x, y):
    return spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "i long, a double, b double, c double, y double").repartition(3)


def dense(x, y, weights, gamma, alpha):
    z = (x - x.mean(0)) / x.std(0)
    k = weights[0] * z[:, :2] @ z[:, :2].T / (z[:, :2] ** 2).sum(1).mean() + weights[1] * np.exp(-gamma * kernels.distances(z[:, 2:], z[:, 2:]))
    return k @ np.linalg.solve(k + alpha * np.eye(len(y)), y - y.mean()) + y.mean()


def head(weights, gamma, alpha):
    return kernels.KernelHead({"p": ["a", "b"], "q": ["c"]}, [("p", "linear", weights[0]), ("q", "rbf", weights[1])], gamma, alpha)


@pytest.mark.parametrize("rank,block", [(1024, 4096), (1024, 16), (8, 16), (0, 50)])
def test_equals_a_dense_solve(spark, monkeypatch, rank, block):
    """By landmarks that capture the kernel, and by conjugate gradients with few of them or none."""
    monkeypatch.setattr(kernels, "MOST_RANK", rank)
    monkeypatch.setattr(kernels, "BLOCK", block)
    monkeypatch.setattr(kernels, "FIRST_RANK", 8)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(90, 3)), rng.normal(size=90)
    df = table(spark, x, y)
    fitted = head((0.4, 0.6), 0.5, 0.1).fit(df, ["y"])
    got = {r.i: r.pred_y for r in fitted.predict(df, ["y"]).collect()}
    assert np.allclose([got[i] for i in range(90)], dense(x, y, (0.4, 0.6), 0.5, 0.1), atol=1e-6)
    assert (fitted.solution.rounds > 0) == (rank < 90) and fitted.solution.residual <= 1e-6
    assert fitted.predict(df.limit(0), ["y"]).collect() == []


def test_weights_and_intercept(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, y, w = rng.normal(size=(60, 2)), rng.normal(size=60), rng.uniform(0.2, 2, 60)
    df = spark.createDataFrame([(*map(float, a), float(b), float(c)) for a, b, c in zip(x, y, w, strict=True)], "a double, b double, y double, w double")
    k = np.exp(-0.7 * kernels.distances(x, x))
    system = np.ones((61, 61))
    system[:60, :60], system[60, 60] = k + np.diag(0.3 / w), 0
    want = np.linalg.solve(system, np.append(y, 0))
    for rank in (1024, 12):
        monkeypatch.setattr(kernels, "MOST_RANK", rank)
        rows = kernels.packed(df, [F.col("a"), F.col("b")], [F.col("y")], F.col("w"))
        found = kernels.solve(rows, 2, 1, kernels.Mix(((0, 2, "rbf", 1.0, 0.7),)), 0.3, True)
        got = np.array([r.v for r in found.predicted(df, [F.col("a"), F.col("b")], "v").collect()])[:, 0]
        at = {tuple(r): i for i, r in enumerate(x)}
        order = [at[(r.a, r.b)] for r in df.collect()]
        assert np.allclose(sorted(got), sorted((k @ want[:60] + want[60])[order]), atol=1e-6) and found.intercept[0] == pytest.approx(want[60], abs=1e-6)


def test_refusals(spark):
    rng = np.random.default_rng(3)
    df = table(spark, rng.normal(size=(30, 3)), rng.normal(size=30))
    with pytest.raises(Exception, match="positive semidefinite"):
        head((0.4, -0.6), 0.5, 0.1).fit(df, ["y"])
    with pytest.raises(ValueError, match="inactive"):
        head((0.4, 0.6), 0.5, 0.1).fit(df.withColumns({c: F.lit(1.0) for c in "abc"}), ["y"])
    with pytest.raises(ValueError, match="no training rows"):
        head((0.4, 0.6), 0.5, 0.1).fit(df.limit(0), ["y"])
    with pytest.raises(Exception, match="nonfinite"):
        head((0.4, 0.6), 0.5, 0.1).fit(df.withColumn("a", F.lit(float("nan"))), ["y"])


def test_a_hundred_thousand_rows(spark):
    """A linear and a smooth kernel of 10^5 rows: captured by few landmarks, held to the residual of the whole system by KernelHead."""
    n = 100_000
    df = spark.range(n).select("id", (F.col("id") % 1000 / 1000).alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.floor(F.col("id") / 1000) % 10).cast("double").alias("c"))
    df = df.withColumn("y", F.sin("a") + 0.1 * F.col("b") + F.col("c") % 3)
    linear = kernels.KernelHead({"p": ["a", "b"]}, [("p", "linear", 1.0)], 1.0, 1.0).fit(df, ["y"])
    assert linear.solution.rank == 2 and linear.solution.duals is None
    smooth = kernels.KernelHead({"q": ["c"]}, [("q", "rbf", 1.0)], 1.0, 1.0).fit(df, ["y"])
    assert smooth.solution.rank <= 10 and smooth.solution.residual <= 1e-6
    got = sorted(smooth.predict(df, ["y"]).groupBy("c").agg(F.avg("pred_y").alias("p"), F.avg("y").alias("y")).collect())
    # Rows of one value share a prediction: the system of the values' means is a small one.
    c, mean = np.array([r.c for r in got]), np.array([r.y for r in got])
    k = np.exp(-kernels.distances(*[((c - c.mean()) / c.std())[:, None]] * 2))
    want = k @ np.linalg.solve(k + np.eye(10) / 10_000, mean - mean.mean()) + mean.mean()
    assert np.allclose([r.p for r in got], want, atol=1e-6)


@pytest.mark.parametrize("block", [4096, 30])
def test_softplus_response(spark, monkeypatch, block):
    monkeypatch.setattr(kernels, "BLOCK", block)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(80, 2)), np.abs(rng.normal(size=80))
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double")
    rows, mix = kernels.packed(df, [F.col("a"), F.col("b")], [F.col("y")]), kernels.Mix(((0, 2, "rbf", 1.0, 0.3),))
    found, told = kernels.fit_softplus(rows, 2, mix, 0.1)
    eta = found.values(x)[:, 0]
    k = np.exp(-0.3 * kernels.distances(x, x))
    # At the least value the kernel's own gradient is zero: alpha times the dual is minus the residual's slope.
    slope = (np.logaddexp(0, eta) - y) / (1 + np.exp(-eta))
    dual = -slope / 0.1
    assert np.allclose(k @ dual + found.intercept[0], eta, atol=1e-4) and abs(slope.sum()) < 1e-4
    value = np.linalg.eigvalsh(k)
    assert told["largest_eigenvalue"] == pytest.approx(value[-1]) and told["reconstruction_error"] < 1e-6 and 20 < told["rank"] <= 80
    monkeypatch.setattr(kernels, "MOST_RANK", 5)
    with pytest.raises(ValueError, match="dimensions"):
        kernels.fit_softplus(rows, 2, mix, 0.1)


def test_equal_rows_are_packed_once(spark):
    df = spark.range(0, 200_000, 1, 2).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 10).cast("double").alias("y"))
    rows, mix = kernels.packed(df, [F.col("x")], [F.col("y")]), kernels.Mix(((0, 1, "rbf", 1.0, 0.5),))
    held = rows.select(F.sum(F.octet_length("w") / 8)).first()[0]
    assert held <= 20 and kernels.total(rows, lambda r: np.frombuffer(r["w"].as_buffer()).sum(keepdims=True)) == [200_000]
    found, told = kernels.fit_softplus(rows, 1, mix, 1e-6)
    # Almost without penalty both values' responses are their means; the spectrum is that of all rows.
    assert np.allclose(np.logaddexp(0, found.values(np.array([[0.0], [1.0]])))[:, 0], [4, 5], atol=1e-6)
    assert told["largest_eigenvalue"] == pytest.approx(100_000 * (1 + np.exp(-0.5)))
