"""Logistic regression with a category of any number of values, against dense Newton steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import components, sparse


def dense(x, c, y, w, alpha):
    z = (x - x.mean(0)) / x.std(0)
    names = sorted(set(c))
    d = np.column_stack([np.ones(len(y)), z, *[[v == n for v in c] for n in names]]).astype(float)
    w, t = w / w.sum(), np.zeros(d.shape[1])
    ridge = alpha * np.append([0.0], np.ones(d.shape[1] - 1))
    for _ in range(50):
        s = 1 / (1 + np.exp(-(d @ t)))
        t -= np.linalg.solve(d.T @ (d * (w * s * (1 - s))[:, None]) + np.diag(ridge), d.T @ (w * (s - y)) + ridge * t)
    return d @ t


@pytest.mark.parametrize("hot", [False, True])
def test_equals_dense_newton(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(components, "HEAVY", 4)
    r = np.random.default_rng(8)
    n = 300
    x, c, w = r.normal(size=(n, 2)), [f"k{0 if i % 2 else i % 13}" for i in range(n)], r.uniform(0.5, 2, n)
    y = (x[:, 0] + r.normal(size=n) > 0.3).astype(int)
    df = spark.createDataFrame([(i, *map(float, a), k, int(b), float(v)) for i, (a, k, b, v) in enumerate(zip(x, c, y, w, strict=True))], "i int, a double, b double, k string, y int, w double").repartition(3)
    head = sparse.fit_categories(df, ["a", "b"], "y", "w", 0.01, "k")
    got = {r.i: r.logit for r in head.predict(df).collect()}
    assert np.allclose([got[i] for i in range(n)], dense(x, c, y, w, 0.01), atol=1e-6) and head.rounds < 15


def test_refusals_and_reasons(spark):
    df = spark.createDataFrame([(float(i), i % 2, f"k{i % 3}", 1.0) for i in range(30)], "a double, y int, k string, w double")
    head = sparse.fit_categories(df, ["a"], "y", "w", 0.1, "k")
    odd = spark.createDataFrame([(1.0, "k1"), (None, "k1"), (1.0, "new"), (1.0, None), (float("inf"), "new")], "a double, k string")
    assert sorted(str(r.reason) for r in head.predict(odd).collect()) == ["None", "nonfinite_query_features", "nonfinite_query_features", "unsupported_category", "unsupported_category"]
    for bad, message in ((df.withColumn("k", F.when(F.col("a") > 3, "x")), "missing categories"), (df.where("y = 1"), "both classes"), (df.withColumn("a", F.lit(float("nan"))), "nonfinite")):
        with pytest.raises(ValueError, match=message):
            sparse.fit_categories(bad, ["a"], "y", "w", 0.1, "k")


def test_a_million_categories(spark):
    rows = spark.range(1_500_000).select((F.col("id") % 1_000_000).alias("k"), (F.col("id") % 10 / 10).alias("x"), (F.hash("id") % 3 == 0).cast("int").alias("y"), F.lit(1.0).alias("w"))
    head = sparse.fit_categories(rows, ["x"], "y", "w", 1e-3, "k")
    assert head.table.count() == 1_000_000 and head.gradient <= 1e-5
    assert head.predict(rows).where("reason IS NOT NULL").limit(1).count() == 0
