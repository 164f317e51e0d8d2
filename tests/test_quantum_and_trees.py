import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forests, trees
from tessera.sources import singlepoint as sp
from tessera.sources.contracts import Refused

Z, X = [8, 1, 1], [[0.0, 0.0, 0.1], [0.0, 0.75, -0.4], [0.0, -0.75, -0.4]]


def record(**change):
    q, own = np.array([-0.6, 0.3, 0.3]), np.array([[0.0, 0.0, 0.01], [0.0, 0.002, 0.0], [0.0, -0.002, 0.0]])
    only = q @ (np.array(X) / sp.BOHR)
    full = only + own.sum(0)
    line = lambda v: " ".join(f"{a:.3f}" for a in v)
    setup = "\n".join(f"          :  {k:<22} {v}{' K' if k == 'electronic temp.' else ''}   :" for k, v in sp.PROTOCOL.items())
    table = "   #   Z          covCN         q      C6AA      α(0)\n" + "".join(f"   {i + 1}  {z} {'O' if z == 8 else 'H'}  1.0  {c:.3f}  2.0  3.0\n" for i, (z, c) in enumerate(zip(Z, q, strict=True)))
    out = f"{setup}\n convergence criteria satisfied after 9 iterations\n{table}\n Mol. C6AA /au·bohr⁶  : 44.5\n Mol. C8AA /au·bohr⁸ : 7.9D+02\n Mol. α(0) /au : 9.45\n q only: {line(only)}\n   full: {line(full)} {np.linalg.norm(full) * sp.DEBYE:.3f}\n"
    body = {"method": "GFN2-xTB", "xtb version": sp.VERSION, "number of electrons": 8, "number of unpaired electrons": 0, "partial charges": q.tolist(), "dipole / a.u.": full.tolist(), "atomic dipole moments": own.tolist(), "HOMO-LUMO gap / eV": 14.4}
    return change.get("out", lambda t: t)(out), change.get("err", "normal termination of xtb"), change.get("text", json.dumps(body | change.get("body", {})))


def test_a_record_is_read():
    got = sp.read_singlepoint(*record(), Z, X)
    assert got["alpha"] == 9.45 and got["c8"] == 790.0 and got["gap_ev"] == 14.4 and not got["metadata_line_dropped"]
    broken = record()[2].replace("{", '{\n"program call": "a\\b\\c",\n', 1)
    assert sp.read_singlepoint(record()[0], record()[1], broken, Z, X, repair=True)["metadata_line_dropped"]
    with pytest.raises(Refused):
        sp.read_singlepoint(record()[0], record()[1], broken, Z, X)


@pytest.mark.parametrize("change", [
    {"err": ""}, {"out": lambda t: t + "\nERROR\n"}, {"out": lambda t: t.replace("300.0", "310.0")}, {"out": lambda t: t + " Mol. α(0) /au : 9.45\n"}, {"out": lambda t: t.replace("q only: ", "q only: 1")}, {"out": lambda t: t.replace("   3  1 H", "   3  6 C")},
    {"body": {"xtb version": "1"}}, {"body": {"number of electrons": 9}}, {"body": {"partial charges": [0.1, 0.3, 0.3]}}, {"body": {"HOMO-LUMO gap / eV": True}}, {"text": '{"a": 1, "a": 2}'},
])
def test_faults(change):
    with pytest.raises(Refused):
        sp.read_singlepoint(*record(**change), Z, X)


def test_rows_and_means(spark):
    out, err, text = record()
    rows = [("m", i, 10.0, out, err, text + " " * i, Z, X) for i in range(3)] + [("n", i, 10.0, out, err if i else "", text, Z, X) for i in range(3)]
    df = spark.createDataFrame(rows, "mol string, i int, volume double, stdout string, stderr string, json string, atomic_numbers array<int>, positions array<array<double>>")
    got = sp.singlepoints(df)
    assert got.where("fault IS NOT NULL").count() == 1 and got.count() == 6
    (one,) = sp.conformer_means(got, ["mol"], "volume").collect()
    assert one.mol == "m" and abs(one.alpha_per_volume_mean - 0.945) < 1e-12 and one.gap_ev_std == 0


def test_ensembles_as_arrays(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2)).astype(np.float32).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(a * 2 + (b > 0))) for a, b in x], "a double, b double, y double")
    for fit in (lambda: trees.fit_boosted(df, ["a", "b"], "y", trees=5), lambda: trees.fit_forest(df, ["a", "b"], "y", trees=5)):
        found = json.loads(json.dumps(fit()))
        got = trees.predict_trees(df, found, "p").agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0]
        assert got < np.var(x[:, 0] * 2 + (x[:, 1] > 0)) / 2


def wave(spark, n=240):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, size=(n, 3)).astype(np.float32).astype(float)
    y = np.column_stack([np.sin(2 * x[:, 0]) + x[:, 1] ** 2, 3 + np.abs(x[:, 2])])
    return x, y, spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, u double, v double")


def test_extra_trees(spark, monkeypatch):
    x, y, df = wave(spark)
    small = dict(trees=20, depth=8, leaf=2, tries=2, seed=1)
    state = json.loads(json.dumps(forests.fit_extra_trees(df.repartition(3), ["a", "b", "c"], ["u", "v"], **small)))
    got = forests.predicted(df, state).toPandas()[["pred_u", "pred_v"]].to_numpy()
    for t in state["trees"]:
        at = forests._leaves(x.astype(np.float32), t)
        for node in np.unique(at):
            assert (at == node).sum() >= small["leaf"] and np.allclose(t["value"][node], y[at == node].mean(0))
    assert ((got - y) ** 2).mean(0).max() < 0.25 * y.var(0).max()
    monkeypatch.setattr(forests, "TOGETHER", 3)
    again = forests.fit_extra_trees(df, ["a", "b", "c"], ["u", "v"], **small)
    assert [t["threshold"] for t in again["trees"]] == [t["threshold"] for t in state["trees"]]
    with pytest.raises(ValueError):
        forests.predicted(df, state | {"root": True})
    with pytest.raises(ValueError):
        forests.fit_extra_trees(df.withColumn("a", F.lit(float("nan"))), ["a"], ["u"])


def test_positive_forests(spark):
    _, y, df = wave(spark)
    with pytest.raises(ValueError):
        forests.fit_positive_forests(df, ["a"], ["u"])
    plain, root = (forests.fit_positive_forests(df, ["a", "b", "c"], ["v"], squared=s, trees=10, depth=6)[0] for s in (False, True))
    for state in (plain, root):
        got = forests.predicted(df, state).toPandas()["pred_v"].to_numpy()
        assert (got >= 3).all() and ((got - y[:, 1]) ** 2).mean() < 0.2 * y[:, 1].var()
    constant = forests.fit_extra_trees(df.withColumn("v", F.lit(2.0)), ["a"], ["v"], trees=1)
    assert constant["trees"][0]["left"] == [-1] and constant["trees"][0]["value"] == [[2.0]]


def test_network(spark):
    x, y, df = wave(spark)
    state = json.loads(json.dumps(forests.fit_network(df, ["a", "b", "c"], ["u", "v"], 12, 0.01, rounds=400, gate=1e-3)))
    got = forests.predicted(df, state).toPandas()[["pred_u", "pred_v"]].to_numpy()
    assert ((got - y) ** 2).mean(0).max() < 0.05 * y.var(0).max() and state["converged"]
    short = forests.fit_network(df, ["a"], ["u"], 2, 0.1, rounds=3)
    far = forests.fit_network(df.repartition(3), ["a"], ["u"], 2, 0.1, rounds=3)
    assert not short["converged"] and np.allclose(np.ravel(short["weights"][0]), np.ravel(far["weights"][0]))


def test_sums_by_a_shuffle_are_the_same(spark, monkeypatch):
    _, _, df = wave(spark, 90)
    small = dict(trees=2, depth=3, leaf=3, seed=1)
    few = forests.fit_extra_trees(df.repartition(3), ["a", "b", "c"], ["u", "v"], **small)
    monkeypatch.setattr(forests, "FEW_TASKS", 0)
    many = forests.fit_extra_trees(df.repartition(3), ["a", "b", "c"], ["u", "v"], **small)
    assert [t["threshold"] for t in few["trees"]] == [t["threshold"] for t in many["trees"]]


def test_leafwise_boosting(spark):
    x, y, df = wave(spark)
    state = json.loads(json.dumps(forests.fit_leafwise(df, ["a", "b", "c"], ["u", "v"], trees=40, rate=0.2)))
    for i, s in enumerate(state):
        got = forests.predicted(df, s).toPandas()[f"pred_{s['targets'][0]}"].to_numpy()
        assert ((got - y[:, i]) ** 2).mean() < 0.1 * y[:, i].var() and len(s["trees"]) == 40
        for t in s["trees"]:
            at, n = np.unique(forests._leaves(x.astype(np.float32).astype(float), t), return_counts=True)
            assert len(at) <= 7 and n.min() >= 8
    # One tree of two leaves at full rate: the best split of all, by brute force.
    (one,) = forests.fit_leafwise(df, ["a"], ["v"], trees=1, leaves=2, least=1, rate=1.0)
    def loss(e, a=x[:, 0], v=y[:, 1]):
        return sum(((v[m] - v[m].mean()) ** 2).sum() for m in (a <= e, a > e))
    values = np.sort(x[:, 0])
    assert loss(one["trees"][0]["threshold"][0]) == pytest.approx(min(map(loss, (values[1:] + values[:-1]) / 2)))
    flat = forests.fit_leafwise(df.withColumn("v", F.lit(1.5)), ["a"], ["v"])[0]
    assert flat["trees"] == [] and forests.predicted(df.select("a"), flat).agg(F.min("pred_v"), F.max("pred_v")).first()[:] == (1.5, 1.5)
    small = dict(trees=2, leaves=4)
    assert len(forests.edges_of(df, "a", 16)) == 15 and len(forests.edges_of(df, "a", 255)) == 239
    near = forests.fit_leafwise(df, ["a", "b"], ["u"], **small)[0]
    far = forests.fit_leafwise(df.repartition(3), ["a", "b"], ["u"], **small)[0]
    assert [t["threshold"] for t in near["trees"]] == [t["threshold"] for t in far["trees"]]
