import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cells, heads, kernels, models, nested

FEATURES, EMBEDDING, TARGETS = ["a", "b"], ["e0", "e1"], ["u"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 4))
    u = 10 + x @ [1.0, -0.5, 0.8, 0.0] + rng.normal(size=160) * 0.05
    data = [(f"r{i}", f"f{i % 16}", *map(float, v), float(t), []) for i, (v, t) in enumerate(zip(x, u, strict=True))]
    return spark.createDataFrame(data, "sample_id string, family string, a double, b double, e0 double, e1 double, u double, scope array<string>").persist()


def test_train_calibrate_evaluate_predict(spark, rows):
    out = models.train_and_report(rows, FEATURES, EMBEDDING, TARGETS, "family", "synthetic")
    mae = {m: r["report"]["components"]["u"]["mae"] for m, r in out["models"].items()}
    assert mae["C"] < mae["A"] and not out["models"]["A"]["report"]["real_accuracy_validated"]
    assert sum(s["groups"] for s in out["split"].values()) == 16
    # Three calibration families are too few for a radius at 0.2; at 0.5 they are enough.
    assert out["models"]["C"]["state"]["radius"] == {"u": None} and not out["models"]["C"]["report"]["coverage"]
    model = models.Model.restore(out["models"]["C"]["state"])
    with pytest.raises(ValueError):
        models.Model.restore(out["models"]["C"]["state"] | {"mode": "A"})
    wide = models.evaluate(models.calibrate(models.Model.restore(out["models"]["A"]["state"]), rows, "family", "synthetic", 0.5), rows, "family", "synthetic")
    assert 0.5 <= wide["coverage"]["u"]["group_coverage"] <= 1
    model.radius = {"u": 0.5}
    far = rows.limit(1).withColumn("a", F.lit(1e6)).withColumn("sample_id", F.lit("far"))
    bad = rows.limit(1).withColumn("scope", F.array(F.lit("ionic_not_validated"))).withColumn("sample_id", F.lit("bad"))
    got = {r.sample_id: r for r in models.predictions(model, rows.where("sample_id = 'r3'").unionByName(far).unionByName(bad)).collect()}
    assert got["far"].status == "out_of_domain" and got["far"].u_value is None and got["far"].reasons == ["feature_extrapolation"]
    assert got["bad"].status == "unsupported" and got["bad"].reasons == ["ionic_not_validated"]
    assert got["r3"].status in ("synthetic_demo", "out_of_domain")
    if got["r3"].u_value is not None:
        assert abs(got["r3"].u_upper - got["r3"].u_lower - 1) < 1e-9
    with pytest.raises(ValueError):
        models.calibrate(model, rows, "family", "experimental")
    with pytest.raises(ValueError):
        models.evaluate(model, rows, "family", "teacher_reproduction")
    with pytest.raises(ValueError):
        models.isolated(rows, rows, ["family"])


def test_auxiliary_and_hybrid(rows):
    found = models.auxiliary_fit(rows, "sample_id", FEATURES, TARGETS, [F.col("family")], [rows.where("family = 'f0'").select("family")], "family")
    assert found["rows"] == 150 and found["metrics"]["u"]["rows"] > 0
    out = nested.select_hybrid(rows, FEATURES, EMBEDDING, TARGETS, "family", alphas=(100.0, 0.1))
    assert out["residual"]["u"]["candidate"] == 0.1 and out["scores"]["u"][0] > min(out["scores"]["u"])
    flat = nested.select_hybrid(rows.withColumn("u", F.lit(2.0)), FEATURES, EMBEDDING, TARGETS, "family", alphas=(1.0,))
    assert flat["residual"]["u"] == {"candidate": "none", "coef": [0.0, 0.0], "intercept": 0.0}


def test_fusion_equals_decomposition(rows):
    f = models.Fusion.fit(rows, FEATURES, EMBEDDING)
    got = rows.select(*[v.alias(n) for n, v in f.columns().items()]).toPandas().to_numpy()
    x = rows.select(*FEATURES, *EMBEDDING).toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    u, s, vt = np.linalg.svd(z[:, 2:], full_matrices=False)
    assert np.allclose(got[:, :2], z[:, :2]) and np.allclose(np.abs(got[:, 2:]), np.abs(u * np.sqrt(len(x))), atol=1e-6)


def test_scalar_head(spark, rows):
    names = FEATURES + EMBEDDING
    head, scores = models.select_scalar(rows, names, "u", "family")
    x = rows.select(*names).toPandas().to_numpy()
    assert len(scores) == 6 and not head.predicted(rows, "p").where("NOT p > 0").count()
    assert models.select_scalar(rows, names, "u", "family", models.SCALAR_GRID[:3])[1] == pytest.approx(scores[:3])
    y, g = np.exp(x @ [0.1, 0.2, 0.0, 0.0]), np.array([f"f{i % 7}" for i in range(len(x))])
    df = spark.createDataFrame([(*map(float, a), float(b), k) for a, b, k in zip(x, y, g, strict=True)], "a double, b double, e0 double, e1 double, y double, g string")
    ridge = models.fit_scalar(df, names, "y", "g", "ridge", 0.1)
    w = np.array([1 / (7 * (g == k).sum()) for k in g])
    z = (x - w @ x) / np.sqrt(w @ (x - w @ x) ** 2)
    r = np.log(y) - w @ np.log(y)
    stacked = np.linalg.lstsq(np.vstack([z * np.sqrt(w)[:, None], np.sqrt(0.1) * np.eye(4)]), np.append(r * np.sqrt(w), np.zeros(4)), rcond=None)[0]
    assert np.allclose(ridge.linear.coef[0], stacked)
    got = df.select(ridge.column().alias("p")).toPandas()["p"].to_numpy()
    assert np.allclose(got, np.exp(z @ stacked + w @ np.log(y)))
    for bad in (df.withColumn("y", -F.col("y")), df.withColumns({c: F.lit(0.0) for c in names}), df.withColumn("a", F.lit(float("nan"))), df.limit(0)):
        with pytest.raises(ValueError):
            models.fit_scalar(bad, names, "y", "g", "ridge", 0.1)
    kernel = models.fit_scalar(df, names, "y", "g", "rbf", 0.1)
    # The same by a kernel centred under the weights, and a ridge around the weighted mean.
    k = np.exp(-kernels.distances(z, z) / 4)
    centre = np.eye(len(x)) - np.outer(np.ones(len(x)), w)
    inner = centre @ k @ centre.T
    dual = np.linalg.solve(inner + 0.1 * np.diag(1 / w), r)
    assert np.allclose(kernel.predicted(df, "p").toPandas()["p"], np.exp(inner @ dual + w @ np.log(y)), rtol=1e-6)


def test_sites_and_cells(spark):
    d = spark.createDataFrame([("m", 0, 0.0, 0.0, 0.0, [0, 1, 2, 3])], "mol string, place int, x double, y double, z double, path array<int>")
    a = spark.createDataFrame([("m", 3, 3.0, 0.0, 0.0), ("m", 1, 9.0, 0.0, 0.0), ("m", 0, 0.0, 0.0, 0.0)], "mol string, place int, x double, y double, z double")
    assert models.site_bands(d, a, "mol").first()[:] == ("m", 1, 1)
    cell = [("f", 0, "p", 0.5, 0.3, 0.2, 0.0, 0.0, 0.0), ("f", 1, "p", -0.5, 0.3, 0.2, 0.1, 0.0, 0.0), ("f", 2, "q", 0.0, 0.3, 0.2, 0.5, 0.0, 0.0)]
    particles = spark.createDataFrame(cell, "frame string, place int, molecule string, charge double, sigma double, epsilon double, x double, y double, z double")
    none = spark.createDataFrame([], "place_a int, place_b int")
    got = models.frame_cohesion(particles, none, 1.0).first()
    lj = sum(4 * 0.2 * ((0.3 / r) ** 12 - (0.3 / r) ** 6) for r in (0.5, 0.4))
    assert abs(got.lj - lj) < 1e-12 and got.coulomb == 0
    with pytest.raises(ValueError):
        models.frame_cohesion(particles.where("place <> 1"), none, 1.0)
    assert heads.ALPHAS[0] == 0.01


def test_periodic_cells(spark):
    # Rock salt: the sum over all images is Madelung's constant, whatever the cutoff.
    place = [(i, j, k) for i in range(4) for j in range(4) for k in range(4)]
    x, q = np.array(place) * 0.25, np.array([(-1.0) ** sum(p) for p in place])
    for cutoff in (0.5, 0.35):
        energy = cells.ewald(q, x, np.array([1.0, 1.0, 1.0]), cutoff, tolerance=1e-8)
        assert energy / 64 == pytest.approx(-1.7475646 / 2 * cells.COULOMB / 0.25, rel=1e-5)
    # One molecule far from its images has no cohesion but the pair tail; two apart have their own pair energy.
    pair = [("f", 0, "p", 0.4, 0.3, 0.2, 10.0, 10.0, 10.0), ("f", 1, "p", -0.4, 0.3, 0.2, 10.1, 10.0, 10.0)]
    other = [("f", 2, "q", 0.4, 0.3, 0.2, 10.0, 10.5, 10.0), ("f", 3, "q", -0.4, 0.3, 0.2, 10.1, 10.5, 10.0)]
    names = "frame string, place int, molecule string, charge double, sigma double, epsilon double, x double, y double, z double"
    alone, both = (cells.periodic_cohesion(spark.createDataFrame(rows, names), (40.0, 40.0, 40.0), 3.0).first() for rows in (pair, [*pair, *other]))
    assert abs(alone.lj) < 1e-4 and abs(alone.coulomb) < 1e-3
    direct = models.frame_cohesion(spark.createDataFrame([*pair, *other], names), spark.createDataFrame([], "place_a int, place_b int"), 64000.0).first()
    assert both.lj == pytest.approx(direct.lj, abs=1e-3) and both.coulomb == pytest.approx(direct.coulomb, abs=1e-3) and both.lj_mpa == pytest.approx(-both.lj * 1e24 / 6.02214076e23 / 64000)
    # Moving the whole cell, or wrapping a molecule around it, changes nothing; nor does leaving out a bond.
    moved = [(*r[:6], (r[6] + 29.95) % 40, *r[7:]) for r in [*pair, *other]]
    again = cells.periodic_cohesion(spark.createDataFrame(moved, names), (40.0, 40.0, 40.0), 3.0, [(0, 1)]).first()
    assert again.lj == pytest.approx(both.lj, abs=1e-6) and again.coulomb == pytest.approx(both.coulomb, abs=1e-4)
    for bad in ([pair[0]], [*pair, pair[0]]):
        with pytest.raises(Exception, match="zero|distinct"):
            cells.periodic_cohesion(spark.createDataFrame(bad, names), (40.0, 40.0, 40.0), 3.0).collect()
    with pytest.raises(ValueError):
        cells.frame_energies(spark.createDataFrame(pair, names).toPandas(), np.array([4.0, 4.0, 4.0]), 3.0, set())
