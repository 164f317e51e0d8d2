import hashlib
import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import diagnostics, domain, evidence, grouping, heads, metrics, prepare, refuse
from tessera.sources import contracts, gate, ranges

GOOD = {"dataset_id": "d", "sha256": "0" * 64, "label_kind": "synthetic", "source": "s", "license": "MIT", "rights_status": "approved", "permission_evidence": "e", "approved_by": "a", "training_allowed": True, "derived_weights_allowed": True, "local_evaluation_allowed": True}


@pytest.mark.parametrize("change,message", [
    ({"training_allowed": 1}, "training_allowed"), ({"extra": 1}, "unknown"), ({"sha256": "x"}, "sha256"), ({"label_kind": "experimental"}, "independent"), ({"teacher_id": "t"}, "teacher"),
    ({"audit_basis": "operator_assumption", "redistribution_allowed": True}, "redistribution"), ({"temperature_k": -1.0}, "temperature"), ({"rights_status": "denied"}, "rights"), ({"derived_weights_allowed": False}, "permissions"), ({"allowed_role": "evaluation_only"}, "evaluation-only"),
])
def test_manifests_are_refused(change, message):
    with pytest.raises(contracts.Refused, match=message):
        contracts.DATASET.authorize(contracts.DATASET.parse(json.dumps(GOOD | change)), "train")


@pytest.mark.parametrize("text", ['{"a": 1, "a": 2}', '{"a": NaN}', "{", '{"a": Infinity}'])
def test_strict_json(text):
    with pytest.raises(contracts.Refused):
        contracts.strict_json(text)


def labelled(tmp_path, rows=12, change=None):
    lines = [["sample_id", "smiles", "delta_d", "delta_p", "delta_h", "label_kind"], *[[f"s{i}", "C" * (i + 1), "15.0", "1", "2", "synthetic"] for i in range(rows)]]
    if change:
        change(lines)
    path = tmp_path / "t.csv"
    path.write_text("﻿" + "\n".join(",".join(r) for r in lines) + "\n", encoding="utf-8")
    return str(path), GOOD | {"sha256": hashlib.sha256(path.read_bytes()).hexdigest()}


def test_labelled_table_and_order_of_gates(spark, tmp_path, monkeypatch):
    path, manifest = labelled(tmp_path)
    df = gate.labelled_table(spark, path, manifest)
    assert df.count() == 12 and df.columns[0] == "sample_id" and {r.temperature_k for r in df.collect()} == {298.15}
    with pytest.raises(contracts.Refused, match="checksum"):
        gate.labelled_table(spark, path, manifest | {"sha256": "1" * 64})
    with pytest.raises(contracts.Refused, match="blocked"):
        gate.labelled_table(spark, path, manifest, blocked=("t.csv",))
    opened = []
    monkeypatch.setattr(gate, "file_digest", lambda p: opened.append(p))
    with pytest.raises(contracts.Refused, match="rights"):
        gate.labelled_table(spark, path, manifest | {"rights_status": "pending"})
    assert not opened


@pytest.mark.parametrize("row,column,value", [(3, 1, "[Na+].[Cl-]"), (3, 1, "C("), (3, 1, "[CH3]"), (3, 2, "nan"), (3, 2, "-1"), (3, 2, "x"), (3, 5, "experimental"), (3, 0, "s1"), (3, 0, " "), (3, 1, "")])
def test_one_bad_row_refuses_the_table(spark, tmp_path, row, column, value):
    path, manifest = labelled(tmp_path, change=lambda lines: lines[row].__setitem__(column, value))
    with pytest.raises(contracts.Refused):
        gate.labelled_table(spark, path, manifest)


def test_sinks_never_overwrite(spark, tmp_path):
    gate.write_json(str(tmp_path / "a" / "r.json"), {"x": 1})
    for write in (lambda: gate.write_json(str(tmp_path / "a" / "r.json"), {}), lambda: gate.write_bundle(spark.range(1), str(tmp_path / "a"), {}, {})):
        with pytest.raises(contracts.Refused):
            write()
    with pytest.raises(ValueError):
        gate.write_json(str(tmp_path / "b.json"), {"x": math.nan})
    gate.write_bundle(spark.range(3), str(tmp_path / "c"), {"training_allowed": True, "rights_status": "approved"}, {"rows": 3})
    assert json.loads((tmp_path / "c/manifest.json").read_text()) == {"training_allowed": False, "rights_status": "pending"}


def test_prediction_table(spark, tmp_path):
    row = {c: None for c in [*gate.PREDICTION, *[f"{t}{s}" for t in gate.TARGETS for s in ("", "_lower", "_upper")]]}
    schema = ", ".join(f"{c} {'array<string>' if c == 'reasons' else 'string'}" for c in row)
    gate.write_predictions(spark.createDataFrame([tuple((row | {"sample_id": "a", "reasons": ["x", "y"]}).values())], schema), str(tmp_path / "p"))
    text = max((f.read_text().splitlines() for f in (tmp_path / "p").glob("part-*")), key=len)
    assert text[0].startswith("sample_id,smiles,canonical_smiles,status,reasons") and text[1].startswith("a,,,,x|y,,")


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("order", ["C", "F"])
def test_archives_are_read_by_ranges(spark, tmp_path, save, order):
    names, n = np.array(["a", "b", "c"]), 1000
    smiles, targets = np.array(["C" * (1 + i % 7) + "é" for i in range(n)]), np.array(np.arange(3.0 * n).reshape(n, 3), order=order)
    save(tmp_path / "t.npz", smiles=smiles, targets=targets, target_names=names)
    spark.dataSource.register(gate.NpzSource)
    df = spark.read.format("npz").option("rows", 150).load(str(tmp_path / "t.npz"))
    assert df.rdd.getNumPartitions() == (7 if save is np.savez else 1)
    got = sorted((r.targets[0], r.smiles, r.targets) for r in df.collect())
    assert [g[1] for g in got] == smiles.tolist() and [g[2] for g in got] == targets.tolist()
    for change, message in (({"targets": targets[1:]}, "shapes"), ({"smiles": np.array([{}] * n, object)}, "objects"), ({"targets": np.zeros((0, 3)), "smiles": smiles[:0]}, None)):
        save(tmp_path / "u.npz", **{"smiles": smiles, "targets": targets, "target_names": names} | change)
        if message:
            with pytest.raises(Exception, match=message):
                spark.read.format("npz").load(str(tmp_path / "u.npz")).collect()
        else:
            assert spark.read.format("npz").load(str(tmp_path / "u.npz")).collect() == []


def test_sinks_are_one_commit(spark, tmp_path):
    """Of two writers one fails, and what fails leaves nothing."""
    path = str(tmp_path / "bundle")
    with pytest.raises(contracts.Refused, match="exists"), gate.committed(path) as stage:
        spark.range(2).write.parquet(stage)
        gate.write_bundle(spark.range(3), path, {}, {"rows": 3})
    assert spark.read.parquet(f"{path}/rows").count() == 3 and [p.name for p in tmp_path.iterdir()] == ["bundle"]
    one = str(tmp_path / "one.json")
    with pytest.raises(contracts.Refused, match="exists"), gate.committed(one) as stage:
        gate._json_at(stage, 1)
        gate.write_json(one, 2)
    assert json.loads((tmp_path / "one.json").read_text()) == 2
    failing = spark.range(8).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))
    for write in (lambda: gate.write_rows(failing, str(tmp_path / "r"), {}), lambda: gate.write_bundle(spark.range(1), str(tmp_path / "b"), {}, {"x": math.nan}), lambda: gate.write_json(str(tmp_path / "j"), math.inf)):
        with pytest.raises(Exception, match="lost|JSON"):
            write()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bundle", "one.json"]


def test_column_json_and_npz(spark, tmp_path):
    body = '{"SMILES": ["C", "CC"], "OTHER": [1], "SOLVATION": {"water": [1.5, NaN]}}'
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("x.json", body)
    got = gate.column_json(spark, f"file://{tmp_path}/x.zip", "SMILES", "SOLVATION").orderBy("position").collect()
    assert [(r.position, r.key, r.value["water"]) for r in got] == [(0, "C", 1.5), (1, "CC", None)]
    for bad in ('{"SMILES": ["C"], "SOLVATION": {"water": [1, 2]}}', '{"SOLVATION": {"water": [1]}}', '{"SMILES": [1], "SOLVATION": {"water": [1]}}', '{"SMILES": ["C"], "SOLVATION": {"water": ["x"]}}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(Exception, match="columns differ|is no"):
            gate.column_json(spark, f"file://{tmp_path}/bad.json", "SMILES", "SOLVATION").collect()
    (tmp_path / "bad.json").unlink()
    out = io.BytesIO()
    np.savez(out, smiles=np.array(["C", "O"]), targets=np.array([[1.0], [2.0]]), target_names=np.array(["mu"]))
    (tmp_path / "t.npz").write_bytes(out.getvalue())
    manifest = {"dataset_id": "d", "sha256": hashlib.sha256(out.getvalue()).hexdigest(), "source": "s", "license": "MIT", "rights_status": "approved", "permission_evidence": "e", "target_names": ["mu"], "target_units": ["D"], "training_allowed": True, "derived_weights_allowed": True}
    assert [tuple(r) for r in gate.auxiliary_table(spark, str(tmp_path / "t.npz"), manifest).orderBy("smiles").collect()] == [("C", [1.0]), ("O", [2.0])]
    assert gate.digests(spark, str(tmp_path)).count() == 2


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 16, 64, 10_000])
def test_column_json_split_at_any_byte(spark, tmp_path, size):
    """Ranges of any size give the rows of the whole file: texts with escapes, quotes, brackets and letters of several bytes at every edge."""
    keys = ["C", 'a"b', "\\", '\\"', "[]{},:", "é中😀", "NaN", "", " x\ty\n", "\\\\"]
    values = {"water": [1.5, None, -2e-7, 0, None, 12345678901, None, 3, 4, 5], 'odd "name"]': [float(i) for i in range(10)]}
    written = ", ".join(json.dumps(k, ensure_ascii=i % 2 == 0) for i, k in enumerate(keys))
    water = " ,".join({1: "NaN", 4: "-Infinity", 6: "Infinity"}.get(i, json.dumps(v)) for i, v in enumerate(values["water"]))
    body = f'\ufeff {{"OTHER": {{"SMILES": ["no"], "x": [[1, {{"y": "]}}"}}], NaN], "t": true}}, "SMILES"\n: [{written}] , "SOLVATION" : {{"water":[{water}], {json.dumps("odd " + chr(34) + "name" + chr(34) + "]")}: {json.dumps(values[list(values)[1]])}}}, "last": null}}\n'
    (tmp_path / "x.json").write_bytes(body.encode())
    got = ranges.read_columns(spark, f"file://{tmp_path}/x.json", "SMILES", "SOLVATION", gate.located, size if size > 1 or len(body) < 900 else 2)
    rows = got.collect()
    assert [r.text for r in sorted((r for r in rows if r.column is None), key=lambda r: r.position)] == keys
    for name, want in values.items():
        assert [r.value for r in sorted((r for r in rows if r.column == name), key=lambda r: r.position)] == want
    assert len(rows) == 30


@pytest.mark.parametrize("bad", [" ", "[1]", '{"SMILES": ["C"', '{"SMILES": ["C]}', '{"SMILES": ["C"]}}', '{"SMILES" ["C"]}', '{"SMILES": ["C",]}', '{"SMILES": ["C" "D"]}', '{"SMILES": ["C"], "SMILES": ["D"]}', '{"SMILES": ["C"]} x', '{"SMILES": ["C", tru]}', '{"SMILES": [["C"]]}', '{"SMILES": ["C"}]', "{,}"])
def test_broken_column_json_is_refused(spark, tmp_path, bad):
    (tmp_path / "x.json").write_text(bad)
    for size in (3, 1000):
        with pytest.raises(Exception, match="Refused"):
            ranges.read_columns(spark, f"file://{tmp_path}/x.json", "SMILES", "SOLVATION", gate.located, size).collect()



def test_vectors(spark, tmp_path):
    path = tmp_path / "v.csv"
    path.write_text("smiles,e0,e1\nC,1,2\nO,3,4\n")
    assert gate.vector_table(spark, str(path), 2).count() == 2
    for text in ("smiles,e0,e1\nC,1,2\nC,3,4\n", "smiles,e0,e1\nOCC,1,2\nCCO,3,4\n", "smiles,e0,e1\nnone,1,2\n", "smiles,e1,e0\nC,1,2\n", "smiles,e0,e1\nC,1,nan\n", "smiles,e0,e1\n"):
        path.write_text(text)
        with pytest.raises(contracts.Refused):
            gate.vector_table(spark, str(path), 2)


def test_ridge_equals_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3)) * [1, 10, 0] + [0, 5, 2]
    y = x @ [[1.0, 2.0], [0.5, -1], [0, 0]] + rng.normal(size=(80, 2)) * 0.1
    df = spark.createDataFrame([(*map(float, a), *map(float, b), f"g{i % 9}") for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, c double, u double, v double, g string")
    head = heads.fit_ridge(df, ["a", "b", "c"], ["u", "v"], 2.0)
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1)
    want = np.linalg.lstsq(np.vstack([z, np.sqrt(2.0) * np.eye(3)]), np.vstack([y - y.mean(0), np.zeros((3, 2))]), rcond=None)[0]
    assert np.allclose(np.array(head.coef).T, want, atol=1e-9)
    assert heads.LinearHead.restore(head.state()) == head
    with pytest.raises(ValueError):
        heads.LinearHead.restore(head.state() | {"intercept": [0.0, 0.0]})
    p = df.select(*[c.alias(t) for t, c in head.predict().items()]).toPandas().to_numpy()
    assert np.allclose(p, z @ want + y.mean(0))
    found = heads.select_ridge(df, ["a", "b", "c"], ["u", "v"], "g")
    assert found.selected["u"] in heads.ALPHAS and found.scores["u"][0] > min(found.scores["u"])
    poisoned = df.withColumn("u", F.when(F.col("g") == "g0", 1e6).otherwise(F.col("u")))
    fold = grouping.hash_folds(df, "g", 5, 42, "x")
    rows = heads.out_of_fold(poisoned.join(fold, "g"), ["a", "b"], ["u"], 1.0, "fold").where("oof_u IS NULL").count()
    assert rows == 0
    constant = heads.select_ridge(df.withColumn("u", F.lit(3.0)), ["a"], ["u"], "g")
    assert constant.selected["u"] is None and constant.head.coef == [[0.0]]
    assert isinstance(heads.fit_residual(df, ["a"], ["b"], ["u"], "g").predict()["u"], type(F.lit(1)))


def test_logistic_gradient_and_refusals(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(b), "s" if i % 2 else "t", 1.0) for i, (a, b) in enumerate(zip(x, y, strict=True))], "a double, b double, y int, k string, w double")
    head = heads.fit_logistic(df, ["a", "b"], "y", "w", 0.1, "k")
    z = np.column_stack([(x - x.mean(0)) / x.std(0), np.arange(60) % 2 == 1, np.arange(60) % 2 == 0]).astype(float)
    p = 1 / (1 + np.exp(-(z @ head.coef + head.intercept)))
    assert np.abs(np.append(z.T @ (p - y) / 60 + 0.1 * np.array(head.coef), (p - y).mean())).max() <= 1e-5
    bad = spark.createDataFrame([(float("nan"), 0.0, "s"), (0.0, 0.0, "new"), (0.0, 0.0, "s")], "a double, b double, k string")
    assert [r[0] for r in bad.select(head.reasons()).collect()] == ["nonfinite_query_features", "unsupported_category", None]
    with pytest.raises(ValueError):
        heads.fit_logistic(df.where("y = 1"), ["a"], "y", "w", 0.1)


def test_stored_trees():
    left, right, feature, threshold, value = map(np.array, ([1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0, 0, 1, 0, 0], [0.5, 0, 0.1, 0, 0], [0.0, 1, 0, 2, 3]))
    assert heads.tree_values(np.array([[0.5, 9], [0.6, 0.05], [0.6, 0.2]]), left, right, feature, threshold, value).tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        heads.tree_values(np.zeros((1, 2)), np.array([0]), np.array([0]), np.array([0]), np.array([0.0]), np.array([0.0]))


def trace(spark, values, replicate="r", observable="o", dt=1.0):
    return spark.createDataFrame([(replicate, observable, i, i * dt, float(v)) for i, v in enumerate(values)], "replicate string, observable string, i int, t double, value double")


def test_traces(spark):
    rng = np.random.default_rng(5)
    ar = [0.0]
    for _ in range(4095):
        ar.append(0.9 * ar[-1] + rng.normal())
    both = trace(spark, ar).union(trace(spark, rng.normal(size=4096), observable="iid")).union(trace(spark, np.full(4096, 7.0), observable="flat")).union(trace(spark, [(-1) ** i for i in range(4096)], observable="flip"))
    got = {r.observable: r for r in diagnostics.diagnose_trace(both, 8).collect()}
    assert 10 < got["o"].g < 40 and 0.8 < got["iid"].g < 1.5 and got["flip"].g == 1 and got["flip"].ess_bound_applied
    assert got["flat"].status == "constant_or_numerically_unresolved" and got["flat"].ess is None and got["flat"].warnings
    assert abs(got["o"].mean - np.mean(ar)) < 1e-9 and abs(got["o"].sd - np.std(ar, ddof=1)) < 1e-9 and not got["o"].accuracy_validated
    for bad, fault in ((trace(spark, range(31)), "too_few"), (trace(spark, range(33)), "divide"), (trace(spark, [*range(31), math.nan]), "nonfinite"), (trace(spark, range(32)).withColumn("t", F.col("t") * F.col("t")), "uniform")):
        with pytest.raises(ValueError, match=fault):
            diagnostics.diagnose_trace(bad, 4)
    runs = trace(spark, rng.normal(size=64)).union(trace(spark, rng.normal(size=96) + 1, replicate="s"))
    (spread,) = diagnostics.diagnose_replicates(diagnostics.trace_moments(runs, 4)).collect()
    assert spread.replicates == 2 and spread.standard_error > 0
    frames = spark.createDataFrame([("r", i, float(i), *map(float, rng.normal(size=3)), 1.0 + i % 2) for i in range(32)], "replicate string, i int, t double, mx double, my double, mz double, volume double")
    assert diagnostics.dipole_series(frames).select("observable").distinct().count() == 13
    assert [b.count() for b in diagnostics.blocks_of(frames, 4)] == [8] * 4


def geyer(v):
    """By definition, with all products of one lag in one sum."""
    v = np.array(v, float)
    n, x = len(v), v - v.mean()
    x = x / np.abs(x).max()
    acf = np.array([x[: n - k] @ x[k:] for k in range(n // 2 + 1)]) / (x @ x)
    whole = (len(acf) - 1) // 2 + (len(acf) - 1) % 2
    pairs = acf[: 2 * whole].reshape(-1, 2).sum(1)
    stop = np.flatnonzero(pairs <= 0)
    kept = np.minimum.accumulate(pairs[: stop[0]] if stop.size else pairs)
    return pairs, len(kept), bool(stop.size), float(2 * kept.sum() - 1)


@pytest.mark.parametrize("width,chunk", [(1 << 18, 4096), (64, 64), (16, 8), (256, 32)])
def test_correlations_over_many_blocks(spark, monkeypatch, width, chunk):
    """One series over many blocks and rounds of distances; lengths of all kinds, gaps in i, slow and fast decay."""
    monkeypatch.setattr(diagnostics, "WIDTH", width)
    monkeypatch.setattr(diagnostics, "CHUNK", chunk)
    rng = np.random.default_rng(11)
    slow = np.cumsum(rng.normal(size=1500))
    series = {"slow": slow, "iid": rng.normal(size=777), "wave": np.sin(np.arange(1001) / 150), "huge": 1e200 * slow[:300], "two": [1.0, 2.0], "odd": rng.normal(size=65)}
    df = None
    for name, v in series.items():
        one = trace(spark, v, observable=name)
        df = one if df is None else df.union(one)
    df = df.union(trace(spark, [3.0] * 40, observable="flat")).withColumn("i", F.when(F.col("observable") == "iid", F.col("i") * 1000 - 70_000).otherwise(F.col("i"))).repartition(5)
    got = {r.observable: r for r in diagnostics.trace_correlations(df).collect()}
    pairs = {}
    for r in diagnostics.pair_correlations(df).collect():
        pairs.setdefault(r.observable, {})[r.k] = r.pair
    assert got["flat"].g is None and got["flat"].pairs is None and "flat" not in pairs
    for name, v in series.items():
        want, n, truncated, raw = geyer(v)
        assert [pairs[name][k] for k in range(len(want))] == pytest.approx(want.tolist(), abs=1e-9) and len(pairs[name]) == len(want), name
        r = got[name]
        assert (r.pairs, r.truncated) == (n, truncated) and r.raw_g == pytest.approx(raw, rel=1e-9)
        assert r.ess == pytest.approx(len(v) / min(max(raw, 1), len(v)))


def test_first_valid_wins_and_preparation(spark):
    need = ["UUID", "smiles_list", "forcefield"]
    good = {"check_eq": "True", "temp": "300", "press": "1", "sp_ced": "9", "sp_total": "3", "sp_vdw": "1", "sp_ele": "2", "UUID": "u", "smiles_list": "C", "forcefield": "f"}
    rows = [good | {"sp_ele": ""}, good, good, good | {"check_eq": "False"}, good | {"sp_ele": "x"}, good | {"UUID": "w", "temp": "0"}, good | {"UUID": ""}]
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "row int, " + ", ".join(f"{k} string" for k in good))
    got = {r.row: r.reason for r in prepare.cohesion_rows(df, "row", need).collect()}
    bad, repeated = "missing_nonfinite_negative_observable_or_invalid_conditions", "repeated_uuid_refused"
    assert got == {0: bad, 1: None, 2: repeated, 3: "equilibrium_not_declared", 4: repeated, 5: bad, 6: "required_source_metadata_missing"}
    assert sum(r.n for r in prepare.accounting(prepare.cohesion_rows(df, "row", need)).collect()) == 7
    solved = spark.createDataFrame([(0, "a", 1.0), (1, "a", 1.0 + 1e-9), (2, "b", 1.0), (3, "b", 2.0), (4, "c", math.nan), (5, "d", 4.0)], "row int, k string, t double")
    got = {r.row: r.reason for r in prepare.solvation_rows(solved, "row", "k", ["t"], [("reserved", F.col("k") == "d")]).collect()}
    assert got == {0: None, 1: "duplicate", 2: "conflicting", 3: "conflicting", 4: "nonfinite_target", 5: "reserved"}


def test_weights_splits_and_embargo(spark):
    df = spark.createDataFrame([(f"f{i % 9}", f"p{i % 4}", i) for i in range(90)], "family string, pair string, row int")
    assert abs(grouping.family_pair_weights(df, "family", ["pair"]).agg(F.sum("weight")).first()[0] - 1) < 1e-12
    assert abs(grouping.balanced_weights(df, "family").agg(F.sum("weight")).first()[0] - 1) < 1e-12
    split = df.join(grouping.group_split(df, "family", 42), "family")
    assert not grouping.leaks(split, "family", "split").count() and split.select("split").distinct().count() == 3
    with pytest.raises(ValueError):
        grouping.group_split(df.where("family < 'f7'"), "family", 42)
    rows = spark.createDataFrame([(k,) for k, n in (("a", 5), ("b", 3), ("c", 3), ("d", 1)) for _ in range(n)], "g string")
    assert {r.g: (r.n, r.fold) for r in grouping.size_balanced_folds(rows, "g", 2).collect()} == {"a": (5, 0), "b": (3, 1), "c": (3, 1), "d": (1, 0)}
    assert grouping.size_balanced_folds(rows.limit(0), "g", 2).collect() == []
    kept = grouping.embargo(df, "row", [F.col("family"), F.col("pair")], [df.where("row = 0").select("family"), df.where("row = 1").select("pair")])
    assert {(r.family, r.pair) for r in kept.collect()} == {(f"f{i % 9}", f"p{i % 4}") for i in range(90) if i % 9 and i % 4 != 1}
    assert grouping.split_groups(df, "family", "row").count() == 9 and grouping.overlap(df, df, "pair").count() == 4


def test_order_statistics_and_scores(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("v"))
    assert [metrics.kth_smallest(df, "v", k).first()[0] for k in (1, 500, 1000, 1001, 0)] == [1.0, 500.0, 1000.0, None, None]
    same = spark.createDataFrame([(1.0,)] * 50 + [(2.0,)], "v double")
    assert metrics.kth_smallest(same, "v", 51).first()[0] == 2.0
    ties = spark.createDataFrame([(0, 1.0), (1, 1.0 - 1e-13), (2, 2.0)], "i int, s double")
    assert metrics.best_candidate(ties, "s", "i").first()["i"] == 0
    one = spark.createDataFrame([(1, 2.0)] * 3, "y int, eta double")
    assert metrics.binary_scores(one, F.col("eta"), F.col("y"), F.lit(1.0)).first()["balanced_accuracy"] is None
    flat = metrics.component_metrics(spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 0.0), ("b", 1.0, 1.0)], "g string, y double, p double"), F.col("y"), F.col("p"), ["g"]).collect()
    assert all(r.r2 is None for r in flat)


def test_ladders(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 2.0), (9.0, None)], "a double, b double")
    low, high = [0.0, 0.0], [5.0, 5.0]
    assert [r[0] for r in df.select(refuse.out_of_range([F.col("a"), F.col("b")], low, high, 1e-8)).collect()] == [False, True, True]
    assert [r[0] for r in df.select(refuse.offending([F.col("a"), F.col("b")], low, high)).collect()] == [[], [0], [0, 1]]
    with pytest.raises(ValueError):
        refuse.matching(df, {"z": 1}, ["a"])
    with pytest.raises(ValueError):
        refuse.asserted(df, "a", F.col("a") > 5)
    assert refuse.unique(df, ["a"]).count() == 3


def test_ledger(spark):
    quantity = "struct<value:double,unit:string,qualifier:string,unit_as_reported:string>"
    q = lambda v, u="wt%": {"value": v, "unit": u if v is not None else None, "qualifier": "exact" if v is not None else None, "unit_as_reported": u}
    rows = [("r1", "g", "f1", True, q(5.0), "clear"), ("r2", "g", "f1", True, q(5.0, "wt%"), "cloudy"), ("r3", "g", "f2", False, q(0.0), "clear"), ("r4", "g", "f3", None, q(None), "clear")]
    records = spark.createDataFrame(rows, f"cell string, grade string, formulation string, present boolean, dose {quantity}, outcome string")
    review = {"ledger_sha256": "0" * 64, "source_sha256": "0" * 64, "license": "MIT", "reviewed_by": "x", "row_count": 4, "lookup_allowed": True}
    grades = spark.createDataFrame([("g",)], "grade string")
    book = evidence.Ledger.open(records, review, records.select("cell"), ["cell"], {"grade": grades}, ("dose",), ("grade", "outcome"), "outcome")
    found = book.lookup({"grade": "g"}, "grade", "formulation", "present")
    assert (found["outcome_records"], found["formulations"], found["present_formulations"], found["control_formulations"], found["conflicting_outcomes_at_same_conditions"]) == (4, 3, 1, 1, True)
    assert book.matching({"dose": None}).count() == 1 and book.matching({"dose": {"value": 5.0, "unit": "wt%", "qualifier": "exact"}}).count() == 2
    assert book.lookup({"grade": "none"}, "grade", "formulation", "present")["status"] == "no_reported_observation"
    assert not json.loads(evidence.report(found))["physical_accuracy_validated"]
    for change, expected in (({"row_count": 5}, records), ({}, records.limit(3)), ({"lookup_allowed": False}, records), ({"population": {"a": 1}}, records)):
        with pytest.raises(contracts.Refused):
            evidence.Ledger.open(records, review | change, expected.select("cell"), ["cell"], {}, ("dose",), ("grade",), "outcome")
    with pytest.raises(contracts.Refused):
        evidence.Ledger.open(records, review, records.select("cell"), ["cell"], {"grade": spark.createDataFrame([("h",)], "grade string")}, ("dose",), ("grade",), "outcome")


def test_nested_validators(spark):
    pmf = "array<struct<eo:int,po:int,p:double>>"
    row = spark.sql(f"""SELECT named_struct('eo_mean', 1.5D, 'po_mean', 0D, 'eo_std', 0.5D, 'po_std', CAST(NULL AS DOUBLE), 'sequence', 'random', 'block_order', CAST(NULL AS STRING), 'distribution', 'empirical',
      'joint_pmf', CAST(array(struct(1, 0, 0.5D), struct(2, 0, 0.5D)) AS {pmf})) d, named_struct('series_id', 's', 'repeat_units', array(named_struct('mole_fraction', 0.7D), named_struct('mole_fraction', 0.2D)), 'mn_g_mol', 10D, 'dispersity', 0.5D, 'end_groups', array(named_struct('count_per_chain', 1D))) p""")
    got = row.select(contracts.distribution_reasons(F.col("d")), contracts.distribution_reasons(F.col("d").withField("eo_mean", F.lit(2.5))), contracts.polymer_reasons(F.col("p"))).first()
    assert list(got) == [[], ["pmf_disagrees_with_moments"], ["mole_fractions_do_not_sum_to_one", "dispersity_below_one"]]
    mix = spark.range(1).select(contracts.mixture_reasons(F.array(F.lit("a")), F.array(F.lit(0.5), F.lit(0.6)))).first()[0]
    assert mix == ["too_few_components", "one_fraction_per_component", "fractions_do_not_sum_to_one"]


def test_scalars(spark):
    assert [scalar.canonical_number(v) for v in (5, 5.0, "50e-1", "0.00", "-120", "0.05")] == ["5", "5", "5", "0", "-12E1", "5E-2"]
    with pytest.raises(ValueError):
        scalar.canonical_number("nan")
    text = spark.createDataFrame([("5.0",), ("-120",), ("0.050",), ("0.0",)], "t string")
    assert [r[0] for r in text.select(scalar.canonical_number_column(F.col("t"))).collect()] == [scalar.canonical_number(t.t) for t in text.collect()]
    assert scalar.canonical_digest({"b": 1, "a": 2}) == scalar.canonical_digest({"a": 2, "b": 1})
    got = spark.range(1).select(scalar.exponent_number(F.lit("1.5D-2")), scalar.exponent_number(F.lit("x")), *scalar.moment_line(F.lit(9.0), F.lit(33.0), F.lit(129.0), F.lit(10.0)), scalar.mean_repeats(F.lit(100.0), F.lit(2.0), F.lit(14.0)), scalar.mass_consistent(F.lit(100.0), F.lit(101.1))).first()
    assert list(got) == [0.015, None, 21.0, True, 7.0, False]
    vectors = spark.createDataFrame([(i, int(b)) for i, b in enumerate([0b1111, 0b1110, 0, 0b1])], "k long, bits long")
    near = {r.k: r.similarity for r in domain.nearest_tanimoto(vectors.where("k > 0"), vectors.where("k = 0"), "k", "bits").collect()}
    assert near == {0: 0.75}


def test_queries_against_all_rows_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    bits = [None, *map(int, rng.integers(0, 1 << 20, 90))]
    df = spark.createDataFrame(list(enumerate(bits)), "k long, bits long").repartition(3)
    asked = df.where("k % 5 = 0").unionByName(spark.createDataFrame([(5, bits[7]), (5, None), (None, 1)], "k long, bits long"))
    share = lambda a, b: (a & b).bit_count() / max((a | b).bit_count(), 1)
    want = {k: max((share(b, t) for t in bits[1:]), default=None) if b is not None else None for k, b in enumerate(bits) if k % 5 == 0}
    want[None] = None
    vectors = df.select("k", F.when(F.col("k") % 7 != 0, F.array(F.col("k") / 10, F.col("k") % 3 + F.lit(0.0))).alias("v"))
    x = {k: (k / 10, k % 3) for k in range(91) if k % 7}
    sums = {k: sum(math.exp(-0.5 * ((a - c) ** 2 + (b - d) ** 2) / 2) for c, d in x.values()) for k, (a, b) in x.items()} | {k: None for k in range(0, 91, 7)}
    for block in (4096, 8):
        monkeypatch.setattr(domain, "QUERY_BLOCK", block)
        monkeypatch.setattr(domain, "TRAIN_BLOCK", 2 * block)
        got = {r.k: r for r in domain.nearest_tanimoto(df, asked, "k", "bits", 0.99).collect()}
        assert {k: r.similarity for k, r in got.items()} == pytest.approx(want) and got[0].ood is None
        assert {r.k: r.kernel_sum for r in domain.kernel_sums(vectors, vectors, "k", "v", 0.5, 2).collect()} == pytest.approx(sums)
    none = df.limit(0)
    assert [tuple(r) for r in domain.nearest_tanimoto(none, df.where("k = 3"), "k", "bits").collect()] == [(3, None, None)]
    assert domain.nearest_tanimoto(df, none, "k", "bits").collect() == [] and domain.kernel_sums(vectors, vectors.limit(0), "k", "v", 0.5).collect() == []
    assert {r.k: r.kernel_sum for r in domain.kernel_sums(vectors.limit(0), vectors.where("k < 2"), "k", "v", 0.5).collect()} == {0: None, 1: 0.0}


def test_blocks_that_cannot_hold_a_neighbour_are_skipped(spark, monkeypatch):
    """Families of similar bits: most pairs of blocks are out by their bounds, and the answers are those of all pairs."""
    monkeypatch.setattr(domain, "QUERY_BLOCK", 16)
    monkeypatch.setattr(domain, "TRAIN_BLOCK", 16)
    r = np.random.default_rng(4)
    heads_, flips = [int(sum(1 << int(b) for b in r.choice(60, k, replace=False))) for k in (3, 6, 12, 20, 30, 40, 50, 57)], r.integers(0, 60, (8, 40))
    bits = [h ^ (1 << int(f)) for h, row in zip(heads_, flips, strict=True) for f in row] + [heads_[0], heads_[0], 0, 0, 7]
    df = spark.createDataFrame(list(enumerate(bits)), "k long, bits long").repartition(4)
    share = lambda a, b: (a & b).bit_count() / max((a | b).bit_count(), 1)
    want = {k: max(share(b, t) for i, t in enumerate(bits) if i != k) for k, b in enumerate(bits)}
    met, best = [], domain._best

    def counted(pairs, *a):
        met.append(pairs.count())
        return best(pairs, *a)

    monkeypatch.setattr(domain, "_best", counted)
    got = {r.k: r.similarity for r in domain.nearest_tanimoto(df, df, "k", "bits", own=True).collect()}
    assert got == pytest.approx(want)
    n = -(-len(bits) // 16)
    assert sum(met) < 0.5 * n * n, met


def test_ranks_in_narrowing_brackets(spark, monkeypatch):
    monkeypatch.setattr(metrics, "RANKED", 3)
    r = np.random.default_rng(9)
    for values in (r.normal(size=400), r.integers(0, 5, 400) * 1.0, np.repeat([1.0, 2.0], [300, 100]), np.append(np.zeros(200), r.normal(size=201)), np.arange(30.0)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        for k in (1, 2, len(values) // 2, len(values)):
            assert metrics.kth_smallest(df, "v", k).first()[0] == np.sort(values)[k - 1]
    df = spark.createDataFrame([(float(v), None) for v in (5, 1, 2, 8)] * 5 + [(None, None)], "v double, w double")
    out = heads.median_imputed(df, ["v", "w"])
    assert out.columns == ["v", "missing_v"] and out.where("missing_v = 1").first()["v"] == 3.5


def greedy(sizes, folds):
    """One group after another, as the rule says."""
    load, out = [0] * min(folds, max(1, len(sizes))), {}
    for key, n in sorted(sizes.items(), key=lambda s: (-s[1], str(s[0]))):
        out[key] = load.index(min(load))
        load[out[key]] += n
    return out


def test_groups_are_dealt_by_runs(spark):
    r = np.random.default_rng(1)
    for folds in (1, 2, 3, 5, 9):
        for _ in range(60):
            sizes = {f"{i:03d}": int(n) for i, n in enumerate(r.choice([1, 1, 1, 2, 3, 7, 10, 40, 200], r.integers(1, 120)))}
            runs = grouping.dealt_runs([(n, list(sizes.values()).count(n)) for n in set(sizes.values())], min(folds, len(sizes)))
            got = {}
            for n in set(sizes.values()):
                for i, key in enumerate(sorted(k for k, m in sizes.items() if m == n)):
                    first, turns = [x for x in runs[n] if x[0] <= i][-1]
                    got[key] = turns[(i - first) % len(turns)]
            assert got == greedy(sizes, folds)
            assert all(len(x) <= folds for x in runs.values())
    sizes = {f"g{i}": 1 + i % 4 * (i % 3) for i in range(400)}
    df = spark.createDataFrame([(k,) for k, n in sizes.items() for _ in range(n)], "g string").repartition(6)
    assert {x.g: x.fold for x in grouping.size_balanced_folds(df, "g", 5).collect()} == greedy(sizes, 5)


def test_order_statistics_of_many_columns(spark, monkeypatch):
    """A hundred columns take as many passes as one."""
    monkeypatch.setattr(metrics, "RANKED", 20)
    r = np.random.default_rng(2)
    x = [r.normal(size=3000), r.integers(0, 3, 3000) * 1.0, np.repeat([1.0, 2.0, 3.0], 1000), np.where(r.random(3000) < 0.5, np.nan, r.normal(size=3000)), np.arange(3000.0)]
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in row) for row in zip(*x, strict=True)], ", ".join(f"c{i} double" for i in range(5))).repartition(3)
    ranks = [1, 2, 750, 1500, 1501, 3000, 3001, 0]
    got = metrics.order_statistics(df, {f"c{i}": ranks for i in range(5)})
    for i, v in enumerate(x):
        v = np.sort(v[~np.isnan(v)])
        assert got[f"c{i}"] == [float(v[k - 1]) if 1 <= k <= len(v) else None for k in ranks], i
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns):
        spark.sparkContext.setJobGroup(f"medians-{len(columns)}", "x")
        found = heads.medians(wide, columns)
        return found, len(tracker.getJobIdsForGroup(f"medians-{len(columns)}"))

    monkeypatch.setattr(metrics, "RANKED", 1000)
    wide = df.select("c0", *[(F.col("c0") * i).alias(f"w{i}") for i in range(99)])
    one, all_ = jobs(["c0"]), jobs(wide.columns)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all_[1] <= one[1] + 2 and all_[0]["w7"] == pytest.approx(7 * one[0]["c0"]) and len(all_[0]) == 100


def test_a_hot_alias_is_looked_up(spark, monkeypatch):
    from tessera.operators import components

    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "HEAVY", 5)
    df = spark.createDataFrame([(i, ["ring-free"] if i % 10 else [f"own {i}"]) for i in range(200)] + [(500, ["own 10", "own 20"]), (501, None)], "k long, a array<string>")
    got = {r.k: r.group for r in grouping.alias_components(df, "k", F.col("a")).collect()}
    assert {got[i] for i in range(200) if i % 10} == {1} and got[500] == got[20] == got[10] == 10 and got[501] == 501


def test_categories_are_never_dropped(spark, monkeypatch):
    monkeypatch.setattr(heads, "MOST_FEATURES", 5)
    df = spark.createDataFrame([(float(i), i % 2, f"c{i % 6}", 1.0) for i in range(40)], "a double, y int, k string, w double")
    with pytest.raises(ValueError, match="at most 5"):
        heads.fit_logistic(df, ["a"], "y", "w", 0.1, "k")
    with pytest.raises(ValueError, match="missing"):
        heads.fit_logistic(df.withColumn("k", F.when(F.col("a") > 3, "x")), ["a"], "y", "w", 0.1, "k")


def test_heavy_labels_are_spread(spark, monkeypatch):
    from tessera.operators import components

    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(components, "HEAVY", 4)
    star = [(5, i) for i in range(6, 80)]
    path = [(i, i + 1) for i in range(1000, 1030)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame([*star, *path], "u long, v long")).collect()}
    assert got == {**{i: 5 for i in range(5, 80)}, **{i: 1000 for i in range(1000, 1031)}}
    rows = spark.createDataFrame([(1, "a")] * 50 + [(2, "b"), (None, "c"), (9, "d")], "k long, s string")
    table = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, t string")
    left = components.looked_up(rows, table, "k", "left").groupBy("k", "t").count().collect()
    assert sorted(map(tuple, left), key=str) == sorted([(1, "x", 50), (2, "y", 1), (None, None, 1), (9, None, 1)], key=str)


def test_streams_and_storage_without_files(spark, tmp_path):
    from tessera import storage
    from tessera.streaming import events

    (tmp_path / "none").mkdir()
    empty = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "none"))
    assert events.drained(empty, "none").collect() == []

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_folder(Session, "x")
