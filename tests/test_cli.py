import hashlib
import json

import io
import math

import numpy as np
import pytest

from tessera import cli
from tessera.functions import scalar
from tessera.operators import cohesion, heads
from tessera.sources import contracts, gate

from .test_core import GOOD

APPROVED = {"source": "s", "license": "MIT", "rights_status": "approved", "permission_evidence": "e"}


def sha(path):
    return hashlib.sha256(path.read_bytes()).hexdigest()


def written(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_auxiliary_and_solvation(spark, tmp_path):
    texts = [a + b for a in ("C", "CC", "CCC", "OCC") for b in ("C1CC1", "C1CCC1", "C1CCCC1", "c1ccccc1", "C1CCCCCC1", "c1ccoc1", "c1ccsc1", "C1CCNC1", "c1ccncc1", "C1CCOCC1")]
    out = io.BytesIO()
    np.savez(out, smiles=np.array(texts), targets=np.array([[float(len(t))] for t in texts]), target_names=np.array(["mu"]))
    data = tmp_path / "a.npz"
    data.write_bytes(out.getvalue())
    aux = APPROVED | {"dataset_id": "d", "target_names": ["mu"], "target_units": ["D"], "training_allowed": True, "derived_weights_allowed": True}
    reserved = written(tmp_path / "r.json", {"smiles": ["CC1CC1"]})
    args = ["auxiliary-fit", "--data", str(data), "--manifest", written(tmp_path / "m.json", aux | {"sha256": sha(data)}), "--reserved", reserved, "--model", str(tmp_path / "aux.json"), "--report", str(tmp_path / "aux-report.json")]
    assert cli.main(args) == 0 and cli.main(args) == 2
    report = json.loads((tmp_path / "aux-report.json").read_text())
    assert report["rows"] == 36 and report["units"] == {"mu": "D"} and heads.LinearHead.restore(json.loads((tmp_path / "aux.json").read_text()))
    body = {"SMILES": ["CCO", "OCC", "C[NH3+]", "C(", "CC1CC1", "CCN", "CCC", "CCC"], "SOLVATION": {"mu": [1.0, 1.0, 2.0, 3.0, 4.0, None, 5.0, 6.0]}}
    source = tmp_path / "s.json"
    source.write_text(json.dumps(body).replace("null", "NaN"))
    assert cli.main(["solquest-prepare", "--source", str(source), "--review", written(tmp_path / "s-m.json", aux | {"sha256": sha(source)}), "--reserved", reserved, "--out", str(tmp_path / "solved")]) == 0
    counts = json.loads((tmp_path / "solved/report.json").read_text())["counts"]
    assert counts == {"prepared": 1, "duplicate": 1, "charged_or_disconnected": 1, "invalid_or_unstable_structure": 1, "reserved_identity": 1, "nonfinite_target": 1, "conflicting": 2}
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "solved/rows")).collect()] == [("CCO", [1.0])]


def test_registered_cohesion(spark, tmp_path):
    state = cohesion.chain_state("*CCO*", "*C", "*C", 20, "atactic")
    size = len(state["rebuilt"])
    names, z = [f"x{i}" for i in range(size)], [f"z{i}" for i in range(6)]
    head = lambda f, coef, level: heads.LinearHead(f, ["t"], [0.0] * len(f), [1.0] * len(f), [coef], [level]).state()
    body = {"targets": ["t"], "low": [-1.0] * size, "high": [1e6] * size, "radii": {m: [0.5] for m in "ABC"}, "heads": {"A": head(names, [0.0] * size, 3.0), "B": head(z, [2.0, 0, 0, 0, 0, 0], 1.0), "C_chemical": head(names, [0.0] * size, 3.0), "C_residual": head(z, [0, -9.0, 0, 0, 0, 0], 0.0)}}
    model = written(tmp_path / "model.json", body | {"digest": scalar.canonical_digest(body)})
    arrays = {"source_uuid": np.array(["u"]), "repeat_smiles": np.array([state["unit"]]), "capped_smiles": np.array([state["capped"]]), "tacticity": np.array(["atactic"]), "dp": np.array([20]), "mn_g_mol": np.array([state["mass"]]), "features": np.array([state["rebuilt"]]), "embeddings": np.array([[0.25, 1.0]])}
    support = tmp_path / "support.npz"
    np.savez(support, **arrays, metadata_json=np.array(json.dumps({"source": "s"})))
    review = written(tmp_path / "review.json", APPROVED | {"sha256": sha(support), "local_preparation_allowed": True})
    good = {"source_uuid": "u", "repeat_unit_smiles": "*CCO*", "left_cap": "*C", "right_cap": "*C", "dp": 20, "tacticity": "atactic", "mn_g_mol": state["mass"], "dispersity": 1.0, **cohesion.PROTOCOL}
    bad = {"invalid_material_input": {"dp": 0}, "unsupported_source_protocol": {"pressure_atm": 2.0}, "unsupported_molecular_weight_distribution": {"dispersity": 1.1}, "unregistered_source_material": {"source_uuid": "v"}, "source_structure_reconstruction_failed": {"repeat_unit_smiles": "CC"}, "unsupported_repeat_chemistry": {"repeat_unit_smiles": "*C[NH2+]*"}, "unsupported_end_groups": {"left_cap": "*CC"}, "registered_material_state_mismatch": {"tacticity": "none"}}
    asked = written(tmp_path / "in.json", [good, *[good | change for change in bad.values()]])
    want = {"A": 3.0, "B": 1.5, "C": None}
    for mode, value in want.items():
        out = tmp_path / f"out-{mode}.json"
        assert cli.main(["md-cohesion-predict", "--model", model, "--review", review, "--support", str(support), "--input", asked, "--out", str(out), "--mode", mode]) == 0
        rows = json.loads(out.read_text())
        assert sorted(r["reason"] for r in rows if r["reason"]) == sorted([*bad, *([] if value else ["negative_computed_prediction"])])
        (one,) = [r for r in rows if r["reason"] in (None, "negative_computed_prediction")]
        assert (one["t"], one["t_lower"]) == ((value, value - 0.5) if value else (None, None)) and not one["physical_accuracy_validated"]
    requests = cohesion.requests_of(spark, json.dumps(good))
    for change in ({"dp": np.array([0])}, {"source_uuid": np.array([" "])}, {"features": np.array([[math.nan]])}, {"tacticity": np.array(["x"])}, {"dp": np.array([20.0])}, {"embeddings": np.array([0.5])}):
        np.savez(tmp_path / "bad.npz", **(arrays | change), metadata_json=np.array(json.dumps({"source": "s"})))
        with pytest.raises(Exception, match="registry"):
            cohesion.registry(spark, str(tmp_path / "bad.npz"), {}).collect()
    with pytest.raises(Exception, match="metadata"):
        cohesion.registry(spark, str(support), {"source": "other"}).collect()
    with pytest.raises(contracts.Refused):
        cohesion.predicted(requests, requests, body | {"digest": "x"}, "A")
    with pytest.raises(contracts.Refused):
        cohesion.requests_of(spark, json.dumps(good | {"more": 1}))


def test_fetch_and_inventory(tmp_path):
    files = {"w.bin": {"url": "u://w", "sha256": hashlib.sha256(b"weights").hexdigest()}}
    review = APPROVED | {"encoder_id": "e", "revision": "1", "files": files, "weights_license": "MIT", "code_license": "MIT", "download_allowed": True}
    review = {k: v for k, v in review.items() if k not in ("source", "license")}
    opened = lambda url: io.BytesIO({"u://w": b"weights"}[url])
    gate.fetched(review, str(tmp_path / "c"), opened)
    assert [f.name for f in (tmp_path / "c").iterdir()] == ["w.bin"]
    for change in ({"download_allowed": False}, {"weights_license": "own"}, {"files": {}}, {"files": {"../x": files["w.bin"]}}, {"files": {"w.bin": files["w.bin"] | {"sha256": "0" * 64}}}):
        with pytest.raises(contracts.Refused):
            gate.fetched(review | change, str(tmp_path / f"d{len(list(tmp_path.iterdir()))}"), opened)
    assert cli.main(["checkpoint-fetch", "--review", written(tmp_path / "r.json", review | {"files": {"w": {"url": "file:///none", "sha256": "0" * 64}}}), "--out", str(tmp_path / "none")]) == 2
    assert cli.main(["licence-inventory", "--out", str(tmp_path / "l.json")]) == 0
    found = {r["name"]: r for r in json.loads((tmp_path / "l.json").read_text())}
    assert found["pyspark"]["version"] and not any(r["reviewed"] for r in found.values())


def test_end_to_end(spark, tmp_path, capsys):
    data = tmp_path / "synthetic"
    assert cli.main(["synthetic", "--out", str(data)]) == 0
    (path,) = data.glob("part-*.csv")
    assert cli.main(["synthetic", "--out", str(data)]) == 2
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps(GOOD | {"sha256": hashlib.sha256(path.read_bytes()).hexdigest()}))
    assert cli.main(["validate", "--data", str(path), "--manifest", str(manifest)]) == 0
    common = ["--data", str(path), "--manifest", str(manifest), "--model", str(tmp_path / "model.json"), "--report", str(tmp_path / "report.json")]
    assert cli.main(["train", *common]) == 0
    report = json.loads((tmp_path / "report.json").read_text())
    assert report["models"]["A"]["components"]["delta_d"]["mae"] < 1 and report["models"]["A"]["real_accuracy_validated"] is False
    assert cli.main(["train", *common]) == 2
    measured = ["evaluate", "--model", str(tmp_path / "model.json"), "--data", str(path), "--report", str(tmp_path / "held.json")]
    assert cli.main([*measured, "--manifest", written(tmp_path / "no.json", GOOD | {"sha256": sha(path), "local_evaluation_allowed": False})]) == 2
    assert cli.main([*measured, "--manifest", str(manifest)]) == 0
    assert json.loads((tmp_path / "held.json").read_text())["components"]["delta_d"]["rows"] > 12
    rows = tmp_path / "in.csv"
    rows.write_text("sample_id,smiles\na,CCCO\nb,[Na+].[Cl-]\nc,broken(\n")
    assert cli.main(["predict", "--data", str(rows), "--model", str(tmp_path / "model.json"), "--out", str(tmp_path / "out")]) == 0
    lines = [x.split(",") for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines() if not x.startswith("sample_id")]
    status = {x[0]: x[3] for x in lines}
    assert status["b"] == status["c"] == "unsupported" and status["a"] in ("synthetic_demo", "out_of_domain")
    assert all(not x[11] for x in lines if x[3] == "unsupported")
    capsys.readouterr()
    assert cli.main(["features", "--smiles", "CCO"]) == 0 and json.loads(capsys.readouterr().out)["groups"]["alcohol"] == 1
    assert cli.main(["features", "--smiles", "C("]) == 2
    assert cli.main(["chain-features", "--smiles", "*CC*", "--left", "*C", "--right", "*C", "--mn", "1000"]) == 0
    assert cli.main(["schema"]) == 0


def test_reference_table(tmp_path, capsys):
    table = tmp_path / "t.json"
    table.write_text(json.dumps({"groups": {"methyl": {"fd": 400, "fp": 0, "eh": 0, "volume": 30}, "methylene": {"fd": 270, "fp": 0, "eh": 0, "volume": 16}, "alcohol": {"fd": 210, "fp": 500, "eh": 20000, "volume": 10}}}))
    review = tmp_path / "r.json"
    review.write_text(json.dumps({"sha256": hashlib.sha256(table.read_bytes()).hexdigest(), "license": "own", "rights_status": "approved", "permission_evidence": "e", "calculation_allowed": True}))
    assert cli.main(["reference-gc", "--smiles", "CCO", "--table", str(table), "--review", str(review)]) == 0
    got = json.loads(capsys.readouterr().out)
    assert abs(got["delta_d"] - 880 / 56) < 1e-9 and abs(got["delta_p"] - 500 / 56) < 1e-9 and abs(got["delta_h"] - (20000 / 56) ** 0.5) < 1e-9
    assert cli.main(["reference-gc", "--smiles", "CCN", "--table", str(table), "--review", str(review)]) == 2
