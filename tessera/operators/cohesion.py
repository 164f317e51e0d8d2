"""Computed cohesion of registered materials: requests are matched to a registry exactly, then predicted or refused by name."""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks, structures
from ..functions.scalar import canonical_digest
from ..sources.contracts import Refused, strict_json
from ..sources.gate import located
from . import heads, refuse

# The registry's arrays with their kinds and whether they are matrices, its states, the protocol and caps.
REGISTRY = {"source_uuid": ("U", False), "repeat_smiles": ("U", False), "capped_smiles": ("U", False), "tacticity": ("U", False), "dp": ("iu", False), "mn_g_mol": ("f", False), "features": ("f", True), "embeddings": ("f", True)}
TACTICITY, PROTOCOL, CAP = ("none", "atactic"), {"temperature_k": 300.0, "pressure_atm": 1.0, "forcefield": "GAFF2_mod", "sp_module_version": "0.1.1"}, "*C"
SLACK, REBUILT = 0.05, 1e-10
#: What a request holds.
REQUEST = ("source_uuid", "repeat_unit_smiles", "left_cap", "right_cap", "dp", "tacticity", "mn_g_mol", "dispersity", *PROTOCOL)
_MOST_ATOMS = 512


def chain_state(unit: str, left: str, right: str, dp: int, tacticity: str) -> dict:
    """The canonical unit, the capped first chain, the mass at dp units and the features of that chain."""
    m = structures.read(unit)
    if len(structures.ports(m)) != 2 or len(m.fragments) != 1:
        raise structures.StructureError("a connected repeat unit with two ports is needed")
    first = structures.chain(unit, 1, left, right)
    residue = structures.weight(structures.chain(unit, 2, left, right)) - structures.weight(first)
    mass = structures.weight(first) + (dp - 1) * residue
    if len(first.atoms) > _MOST_ATOMS or not dp >= 1:
        raise structures.StructureError("a bounded chain of one unit at least is needed")
    shape = [*blocks.composed(blocks.populations(first)).values(), math.log1p(dp), math.log1p(mass), 1 / dp, float(tacticity == "atactic")]
    plain = not any(a.charge or a.isotope or structures.radical(m) for a in m.atoms)
    return {"unit": structures.canonical(unit), "plain": plain, "capped": structures.write(first, marks=True), "mass": mass, "rebuilt": shape}


def with_chain_state(df: DataFrame) -> DataFrame:
    """df with state (a struct, null where the structure can't be built), worked out once per distinct request."""
    key = ["repeat_unit_smiles", "left_cap", "right_cap", "dp", "tacticity"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    out.append([*r, chain_state(*r)])
                except (structures.StructureError, TypeError, ValueError):
                    out.append([*r, None])
            yield pd.DataFrame(out, columns=[*key, "state"])

    known = df.select(*key).dropna().distinct()
    schema = "repeat_unit_smiles string, left_cap string, right_cap string, dp long, tacticity string, state struct<unit:string,plain:boolean,capped:string,mass:double,rebuilt:array<double>>"
    return df.join(known.select(*[F.col(k).cast("long") if k == "dp" else F.col(k) for k in key]).mapInPandas(run, schema), key, "left")


def registry(spark: SparkSession, uri: str, metadata: dict) -> DataFrame:
    """The rows of a registry of named arrays (an uncompressed or compressed archive); any array or metadata that is not as it should be refuses all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = located(path)
                with fs.open_input_file(at) as f, np.load(f, allow_pickle=False) as archive:
                    if set(archive.files) != {*REGISTRY, "metadata_json"}:
                        raise Refused("the registry's arrays are not the named ones")
                    found = strict_json(str(archive["metadata_json"].item()))
                    if wrong := [k for k, v in metadata.items() if found.get(k) != v]:
                        raise Refused(f"the registry's metadata differ: {wrong}")
                    arrays = {k: archive[k] for k in REGISTRY}
                n = len(arrays["source_uuid"])
                for name, (kinds, matrix) in REGISTRY.items():
                    a = arrays[name]
                    texts = a.dtype.kind == "U"
                    if a.dtype.kind not in kinds or a.ndim != 1 + matrix or len(a) != n or not n or (texts and any(not t.strip() for t in a.tolist())) or (not texts and not np.isfinite(a).all()):
                        raise Refused(f"the registry's {name} are not valid")
                if len(set(arrays["source_uuid"].tolist())) != n or (arrays["dp"] <= 0).any() or (arrays["mn_g_mol"] <= 0).any() or not set(arrays["tacticity"].tolist()) <= set(TACTICITY):
                    raise Refused("the registry's states are not valid")
                for a in range(0, n, 4096):
                    yield pa.RecordBatch.from_pydict({k: pa.array(v[a : a + 4096].tolist()) for k, v in arrays.items()})

    schema = ", ".join(f"{k} {'array<double>' if m else {'U': 'string', 'iu': 'long', 'f': 'double'}[kinds]}" for k, (kinds, m) in REGISTRY.items())
    return spark.createDataFrame([(uri,)], "uri string").mapInArrow(run, schema)


def _rules(model: dict, mode: str, values: list[Column], radii: list[float]) -> list[tuple[str, Column]]:
    """The names of refusals in order, after the lookup of a material; each with what breaks it."""
    state, known = F.col("state"), lambda c: F.col(f"known.{c}")
    off = lambda a, b: F.coalesce(F.abs(a - b) > SLACK, F.lit(True))
    caps = [F.coalesce(F.col(c) != CAP, F.lit(True)) for c in ("left_cap", "right_cap")]
    same = (state["unit"] == known("repeat_smiles")) & (F.col("dp") == known("dp")) & (F.col("tacticity") == known("tacticity"))
    apart = F.exists(F.arrays_zip(state["rebuilt"].alias("a"), known("features").alias("b")), lambda p: F.coalesce(F.abs(p["a"] - p["b"]) > REBUILT + REBUILT * F.abs(p["b"]), F.lit(True)))
    size = len(model["low"])
    beyond = refuse.out_of_range([known("features")[i] for i in range(size)], model["low"], model["high"], 0.0)
    finite = functools.reduce(lambda a, b: a & b, [refuse.finite(v) for v in values])
    return [
        ("unregistered_source_material", known("source_uuid").isNull()),
        ("source_structure_reconstruction_failed", state.isNull()),
        ("unsupported_repeat_chemistry", ~state["plain"]),
        ("unsupported_end_groups", caps[0] | caps[1]),
        ("registered_material_state_mismatch", ~F.coalesce(same, F.lit(False)) | off(F.col("mn_g_mol"), known("mn_g_mol"))),
        ("source_assembly_mismatch", F.coalesce(state["capped"] != known("capped_smiles"), F.lit(True))),
        ("source_mass_mismatch", off(state["mass"], F.col("mn_g_mol")) | off(state["mass"], known("mn_g_mol"))),
        ("source_feature_reconstruction_mismatch", apart | (F.size(known("features")) != size)),
        ("outside_training_feature_bounds", beyond),
        ("nonfinite_computed_prediction", ~F.coalesce(finite, F.lit(False))),
        ("negative_computed_prediction", functools.reduce(lambda a, b: a | b, [v < 0 for v in values])),
        ("nonfinite_computed_interval", F.lit(not all(math.isfinite(r) for r in radii))),
    ]


def predicted(requests: DataFrame, support: DataFrame, model: dict, mode: str) -> DataFrame:
    """requests with status, reason and, where there is none, a value, lower and upper bound per target.

    model: targets, low and high of the features, heads (states of A on features, B on embeddings and the last four
    features, C_chemical and C_residual), radii per mode, and the digest of all of it.
    """
    body = {k: v for k, v in model.items() if k != "digest"}
    if canonical_digest(body) != model.get("digest"):
        raise Refused("the model does not match its digest")
    if mode not in ("A", "B", "C"):
        return requests.withColumns({"status": F.lit("refused"), "reason": F.lit("unsupported_model_mode")})
    size, targets, radii = len(model["low"]), model["targets"], model["radii"][mode]
    x = [F.col("known.features")[i] for i in range(size)]

    def of(name: str, embedded: bool) -> list[Column]:
        head = heads.LinearHead.restore(model["heads"][name])
        columns = [F.col("known.embeddings")[i] for i in range(len(head.features) - 4)] + x[-4:] if embedded else x
        return list(head.predict(columns).values())

    values = [a + b for a, b in zip(of("C_chemical", False), of("C_residual", True), strict=True)] if mode == "C" else of(mode, mode == "B")
    valid = functools.reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUEST]) & (F.trim("source_uuid") != "") & (F.col("dp") >= 1) & (F.col("mn_g_mol") > 0)
    protocol = functools.reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in PROTOCOL.items()])
    rules = [
        ("invalid_material_input", ~F.coalesce(valid, F.lit(False))),
        ("unsupported_source_protocol", ~protocol),
        ("unsupported_molecular_weight_distribution", F.col("dispersity") != 1),
        *_rules(model, mode, values, radii),
    ]
    known = support.select(F.struct(*support.columns).alias("known"), F.col("source_uuid").alias("_key"))
    rows = with_chain_state(requests).join(known, F.col("source_uuid") == F.col("_key"), "left").drop("_key")
    rows = rows.withColumn("reason", refuse.first_reason(rules))
    ok = F.col("reason").isNull()
    out = {"status": F.when(ok, "computed_reference_prediction").otherwise("refused")}
    for t, v, r in zip(targets, values, radii, strict=True):
        low, high = refuse.interval(v, F.lit(r))
        out |= {t: F.when(ok, v), f"{t}_lower": F.when(ok, low), f"{t}_upper": F.when(ok, high)}
    return rows.withColumns(out).drop("state", "known").withColumn("physical_accuracy_validated", F.lit(False))


def requests_of(spark: SparkSession, text: str | bytes) -> DataFrame:
    """One request, or a list of them, of a JSON text; unknown fields refuse all."""
    records = strict_json(text)
    records = records if isinstance(records, list) else [records]
    for r in records:
        if not isinstance(r, dict) or (unknown := set(r) - set(REQUEST)):
            raise Refused(f"no request, or unknown fields: {sorted(unknown) if isinstance(r, dict) else type(r).__name__}")
    schema = ", ".join(f"{c} {'string' if c in ('source_uuid', 'repeat_unit_smiles', 'left_cap', 'right_cap', 'tacticity', 'forcefield', 'sp_module_version') else 'long' if c == 'dp' else 'double'}" for c in REQUEST)
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in records], 1))
