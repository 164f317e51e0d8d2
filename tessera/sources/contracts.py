"""Manifests and reviews: closed records that are parsed and authorised before any asset is opened.

A contract lists fields (kind, whether required, a check), rules over the whole record, and per purpose what has to hold.
Parsing is strict: repeated keys, unknown keys, NaN, numbers for booleans and booleans for numbers are refused.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Refused(ValueError):
    """A record, purpose or table is refused; nothing is repaired."""


def strict_json(text: str | bytes) -> Any:
    """JSON without repeated keys and nonfinite numbers; a byte-order mark is dropped."""
    if isinstance(text, bytes):
        text = text.decode("utf-8-sig")

    def once(pairs: list[tuple[str, Any]]) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise Refused("a key occurs twice")
        return out

    def no(token: str) -> None:
        raise Refused(f"{token} is no JSON number")

    try:
        return json.loads(text.removeprefix("﻿"), object_pairs_hook=once, parse_constant=no)
    except json.JSONDecodeError as e:
        raise Refused(f"no JSON: {e}") from None


@dataclass(frozen=True)
class Field:
    kind: str  # text, bool, int, number, enum, sha256, list, record, null
    required: bool = True
    default: Any = None
    choices: tuple[Any, ...] = ()

    def read(self, name: str, value: Any) -> Any:
        ok = {
            "text": lambda v: isinstance(v, str) and bool(v.strip()),
            "bool": lambda v: isinstance(v, bool),
            "int": lambda v: isinstance(v, int) and not isinstance(v, bool),
            "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v),
            "enum": lambda v: v in self.choices and type(v) in {type(c) for c in self.choices},
            "sha256": lambda v: isinstance(v, str) and re.fullmatch("[0-9a-f]{64}", v) is not None,
            "list": lambda v: isinstance(v, list),
            "record": lambda v: isinstance(v, dict),
            "null": lambda v: v is None,
        }[self.kind]
        if value is None and not self.required and self.default is None:
            return None
        if not ok(value):
            raise Refused(f"{name} is not a valid {self.kind}")
        return value


Rule = tuple[str, Callable[[dict], bool]]


@dataclass(frozen=True)
class Contract:
    name: str
    fields: dict[str, Field]
    rules: tuple[Rule, ...] = ()
    purposes: dict[str, tuple[Rule, ...]] = field(default_factory=dict)

    def parse(self, text: str | bytes | dict) -> dict:
        record = text if isinstance(text, dict) else strict_json(text)
        if not isinstance(record, dict):
            raise Refused(f"{self.name} has to be an object")
        if unknown := set(record) - set(self.fields):
            raise Refused(f"{self.name} has unknown fields: {sorted(unknown)}")
        out = {}
        for key, f in self.fields.items():
            if key not in record:
                if f.required:
                    raise Refused(f"{self.name} lacks {key}")
                out[key] = f.default
            else:
                out[key] = f.read(key, record[key])
        for message, holds in self.rules:
            if not holds(out):
                raise Refused(message)
        return out

    def authorize(self, record: dict, purpose: str) -> dict:
        for message, holds in self.purposes[purpose]:
            if not holds(record):
                raise Refused(message)
        return record


def _text(required: bool = True) -> Field:
    return Field("text", required)


def _flag() -> Field:
    return Field("bool", False, False)


def _false() -> Field:
    return Field("enum", False, False, (False,))


_STATUS = Field("enum", choices=("approved", "pending", "denied"))
# Kinds of labels and licences that count as permissive.
LABEL_KINDS = ("synthetic", "teacher_reproduction", "experimental", "published_reference")
PERMISSIVE = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC")
_APPROVED: Rule = ("rights are not approved", lambda r: r["rights_status"] == "approved")
_MAY_TRAIN: Rule = ("training and derived-weight permissions are needed", lambda r: r["training_allowed"] and r["derived_weights_allowed"])

DATASET = Contract(
    "dataset manifest",
    {
        "schema_version": Field("enum", False, 1, (1,)), "dataset_id": _text(), "sha256": Field("sha256"), "label_kind": Field("enum", choices=LABEL_KINDS),
        "allowed_role": Field("enum", False, "training", ("training", "evaluation_only")), "units": Field("enum", False, "MPa^0.5", ("MPa^0.5",)), "source": _text(), "license": _text(),
        "rights_status": _STATUS, "permission_evidence": _text(), "approved_by": _text(), "local_evaluation_allowed": _flag(), "training_allowed": _flag(), "derived_labels_allowed": _flag(),
        "derived_weights_allowed": _flag(), "redistribution_allowed": _flag(), "confidential": _flag(), "temperature_k": Field("number", False, 298.15), "teacher_id": _text(False),
        "independent_measurements": _flag(), "audit_basis": Field("enum", False, "documented_permission", ("documented_permission", "operator_assumption")), "restricted_asset_permission_evidence": _text(False),
    },
    (
        ("an operator's assumption cannot allow redistribution", lambda r: not (r["audit_basis"] == "operator_assumption" and r["redistribution_allowed"])),
        ("teacher_id belongs to reproductions of a teacher, and to them only", lambda r: (r["label_kind"] == "teacher_reproduction") == bool(r["teacher_id"])),
        ("experimental labels are independent measurements, and they only", lambda r: (r["label_kind"] == "experimental") == r["independent_measurements"]),
        ("the temperature has to be positive", lambda r: r["temperature_k"] > 0),
    ),
    {
        "train": (("an evaluation-only dataset cannot train", lambda r: r["allowed_role"] != "evaluation_only"), _APPROVED, _MAY_TRAIN, ("pseudo-label permission is needed", lambda r: r["label_kind"] != "teacher_reproduction" or r["derived_labels_allowed"])),
        "evaluate": (_APPROVED, ("local evaluation permission is needed", lambda r: r["local_evaluation_allowed"]), ("pseudo-label permission is needed", lambda r: r["label_kind"] != "teacher_reproduction" or r["derived_labels_allowed"])),
    },
)

EMBEDDING = Contract(
    "embedding manifest",
    {
        "schema_version": Field("enum", False, 1, (1,)), "encoder_id": _text(), "revision": _text(), "sha256": Field("sha256"), "weights_license": _text(), "code_license": _text(), "dependency_review": _STATUS,
        "rights_status": _STATUS, "permission_evidence": _text(), "frozen": Field("enum", choices=(True,)), "training_allowed": _flag(), "derived_weights_allowed": _flag(), "commercial_use_allowed": _flag(),
    },
    (),
    {
        "train": (
            ("weights, code or dependencies are not approved", lambda r: r["rights_status"] == r["dependency_review"] == "approved"),
            ("licences have to be permissive", lambda r: r["weights_license"] in PERMISSIVE and r["code_license"] in PERMISSIVE),
            ("training, derived-weight and commercial permissions are needed", lambda r: r["training_allowed"] and r["derived_weights_allowed"] and r["commercial_use_allowed"]),
        )
    },
)

AUXILIARY = Contract(
    "auxiliary manifest",
    {
        "schema_version": Field("enum", False, 1, (1,)), "dataset_id": _text(), "sha256": Field("sha256"), "source": _text(), "license": _text(), "rights_status": _STATUS, "permission_evidence": _text(),
        "target_names": Field("list"), "target_units": Field("list"), "training_allowed": _flag(), "derived_weights_allowed": _flag(), "lineage": _text(False),
    },
    (("targets need names and units, each once", lambda r: r["target_names"] and len(r["target_names"]) == len(r["target_units"]) == len(set(r["target_names"]))),),
    {"train": (_APPROVED, _MAY_TRAIN)},
)

SOURCE_REVIEW = Contract(
    "source review",
    {"sha256": Field("sha256"), "source": _text(), "license": _text(), "rights_status": _STATUS, "permission_evidence": _text(), "local_preparation_allowed": _flag(), "accuracy_validated": _false()},
    (),
    {"prepare": (_APPROVED, ("local preparation permission is needed", lambda r: r["local_preparation_allowed"]))},
)

OBSERVATION_REVIEW = Contract(
    "observation review",
    {
        "ledger_sha256": Field("sha256"), "source_sha256": Field("sha256"), "license": _text(), "reviewed_by": _text(), "row_count": Field("int"), "lookup_allowed": Field("enum", choices=(True,)),
        "training_allowed": _false(), "physical_accuracy_validated": _false(), "population": Field("record", False, None),
    },
    (
        ("row_count has to be positive", lambda r: r["row_count"] > 0),
        ("population counts have to add up to row_count", lambda r: r["population"] is None or sum(r["population"].values()) == r["row_count"]),
    ),
    {"lookup": ()},
)

COEFFICIENTS = Contract(
    "coefficient review",
    {"sha256": Field("sha256"), "license": _text(), "rights_status": _STATUS, "permission_evidence": _text(), "calculation_allowed": _flag(), "reference_temperature_k": Field("number", False, None)},
    (("the temperature has to be positive", lambda r: r["reference_temperature_k"] is None or r["reference_temperature_k"] > 0),),
    {"calculate": (_APPROVED, ("calculation permission is needed", lambda r: r["calculation_allowed"]))},
)


CHECKPOINT = Contract(
    "checkpoint review",
    {"encoder_id": _text(), "revision": _text(), "files": Field("record"), "weights_license": _text(), "code_license": _text(), "rights_status": _STATUS, "permission_evidence": _text(), "download_allowed": _flag()},
    (("files have to be named", lambda r: bool(r["files"])),),
    {"fetch": (_APPROVED, ("licences have to be permissive", lambda r: r["weights_license"] in PERMISSIVE and r["code_license"] in PERMISSIVE), ("download permission is needed", lambda r: r["download_allowed"]))},
)


# --------------------------------------------------------------------- the same kind of validators as columns of reasons


def polymer_reasons(p: Column) -> Column:
    """Of a struct series_id, repeat_units[mole_fraction], mn_g_mol, dispersity, end_groups[count_per_chain]."""
    from ..operators.refuse import all_reasons

    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + x[f])
    fractions, ends = total(p["repeat_units"], "mole_fraction"), F.coalesce(total(p["end_groups"], "count_per_chain"), F.lit(0.0))
    return all_reasons([
        ("series_id_missing", F.coalesce(F.length(p["series_id"]) == 0, F.lit(True))),
        ("repeat_units_missing", F.coalesce(F.size(p["repeat_units"]) < 1, F.lit(True))),
        ("mole_fractions_do_not_sum_to_one", F.abs(fractions - 1) > 1e-6),
        ("mole_fraction_out_of_range", F.exists(p["repeat_units"], lambda r: (r["mole_fraction"] <= 0) | (r["mole_fraction"] > 1))),
        ("mn_not_positive", ~F.coalesce(p["mn_g_mol"] > 0, F.lit(False))),
        ("dispersity_below_one", F.coalesce(p["dispersity"] < 1, F.lit(False))),
        ("too_many_end_groups", (F.coalesce(F.size(p["end_groups"]), F.lit(0)) > 2) | (ends > 2)),
    ])


def distribution_reasons(d: Column) -> Column:
    """Of a struct eo_mean, po_mean, eo_std, po_std, sequence, block_order, distribution, joint_pmf[eo, po, p]."""
    from ..operators.refuse import all_reasons

    pmf = d["joint_pmf"]
    size = F.coalesce(F.size(pmf), F.lit(0))
    empirical = d["distribution"] == "empirical"
    fold = lambda f: F.aggregate(pmf, F.lit(0.0), lambda s, x: s + f(x))
    bad = F.lit(False)
    for axis in ("eo", "po"):
        mean, std = d[f"{axis}_mean"], d[f"{axis}_std"]
        bad = bad | (F.abs(fold(lambda x, a=axis: x[a] * x["p"]) - mean) > 1e-6)
        spread = F.sqrt(fold(lambda x, a=axis, m=mean: (x[a] - m) * (x[a] - m) * x["p"]))
        bad = bad | F.coalesce(F.abs(spread - std) > 1e-6, F.lit(False))
    whole = (d["eo_mean"] == F.floor(d["eo_mean"])) & (d["po_mean"] == F.floor(d["po_mean"]))
    return all_reasons([
        ("chain_is_empty", ~F.coalesce(d["eo_mean"] + d["po_mean"] > 0, F.lit(False))),
        ("block_order_without_block", d["block_order"].isNotNull() & (d["sequence"] != "block")),
        ("pmf_missing", empirical & (size == 0)),
        ("pmf_not_allowed", ~empirical & (size > 0)),
        ("pmf_bins_repeat", empirical & (F.size(F.array_distinct(F.transform(pmf, lambda x: F.struct(x["eo"], x["po"])))) < size)),
        ("pmf_entry_out_of_range", empirical & F.exists(pmf, lambda x: (x["eo"] < 0) | (x["po"] < 0) | ~(x["p"] > 0))),
        ("pmf_does_not_sum_to_one", empirical & (F.abs(fold(lambda x: x["p"]) - 1) > 1e-6)),
        ("pmf_disagrees_with_moments", empirical & bad),
        ("monodisperse_counts_are_integers", (d["distribution"] == "monodisperse") & (~whole | F.coalesce(d["eo_std"] > 0, F.lit(False)) | F.coalesce(d["po_std"] > 0, F.lit(False)))),
    ])


def surfactant_reasons(s: Column, d: Column) -> Column:
    """Of a struct series_id, head_smiles, tail_smiles, mn_g_mol, ionic, counterion_smiles, temperature_k and its distribution d."""
    from ..operators.refuse import all_reasons

    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    own = all_reasons([
        ("series_id_missing", blank(s["series_id"])),
        ("head_or_tail_missing", blank(s["head_smiles"]) | blank(s["tail_smiles"])),
        ("mn_not_positive", s["mn_g_mol"].isNotNull() & ~(s["mn_g_mol"] > 0)),
        ("counterion_without_charge", s["counterion_smiles"].isNotNull() & ~F.coalesce(s["ionic"], F.lit(False))),
        ("temperature_not_positive", s["temperature_k"].isNotNull() & ~(s["temperature_k"] > 0)),
    ])
    return F.concat(own, distribution_reasons(d))


def mixture_reasons(components: Column, fractions: Column) -> Column:
    from ..operators.refuse import all_reasons

    return all_reasons([
        ("too_few_components", ~F.coalesce(F.size(components) >= 2, F.lit(False))),
        ("one_fraction_per_component", F.size(components) != F.size(fractions)),
        ("fraction_not_positive", F.exists(fractions, lambda x: F.isnan(x) | ~(x > 0))),
        ("fractions_do_not_sum_to_one", F.abs(F.aggregate(fractions, F.lit(0.0), lambda s, x: s + x) - 1) > 1e-6),
    ])


def quantity_reasons(q: Column) -> Column:
    """Of a struct value, unit, qualifier: a value needs a unit and a qualifier, no value has neither; wt% lies in 0..100."""
    from ..operators.refuse import all_reasons

    has = q["value"].isNotNull()
    return all_reasons([
        ("value_without_unit", has & q["unit"].isNull()),
        ("unit_without_value", ~has & q["unit"].isNotNull()),
        ("qualifier_without_value", ~has & q["qualifier"].isNotNull() & (q["qualifier"] != "unreported")),
        ("value_not_finite", has & (F.isnan(q["value"]) | (F.abs(q["value"]) == float("inf")))),
        ("weight_percent_out_of_range", (q["unit"] == "wt%") & ((q["value"] < 0) | (q["value"] > 100))),
    ])
