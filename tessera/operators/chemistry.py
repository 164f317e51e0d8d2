"""Structure functions over columns: each distinct text is worked out once, and failures are reasons, not errors."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import blocks, crippen, sites, structures, tautomers
from .grouping import alias_components


def _per_distinct(df: DataFrame, column: str, schema: str, work: Callable[[str], dict]) -> DataFrame:
    """df with work's columns and `structure_fault`, joined from the distinct texts."""
    names = [p.strip().split()[0] for p in _columns(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch[column]:
                try:
                    rows.append({column: text, **work(text), "structure_fault": None})
                except structures.StructureError as e:
                    rows.append({column: text, **dict.fromkeys(names), "structure_fault": str(e)})
            yield pd.DataFrame(rows, columns=[column, *names, "structure_fault"])

    found = df.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(run, f"{column} string, {schema}, structure_fault string")
    out = df.join(found, column, "left")
    return out.withColumn("structure_fault", F.when(F.col(column).isNull(), "text_missing").otherwise(F.col("structure_fault")))


def _columns(schema: str) -> list[str]:
    """The parts of a schema text between its outer commas."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i])
            last = i + 1
    return [*out, schema[last:]]


def with_features(df: DataFrame, column: str = "smiles") -> DataFrame:
    """canonical, features (27 numbers, structures.FEATURES) and fingerprint bits; refused rows have nulls and a fault."""
    return _per_distinct(df, column, "canonical string, features array<double>, bits array<int>", lambda t: {"canonical": structures.canonical(t), "features": structures.features(t), "bits": structures.fingerprint(t)})


def with_ownership(df: DataFrame, column: str = "smiles") -> DataFrame:
    """counts (group to number), unassigned atoms and the covered fraction."""

    def work(t: str) -> dict:
        owned = structures.owned_groups(structures.read(structures.canonical(t)))
        return {"counts": {k: v for k, v in owned.counts.items() if v}, "unassigned": owned.unassigned, "coverage": owned.fraction}

    return _per_distinct(df, column, "counts map<string,int>, unassigned array<int>, coverage double", work)


def with_scope(df: DataFrame, column: str = "smiles") -> DataFrame:
    """scope (all reasons against) and supported."""
    out = _per_distinct(df, column, "scope array<string>", lambda t: {"scope": structures.scope_reasons(t)})
    return out.withColumn("supported", F.coalesce(F.size("scope") == 0, F.lit(False)))


def with_aliases(df: DataFrame, column: str = "smiles") -> DataFrame:
    """aliases of each structure, its scaffold and its charge class."""
    return _per_distinct(df, column, "aliases array<string>, scaffold string, charges string", lambda t: {"aliases": structures.aliases(t), "scaffold": structures.scaffold(t), "charges": structures.charge_class(t)})


def with_periodic_alias(df: DataFrame, column: str = "smiles") -> DataFrame:
    return _per_distinct(df, column, "periodic string", lambda t: {"periodic": structures.periodic_alias(t)})


def with_canonical(df: DataFrame, column: str = "smiles") -> DataFrame:
    """The canonical text and the fingerprint's bits."""
    return _per_distinct(df, column, "canonical string, bits array<int>", lambda t: {"canonical": structures.canonical(t), "bits": structures.fingerprint(t)})


def with_tautomer_parent(df: DataFrame, column: str = "smiles") -> DataFrame:
    """The tautomer parent; a set of forms beyond the bounds is a fault."""
    return _per_distinct(df, column, "parent string", lambda t: {"parent": tautomers.parent(t)})


def with_charges(df: DataFrame, column: str = "smiles") -> DataFrame:
    """The charge class, and whether the structure is one saturated chain of carbon and hydrogen."""
    return _per_distinct(df, column, "charges string, saturated boolean", lambda t: {"charges": structures.charge_class(t), "saturated": structures.saturated_chain(t)})


def with_source_groups(df: DataFrame, column: str = "smiles") -> DataFrame:
    """Counts of the source groups that occur; refused where an atom belongs to none."""
    return _per_distinct(df, column, "source_groups map<string,int>", lambda t: {"source_groups": {k: v for k, v in structures.source_groups(t).items() if v}})


def with_totals(df: DataFrame, column: str = "smiles") -> DataFrame:
    """log_p and refraction by published contributions, and the site features (null, without fault, where charges are not reviewed)."""

    def work(t: str) -> dict:
        log_p, refraction = crippen.totals(t)
        try:
            found = sites.site_features(t)
        except structures.StructureError:
            found = None
        return {"log_p": log_p, "refraction": refraction, "sites": found}

    return _per_distinct(df, column, "log_p double, refraction double, sites map<string,double>", work)


def with_surfactant(df: DataFrame) -> DataFrame:
    """The columns tail_smiles, head_smiles, eo_mean, po_mean and block_order with mn, mean_heavy_atoms, features and issues of the block chain, worked out once for each distinct record, or a fault."""
    key = ["tail_smiles", "head_smiles", "eo_mean", "po_mean", "block_order"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                plain = {k: None if pd.isna(v) else v for k, v in r.items()}
                try:
                    found = blocks.surfactant(plain | {"sequence": "block"})
                    out.append(plain | {"mn": found["mn"], "mean_heavy_atoms": found["mean_heavy_atoms"], "features": found["features"], "issues": found["issues"], "structure_fault": None})
                except (structures.StructureError, TypeError) as e:
                    out.append(plain | dict.fromkeys(("mn", "mean_heavy_atoms", "features", "issues")) | {"structure_fault": str(e)})
            yield pd.DataFrame(out, columns=[*key, "mn", "mean_heavy_atoms", "features", "issues", "structure_fault"])

    texts = df.select(*[F.col(k).cast("double" if k.endswith("mean") else "string") for k in key]).distinct()
    found = texts.mapInPandas(run, "tail_smiles string, head_smiles string, eo_mean double, po_mean double, block_order string, mn double, mean_heavy_atoms double, features map<string,double>, issues array<string>, structure_fault string")
    same = [df[k].eqNullSafe(found[k]) for k in key]
    return df.join(found, functools.reduce(operator.and_, same), "left").drop(*[found[k] for k in key])


def families(df: DataFrame, row: str, column: str = "smiles") -> DataFrame:
    """row and group: rows that share an identity, topology or scaffold belong together."""
    return alias_components(with_aliases(df, column).where("structure_fault IS NULL"), row, F.col("aliases"))


@udtf(returnType="place int, number int, aromatic boolean, charge int, hydrogens int, ring boolean")
class AtomsOf:
    """Rows for the atoms of a structure; none for a text that isn't one."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            m = structures.read(text)
        except structures.StructureError:
            return
        for i, a in enumerate(m.atoms):
            yield i, a.number, a.aromatic, a.charge, a.hydrogens, i in m.ring_atoms


@udtf(returnType="first int, second int, bond_order double, ring boolean")
class BondsOf:
    """Rows for the bonds of a structure."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            m = structures.read(text)
        except structures.StructureError:
            return
        for (a, b), o in sorted(m.bonds.items()):
            yield a, b, o, (a, b) in m.ring_bonds


def register(spark) -> None:
    """atoms_of(text) and bonds_of(text) as SQL table functions."""
    spark.udtf.register("atoms_of", AtomsOf)
    spark.udtf.register("bonds_of", BondsOf)
