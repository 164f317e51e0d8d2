"""Exact lookups over reviewed ledgers: completeness first, then filters that expose conflicts instead of hiding them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest
from ..sources.contracts import OBSERVATION_REVIEW, Refused
from .refuse import bijection, conflicts


def quantity_key(q: Column) -> Column:
    """Value, unit and qualifier of a quantity as one text; where it stood and how it was written do not count."""
    return F.concat_ws("|", F.coalesce(q["value"].cast("decimal(38,18)").cast("string"), F.lit("unreported")), F.coalesce(q["unit"], F.lit("")), F.coalesce(q["qualifier"], F.lit("")))


@dataclass
class Ledger:
    """Records whose review is parsed, whose origins are complete and whose support is checked."""

    records: DataFrame
    review: dict
    quantities: tuple[str, ...]
    plain: tuple[str, ...]
    outcome: str

    @classmethod
    def open(cls, records: DataFrame, review: str | bytes | dict, expected: DataFrame, origin: list[str], allowed: dict[str, DataFrame], quantities: tuple[str, ...], plain: tuple[str, ...], outcome: str) -> Ledger:
        """expected: all reviewed origins, once each. allowed: per column a table of the values that it may have."""
        parsed = OBSERVATION_REVIEW.authorize(OBSERVATION_REVIEW.parse(review), "lookup")
        found = bijection(expected.select(*origin), records.select(*origin)).first()
        if found["missing"] or found["unexpected"]:
            raise Refused(f"{found['missing']} origins are missing, {found['unexpected']} unexpected or repeated")
        for column, values in allowed.items():
            if records.join(values.toDF("_v"), records[column] == F.col("_v"), "left_anti").limit(1).count():
                raise Refused(f"{column} has values outside the review")
        if records.count() != parsed["row_count"]:
            raise Refused("the number of records is not the reviewed one")
        return cls(records, parsed, quantities, plain, outcome)

    def matching(self, query: dict) -> DataFrame:
        """Left out: all; None: unreported only; a value: equal value, unit and qualifier (and spelling of the unit if given)."""
        out = self.records
        for name, wanted in query.items():
            if name in self.quantities:
                q = F.col(name)
                if wanted is None:
                    out = out.where(q["value"].isNull())
                else:
                    for part in ("value", "unit", "qualifier", *(["unit_as_reported"] if "unit_as_reported" in wanted else [])):
                        out = out.where(q[part].eqNullSafe(F.lit(wanted.get(part))))
            elif name in self.plain:
                out = out.where(F.col(name).isNull() if wanted is None else F.col(name) == F.lit(wanted))
            else:
                raise Refused(f"unknown field: {name}")
        return out

    def conditions(self, records: DataFrame) -> DataFrame:
        return records.withColumn("condition_key", F.concat_ws("\u001f", *[quantity_key(F.col(q)) for q in self.quantities]))

    def lookup(self, query: dict, subject: str, formulation: str, present: str) -> dict:
        """Counts and records; an unknown subject is no error and nothing is interpolated."""
        found = self.conditions(self.matching(query))
        both = conflicts(found, [subject, "condition_key"], self.outcome)
        counts = found.agg(
            F.count(F.lit(1)).alias("outcome_records"),
            F.count_distinct(formulation).alias("formulations"),
            F.count_distinct(F.when(F.col(present), F.col(formulation))).alias("present_formulations"),
            F.count_distinct(F.when(~F.col(present), F.col(formulation))).alias("control_formulations"),
        ).first()
        clash = both.agg(F.coalesce(F.max("conflict"), F.lit(False)).alias("c")).first()["c"]
        return {
            "status": "reported_observations" if counts["outcome_records"] else "no_reported_observation",
            "query": query,
            "query_sha256": canonical_digest(query),
            **counts.asDict(),
            "conflicting_outcomes_at_same_conditions": clash,
            "physical_accuracy_validated": False,
            "records": found,
        }


def report(found: dict) -> str:
    """The lookup as JSON, without its table."""
    return json.dumps({k: v for k, v in found.items() if k != "records"}, sort_keys=True)
