"""Scalar expressions: bits, kernels, unit conversions, canonical keys."""

from __future__ import annotations

import hashlib
import json
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

AVOGADRO = 6.02214076e23


def sign_bits(vector: Column, bits: int = 63) -> Column:
    """A long whose bit i says that element i is positive."""
    places = F.slice(vector, 1, bits)
    return F.aggregate(F.transform(places, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits over bits in either, 0 if there are none."""
    return F.bit_count(a.bitwiseAND(b)) / F.greatest(F.bit_count(a.bitwiseOR(b)), F.lit(1))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rbf(a: Column, b: Column, gamma: float, columns: int | None = None) -> Column:
    """exp(-gamma d2), or with columns exp(-gamma d2 / columns)."""
    return F.exp(-F.lit(gamma) * squared_distance(a, b) / F.lit(columns or 1))


def mixed(parts: list[tuple[float, Column]]) -> Column:
    """Weighted sum of kernels."""
    out = F.lit(0.0)
    for weight, kernel in parts:
        out = out + F.lit(weight) * kernel
    return out


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def polar_parts(dispersion: Column, polar: Column, bonding: Column, volume: Column) -> list[Column]:
    """Fd / V, root of the sum of squares of polar terms (an array) / V, root of Eh / V; null unless V > 0 and Eh >= 0."""
    ok = volume > 0
    root = F.sqrt(F.aggregate(polar, F.lit(0.0), lambda s, x: s + x * x))
    return [F.when(ok, dispersion / volume), F.when(ok, root / volume), F.when(ok & (bonding >= 0), F.sqrt(bonding / volume))]


def energy_density(energy_kj_mol: Column, volume_nm3: Column) -> Column:
    """kJ/mol in nm3 as MPa."""
    return energy_kj_mol / volume_nm3 * F.lit(1e24 / AVOGADRO)


def exponent_number(text: Column) -> Column:
    """A number whose exponent may be written with D; null if it isn't one."""
    return F.regexp_replace(text, "[Dd]", "e").try_cast("double")


def mean_repeats(mn: Column, offset: Column, residue: Column) -> Column:
    """(Mn - offset) / residue, null below one repeat."""
    n = F.try_divide(mn - offset, residue)
    return F.when(n >= 1, n)


def mass_consistent(stated: Column, computed: Column) -> Column:
    """Whether both differ by at most the larger of 1 % and 0.1."""
    return F.abs(stated - computed) <= F.greatest(F.abs(computed) * 0.01, F.lit(0.1))


def moment_line(raw4: Column, raw16: Column, raw64: Column, n: Column, atol: float = 1e-7, rtol: float = 1e-9) -> tuple[Column, Column]:
    """Value at n of the line through the populations of 16 and 64 units, and whether it also holds at 4 units."""
    slope = (raw64 - raw16) / 48
    offset = raw16 - slope * 16
    at4 = slope * 4 + offset
    return slope * n + offset, F.abs(raw4 - at4) <= F.lit(atol) + F.lit(rtol) * F.abs(at4)


def canonical_number(value: object) -> str:
    """One text per exact decimal value: 5, 5.0 and 50e-1 are equal; zero is `0`; no value is rounded."""
    try:
        d = Decimal(str(value))
    except InvalidOperation:
        raise ValueError(f"no number: {value!r}") from None
    if not d.is_finite():
        raise ValueError("a finite number is needed")
    if d == 0:
        return "0"
    sign, digits, exponent = d.as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    kept = text.rstrip("0")
    exponent += len(text) - len(kept)
    return ("-" if sign else "") + kept + (f"E{exponent}" if exponent else "")


def canonical_number_column(text: Column) -> Column:
    """canonical_number of plain decimal notation, as an expression."""
    sign = F.when(text.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(text, "^[+-]", "")
    whole, part = F.split_part(bare, F.lit("."), F.lit(1)), F.split_part(bare, F.lit("."), F.lit(2))
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    kept = F.regexp_replace(digits, "0+$", "")
    exponent = F.length(digits) - F.length(kept) - F.length(part)
    return F.when(kept == "", "0").otherwise(F.concat(sign, kept, F.when(exponent == 0, "").otherwise(F.concat(F.lit("E"), exponent.cast("string")))))


def canonical_digest(value: object) -> str:
    """SHA-256 of compact JSON with sorted keys; NaN and infinities are refused."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def canonical_digest_column(fields: dict[str, Column]) -> Column:
    """canonical_digest of an object of whole numbers, texts and truth values, as an expression; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)
