"""Block chains of two repeat units between caps: assembly, masses and mean populations. No physical property is predicted."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import numpy as np

from .structures import GROUP_NAMES, Molecule, StructureError, joined, owned_groups, polar_area, read, rotatable, weight

# The units, in order of their ports, and the orders of blocks.
EO, PO = "[1*]OCC[2*]", "[1*]OCC(C)[2*]"
ORDERS = ("eo_then_po", "po_then_eo")
#: Chains of so many units at most are built atom by atom; longer ones lie on a plane through chains of these block lengths.
BUILT, LATTICE = 48, (5, 9, 23)
#: What is counted: groups, then additive descriptors, unassigned and heavy atoms.
COUNTED = (*GROUP_NAMES, "weight", "rings", "rotatable", "polar_area", "unassigned", "heavy")


def assembled(tail: str, head: str, eo: int, po: int, order: str = ORDERS[0]) -> Molecule:
    """tail, the two blocks in that order, head; without units both caps are tied to each other."""
    if order not in ORDERS or any(isinstance(n, bool) or not isinstance(n, int) or n < 0 for n in (eo, po)):
        raise StructureError("whole numbers of units and a known order are needed")
    blocks = [[EO] * eo, [PO] * po]
    return joined(sum(blocks if order == ORDERS[0] else blocks[::-1], []), tail, head)


def populations(m: Molecule) -> np.ndarray:
    """COUNTED of one molecule: all of them add up over long chains."""
    owned = owned_groups(m)
    return np.array([*owned.counts.values(), weight(m), m.rings, rotatable(m), polar_area(m), len(owned.unassigned), owned.heavy], float)


def plane(build: Callable[[int, int], np.ndarray], present: tuple[bool, bool]) -> np.ndarray:
    """Coefficients (eo, po, 1) of the populations of long blocks: the least squares over a lattice of built chains.

    The lattice has more chains than coefficients; unless the plane goes through all of them, populations don't add up.
    """
    lattice = list(itertools.product(*(LATTICE if p else (0,) for p in present)))
    design = np.array([[*n, 1.0] for n in lattice])
    built = np.array([build(*n) for n in lattice])
    found = np.linalg.lstsq(design, built, rcond=None)[0]
    if not np.allclose(design @ found, built, atol=1e-7, rtol=1e-9):
        raise StructureError("populations are no plane in the numbers of units")
    return found


@functools.lru_cache(maxsize=512)
def _plane(tail: str, head: str, order: str, present: tuple[bool, bool]) -> np.ndarray:
    return plane(lambda e, p: populations(assembled(tail, head, e, p, order)), present)


def mean_populations(tail: str, head: str, eo: float, po: float, order: str = ORDERS[0]) -> np.ndarray:
    """Populations at (mean) numbers of units: built where they are whole and few, else from the plane."""
    if eo < 0 or po < 0:
        raise StructureError("numbers of units are not negative")
    if float(eo).is_integer() and float(po).is_integer() and eo + po <= BUILT:
        return populations(assembled(tail, head, int(eo), int(po), order))
    return np.array([eo, po, 1.0]) @ _plane(tail, head, order, (eo > 0, po > 0))


def composed(raw: np.ndarray) -> dict[str, float]:
    """Per heavy atom: each count and its root, and the inverse size and its root: the same for any multiple of a chain's interior."""
    heavy = raw[-1]
    share = raw[:-1] / heavy if heavy > 0 else raw[:-1] * np.nan
    if not np.isfinite(share).all() or (share < -1e-10).any():
        raise StructureError("populations have to be finite and not negative")
    share = np.maximum(share, 0)
    names = COUNTED[:-1]
    return dict(zip(names, share.tolist(), strict=True)) | {f"root_{n}": v for n, v in zip(GROUP_NAMES, np.sqrt(share[: len(GROUP_NAMES)]).tolist(), strict=True)} | {"inverse_heavy": float(1 / heavy), "inverse_root_heavy": float(heavy**-0.5)}


def surfactant(record: dict) -> dict:
    """Masses, mean populations and intensive features of a nonionic block surfactant; what is left open is named in `issues`.

    record: series_id, tail_smiles, head_smiles, eo_mean, po_mean, sequence, block_order, distribution, joint_pmf of
    (eo, po, probability), mn_g_mol, ionic, counterion_smiles.
    """
    get = record.get
    eo, po, order = get("eo_mean") or 0.0, get("po_mean") or 0.0, get("block_order")
    tail, head = record["tail_smiles"], record["head_smiles"]
    if get("ionic") or get("counterion_smiles") is not None or any(a.charge for t in (tail, head) for a in read(t).atoms):
        raise StructureError("ionic materials need a method of their own")
    if get("sequence") != "block" or (eo and po and order is None):
        raise StructureError("blocks and, of two, their order have to be stated")
    order = order or ORDERS[0]
    pmf, kind = get("joint_pmf") or [], get("distribution") or "unknown"
    if kind == "empirical":
        raw = sum(w * mean_populations(tail, head, e, p, order) for e, p, w in pmf)
    else:
        raw = mean_populations(tail, head, eo, po, order)
    caps, one, other = (weight(assembled(tail, head, *n)) for n in ((0, 0), (1, 0), (0, 1)))
    mn = caps + eo * (one - caps) + po * (other - caps)
    stated = get("mn_g_mol")
    issues = [name for name, holds in (
        ("regiochemistry_and_tacticity_of_po_unspecified", bool(po)),
        ("means_do_not_fix_nonlinear_features_or_empty_blocks", kind not in ("empirical", "monodisperse")),
        ("stated_mass_disagrees_with_mean_counts", stated is not None and abs(mn - stated) > max(0.01 * stated, 0.1)),
    ) if holds]
    return {"series_id": get("series_id"), "block_order": order, "cap_mass": caps, "eo_mass": one - caps, "po_mass": other - caps, "mn": mn, "mean_heavy_atoms": float(raw[-1]), "coverage": float(1 - raw[-2] / raw[-1]), "populations": dict(zip(COUNTED, raw.tolist(), strict=True)), "features": composed(raw), "issues": issues, "physical_accuracy_validated": False}
