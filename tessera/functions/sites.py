"""Donor and acceptor sites, and partial charges by iterated equalisation of orbital electronegativity: per heavy atom.

Sites are this module's own: a donor is nitrogen, oxygen or sulfur with hydrogen; an acceptor is oxygen, or nitrogen whose
lone pair is not shared with a neighbouring double bond, a ring or a charge. None of it is an energy or a component.
"""

from __future__ import annotations

import math
from collections import deque

from .structures import Molecule, StructureError, charge_class, read

TOPOLOGY = ("donors", "acceptors", "donor_acceptor_product", "donor_acceptor_3_to_7")
CHARGES = ("abs_charge", "charge_squared", "max_charge", "min_charge", "donor_hydrogen_charge", "acceptor_charge", "hetero_abs_charge")
# Published electronegativity a + b q + c q^2 by element and hybridisation, of hydrogen's cation, and the damping.
EQUALISED = {
    "H": (7.17, 6.24, -0.56), "C3": (7.98, 9.18, 1.88), "C2": (8.79, 9.32, 1.51), "C1": (10.39, 9.45, 0.73), "N3": (11.54, 10.82, 1.36), "N2": (12.87, 11.15, 0.85), "N1": (15.68, 11.70, -0.27),
    "O3": (14.18, 12.92, 1.39), "O2": (17.07, 13.79, 0.47), "F3": (14.66, 13.85, 2.31), "Cl3": (11.00, 9.69, 1.35), "Br3": (10.08, 8.47, 1.16), "I3": (9.90, 7.96, 0.96), "S3": (10.14, 9.13, 1.38),
}
HYDROGEN_CATION, DAMPING, ROUNDS = 20.02, 0.5, 12
_NAMES = {6: "C", 7: "N", 8: "O", 9: "F", 16: "S", 17: "Cl", 35: "Br", 53: "I"}


def donors(m: Molecule) -> list[int]:
    return [i for i, a in enumerate(m.atoms) if a.number in (7, 8, 16) and a.hydrogens]


def acceptors(m: Molecule) -> list[int]:
    def free(i: int) -> bool:
        a = m.atoms[i]
        if a.charge > 0 or a.number not in (7, 8):
            return False
        if a.number == 8:
            return not a.aromatic
        if a.aromatic:
            return len(m.near[i]) == 2 and not a.hydrogens
        double = any(m.order(i, j) > 1.0 for j in m.near[i])
        return double or not any(m.atoms[j].aromatic or any(m.order(j, k) == 2.0 for k in m.near[j]) for j in m.near[i])

    return [i for i in range(len(m.atoms)) if free(i)]


def _steps(m: Molecule, start: int) -> dict[int, int]:
    """Bonds to every atom of the fragment."""
    found, todo = {start: 0}, deque([start])
    while todo:
        i = todo.popleft()
        for j in m.near[i]:
            if j not in found:
                found[j] = found[i] + 1
                todo.append(j)
    return found


def _hybrid(m: Molecule, i: int) -> str:
    a = m.atoms[i]
    if a.number not in _NAMES:
        raise StructureError(f"no published electronegativity for element {a.number}")
    orders = [m.order(i, j) for j in m.near[i]]
    level = 1 if 3.0 in orders or orders.count(2.0) > 1 else 2 if a.aromatic or 2.0 in orders else 3
    name = f"{_NAMES[a.number]}{level}"
    return name if name in EQUALISED else f"{_NAMES[a.number]}3"


def partial_charges(m: Molecule) -> tuple[list[float], list[float]]:
    """The charge of each heavy atom and that of each of its hydrogens (all alike); they add up to the formal charge."""
    kinds = [EQUALISED[_hybrid(m, i)] for i in range(len(m.atoms))]
    q, h = [float(a.charge) for a in m.atoms], [0.0] * len(m.atoms)
    value = lambda k, x: k[0] + k[1] * x + k[2] * x * x
    cation = [sum(k) for k in kinds]
    damping = DAMPING
    for _ in range(ROUNDS):
        chi, chi_h = [value(k, x) for k, x in zip(kinds, q, strict=True)], [value(EQUALISED["H"], x) for x in h]
        # What flows over a bond goes to the more electronegative end, scaled by the other end's cation.
        moved, moved_h = [0.0] * len(q), [0.0] * len(q)
        for a, b in m.bonds:
            low, high = (a, b) if chi[a] <= chi[b] else (b, a)
            flow = (chi[high] - chi[low]) / cation[low] * damping
            moved[low] += flow
            moved[high] -= flow
        for i, a in enumerate(m.atoms):
            if a.hydrogens:
                gap = chi[i] - chi_h[i]
                flow = gap / (HYDROGEN_CATION if gap > 0 else cation[i]) * damping
                moved_h[i] += flow
                moved[i] -= flow * a.hydrogens
        q, h = [x + d for x, d in zip(q, moved, strict=True)], [x + d for x, d in zip(h, moved_h, strict=True)]
        damping *= DAMPING
    return q, h


def site_features(text: str) -> dict[str, float]:
    """TOPOLOGY and CHARGES of a structure of one fragment whose charges are reviewed: counts and sums per heavy atom (pairs per its square)."""
    if charge_class(text) == "unreviewed":
        raise StructureError("a structure of one fragment with reviewed charges is needed")
    m = read(text)
    heavy = sum(a.number > 1 for a in m.atoms)
    give, take = donors(m), acceptors(m)
    within = sum(3 <= steps.get(j, 0) <= 7 for steps in (_steps(m, i) for i in give) for j in take)
    out = dict(zip(TOPOLOGY, (len(give) / heavy, len(take) / heavy, len(give) * len(take) / heavy**2, within / heavy**2), strict=True))
    q, h = partial_charges(m)
    every = [*q, *(x for x, a in zip(h, m.atoms, strict=True) for _ in range(a.hydrogens))]
    sums = (sum(map(abs, every)) / heavy, sum(x * x for x in every) / heavy, max(every), min(every), sum(h[i] * m.atoms[i].hydrogens for i in give) / heavy, sum(q[i] for i in take) / heavy, sum(abs(x) for x, a in zip(q, m.atoms, strict=True) if a.number != 6) / heavy)
    if not all(map(math.isfinite, sums)):
        raise StructureError("charges do not settle")
    return out | dict(zip(CHARGES, sums, strict=True))
