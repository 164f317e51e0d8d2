"""Tautomer parents: all forms that shifts of a hydrogen over three atoms reach, within bounds, and the one that stands for them.

A shift takes the hydrogen of an uncharged atom to the far end of a double bond beside it; carbon gives or takes it only
where the other end is N, O or S. Rings of six electrons that arise are aromatic and stay so: a form that reaches one is
named by it. A set that isn't complete within the bounds is an error, never a guess.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

from .structures import Molecule, StructureError, _aromatise, canonical, nonisomeric, read, write

MOST_FORMS, MOST_SHIFTS = 256, 1024
_ENDS = (6, 7, 8, 16)


def shifts(m: Molecule) -> Iterator[Molecule]:
    """Every molecule that one shift makes of m; marks are left out."""
    for (b, c), order in m.bonds.items():
        if order != 2.0:
            continue
        for middle, far in ((b, c), (c, b)):
            for near in m.near[middle]:
                atoms = m.atoms[near], m.atoms[far]
                if near == far or m.order(near, middle) != 1.0 or not atoms[0].hydrogens or any(x.charge or x.aromatic or x.number not in _ENDS for x in atoms) or m.atoms[middle].aromatic or all(x.number == 6 for x in atoms):
                    continue
                made = Molecule([replace(x) for x in m.atoms], dict(m.bonds))
                made.atoms[near].hydrogens -= 1
                made.atoms[far].hydrogens += 1
                made.bonds[(min(near, middle), max(near, middle))] = 2.0
                made.bonds[(min(middle, far), max(middle, far))] = 1.0
                if all(sum(made.order(i, j) == 2.0 for j in made.near[i]) < 2 for i in (near, middle)):
                    _aromatise(made)
                    yield made


def forms(text: str) -> dict[str, Molecule]:
    """Canonical texts (without marks) of all forms, the given one first."""
    start = nonisomeric(text)
    found, todo, made = {start: read(start)}, [start], 0
    while todo:
        for m in shifts(found[todo.pop()]):
            made += 1
            name = write(m)
            if name not in found:
                found[name] = m
                todo.append(name)
            if made > MOST_SHIFTS or len(found) > MOST_FORMS:
                raise StructureError("the forms are not complete within the bounds")
    return found


def _order(m: Molecule) -> tuple[int, ...]:
    """What a better form has more of: aromatic bonds, then double bonds to oxygen, to sulfur, to nitrogen."""
    double = lambda n: sum(o == 2.0 and n in (m.atoms[a].number, m.atoms[b].number) for (a, b), o in m.bonds.items())
    return sum(o == 1.5 for o in m.bonds.values()), double(8), double(16), double(7)


def parent(text: str) -> str:
    """The best form, then the least text: the same for all forms of a set."""
    found = forms(text)
    return canonical(min(found, key=lambda t: (*(-v for v in _order(found[t])), t)))
