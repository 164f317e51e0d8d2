"""Cohesion of periodic simulation cells: Ewald sums, cut-off pair energies with tails, and molecules taken apart.

Per frame: the energy of the cell (all images) and that of its molecules alone, each as it stands; their difference over
the volume is the cohesive energy density. A frame is one group, of MOST_PARTICLES at most; boxes are right-angled.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import energy_density

# kJ nm / mol of two elementary charges.
COULOMB = 138.935458
MOST_PARTICLES, TOLERANCE = 8192, 1e-6
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _near(x: np.ndarray, box: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs i < j whose nearest images are within the cutoff, and their distances; rows are compared in blocks."""
    out = []
    for a in range(0, len(x), 256):
        d = x[a : a + 256, None, :] - x[None, :, :]
        d -= box * np.rint(d / box)
        r2 = (d * d).sum(-1)
        i, j = np.nonzero((r2 <= cutoff * cutoff) & (np.arange(len(x))[None, :] > np.arange(a, a + len(d))[:, None]))
        out.append((i + a, j, np.sqrt(r2[i, j])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def ewald(q: np.ndarray, x: np.ndarray, box: np.ndarray, cutoff: float, pairs: tuple | None = None, tolerance: float = TOLERANCE) -> float:
    """Electrostatic energy of a neutral periodic cell in kJ/mol: a screened direct sum and one over reciprocal vectors."""
    i, j, r = pairs or _near(x, box, cutoff)
    width = math.sqrt(-math.log(2 * tolerance)) / cutoff
    direct = (q[i] * q[j] * _erfc(width * r).astype(float) / r).sum()
    # Reciprocal vectors up to where their Gaussian falls below the tolerance; of k and -k one is enough.
    most = np.ceil(box * 2 * width * math.sqrt(-math.log(tolerance)) / (2 * math.pi)).astype(int)
    reach = 4 * width * width * -math.log(tolerance)
    total = 0.0
    for nx in range(most[0] + 1):
        ny, nz = (v.ravel() for v in np.meshgrid(np.arange(-most[1], most[1] + 1), np.arange(-most[2], most[2] + 1), indexing="ij"))
        half = (ny > 0) | ((ny == 0) & (nz > 0)) if nx == 0 else np.ones(len(ny), bool)
        k = 2 * math.pi * np.column_stack([np.full(half.sum(), nx), ny[half], nz[half]]) / box
        k2 = (k * k).sum(1)
        k, k2 = k[k2 <= reach], k2[k2 <= reach]
        for a in range(0, len(k), 512):
            wave = np.exp(1j * (k[a : a + 512] @ x.T)) @ q
            total += 2 * (np.exp(-k2[a : a + 512] / (4 * width * width)) / k2[a : a + 512] * np.abs(wave) ** 2).sum()
    return float(COULOMB * (direct + 2 * math.pi / box.prod() * total - width / math.sqrt(math.pi) * (q * q).sum()))


def _lennard(sigma: np.ndarray, epsilon: np.ndarray, i: np.ndarray, j: np.ndarray, r: np.ndarray) -> float:
    s6 = ((sigma[i] + sigma[j]) / (2 * r)) ** 6
    return float((4 * np.sqrt(epsilon[i] * epsilon[j]) * (s6 * s6 - s6)).sum())


def _tail(sigma: np.ndarray, epsilon: np.ndarray, volume: float, cutoff: float) -> float:
    """What pairs beyond the cutoff add on average; kinds of particles are paired once."""
    kinds, count = np.unique(np.column_stack([sigma, epsilon]), axis=0, return_counts=True)
    s = (kinds[:, None, 0] + kinds[None, :, 0]) / 2
    e = np.sqrt(kinds[:, None, 1] * kinds[None, :, 1])
    each = 4 * e * (s**12 / (9 * cutoff**9) - s**6 / (3 * cutoff**3))
    return float(2 * math.pi / volume * (count[:, None] * count[None, :] * each).sum())


def frame_energies(f: pd.DataFrame, box: np.ndarray, cutoff: float, excluded: set[tuple[int, int]], tolerance: float = TOLERANCE) -> dict[str, float]:
    """Pair (lj) and electrostatic energies of one cell less those of its molecules alone; excluded pairs interact in neither."""
    if len(f) > MOST_PARTICLES or f["place"].duplicated().any() or not 0 < 2 * cutoff <= box.min():
        raise ValueError("a bounded frame of distinct places and a cutoff of half the box at most are needed")
    x, q, sigma, epsilon = f[["x", "y", "z"]].to_numpy(float), *(f[c].to_numpy(float) for c in ("charge", "sigma", "epsilon"))
    if not all(np.isfinite(v).all() for v in (x, q, sigma, epsilon, box)):
        raise ValueError("finite particles are needed")
    molecule = np.unique(f["molecule"].to_numpy(), return_inverse=True)[1]
    if np.abs(np.bincount(molecule, q)).max() > 1e-4:
        raise ValueError("a molecule's charges do not add up to zero")
    at = {p: k for k, p in enumerate(f["place"].tolist())}
    apart = np.array(sorted({(min(at[a], at[b]), max(at[a], at[b])) for a, b in excluded if a in at and b in at}), np.int64).reshape(-1, 2)
    pairs = _near(x, box, cutoff)
    kept = ~np.isin(pairs[0] * len(x) + pairs[1], apart[:, 0] * len(x) + apart[:, 1])
    lj = _lennard(sigma, epsilon, *(c[kept] for c in pairs)) + _tail(sigma, epsilon, box.prod(), cutoff)
    coulomb = ewald(q, x, box, cutoff, pairs, tolerance)
    # Excluded pairs are taken out of the sum over all images at their nearest one.
    d = x[apart[:, 0]] - x[apart[:, 1]]
    d -= box * np.rint(d / box)
    coulomb -= COULOMB * (q[apart[:, 0]] * q[apart[:, 1]] / np.sqrt((d * d).sum(1))).sum()
    skip = set(map(tuple, apart.tolist()))
    for m in range(molecule.max() + 1):
        own = np.flatnonzero(molecule == m)
        i, j = (own[k] for k in np.triu_indices(len(own), 1))
        alone = np.array([p not in skip for p in zip(i.tolist(), j.tolist(), strict=True)], bool)
        i, j = i[alone], j[alone]
        # As the molecule stands: unwrapped along with its first atom.
        d = x[i] - x[j]
        d -= box * np.rint(d / box)
        r = np.sqrt((d * d).sum(1))
        lj -= _lennard(sigma, epsilon, i, j, r)
        coulomb -= COULOMB * float((q[i] * q[j] / r).sum())
    return {"lj": lj, "coulomb": coulomb}


def periodic_cohesion(particles: DataFrame, box: tuple[float, float, float], cutoff: float, excluded: list[tuple[int, int]] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """Per frame lj, coulomb (kJ/mol, cell less molecules) and their cohesive energy densities in MPa.

    particles: frame, place, molecule, charge, sigma, epsilon, x, y, z (nm, kJ/mol). excluded: pairs of places, the same
    in every frame (a topology's bonds and angles). Molecules have to be shorter than half the box.
    """
    sides, apart = np.array(box, float), set(map(tuple, excluded))

    def one(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"frame": key[0], **frame_energies(f, sides, cutoff, apart, tolerance)}])

    kind = particles.schema["frame"].dataType.simpleString()
    out = particles.groupBy("frame").applyInPandas(one, f"frame {kind}, lj double, coulomb double")
    volume = F.lit(float(sides.prod()))
    return out.withColumns({"lj_mpa": energy_density(-F.col("lj"), volume), "coulomb_mpa": energy_density(-F.col("coulomb"), volume)})
