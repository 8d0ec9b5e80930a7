"""Potentials: JSON objects that turn structures into energies, forces and virials.

Each gives *terms* (structure_id, atom_id, energy, forces, virials); a sum of
potentials is the union of their terms, so any composite is summed by one
group-by per level.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.functions import elements, expr
from atomloom.plans.registry import Radial, build, register
from atomloom.plans.session import cut, driver_table

from .descriptors import TERMS, Descriptor, _term, _virial
from .structures import VIRIAL, tensor


@dataclass
class IsolatedAtom:
    energies: dict[str, float]
    error_on_unknown: bool = True
    reach: float = 0.0

    def unknown(self, atoms: DataFrame) -> DataFrame:
        """Species without an energy."""
        return atoms.join(self._table(atoms.sparkSession), "species", "left_anti").select("species").distinct()

    def _table(self, spark: SparkSession) -> DataFrame:
        return driver_table(spark, sorted(self.energies.items()), "species string, e0 double")

    def terms(self, structures: DataFrame, atoms: DataFrame, neighbours: DataFrame) -> list[DataFrame]:
        if self.error_on_unknown and (bad := [r.species for r in self.unknown(atoms).limit(5).collect()]):
            raise ValueError(f"no isolated-atom energy for {bad}")
        rows = atoms.join(self._table(atoms.sparkSession), "species", "left")
        null = F.lit(None).cast("double")
        t = _term(F.col("atom_id"), F.coalesce("e0", F.lit(0.0)), (null, null, null), [null] * 6)
        return [rows.select("structure_id", t.alias("t")).select("structure_id", "t.*")]

    def to_json(self) -> dict:
        return {"type": "isolated_atom", "energies": dict(sorted(self.energies.items())), "error_on_unknown": self.error_on_unknown}


@register("potential", "isolated_atom")
def _isolated(spec: dict) -> IsolatedAtom:
    return IsolatedAtom({k: float(v) for k, v in spec["energies"].items()}, bool(spec.get("error_on_unknown", True)))


def _pair_terms(pairs: DataFrame) -> DataFrame:
    """Terms of a pair potential from ordered pairs with the pair's energy u and slope du."""
    g = 0.5 * F.col("du") / F.col("d")
    r = tuple(F.col(f"r{c}") for c in "xyz")
    t = _term(F.col("i"), 0.5 * F.col("u"), tuple(2.0 * g * x for x in r), _virial([(g, r)]))
    return pairs.select("structure_id", t.alias("t")).select("structure_id", "t.*")


@dataclass
class Screened:
    """Screened nuclear repulsion with fitted coefficients per pair of elements."""

    coefficients: dict[tuple[str, str], list[float]]
    cutoff: Radial
    file: str | None = None

    @property
    def reach(self) -> float:
        return self.cutoff.cutoff

    def with_energy(self, pairs: DataFrame) -> DataFrame:
        """Pairs (species_i, species_j, d) with energy u and slope du."""
        spark = pairs.sparkSession
        rows = [(a, b, float(elements.NUMBER[a]), float(elements.NUMBER[b]), *map(float, c)) for (a, b), c in sorted(self.coefficients.items())]
        names = [f"c{k} double" for k in range(6)]
        table = driver_table(spark, rows, "k1 string, k2 string, z1 double, z2 double, " + ", ".join(names))
        keyed = pairs.where(F.col("d") <= self.reach).withColumns({"k1": F.least("species_i", "species_j"), "k2": F.greatest("species_i", "species_j")})
        # A pair without coefficients ends the job where it is met.
        known = F.when(F.col("z1").isNull(), F.raise_error(F.concat_ws(" ", F.lit("no screening coefficients for"), "k1", "k2")).cast("double")).otherwise(F.col("z1"))
        p = keyed.join(table, ["k1", "k2"], "left").withColumn("z1", known)
        c, d = [F.col(f"c{k}") for k in range(6)], F.col("d")
        e, de = expr.zbl_energy(d, F.col("z1"), F.col("z2"), c), expr.zbl_slope(d, F.col("z1"), F.col("z2"), c)
        f, df = self.cutoff.value(d), self.cutoff.slope(d)
        return p.withColumns({"u": f * e, "du": f * de + df * e})

    def terms(self, structures: DataFrame, atoms: DataFrame, neighbours: DataFrame) -> list[DataFrame]:
        return [_pair_terms(self.with_energy(neighbours))]

    def to_json(self) -> dict:
        out = {"type": "zbl", "cutoff": self.cutoff.spec}
        if self.file:
            return out | {"dmol_fit_coefficients_file": self.file}
        return out | {"coefficients": {",".join(str(elements.NUMBER[x]) for x in k): v for k, v in sorted(self.coefficients.items())}}


def read_screening(data: dict) -> dict[tuple[str, str], list[float]]:
    """Coefficients keyed "Z1,Z2", by sorted symbols."""
    out = {}
    for key, v in data.items():
        a, b = (elements.SYMBOL[int(z)] for z in key.split(","))
        out[tuple(sorted((a, b)))] = [float(x) for x in v[:6]]
    return out


@register("potential", "zbl")
def _zbl(spec: dict) -> Screened:
    cutoff = build("cutoff", spec.get("cutoff", {"type": "perriot", "cutoff": 2.2, "r_min": 1.2}))
    file = spec.get("dmol_fit_coefficients_file")
    if "coefficients" in spec:
        data = spec["coefficients"]
    elif file:
        with open(file) as f:
            data = json.load(f)
    else:
        raise ValueError("zbl needs coefficients or dmol_fit_coefficients_file")
    return Screened(read_screening(data), cutoff, file)


def natural_spline(r: list[float], e: list[float]) -> np.ndarray:
    """(n - 1, 4) coefficients a, b, c, d of the natural cubic spline."""
    x, y = np.asarray(r, float), np.asarray(e, float)
    if len(x) != len(y) or len(x) < 2:
        raise ValueError("a spline needs as many energies as distances, at least two")
    h = np.diff(x)
    n = len(x)
    m = np.zeros((n, n))
    rhs = np.zeros(n)
    m[0, 0] = m[-1, -1] = 1.0
    for k in range(1, n - 1):
        m[k, k - 1 : k + 2] = h[k - 1], 2.0 * (h[k - 1] + h[k]), h[k]
        rhs[k] = 3.0 * ((y[k + 1] - y[k]) / h[k] - (y[k] - y[k - 1]) / h[k - 1])
    c = _tridiagonal(m, rhs) if n > 2 else np.zeros(n)
    b = np.diff(y) / h - h * (2.0 * c[:-1] + c[1:]) / 3.0
    return np.stack([y[:-1], b, c[:-1], np.diff(c) / (3.0 * h)], 1)


def _tridiagonal(m: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    lower, main, upper = np.diag(m, -1).copy(), np.diag(m).copy(), np.diag(m, 1).copy()
    out = rhs.copy()
    for k in range(1, len(main)):
        w = lower[k - 1] / main[k - 1]
        main[k] -= w * upper[k - 1]
        out[k] -= w * out[k - 1]
    out[-1] /= main[-1]
    for k in range(len(main) - 2, -1, -1):
        out[k] = (out[k] - upper[k] * out[k + 1]) / main[k]
    return out


@dataclass
class SplinePair:
    data: dict[tuple[str, str], tuple[list[float], list[float]]]

    @property
    def reach(self) -> float:
        return max((r[-1] for r, _ in self.data.values()), default=0.0)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for (a, b), (r, e) in sorted(self.data.items()):
            pieces = [tuple(map(float, p)) for p in natural_spline(r, e)]
            rows.append((a, b, [float(x) for x in r], pieces))
        return driver_table(spark, rows, "k1 string, k2 string, knots array<double>, pieces array<struct<a: double, b: double, c: double, d: double>>")

    def with_energy(self, pairs: DataFrame) -> DataFrame:
        """Pairs with energy u and slope du; pairs of species without a table don't interact."""
        keyed = pairs.withColumns({"k1": F.least("species_i", "species_j"), "k2": F.greatest("species_i", "species_j")})
        p = keyed.join(self.table(pairs.sparkSession), ["k1", "k2"])
        u, du = expr.cubic_at(F.col("knots"), F.col("pieces"), F.col("d"))
        return p.withColumns({"u": u, "du": du}).drop("knots", "pieces")

    def terms(self, structures: DataFrame, atoms: DataFrame, neighbours: DataFrame) -> list[DataFrame]:
        return [_pair_terms(self.with_energy(neighbours))]

    def to_json(self) -> dict:
        return {"type": "spline_pairpot", "pair_data": {",".join(k): {"r": list(r), "E": list(e)} for k, (r, e) in sorted(self.data.items())}}


@register("potential", "spline_pairpot")
def _spline(spec: dict) -> SplinePair:
    return SplinePair({tuple(sorted(k.split(","))): (list(map(float, v["r"])), list(map(float, v["E"]))) for k, v in spec["pair_data"].items()})


@dataclass
class Gap:
    """A sum of descriptors."""

    descriptors: dict[str, Descriptor]

    @property
    def reach(self) -> float:
        return max((d.reach for d in self.descriptors.values()), default=0.0)

    def terms(self, structures: DataFrame, atoms: DataFrame, neighbours: DataFrame) -> list[DataFrame]:
        spark = atoms.sparkSession
        return [d.terms(atoms, neighbours, d.table(spark, spread=False), spread=False) for _, d in sorted(self.descriptors.items())]

    def to_json(self) -> dict:
        return {"type": "gap", "descriptors": {k: d.to_json() for k, d in sorted(self.descriptors.items())}}


@register("potential", "gap")
def _gap(spec: dict) -> Gap:
    return Gap({k: build("descriptor", d) for k, d in spec["descriptors"].items()})


@dataclass
class Composite:
    potentials: dict[str, object] = field(default_factory=dict)

    @property
    def reach(self) -> float:
        return max((p.reach for p in self.potentials.values()), default=0.0)

    def terms(self, structures: DataFrame, atoms: DataFrame, neighbours: DataFrame) -> list[DataFrame]:
        return [t for _, p in sorted(self.potentials.items()) for t in p.terms(structures, atoms, neighbours)]

    def to_json(self) -> dict:
        return {"type": "composite", "potentials": {k: p.to_json() for k, p in sorted(self.potentials.items())}}


@register("potential", "composite")
def _composite(spec: dict) -> Composite:
    return Composite({k: build("potential", p) for k, p in spec["potentials"].items()})


def read_potential(spec: dict):
    return build("potential", spec, default="composite")


def predict(structures: DataFrame, atoms: DataFrame, potential, neighbours: DataFrame | None = None, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(structure_id, energy, virials) and (structure_id, atom_id, fx, fy, fz) of all structures and atoms.

    A structure's sum is null only if no potential has the quantity; one that
    has it but finds no neighbours gives zeros.  ``once`` sums the atoms now, into
    Parquet files of the shared folder, for callers that use both tables: each
    would search for neighbours otherwise.
    """
    from .neighbours import find_neighbours

    if neighbours is None and potential.reach > 0:
        neighbours = find_neighbours(structures, atoms, potential.reach)
    return collect_terms(structures, atoms, potential.terms(structures, atoms, neighbours), has_forces=potential.reach > 0, once=once)


def collect_terms(structures: DataFrame, atoms: DataFrame, terms: list[DataFrame], has_forces: bool, once: bool = False) -> tuple[DataFrame, DataFrame]:
    empty = F.lit(0.0) if has_forces else F.lit(None).cast("double")
    # Every atom has a row of zeros, so that those without neighbours are there without a join.
    all_terms = atoms.select("structure_id", "atom_id", F.lit(0.0).alias("energy"), *[empty.alias(c) for c in TERMS[1:]])
    for t in terms:
        all_terms = all_terms.unionByName(t)
    # Sums by atom first, then by structure: the second works on one row per atom.
    by_atom = all_terms.groupBy("structure_id", "atom_id").agg(*[F.sum(c).alias(c) for c in TERMS])
    by_atom = cut(by_atom) if once else by_atom
    total = by_atom.groupBy("structure_id").agg(*[F.sum(c).alias(c) for c in ("energy", *VIRIAL)])
    s = structures.select("structure_id").join(total, "structure_id", "left")
    s = s.withColumns({"energy": F.coalesce("energy", F.lit(0.0))} | {v: F.coalesce(v, empty) for v in VIRIAL})
    f = by_atom.select("structure_id", "atom_id", "fx", "fy", "fz")
    return s.select("structure_id", "energy", tensor(*VIRIAL).alias("virials")), f
