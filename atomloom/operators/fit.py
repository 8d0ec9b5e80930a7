"""Fits: observations, design matrix and least squares.

A structure's observations are numbered: 0 the energy, 1 to 6 the virial, from 7
on three per atom.  Fits make the weighted matrix in dense blocks of whole
structures and reduce these to a triangular factor (``blocks``), with the prior's
Cholesky factor below, and solve that.  ``design`` has the same matrix as long
rows (structure_id, obs, col_id, a), the target in column m: the relational
definition, against which the blocks are tested.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.plans.registry import build, register
from atomloom.plans.session import cut

from . import sigmas as _sigmas  # noqa: F401  (registers the rules)
from .blocks import reduced, triangular_factor
from .descriptors import Descriptor
from .neighbours import find_neighbours
from .potentials import Composite, Gap, IsolatedAtom, predict, read_potential
from .structures import VIRIAL, VOIGT, adjust


def targets(structures: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, obs, value, sigma_inv) of all observations that are there."""
    e = structures.where("energy is not null").select("structure_id", F.lit(0).cast("bigint").alias("obs"), F.col("energy").alias("value"), F.col("energy_sigma_inv").alias("sigma_inv"))
    v = F.array(*[F.struct(F.lit(n + 1).cast("bigint").alias("obs"), F.col("virials")[a][b].alias("value"), F.col("virial_sigmas_inv")[a][b].alias("sigma_inv")) for n, (a, b) in enumerate(VOIGT)])
    virials = structures.where("virials is not null").select("structure_id", F.explode(v).alias("o")).select("structure_id", "o.*")
    f = F.array(*[F.struct((F.col("atom_id") * 3 + 7 + n).alias("obs"), F.col(c).alias("value"), F.col(s).alias("sigma_inv")) for n, (c, s) in enumerate((("fx", "sx"), ("fy", "sy"), ("fz", "sz")))])
    forces = atoms.where("fx is not null").select("structure_id", F.explode(f).alias("o")).select("structure_id", "o.*")
    return e.unionByName(virials).unionByName(forces)


def weighted_targets(structures: DataFrame, atoms: DataFrame) -> DataFrame:
    """(structure_id, obs, b): observations times their inverse sigmas."""
    return targets(structures, atoms).select("structure_id", "obs", (F.col("value") * F.col("sigma_inv")).alias("b"))


def design(atoms: DataFrame, neighbours: DataFrame, descriptors: dict[str, Descriptor]) -> tuple[DataFrame, int]:
    """(structure_id, obs, col_id, a) of the kernel rows, and the number of columns; descriptors in label order."""
    spark, first, out = atoms.sparkSession, 0, None
    for _, d in sorted(descriptors.items()):
        t = d.terms(atoms, neighbours, d.table(spark, spread=True, first=first), spread=True)
        by_atom = t.groupBy("structure_id", "atom_id", "col_id").agg(*[F.sum(c).alias(c) for c in ("energy", "fx", "fy", "fz", *VIRIAL)])
        total = by_atom.groupBy("structure_id", "col_id").agg(*[F.sum(c).alias(c) for c in ("energy", *VIRIAL)])
        s = F.array(*[F.struct(F.lit(n).cast("bigint").alias("obs"), F.col(c).alias("a")) for n, c in enumerate(("energy", *VIRIAL))])
        f = F.array(*[F.struct((F.col("atom_id") * 3 + 7 + n).alias("obs"), F.col(c).alias("a")) for n, c in enumerate(("fx", "fy", "fz"))])
        rows = total.select("structure_id", "col_id", F.explode(s).alias("o")).unionByName(by_atom.select("structure_id", "col_id", F.explode(f).alias("o")))
        rows = rows.select("structure_id", "o.obs", "col_id", "o.a")
        out = rows if out is None else out.unionByName(rows)
        first += d.n_sparse()
    return out, first


def weighted_design(matrix: DataFrame, observed: DataFrame, m: int) -> DataFrame:
    """Matrix entries and targets, both times inverse sigmas; the target is column m."""
    o = observed.select("structure_id", "obs", "sigma_inv", "value")
    a = matrix.join(o, ["structure_id", "obs"]).select("structure_id", "obs", "col_id", (F.col("a") * F.col("sigma_inv")).alias("a"))
    b = o.select("structure_id", "obs", F.lit(m).alias("col_id"), (F.col("value") * F.col("sigma_inv")).alias("a"))
    return a.unionByName(b)


def normal_products(matrix: DataFrame, observed: DataFrame, m: int) -> DataFrame:
    """(c1, c2, product), c1 <= c2: products of the weighted matrix's columns, the target in column m.

    An observation's entries are gathered in one row of m + 1 numbers, null where
    there is none, and multiplied there: no row of the matrix meets another in a join.
    """
    none = F.lit(None)
    rows = matrix.select("structure_id", "obs", "col_id", "a", none.cast("double").alias("sigma_inv"), none.cast("double").alias("value"), F.lit(0).alias("seen"))
    o = observed.select("structure_id", "obs", none.cast("int").alias("col_id"), none.cast("double").alias("a"), "sigma_inv", "value", F.lit(1).alias("seen"))
    entry = lambda k: F.sum(F.when(F.col("col_id") == k, F.col("a")))
    wide = rows.unionByName(o).groupBy("structure_id", "obs").agg(*[entry(k).alias(f"a{k}") for k in range(m)], F.max("sigma_inv").alias("sigma_inv"), F.max("value").alias(f"a{m}"), F.max("seen").alias("seen"))
    wide = wide.where("seen = 1").select(*[(F.col(f"a{k}") * F.col("sigma_inv")).alias(f"a{k}") for k in range(m + 1)])
    pairs = [(a, b) for a in range(m + 1) for b in range(a, m + 1)]
    sums = wide.agg(*[F.sum(F.col(f"a{a}") * F.col(f"a{b}")).alias(f"p{a}_{b}") for a, b in pairs])
    products = F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(f"p{a}_{b}").alias("product")) for a, b in pairs])
    return sums.select(F.inline(products)).where("product is not null")


def prior_factor(descriptors: dict[str, Descriptor], jitter: float) -> np.ndarray:
    """Upper Cholesky factor of the sparse points' covariance, block by block."""
    m = sum(d.n_sparse() for d in descriptors.values())
    out, first = np.zeros((m, m)), 0
    for _, d in sorted(descriptors.items()):
        for cols, k in d.self_covariance():
            at = [first + c for c in cols]
            out[np.ix_(at, at)] = np.linalg.cholesky(k + jitter * np.eye(len(cols))).T
        first += d.n_sparse()
    return out


def solve(factor: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Coefficients of least squares with the prior's rows below."""
    m = len(prior)
    r = reduced([factor, np.concatenate([prior, np.zeros((m, 1))], axis=1)])[:m]
    return np.linalg.solve(r[:, :m], r[:, m])


@register("fit", "gap")
def _gap_fit(spec: dict):
    return GapFit({k: build("descriptor", d) for k, d in spec["descriptors"].items()}, build("sigma_rules", spec["sigma_rules"]), float(spec.get("jitter", 1e-8)))


class GapFit:
    def __init__(self, descriptors: dict[str, Descriptor], rules, jitter: float = 1e-8):
        self.descriptors, self.rules, self.jitter = descriptors, rules, jitter

    def fit(self, structures: DataFrame, atoms: DataFrame) -> Gap:
        reach = max(d.reach for d in self.descriptors.values())
        neighbours = find_neighbours(structures, atoms, reach)
        if not all(d.points for d in self.descriptors.values()):  # used once otherwise, and far larger than the atoms
            neighbours = neighbours.persist()
        try:
            for d in self.descriptors.values():
                if not d.points:
                    d.choose(atoms, neighbours)
            s, a = self.rules(structures, atoms)
            r, _ = triangular_factor(targets(s, a), a, neighbours, self.descriptors)
        finally:
            neighbours.unpersist()
        c, at = solve(r, prior_factor(self.descriptors, self.jitter)), 0
        for _, d in sorted(self.descriptors.items()):
            d.set_coefficients(c[at : at + d.n_sparse()].tolist())
            at += d.n_sparse()
        return Gap(self.descriptors)


def isolated_energies(structures: DataFrame, atoms: DataFrame) -> DataFrame:
    """(species, energy, spread, n_bad) of the isolated atoms; the first structure's energy counts."""
    own = structures.where("config_type = 'isolated_atom'").select("structure_id", "energy", "n_atoms")
    rows = own.join(atoms.select("structure_id", "atom_id", "species"), "structure_id")
    bad = (F.col("n_atoms") != 1) | F.col("energy").isNull()
    return rows.groupBy("species").agg(
        F.min_by("energy", "structure_id").alias("energy"), (F.max("energy") - F.min("energy")).alias("spread"), F.sum(bad.cast("bigint")).alias("n_bad")
    )


@register("fit", "isolated_atom")
def _isolated_fit(spec: dict):
    return IsolatedFit(bool(spec.get("error_on_unknown", True)))


class IsolatedFit:
    def __init__(self, error_on_unknown: bool = True):
        self.error_on_unknown = error_on_unknown

    def fit(self, structures: DataFrame, atoms: DataFrame) -> IsolatedAtom:
        rows = isolated_energies(structures, atoms).collect()
        for r in rows:
            if r.n_bad:
                raise ValueError(f"an isolated {r.species} structure has no energy or more than one atom")
            if r.spread > 1e-9:
                raise ValueError(f"isolated energies of {r.species} differ by {r.spread}")
        return IsolatedAtom({r.species: r.energy for r in rows}, self.error_on_unknown)


@register("fit", "composite")
def _composite_fit(spec: dict):
    return CompositeFit(spec)


class CompositeFit:
    def __init__(self, spec: dict):
        self.external = None
        if "external" in spec:
            self.external = read_potential(spec["external"])
        elif "external_from_file" in spec:
            import json

            with open(spec["external_from_file"]) as f:
                self.external = read_potential(json.load(f))
        self.fits = {k: build("fit", f) for k, f in spec["fits"].items()}
        if "external" in self.fits:
            raise ValueError("the label external is reserved")
        order = spec.get("fit_order")
        if order is None:
            if len(self.fits) == 1 or (len(self.fits) == 2 and "isolated_atom" in self.fits):
                order = sorted(self.fits, key=lambda k: k != "isolated_atom")
            else:
                raise ValueError("fit_order is needed")
        if sorted(order) != sorted(self.fits):
            raise ValueError("fit_order must name each fit once")
        self.order = list(order)

    def fit(self, structures: DataFrame, atoms: DataFrame) -> Composite:
        out = {}
        if self.external is not None:
            structures, atoms = subtract(structures, atoms, self.external)
        for label in self.order:
            out[label] = self.fits[label].fit(structures, atoms)
            if label != self.order[-1]:
                structures, atoms = subtract(structures, atoms, out[label])
        if self.external is not None:
            out["external"] = self.external
        return Composite(out)


def subtract(structures: DataFrame, atoms: DataFrame, potential) -> tuple[DataFrame, DataFrame]:
    """The data without a potential's part; lineage is cut, as fits build on each other."""
    p, f = predict(structures, atoms, potential, once=True)
    s, a = adjust(structures, atoms, p, f, subtract=True, set_empty=False)
    return cut(s), cut(a)


def read_fit(spec: dict):
    return build("fit", spec, default="composite")
