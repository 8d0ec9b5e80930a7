"""Tabulation: potentials on grids, as long tables keyed by species and grid index.

isolated(species, energy); pairs(k1, k2, i, r, energy);
triplets(k1, k2, k3, i, j, k, r1, r2, cos, energy);
embedding(tab, species, i, rho, energy); pair_densities(tab, giver, receiver, i, r, rho)
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.plans.session import driver_table

from .descriptors import Descriptor, Embedded, ThreeBody, TwoBody, kernel_sums
from .potentials import Composite, Gap, IsolatedAtom, Screened, SplinePair

EXTRA_DENSITY = 3.5


@dataclass
class Grids:
    species: list[str]
    r_max_2b: float
    n2b: int = 1000
    r_min_3b: float = 0.1
    r_max_3b: float = 0.0
    n3b_r: int = 80
    n3b_angle: int = 80
    n_densities: int = 1000
    max_density: float | None = None

    @staticmethod
    def read(spec: dict) -> Grids:
        return Grids(
            list(spec["species"]),
            float(spec["r_max_2b"]),
            int(spec.get("n2b", 1000)),
            float(spec.get("r_min_3b", 0.1)),
            float(spec.get("r_max_3b", 0.0)),
            int(spec.get("n3b_r", 80)),
            int(spec.get("n3b_angle", 80)),
            int(spec.get("n_densities", 1000)),
            float(spec["max_eam_density"]) if "max_eam_density" in spec else None,
        )

    def pairs(self, spark: SparkSession) -> DataFrame:
        """(i, r): from 0 to the largest distance, both included."""
        i = F.col("id")
        r = F.when(i == self.n2b - 1, F.lit(self.r_max_2b)).otherwise(i * (self.r_max_2b / (self.n2b - 1)))
        return spark.range(self.n2b).select(i.alias("i"), r.alias("r"))

    def triplets(self, spark: SparkSession) -> DataFrame:
        """(i, j, k, r1, r2, cos): the half j >= i."""
        step = (self.r_max_3b - self.r_min_3b) / (self.n3b_r - 1)
        n, m = self.n3b_r, self.n3b_angle
        g = spark.range(n * n * m).select((F.col("id") / (n * m)).cast("long").alias("i"), ((F.col("id") / m).cast("long") % n).alias("j"), (F.col("id") % m).alias("k"))
        return g.where("j >= i").withColumns(
            {"r1": F.lit(self.r_min_3b) + F.col("i") * step, "r2": F.lit(self.r_min_3b) + F.col("j") * step, "cos": F.lit(-1.0) + F.col("k") * (2.0 / (m - 1))}
        )


@dataclass
class Tables:
    isolated: list[DataFrame] = field(default_factory=list)
    pairs: list[DataFrame] = field(default_factory=list)
    triplets: list[DataFrame] = field(default_factory=list)
    embedding: list[DataFrame] = field(default_factory=list)
    pair_densities: list[DataFrame] = field(default_factory=list)
    max_density: dict[int, float] = field(default_factory=dict)

    def add(self, other: Tables) -> Tables:
        """Union of all parts; embedding tables keep apart by number."""
        shift = len(self.max_density)
        for name in ("isolated", "pairs", "triplets"):
            getattr(self, name).extend(getattr(other, name))
        for name in ("embedding", "pair_densities"):
            getattr(self, name).extend(x.withColumn("tab", F.col("tab") + shift) for x in getattr(other, name))
        self.max_density |= {k + shift: v for k, v in other.max_density.items()}
        return self

    def _sum(self, parts: list[DataFrame], keys: list[str], also: list[str], value: str = "energy") -> DataFrame | None:
        if not parts:
            return None
        all_parts = parts[0]
        for p in parts[1:]:
            all_parts = all_parts.unionByName(p)
        return all_parts.groupBy(*keys).agg(*[F.first(c).alias(c) for c in also], F.sum(value).alias(value))

    def pair_table(self) -> DataFrame | None:
        return self._sum(self.pairs, ["k1", "k2", "i"], ["r"])

    def triplet_table(self) -> DataFrame | None:
        return self._sum(self.triplets, ["k1", "k2", "k3", "i", "j", "k"], ["r1", "r2", "cos"])

    def isolated_table(self) -> DataFrame | None:
        return self._sum(self.isolated, ["species"], [])


def _categories(d: Descriptor, spark: SparkSession) -> DataFrame:
    return driver_table(spark, sorted(d.points), ", ".join(f"{k} string" for k in d.keys))


def tabulate_two_body(d: TwoBody, grids: Grids, spark: SparkSession) -> DataFrame:
    """Twice the sum over sparse points at each distance."""
    grid = grids.pairs(spark).withColumnRenamed("r", "d").crossJoin(_categories(d, spark))
    out = kernel_sums(grid, d.table(spark, spread=False), list(d.keys), ["d"], d.kernel, spread=False)
    return out.select("k1", "k2", "i", F.col("d").alias("r"), (2.0 * F.col("s0") * d.cutoff.value(F.col("d"))).alias("energy"))


def tabulate_three_body(d: ThreeBody, grids: Grids, spark: SparkSession) -> DataFrame:
    """Computed where j >= i, mirrored below."""
    r1, r2 = F.col("r1"), F.col("r2")
    r12 = F.sqrt(F.greatest(r1 * r1 + r2 * r2 - 2.0 * r1 * r2 * F.col("cos"), F.lit(0.0)))
    grid = grids.triplets(spark).withColumns({"q1": r1 + r2, "q2": (r1 - r2) * (r1 - r2), "q3": r12})
    rows = grid.crossJoin(_categories(d, spark))
    out = kernel_sums(rows, d.table(spark, spread=False), list(d.keys), list(d.at), d.kernel, spread=False)
    energy = 2.0 * F.col("s0") * d.cutoff.value(r1) * d.cutoff.value(r2)
    half = out.select("k1", "k2", "k3", "i", "j", "k", "r1", "r2", "cos", energy.alias("energy"))
    both = F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    mirrored = half.withColumn("m", F.explode(both))
    swap = lambda a, b: F.when(F.col("m") == 0, F.col(a)).otherwise(F.col(b))
    return mirrored.select("k1", "k2", "k3", swap("i", "j").alias("i"), swap("j", "i").alias("j"), "k", swap("r1", "r2").alias("r1"), swap("r2", "r1").alias("r2"), "cos", "energy")


def tabulate_embedded(d: Embedded, grids: Grids, spark: SparkSession) -> tuple[DataFrame, DataFrame, float]:
    """Embedding energies by density, and densities by distance for each ordered pair of the descriptor's species."""
    top = grids.max_density
    if top is None:
        top = max((p[0] for pts in d.points.values() for p in pts), default=0.0) + EXTRA_DENSITY
    rho = F.col("id") * (top / (grids.n_densities - 1))
    grid = spark.range(grids.n_densities).select(F.col("id").alias("i"), rho.alias("rho")).crossJoin(_categories(d, spark))
    out = kernel_sums(grid, d.table(spark, spread=False), ["k1"], ["rho"], d.kernel, spread=False)
    embedding = out.select(F.lit(0).alias("tab"), F.col("k1").alias("species"), "i", "rho", F.col("s0").alias("energy"))
    species = sorted(k[0] for k in d.points)
    parts = None
    for a in species:
        for b in species:
            f = d.functions.get((a, b), d.functions.get(None))
            r = F.col("r")
            value = F.when(r <= f.cutoff, f.value(r)).otherwise(F.lit(0.0)) if f else F.lit(0.0)
            one = grids.pairs(spark).select(F.lit(0).alias("tab"), F.lit(a).alias("giver"), F.lit(b).alias("receiver"), "i", "r", value.alias("rho"))
            parts = one if parts is None else parts.unionByName(one)
    return embedding, parts, top


def tabulate(potential, grids: Grids, spark: SparkSession) -> Tables:
    out = Tables()
    if isinstance(potential, Composite):
        for _, p in sorted(potential.potentials.items()):
            out.add(tabulate(p, grids, spark))
    elif isinstance(potential, Gap):
        for _, d in sorted(potential.descriptors.items()):
            if isinstance(d, TwoBody):
                out.pairs.append(tabulate_two_body(d, grids, spark))
            elif isinstance(d, ThreeBody):
                out.triplets.append(tabulate_three_body(d, grids, spark))
            else:
                embedding, dens, top = tabulate_embedded(d, grids, spark)
                out.add(Tables(embedding=[embedding], pair_densities=[dens], max_density={0: top}))
    elif isinstance(potential, IsolatedAtom):
        out.isolated.append(spark.createDataFrame(sorted(potential.energies.items()), "species string, energy double"))
    elif isinstance(potential, Screened):
        names = [(a, b) for k, a in enumerate(sorted(grids.species)) for b in sorted(grids.species)[k:]]
        missing = [p for p in names if p not in potential.coefficients]
        if missing:
            raise ValueError(f"no screening coefficients for {missing}")
        cats = driver_table(spark, names, "species_i string, species_j string")
        # At the origin the energy is defined as 0; a distance of 1 stands in for the division.
        grid = grids.pairs(spark).crossJoin(cats).withColumn("d", F.when(F.col("r") < 1e-4, F.lit(1.0)).otherwise(F.col("r")))
        inside = potential.with_energy(grid).withColumn("u", F.when(F.col("r") < 1e-4, F.lit(0.0)).otherwise(F.col("u"))).select("k1", "k2", "i", "u")
        all_rows = grid.select(F.col("species_i").alias("k1"), F.col("species_j").alias("k2"), "i", "r")
        out.pairs.append(all_rows.join(inside, ["k1", "k2", "i"], "left").select("k1", "k2", "i", "r", F.coalesce("u", F.lit(0.0)).alias("energy")))
    elif isinstance(potential, SplinePair):
        cats = driver_table(spark, sorted(potential.data), "species_i string, species_j string")
        grid = grids.pairs(spark).withColumn("d", F.col("r")).crossJoin(cats)
        out.pairs.append(potential.with_energy(grid).select("k1", "k2", "i", "r", F.col("u").alias("energy")))
    else:
        raise ValueError(f"{type(potential).__name__} can't be tabulated")
    return out


def cubic_coefficients(values: np.ndarray) -> np.ndarray:
    """n + 2 coefficients of the uniform cubic B-spline through n values, with straight ends.

    Works on the last axis: values of any leading shape.
    """
    y = np.asarray(values, float)
    n = y.shape[-1]
    if n < 2:
        raise ValueError("a spline needs at least two values")
    c = np.empty((*y.shape[:-1], n + 2))
    # With second derivatives 0 at the ends the end coefficients equal the end values.
    c[..., 1], c[..., n] = y[..., 0], y[..., -1]
    m = n - 2
    if m:
        rhs = 6.0 * y[..., 1:-1]
        rhs[..., 0] -= y[..., 0]
        rhs[..., -1] -= y[..., -1]
        upper = np.empty(m)
        main = 4.0
        d = np.empty_like(rhs)
        upper[0], d[..., 0] = 1.0 / main, rhs[..., 0] / main
        for k in range(1, m):
            w = main - upper[k - 1]
            upper[k], d[..., k] = 1.0 / w, (rhs[..., k] - d[..., k - 1]) / w
        for k in range(m - 2, -1, -1):
            d[..., k] -= upper[k] * d[..., k + 1]
        c[..., 2:n] = d
    c[..., 0] = 2.0 * c[..., 1] - c[..., 2]
    c[..., n + 1] = 2.0 * c[..., n] - c[..., n - 1]
    return c


def cubic_coefficients_3d(values: np.ndarray) -> np.ndarray:
    """Tensor-product coefficients of shape (n + 2) on each axis."""
    c = np.asarray(values, float)
    for axis in (2, 1, 0):
        c = np.moveaxis(cubic_coefficients(np.moveaxis(c, axis, -1)), -1, axis)
    return c


def pair_splines(pairs: DataFrame) -> DataFrame:
    """(k1, k2, coefficients) of each pair's table; one series is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("i")
        return pd.DataFrame({"k1": [p.k1.iloc[0]], "k2": [p.k2.iloc[0]], "coefficients": [cubic_coefficients(p.energy.to_numpy()).tolist()]})

    return pairs.groupBy("k1", "k2").applyInPandas(run, "k1 string, k2 string, coefficients array<double>")


def triplet_splines(triplets: DataFrame) -> DataFrame:
    """(k1, k2, k3, n_r, n_angle, coefficients) of each triplet's table, flattened i, j, k."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["i", "j", "k"])
        n, m = int(p.i.max()) + 1, int(p.k.max()) + 1
        c = cubic_coefficients_3d(p.energy.to_numpy().reshape(n, n, m))
        return pd.DataFrame({"k1": [p.k1.iloc[0]], "k2": [p.k2.iloc[0]], "k3": [p.k3.iloc[0]], "n_r": [n], "n_angle": [m], "coefficients": [c.ravel().tolist()]})

    return triplets.groupBy("k1", "k2", "k3").applyInPandas(run, "k1 string, k2 string, k3 string, n_r int, n_angle int, coefficients array<double>")
