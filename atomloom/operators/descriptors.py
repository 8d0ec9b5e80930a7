"""Descriptors: pairs, triplets and densities, and what they add to energy, forces and virials.

Each descriptor turns neighbours into *terms*: rows (structure_id, atom_id,
[col_id], energy, fx, fy, fz, v*) to be summed by structure and by atom.  The
kernel enters through a few sums over sparse points:

* folded: one row per pair, triplet or atom, whose sums run over all sparse
  points times their coefficients, inside the row (prediction);
* spread: one row per sparse point (the columns of a fit's matrix).

The sparse points of a model are a small table by category, so they are
broadcast; categories without data give zero columns, which the caller keeps by
numbering columns on the model side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.functions import expr
from atomloom.plans.registry import Kernel, Radial, build, register
from atomloom.plans.session import BROADCAST_BYTES

from . import blocks, sparse
from .structures import VIRIAL

SPARSE_SCHEMA = "k1 string, k2 string, k3 string, p array<double>, col_id int, c double"
TERMS = ("energy", "fx", "fy", "fz", *VIRIAL)


# Index tables


def pair_index(neighbours: DataFrame, cutoff: Radial) -> DataFrame:
    """Neighbours within the cutoff with their unordered category, cutoff value and slope."""
    d = F.col("d")
    return neighbours.where(d <= cutoff.cutoff).withColumns(
        {"k1": F.least("species_i", "species_j"), "k2": F.greatest("species_i", "species_j"), "f": cutoff.value(d), "df": cutoff.slope(d)}
    )


def half(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once; an atom and its own images once per image."""
    return pairs.where("j >= i")


def triplet_index(neighbours: DataFrame, cutoff: Radial) -> DataFrame:
    """Each centre's unordered pairs of neighbours, with invariants q1..q3 and cutoffs.

    The self-join's keys are the structure and the centre, so a large structure
    spreads over its atoms.
    """
    near = neighbours.where(F.col("d") <= cutoff.cutoff)
    side = lambda n: near.select(
        "structure_id",
        "i",
        F.struct("j", "ox", "oy", "oz").alias(f"key{n}"),
        F.col("species_i").alias(f"root{n}"),
        F.col("j").alias(f"j{n}"),
        F.col("species_j").alias(f"species{n}"),
        F.col("d").alias(f"r0{n}"),
        *[F.col(f"r{c}").alias(f"{c}{n}") for c in "xyz"],
    )
    both = side(1).join(side(2).drop("root2"), ["structure_id", "i"]).where(F.col("key1") < F.col("key2"))
    r01, r02 = F.col("r01"), F.col("r02")
    far = {f"{c}12": F.col(f"{c}2") - F.col(f"{c}1") for c in "xyz"}
    t = both.withColumns(far | {"k1": F.col("root1"), "k2": F.least("species1", "species2"), "k3": F.greatest("species1", "species2")})
    t = t.withColumn("r12", F.sqrt(sum(F.col(f"{c}12") * F.col(f"{c}12") for c in "xyz")))
    q = expr.triplet_invariants(r01, r02, F.col("r12"))
    cuts = {"f1": cutoff.value(r01), "f2": cutoff.value(r02), "df1": cutoff.slope(r01), "df2": cutoff.slope(r02)}
    return t.withColumns({f"q{k + 1}": x for k, x in enumerate(q)} | cuts).drop("root1")


def density_edges(neighbours: DataFrame, functions: dict[tuple[str, str] | None, Radial]) -> DataFrame:
    """Neighbours with the density that j brings to i (rho_in, its slope) and i to j (rho_out); functions by (giver, receiver), None for all others."""
    d = F.col("d")

    def pick(giver: Column, receiver: Column, part: str) -> Column:
        default = functions.get(None)
        out = getattr(default, part)(d) if default else F.lit(0.0)
        if default:
            out = F.when(d <= default.cutoff, out).otherwise(F.lit(0.0))
        for pair, f in functions.items():
            if pair is not None:
                own = F.when(d <= f.cutoff, getattr(f, part)(d)).otherwise(F.lit(0.0))
                out = F.when((giver == pair[0]) & (receiver == pair[1]), own).otherwise(out)
        return out

    si, sj = F.col("species_i"), F.col("species_j")
    reach = max(f.cutoff for f in functions.values())
    return neighbours.where(d <= reach).withColumns(
        {"rho_in": pick(sj, si, "value"), "drho_in": pick(sj, si, "slope"), "drho_out": pick(si, sj, "slope")}
    )


def densities(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(structure_id, i, k1, rho): atoms without neighbours have density 0."""
    own = F.lit(0.0).alias("rho")
    base = atoms.select("structure_id", F.col("atom_id").alias("i"), F.col("species").alias("k1"), own)
    given = edges.select("structure_id", "i", F.col("species_i").alias("k1"), F.col("rho_in").alias("rho"))
    return base.unionByName(given).groupBy("structure_id", "i", "k1").agg(F.sum("rho").alias("rho"))


# The kernel


def _fold(sparse_points: DataFrame, keys: list[str]) -> DataFrame:
    return sparse_points.groupBy(*keys).agg(F.collect_list(F.struct("p", "weight")).alias("points"))


def _hinted(table: DataFrame, points: DataFrame) -> DataFrame:
    """Broadcast what is made of sparse points if the driver, which has them, counted few enough."""
    return F.broadcast(table) if points.__dict__.get("_small", False) else table


def kernel_sums(rows: DataFrame, points: DataFrame, keys: list[str], at: list[str], kernel: Kernel, spread: bool) -> DataFrame:
    """Add s0 (sum of weight * kernel) and s1.. (its derivatives by ``at``); ``points`` has keys, p, weight, col_id."""
    x = [F.col(c) for c in at]
    if spread:
        wide = points.select(*keys, "col_id", "weight", *[F.col("p")[k].alias(f"p{k}") for k in range(len(at))])
        joined = rows.join(_hinted(wide, points), keys)
        p = [F.col(f"p{k}") for k in range(len(at))]
        sums = [F.col("weight") * kernel.value(x, p), *[F.col("weight") * s for s in kernel.slopes(x, p)]]
        return joined.withColumns({f"s{k}": s for k, s in enumerate(sums)}).drop("weight", *[f"p{k}" for k in range(len(at))])
    joined = rows.join(_hinted(_fold(points, keys), points), keys)
    zero = F.struct(*[F.lit(0.0).alias(f"s{k}") for k in range(len(at) + 1)])
    scale = 1.0 / (kernel.length * kernel.length)

    def add(acc: Column, point: Column) -> Column:
        p = [point["p"][k] for k in range(len(at))]
        k0 = point["weight"] * kernel.value(x, p)
        return F.struct((acc["s0"] + k0).alias("s0"), *[(acc[f"s{k + 1}"] + k0 * (p[k] - x[k]) * scale).alias(f"s{k + 1}") for k in range(len(at))])

    joined = joined.withColumn("sums", F.aggregate("points", zero, add))
    return joined.select(*[c for c in joined.columns if c not in ("points", "sums")], "sums.*")


def _group(spread: bool) -> list[str]:
    return ["col_id"] if spread else []


def _term(atom: Column, energy: Column, force: expr.Vector, virial: list[Column]) -> Column:
    values = [energy, *force, *virial]
    return F.struct(atom.alias("atom_id"), *[v.alias(n) for v, n in zip(values, TERMS)])


def _virial(bonds: list[tuple[Column, expr.Vector]]) -> list[Column]:
    """Minus the sum of g * u (x) r over bonds; given g / length and r."""
    return [-sum(g * r[a] * r[b] for g, r in bonds) for a, b in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def _indexed(rows: DataFrame, keys: tuple[str, ...], atoms: list[str], values: list[str]) -> DataFrame:
    """Index rows for dense blocks: structure, category, up to three atoms, and the numbers that the kernel needs."""
    ints = [F.col(a).cast("bigint") for a in atoms] + [F.lit(0).cast("bigint")] * (3 - len(atoms))
    return rows.select("structure_id", *keys, *[a.alias(f"a{n}") for n, a in enumerate(ints)], F.array(*values).alias("v"))


# The descriptors


@dataclass
class Descriptor:
    """What the three kinds share: sparse points by category, in the order of their keys."""

    kernel: Kernel
    spec: dict
    points: dict[tuple[str, ...], list[list[float]]] = field(default_factory=dict)
    coefficients: dict[tuple[str, ...], list[float]] | None = None

    keys: tuple[str, ...] = ()
    at: tuple[str, ...] = ()

    def n_sparse(self) -> int:
        return sum(map(len, self.points.values()))

    def cutoff_of(self, _: list[float]) -> float:
        return 1.0

    def flat(self) -> list[tuple[tuple[str, ...], list[float], float, float | None]]:
        """(category, point, cutoff value, coefficient) in column order."""
        out = []
        for cat in sorted(self.points):
            own = self.coefficients[cat] if self.coefficients else [None] * len(self.points[cat])
            if len(own) != len(self.points[cat]):
                raise ValueError(f"{len(own)} coefficients for {len(self.points[cat])} sparse points of {cat}")
            out += [(cat, p, self.cutoff_of(p), c) for p, c in zip(self.points[cat], own)]
        return out

    def table(self, spark: SparkSession, spread: bool, first: int = 0) -> DataFrame:
        rows = []
        for n, (cat, p, f, c) in enumerate(self.flat()):
            if not spread and c is None:
                raise ValueError("the descriptor has no coefficients")
            rows.append((*cat, [float(x) for x in p], float(f if spread else f * c), first + n))
        names = ", ".join(f"{k} string" for k in self.keys)
        out = spark.createDataFrame(rows, f"{names}, p array<double>, weight double, col_id int")
        out.__dict__["_small"] = sum(64 + 8 * len(row[len(self.keys)]) for row in rows) <= BROADCAST_BYTES
        return out

    def set_coefficients(self, values: list[float]) -> None:
        if len(values) != self.n_sparse():
            raise ValueError(f"{len(values)} coefficients for {self.n_sparse()} sparse points")
        self.coefficients, at = {}, 0
        for cat in sorted(self.points):
            self.coefficients[cat] = [float(x) for x in values[at : at + len(self.points[cat])]]
            at += len(self.points[cat])

    def choose(self, atoms: DataFrame, neighbours: DataFrame) -> None:
        """Pick the sparse points from data."""
        rows, order = self.samples(atoms, neighbours)
        self.points = build("sparsifier", self.spec["sparsify"], default="sample_space_uniform")(rows, list(self.at), order, list(self.keys))

    def self_covariance(self) -> list[tuple[list[int], np.ndarray]]:
        """Blocks (columns, matrix) of the sparse points' covariance; categories don't mix."""
        out, n = [], 0
        for cat in sorted(self.points):
            p = np.array(self.points[cat], float).reshape(len(self.points[cat]), -1)
            f = np.array([self.cutoff_of(x) for x in self.points[cat]])
            square = ((p[:, None] - p[None]) ** 2).sum(-1)
            k = self.kernel.energy**2 * np.exp(-square / (2 * self.kernel.length**2)) * f[:, None] * f[None]
            out.append((list(range(n, n + len(p))), k))
            n += len(p)
        return out

    def category_number(self) -> Column:
        """The number of a row's category among those with sparse points, null if it has none."""
        out = F.lit(None).cast("int")
        for n, cat in enumerate(sorted(self.points)):
            same = F.col(self.keys[0]) == cat[0]
            for k, x in zip(self.keys[1:], cat[1:]):
                same &= F.col(k) == x
            out = F.when(same, F.lit(n)).otherwise(out)
        return out

    def block_categories(self, first: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(first column, points, cutoff values) by category."""
        out = []
        for cat in sorted(self.points):
            p = np.array(self.points[cat], float).reshape(len(self.points[cat]), -1)
            out.append((first, p, np.array([self.cutoff_of(x) for x in self.points[cat]])))
            first += len(p)
        return out

    def sparse_json(self) -> dict:
        data = {}
        for cat in sorted(self.points):
            pts = [self.point_json(p) for p in self.points[cat]]
            data[",".join(cat)] = {"sparse_points": pts} | ({"coefficients": self.coefficients[cat]} if self.coefficients else {})
        return data

    def point_json(self, p: list[float]):
        return float(p[0])

    def read_sparse(self, data: dict) -> None:
        """Sparse points from JSON; categories may be written in any order of their species."""
        with_coefficients = {k for k, v in data.items() if "coefficients" in v}
        if with_coefficients and len(with_coefficients) != len(data):
            raise ValueError("coefficients of some categories are missing")
        for name, v in data.items():
            cat = self.category(name.split(","))
            self.points[cat] = [self.point_of(p) for p in v["sparse_points"]]
            if with_coefficients:
                self.coefficients = (self.coefficients or {}) | {cat: [float(c) for c in v["coefficients"]]}
        self.flat()

    def point_of(self, p) -> list[float]:
        return [float(p)]

    def category(self, species: list[str]) -> tuple[str, ...]:
        return tuple(species)


def _scalar(radial: Radial, r: float) -> float:
    """A cutoff's value at one distance, on the driver."""
    import math

    s = radial.spec
    rc = radial.cutoff
    if s["type"] == "coscutoff":
        w = s["cutoff_transition_width"]
        return 1.0 if r <= rc - w else 0.0 if r >= rc else 0.5 * (math.cos(math.pi * (r - rc + w) / w) + 1.0)
    if s["type"] == "perriot":
        x = (r - s["r_min"]) / (rc - s["r_min"])
        return 1.0 if r <= s["r_min"] else 0.0 if r >= rc else 1.0 - x**3 * (x * (6 * x - 15) + 10)
    if "scalar" in s:
        return float(s["scalar"](r))
    raise ValueError(f"cutoff {s['type']!r} has no driver-side value")


@dataclass
class TwoBody(Descriptor):
    cutoff: Radial | None = None
    keys: tuple[str, ...] = ("k1", "k2")
    at: tuple[str, ...] = ("d",)

    @property
    def reach(self) -> float:
        return self.cutoff.cutoff

    def cutoff_of(self, p: list[float]) -> float:
        return _scalar(self.cutoff, p[0])

    def category(self, species: list[str]) -> tuple[str, ...]:
        return tuple(sorted(species))

    def samples(self, atoms: DataFrame, neighbours: DataFrame):
        return half(pair_index(neighbours, self.cutoff)), ["structure_id", "i", "j", "ox", "oy", "oz"]

    def terms(self, atoms: DataFrame, neighbours: DataFrame, points: DataFrame, spread: bool) -> DataFrame:
        """One row per ordered pair: half of the pair's energy twice over, all of the force on i."""
        rows = kernel_sums(pair_index(neighbours, self.cutoff), points, list(self.keys), ["d"], self.kernel, spread)
        r = tuple(F.col(f"r{c}") for c in "xyz")
        g = (F.col("s1") * F.col("f") + F.col("s0") * F.col("df")) / F.col("d")
        term = _term(F.col("i"), F.col("s0") * F.col("f"), tuple(2.0 * g * x for x in r), _virial([(g, r)]))
        return rows.select("structure_id", *_group(spread), term.alias("t")).select("structure_id", *_group(spread), "t.*")

    def index_rows(self, atoms: DataFrame, neighbours: DataFrame) -> list[DataFrame]:
        rows = pair_index(neighbours, self.cutoff)
        return [_indexed(rows, self.keys, ["i"], ["d", "f", "df", "rx", "ry", "rz"])]

    def block_parts(self, first: int) -> list:
        length, energy = self.kernel.length, self.kernel.energy

        def solve(v, ints, points, weights):
            d, f, df, r = v[:, :1], v[:, 1:2], v[:, 2:3], v[:, 3:6]
            s0, (s1,) = blocks.kernel(d, points, weights, length, energy)
            yield 0, s0 * f
            # Each pair comes in both directions: twice the force, once the virial.
            g = (s1 * f + s0 * df) / d
            for obs, values in blocks.force_and_virial(ints[0], g, r):
                yield obs, values if np.isscalar(obs) else 2.0 * values

        return [(solve, self.block_categories(first))]

    def to_json(self) -> dict:
        return {"type": "2b", "kernel": self.kernel.spec, "cutoff": self.cutoff.spec, "sparse_data": self.sparse_json()}


@dataclass
class ThreeBody(Descriptor):
    cutoff: Radial | None = None
    keys: tuple[str, ...] = ("k1", "k2", "k3")
    at: tuple[str, ...] = ("q1", "q2", "q3")

    @property
    def reach(self) -> float:
        return self.cutoff.cutoff

    def cutoff_of(self, p: list[float]) -> float:
        side = p[1] ** 0.5
        return _scalar(self.cutoff, (p[0] + side) / 2) * _scalar(self.cutoff, (p[0] - side) / 2)

    def category(self, species: list[str]) -> tuple[str, ...]:
        return (species[0], *sorted(species[1:]))

    def point_json(self, p: list[float]) -> dict:
        return dict(zip("xyz", map(float, p)))

    def point_of(self, p) -> list[float]:
        return [float(p[c]) for c in "xyz"] if isinstance(p, dict) else [float(x) for x in p]

    def samples(self, atoms: DataFrame, neighbours: DataFrame):
        return triplet_index(neighbours, self.cutoff), ["structure_id", "i", "key1", "key2"]

    def terms(self, atoms: DataFrame, neighbours: DataFrame, points: DataFrame, spread: bool) -> DataFrame:
        rows = kernel_sums(triplet_index(neighbours, self.cutoff), points, list(self.keys), list(self.at), self.kernel, spread)
        c = F.col
        both = c("f1") * c("f2")
        slopes = expr.triplet_invariant_slopes(c("r01"), c("r02"))
        chain = {k: sum(c(f"s{n + 1}") * x for n, x in enumerate(v)) for k, v in slopes.items()}
        # Derivatives of the energy by the three sides, over the side.
        g01 = 2.0 * (chain["r01"] * both + c("s0") * c("df1") * c("f2")) / c("r01")
        g02 = 2.0 * (chain["r02"] * both + c("s0") * c("f1") * c("df2")) / c("r02")
        g12 = F.when(c("r12") > 0, 2.0 * chain["r12"] * both / c("r12")).otherwise(F.lit(0.0))
        named = rows.withColumns({"g01": g01, "g02": g02, "g12": g12, "e": 2.0 * c("s0") * both})
        r1, r2, r3 = (tuple(c(f"{x}{n}") for x in "xyz") for n in ("1", "2", "12"))
        v = lambda g, r: expr.scaled(r, c(g))
        f0 = expr.plus(v("g01", r1), v("g02", r2))
        f1 = expr.plus(v("g12", r3), v("g01", r1), -1.0)
        f2 = tuple(-x - y for x, y in zip(v("g02", r2), v("g12", r3)))
        virial = _virial([(c("g01"), r1), (c("g02"), r2), (c("g12"), r3)])
        none = [F.lit(0.0)] * 6
        out = F.array(_term(c("i"), c("e"), f0, virial), _term(c("j1"), F.lit(0.0), f1, none), _term(c("j2"), F.lit(0.0), f2, none))
        return named.select("structure_id", *_group(spread), F.explode(out).alias("t")).select("structure_id", *_group(spread), "t.*")

    def index_rows(self, atoms: DataFrame, neighbours: DataFrame) -> list[DataFrame]:
        rows = triplet_index(neighbours, self.cutoff)
        return [_indexed(rows, self.keys, ["i", "j1", "j2"], ["r01", "r02", "r12", "f1", "f2", "df1", "df2", *[f"{c}{n}" for n in "12" for c in "xyz"]])]

    def block_parts(self, first: int) -> list:
        length, energy = self.kernel.length, self.kernel.energy

        def solve(v, ints, points, weights):
            r01, r02, r12, f1, f2, df1, df2 = (v[:, k : k + 1] for k in range(7))
            r1, r2 = v[:, 7:10], v[:, 10:13]
            q = np.concatenate([r01 + r02, (r01 - r02) ** 2, r12], axis=1)
            s0, (a, b, c) = blocks.kernel(q, points, weights, length, energy)
            both, skew = f1 * f2, 2.0 * (r01 - r02)
            yield 0, 2.0 * s0 * both
            g01 = 2.0 * ((a + skew * b) * both + s0 * df1 * f2) / r01
            g02 = 2.0 * ((a - skew * b) * both + s0 * f1 * df2) / r02
            g12 = np.divide(2.0 * c * both, r12, out=np.zeros_like(s0), where=r12 > 0)
            # Each side pulls its two ends together.
            for g, r, one, other in ((g01, r1, 0, 1), (g02, r2, 0, 2), (g12, r2 - r1, 1, 2)):
                yield from blocks.force_and_virial(ints[one], g, r)
                yield from blocks.force_and_virial(ints[other], -g, r, virial=False)

        return [(solve, self.block_categories(first))]

    def to_json(self) -> dict:
        return {"type": "3b", "kernel": self.kernel.spec, "cutoff": self.cutoff.spec, "sparse_data": self.sparse_json()}


@dataclass
class Embedded(Descriptor):
    functions: dict[tuple[str, str] | None, Radial] = field(default_factory=dict)
    keys: tuple[str, ...] = ("k1",)
    at: tuple[str, ...] = ("rho",)
    legacy_virial_sign: bool = False

    @property
    def reach(self) -> float:
        return max((f.cutoff for f in self.functions.values()), default=0.0)

    def samples(self, atoms: DataFrame, neighbours: DataFrame):
        return densities(atoms, density_edges(neighbours, self.functions)), ["structure_id", "i"]

    def terms(self, atoms: DataFrame, neighbours: DataFrame, points: DataFrame, spread: bool) -> DataFrame:
        edges = density_edges(neighbours, self.functions)
        solved = kernel_sums(densities(atoms, edges), points, list(self.keys), ["rho"], self.kernel, spread)
        zero = F.lit(0.0)
        own = _term(F.col("i"), F.col("s0"), (zero, zero, zero), [zero] * 6)
        energy = solved.select("structure_id", *_group(spread), own.alias("t")).select("structure_id", *_group(spread), "t.*")
        slope = solved.select("structure_id", "i", *_group(spread), "s1")
        e = edges.join(slope, ["structure_id", "i"])
        g = F.col("s1") * F.col("drho_in") / F.col("d")
        r = tuple(F.col(f"r{c}") for c in "xyz")
        on_i = expr.scaled(r, g)
        sign = 1.0 if self.legacy_virial_sign else -1.0
        virial = [sign * -x for x in _virial([(g, r)])]
        both = F.array(_term(F.col("i"), zero, on_i, virial), _term(F.col("j"), zero, expr.scaled(on_i, -1.0), [zero] * 6))
        forces = e.select("structure_id", *_group(spread), F.explode(both).alias("t")).select("structure_id", *_group(spread), "t.*")
        return energy.unionByName(forces)

    def energies(self, atoms: DataFrame, neighbours: DataFrame, points: DataFrame) -> DataFrame:
        """(structure_id, col_id, energy): the energies of ``terms`` without its forces, whose rows have none."""
        solved = kernel_sums(densities(atoms, density_edges(neighbours, self.functions)), points, list(self.keys), ["rho"], self.kernel, True)
        return solved.select("structure_id", "col_id", F.col("s0").alias("energy"))

    def index_rows(self, atoms: DataFrame, neighbours: DataFrame) -> list[DataFrame]:
        edges = density_edges(neighbours, self.functions)
        rho = densities(atoms, edges)
        pulls = edges.join(rho, ["structure_id", "i"])
        return [_indexed(rho, self.keys, ["i"], ["rho"]), _indexed(pulls, self.keys, ["i", "j"], ["rho", "drho_in", "d", "rx", "ry", "rz"])]

    def block_parts(self, first: int) -> list:
        length, energy = self.kernel.length, self.kernel.energy
        sign = 1.0 if self.legacy_virial_sign else -1.0

        def own(v, ints, points, weights):
            yield 0, blocks.kernel(v, points, weights, length, energy)[0]

        def pulls(v, ints, points, weights):
            g = blocks.kernel(v[:, :1], points, weights, length, energy)[1][0] * v[:, 1:2] / v[:, 2:3]
            r = v[:, 3:6]
            for obs, values in blocks.force_and_virial(ints[0], g, r):
                yield obs, values if not np.isscalar(obs) else -sign * values
            yield from blocks.force_and_virial(ints[1], -g, r, virial=False)

        return [(own, self.block_categories(first)), (pulls, self.block_categories(first))]

    def to_json(self) -> dict:
        fs = [self.functions[None].spec] if None in self.functions else []
        fs += [f.spec | {"species_ordered": list(k)} for k, f in sorted((k, f) for k, f in self.functions.items() if k is not None)]
        return {"type": "eam", "kernel": self.kernel.spec, "pair_functions": fs, "sparse_data": self.sparse_json()}


def _common(cls, spec: dict, **more) -> Descriptor:
    out = cls(kernel=build("kernel", spec["kernel"]), spec=spec, **more)
    if "sparse_data" in spec:
        out.read_sparse(spec["sparse_data"])
    elif "sparsify" not in spec:
        raise ValueError("a descriptor needs sparse_data or sparsify")
    return out


@register("descriptor", "2b")
def two_body(spec: dict) -> TwoBody:
    return _common(TwoBody, spec, cutoff=build("cutoff", spec["cutoff"]))


@register("descriptor", "3b")
def three_body(spec: dict) -> ThreeBody:
    return _common(ThreeBody, spec, cutoff=build("cutoff", spec["cutoff"]))


@register("descriptor", "eam")
def embedded(spec: dict) -> Embedded:
    functions: dict[tuple[str, str] | None, Radial] = {}
    for f in spec["pair_functions"]:
        radial = build("pair_function", f)
        if "species" in f:
            a, b = f["species"]
            functions[a, b] = functions[b, a] = radial
        elif "species_ordered" in f:
            functions[tuple(f["species_ordered"])] = radial
        else:
            functions[None] = radial
    return _common(Embedded, spec, functions=functions, legacy_virial_sign=bool(spec.get("legacy_virial_sign", False)))
