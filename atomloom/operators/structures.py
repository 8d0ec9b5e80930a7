"""Row operators on structures and atoms.

structures(structure_id, config_type, n_atoms, lattice, energy, virials, energy_sigma_inv, virial_sigmas_inv)
atoms(structure_id, atom_id, species, x, y, z, fx, fy, fz, sx, sy, sz); s* are inverse sigmas.
predictions(structure_id, energy, virials) and forces(structure_id, atom_id, fx, fy, fz)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atomloom.functions import expr

STRUCTURE_SCHEMA = (
    "structure_id long, config_type string, n_atoms long, lattice array<array<double>>, energy double, "
    "virials array<array<double>>, energy_sigma_inv double, virial_sigmas_inv array<array<double>>"
)
ATOM_SCHEMA = "structure_id long, atom_id long, species string, x double, y double, z double, fx double, fy double, fz double, sx double, sy double, sz double"
#: The six independent components of a symmetric 3 x 3 tensor.
VOIGT = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
VIRIAL = ("vxx", "vxy", "vxz", "vyy", "vyz", "vzz")


def cell(lattice: Column, i: int) -> expr.Vector:
    return tuple(lattice[i][k] for k in range(3))  # type: ignore[return-value]


def volume(lattice: Column) -> Column:
    a, b, c = (cell(lattice, i) for i in range(3))
    return F.abs(expr.dot(expr.cross(a, b), c))


def strip_virials(structures: DataFrame) -> DataFrame:
    kind = structures.schema["virials"].dataType
    return structures.withColumn("virials", F.lit(None).cast(kind))


def _merge(old: Column, new: Column, sign: int, set_empty: bool) -> Column:
    """old + sign * new where a prediction is there and there is something to change; else old."""
    there = new.isNotNull() & (old.isNotNull() | F.lit(set_empty))
    return F.when(there, F.coalesce(old, F.lit(0.0)) + sign * new).otherwise(old)


def _merge_tensor(old: Column, new: Column, sign: int, set_empty: bool) -> Column:
    zero = F.array(*[F.array(*[F.lit(0.0)] * 3)] * 3)
    there = new.isNotNull() & (old.isNotNull() | F.lit(set_empty))
    total = F.zip_with(F.coalesce(old, zero), new, lambda a, b: F.zip_with(a, b, lambda x, y: x + sign * y))
    return F.when(there, total).otherwise(old)


def adjust(structures: DataFrame, atoms: DataFrame, predictions: DataFrame, forces: DataFrame, subtract: bool, set_empty: bool) -> tuple[DataFrame, DataFrame]:
    """Add or subtract a prediction; a field changes only if predicted and (present or set_empty)."""
    sign = -1 if subtract else 1
    p = predictions.select("structure_id", F.col("energy").alias("p_energy"), F.col("virials").alias("p_virials"))
    s = structures.join(p, "structure_id", "left").withColumns(
        {
            "energy": _merge(F.col("energy"), F.col("p_energy"), sign, set_empty),
            "virials": _merge_tensor(F.col("virials"), F.col("p_virials"), sign, set_empty),
        }
    )
    f = forces.select("structure_id", "atom_id", *[F.col(c).alias(f"p_{c}") for c in ("fx", "fy", "fz")])
    a = atoms.join(f, ["structure_id", "atom_id"], "left").withColumns(
        {c: _merge(F.col(c), F.col(f"p_{c}"), sign, set_empty) for c in ("fx", "fy", "fz")}
    )
    return s.drop("p_energy", "p_virials"), a.drop("p_fx", "p_fy", "p_fz")


def set_predictions(structures: DataFrame, atoms: DataFrame, predictions: DataFrame, forces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overwrite energies, forces and virials by a prediction."""
    s = structures.drop("energy", "virials").join(predictions.select("structure_id", "energy", "virials"), "structure_id", "left")
    a = atoms.drop("fx", "fy", "fz").join(forces.select("structure_id", "atom_id", "fx", "fy", "fz"), ["structure_id", "atom_id"], "left")
    return s, a


def repeat(structures: DataFrame, atoms: DataFrame, a: int, b: int, c: int) -> tuple[DataFrame, DataFrame]:
    """Supercells: a x b x c copies of each cell; energies grow with it, virials and sigmas are dropped."""
    n = a * b * c
    grid = [F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name) for k, name in ((a, "ia"), (b, "ib"), (c, "ic"))]
    lattice = structures.select("structure_id", "lattice", F.col("n_atoms").alias("n_cell"))
    big = atoms.join(lattice, "structure_id")
    for g in grid:
        big = big.select("*", g)
    shift = lambda k: sum(F.col(i) * F.col("lattice")[r][k] for r, i in enumerate(("ia", "ib", "ic")))
    image = (F.col("ia") * b + F.col("ib")) * c + F.col("ic")
    big = big.withColumns({"x": F.col("x") + shift(0), "y": F.col("y") + shift(1), "z": F.col("z") + shift(2), "atom_id": F.col("atom_id") + image * F.col("n_cell")})
    null = F.lit(None).cast("double")
    big = big.withColumns({k: null for k in ("sx", "sy", "sz")}).select(*atoms.columns)
    rows = F.array(*[F.array(*[F.col("lattice")[r][x] * k for x in range(3)]) for r, k in enumerate((a, b, c))])
    cells = structures.withColumns(
        {
            "lattice": rows,
            "energy": F.col("energy") * n,
            "n_atoms": F.col("n_atoms") * n,
            "virials": F.lit(None).cast(structures.schema["virials"].dataType),
            "energy_sigma_inv": null,
            "virial_sigmas_inv": F.lit(None).cast(structures.schema["virial_sigmas_inv"].dataType),
        }
    )
    return cells, big


def tensor(*names: str) -> Column:
    """A symmetric 3 x 3 array of six component columns; null if the first is."""
    x = [F.col(n) for n in names]
    full = F.array(F.array(x[0], x[1], x[2]), F.array(x[1], x[3], x[4]), F.array(x[2], x[4], x[5]))
    return F.when(x[0].isNotNull(), full)
