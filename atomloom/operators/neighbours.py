"""Neighbour search: an equi-join on the group with a distance condition.

Every ordered pair (i, j, image offset) with 0 < d <= cutoff is a row, so a sum
over i's neighbours is a group-by on i alone.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.functions import expr

from .structures import cell as _axis

#: Structures of more atoms are searched by cells.
CELL_ATOMS = 64


def range_pairs(points: DataFrame, cutoff: float, group: str = "g", key: str = "i", coordinates: tuple[str, ...] = ("x",), carry: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of a group's points with 0 < d <= cutoff: (group, i, j, d, r_*), and carried columns as *_i, *_j.

    A group's points are gathered in one row, which is then taken apart twice:
    the points are shuffled and sorted once, and no join holds them.
    """
    held = (*coordinates, *carry)
    own = F.struct(F.col(key).alias("k"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(held)])
    groups = points.where(F.col(group).isNotNull()).groupBy(group).agg(F.collect_list(own).alias("points")).where(F.size("points") > 1)
    both = groups.select(group, "points", F.explode("points").alias("a")).select(group, "a", F.explode("points").alias("b"))
    r = [F.col(f"b.c{n}") - F.col(f"a.c{n}") for n in range(len(coordinates))]
    d = F.sqrt(sum(x * x for x in r)) if len(r) > 1 else F.abs(r[0])
    near = both.where((F.col("a.k") != F.col("b.k")) & (d > 0) & (d <= cutoff))
    ends = [F.col(f"{s}.c{n}").alias(f"{c}_{e}") for n, c in enumerate(held) for s, e in ("ai", "bj")]
    return near.select(group, F.col("a.k").alias("i"), F.col("b.k").alias("j"), d.alias("d"), *[x.alias(f"r_{c}") for x, c in zip(r, coordinates)], *ends)


def image_offsets(structures: DataFrame, cutoff: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(structure_id, carried columns, ox, oy, oz): translations that may bring an image within the cutoff.

    The number of cells on each side is that of the cutoff over the cell's
    height across the other two axes, which holds for skewed cells too.
    """
    lattice = F.col("lattice")
    axes = [_axis(lattice, k) for k in range(3)]
    ranges = []
    for k in range(3):
        normal = expr.unit(expr.cross(axes[(k + 1) % 3], axes[(k + 2) % 3]))
        height = F.abs(expr.dot(axes[k], normal))
        ranges.append((F.floor(cutoff / height) + 2).cast("int"))
    out = structures.select("structure_id", *carry, "lattice", *[r.alias(f"n{k}") for k, r in enumerate(ranges)])
    for k in range(3):
        out = out.select("*", F.explode(F.sequence(-F.col(f"n{k}"), F.col(f"n{k}"))).alias(f"c{k}"))
    shift = [sum(F.col(f"c{r}") * lattice[r][k] for r in range(3)) for k in range(3)]
    return out.select("structure_id", *carry, *[s.alias(n) for s, n in zip(shift, ("ox", "oy", "oz"))])


def find_neighbours(structures: DataFrame, atoms: DataFrame, cutoff: float) -> DataFrame:
    """(structure_id, i, j, species_i, species_j, ox, oy, oz, rx, ry, rz, d) of all neighbours, both directions and all images.

    Space is cut into cells as wide as the cutoff, and an atom meets the images
    in its cell and the 26 around it, so the work of a large structure grows with
    its atoms and spreads over tasks by cell.  In structures of at most CELL_ATOMS
    atoms each meets all images: there the cells would cost more than they save.
    If ``n_atoms`` names no larger one, all structures are searched that way, whatever
    it says, and the atoms are shuffled once.
    """
    if structures.where(F.col("n_atoms") > CELL_ATOMS).isEmpty():
        return _in_rows(structures, atoms, cutoff)
    box = atoms.groupBy("structure_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))], (F.count(F.lit(1)) > CELL_ATOMS).alias("large"))
    # The box of all of a structure's atoms rules out most image offsets before any image is made.
    reach = F.lit(True)
    for c in "xyz":
        span = F.col(f"hi_{c}") - F.col(f"lo_{c}") + cutoff
        reach &= F.abs(F.col(f"o{c}")) <= span + 1e-9
    sized = structures.select("structure_id", "lattice").join(box, "structure_id")
    known = tuple(c for c in box.columns if c != "structure_id")
    a = atoms.select("structure_id", F.col("atom_id").alias("i"), F.col("species").alias("species_i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("z").alias("zi"))
    b = atoms.select("structure_id", F.col("atom_id").alias("j"), F.col("species").alias("species_j"), F.col("x").alias("xj"), F.col("y").alias("yj"), F.col("z").alias("zj"))
    # Images beyond the cutoff around the box meet no atom.
    inside = F.lit(True)
    for c in "xyz":
        inside &= (F.col(f"{c}j") >= F.col(f"lo_{c}") - cutoff - 1e-9) & (F.col(f"{c}j") <= F.col(f"hi_{c}") + cutoff + 1e-9)
    images = lambda own: b.join(image_offsets(sized.where(own), cutoff, known).where(reach), "structure_id").withColumns({f"{c}j": F.col(f"{c}j") + F.col(f"o{c}") for c in "xyz"})
    # A condition that needs no root.
    r = {f"r{c}": F.col(f"{c}j") - F.col(f"{c}i") for c in "xyz"}
    square = sum(x * x for x in r.values())
    close = (square > 0) & (square <= cutoff * cutoff)
    meet = ("structure_id", "i", "species_i", "xi", "yi", "zi"), ("structure_id", "j", "species_j", "ox", "oy", "oz", "xj", "yj", "zj")
    small = a.join(images(~F.col("large")).select(*meet[1]), "structure_id").where(close)
    cell = lambda c: F.floor((F.col(c) - F.col(f"lo_{c[0]}")) / cutoff)
    around = F.explode(F.array(*[F.struct(*[F.lit(k).alias(n) for k, n in zip(x, "xyz")]) for x in itertools.product((-1, 0, 1), repeat=3)]))
    centres = a.join(box.where("large").select("structure_id", "lo_x", "lo_y", "lo_z"), "structure_id").withColumn("step", around)
    centres = centres.select(*meet[0], *[(cell(f"{c}i") + F.col(f"step.{c}")).alias(f"cell_{c}") for c in "xyz"])
    there = images(F.col("large")).where(inside).select(*meet[1], *[cell(f"{c}j").alias(f"cell_{c}") for c in "xyz"])
    cells = [f"cell_{c}" for c in "xyz"]
    near = small.unionByName(centres.join(there, ["structure_id", *cells]).where(close).drop(*cells))
    pairs = near.withColumns(r | {"d": F.sqrt(square)})
    return pairs.select("structure_id", "i", "j", "species_i", "species_j", "ox", "oy", "oz", "rx", "ry", "rz", "d")


def _in_rows(structures: DataFrame, atoms: DataFrame, cutoff: float) -> DataFrame:
    """``find_neighbours`` with a structure's atoms in one row, which is taken apart once for each end and once for the images."""
    one = F.struct(F.col("atom_id").alias("k"), "species", "x", "y", "z")
    box = [f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))]
    held = atoms.where(F.col("structure_id").isNotNull()).groupBy("structure_id").agg(F.collect_list(one).alias("atoms"), *box)
    reach = F.lit(True)
    for c in "xyz":
        reach &= F.abs(F.col(f"o{c}")) <= F.col(f"hi_{c}") - F.col(f"lo_{c}") + cutoff + 1e-9
    known = tuple(c for c in held.columns if c != "structure_id")
    offsets = ("ox", "oy", "oz")
    images = image_offsets(structures.select("structure_id", "lattice").join(held, "structure_id"), cutoff, known).where(reach)
    both = images.select("structure_id", *offsets, "atoms", F.explode("atoms").alias("a")).select("structure_id", *offsets, "a", F.explode("atoms").alias("b"))
    r = [F.col(f"b.{c}") + F.col(f"o{c}") - F.col(f"a.{c}") for c in "xyz"]
    square = sum(x * x for x in r)
    near = both.where((square > 0) & (square <= cutoff * cutoff))
    ends = [F.col("a.k").alias("i"), F.col("b.k").alias("j"), F.col("a.species").alias("species_i"), F.col("b.species").alias("species_j")]
    return near.select("structure_id", *ends, *offsets, *[x.alias(f"r{c}") for x, c in zip(r, "xyz")], F.sqrt(square).alias("d"))


def open_neighbours(atoms: DataFrame, cutoff: float) -> DataFrame:
    """Neighbours without periodic images, in the columns of ``find_neighbours``."""
    p = range_pairs(atoms, cutoff, "structure_id", "atom_id", ("x", "y", "z"), ("species",))
    zero = F.lit(0.0)
    return p.select("structure_id", "i", "j", "species_i", "species_j", zero.alias("ox"), zero.alias("oy"), zero.alias("oz"), *[F.col(f"r_{c}").alias(f"r{c}") for c in "xyz"], "d")
