"""Neighbours by cells against all pairs."""

import numpy as np
import pytest

from atomloom.operators import neighbours
from helpers import cube, structures


def all_pairs(lattice, x, cutoff):
    lattice, x = np.array(lattice, float), np.array(x, float)
    out = []
    n = [int(cutoff / abs(np.linalg.det(lattice) / np.linalg.norm(np.cross(lattice[(k + 1) % 3], lattice[(k + 2) % 3])))) + 3 for k in range(3)]
    for a in range(-n[0], n[0] + 1):
        for b in range(-n[1], n[1] + 1):
            for c in range(-n[2], n[2] + 1):
                o = a * lattice[0] + b * lattice[1] + c * lattice[2]
                d = np.linalg.norm(x[None] + o - x[:, None], axis=-1)
                for i, j in zip(*np.nonzero((d > 0) & (d <= cutoff))):
                    out.append((i, j, *np.round(o, 6)))
    return sorted(out)


@pytest.mark.parametrize("limit", [0, 64])
def test_cells_find_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(neighbours, "CELL_ATOMS", limit)
    rng = np.random.default_rng(0)
    skewed = [[6.0, 0, 0], [-2.5, 5.0, 0], [1.0, -2.0, 7.0]]
    spread = rng.uniform(-9, 20, (30, 3)).tolist()  # atoms outside their cell
    boxes = [(cube(5.0), ["Fe"] * 8, rng.uniform(0, 5, (8, 3)).tolist(), {}), (skewed, ["Fe"] * 12, rng.uniform(-3, 8, (12, 3)).tolist(), {}), (cube(30.0), ["Fe"] * 30, spread, {}), (cube(2.0), ["Fe"], [(0.5, 0.5, 0.5)], {})]
    s, a = structures(spark, boxes)
    got = {}
    for r in neighbours.find_neighbours(s, a, 4.0).collect():
        got.setdefault(r.structure_id, []).append((r.i, r.j, *np.round((r.ox, r.oy, r.oz), 6)))
    for k, (lattice, _, x, _) in enumerate(boxes):
        assert sorted(got.get(k, [])) == all_pairs(lattice, x, 4.0)


def test_one_large_structure(spark):
    """100,000 atoms of a simple cubic lattice: six neighbours each, and the work doesn't grow with the square."""
    from pyspark.sql import functions as F

    side = (50, 50, 40)
    n = side[0] * side[1] * side[2]
    ids = spark.range(n).select(
        F.lit(1).cast("bigint").alias("structure_id"), F.col("id").alias("atom_id"), F.lit("Fe").alias("species"), (F.col("id") % 50).cast("double").alias("x"), (F.floor(F.col("id") / 50) % 50).cast("double").alias("y"), F.floor(F.col("id") / 2500).cast("double").alias("z")
    )
    s, _ = structures(spark, [([[50.0, 0, 0], [0, 50.0, 0], [0, 0, 40.0]], ["Fe"], [(0, 0, 0)], {})])
    s = s.withColumn("structure_id", F.lit(1).cast("bigint"))
    near = neighbours.find_neighbours(s, ids, 1.2).groupBy("i").count().groupBy("count").count().collect()
    assert [tuple(r) for r in near] == [(6, n)]
