"""Published coefficients of tiny fits and analytic kernel values."""

import math

import pytest
from pyspark.sql import functions as F

from atomloom.operators.descriptors import build
from atomloom.operators.fit import read_fit
from atomloom.operators.neighbours import find_neighbours
from helpers import KERNEL, TRIANGLE, cube, structures

TWO = [(0, 0, 0), (3, 0, 0)]
MOVED = [(0, 0, 0), (1.5, 2.598, 0)]
RIGHT = [(0, 0, 0), (4, 0, 0), (0, 3, 0)]
ZERO = [(0, 0, 0)] * 3
OPPOSED = [(1, 1, 1), (-1, -1, -1)]
TURN = [(1, 0, 0), (0, -1, 0), (0.5, 0.5, 0)]


def pair(points):
    return {"type": "2b", "kernel": KERNEL, "cutoff": {"type": "coscutoff", "cutoff": 10.0, "r_min": 9.3}, "sparse_data": {"Fe,Fe": {"sparse_points": points}}}


def triple(point):
    return {"type": "3b", "kernel": KERNEL, "cutoff": {"type": "coscutoff", "cutoff": 10.0, "r_min": 9.4}, "sparse_data": {"Fe,Fe,Fe": {"sparse_points": [dict(zip("xyz", point))]}}}


def density(points):
    return {"type": "eam", "kernel": KERNEL, "pair_functions": [{"type": "polycutoff", "cutoff": 5.0, "r_min": 0}], "sparse_data": {"Fe": {"sparse_points": points}}}


CASES = [
    (100, TRIANGLE, pair([3.0]), 3, 10, 1, ZERO, [6 / 63]),
    (100, TWO, pair([2.0, 4.0]), 1, 1, 1, ZERO, [0.23266775926220731] * 2),
    (100, TWO, pair([2.0]), 1e7, 1, 0, [(1, 0, 0), (0, 0, 0)], [-0.30764655994411466]),
    (100, MOVED, pair([2.0]), 1e7, 1, 0, [(1, 0, 0), (0, 0, 0)], [-0.15382666452610533]),
    (100, MOVED, pair([2.0]), 1e7, 2, 0, OPPOSED, [-0.47733536744854282]),
    (100, MOVED, pair([2.0, 2.5, 4.0]), 1, 2, 0, OPPOSED, [-0.24567921601436607, -0.10998748761736651, 0.38697171383300527]),
    (100, TWO, density([1.0]), 1, 1, 1, [(1, 0, 0), (-1, 0, 0)], [0.017637586136984833]),
    (100, TRIANGLE, triple((6, 0, 3)), 1, 1, 1, TURN, [0.15381640115291151]),
    (20, RIGHT, triple((6, 0, 3)), 1, 1, 1, TURN, [-0.13044210897182607]),
]


@pytest.mark.parametrize("edge, positions, descriptor, e, f, energy, forces, expected", CASES)
def test_fit(spark, edge, positions, descriptor, e, f, energy, forces, expected):
    s, a = structures(spark, [(cube(edge), ["Fe"] * len(positions), positions, {"energy": float(energy), "forces": forces})])
    rules = {"type": "simple", "E_per_root_n_atoms": e, "F_component": f, "liquid": 1, "short_range": 1}
    gap = read_fit({"type": "gap", "sigma_rules": rules, "descriptors": {"d": descriptor}}).fit(s, a)
    got = [x for v in gap.descriptors["d"].coefficients.values() for x in v]
    assert got == pytest.approx(expected, abs=1e-8)


def covariance(spark, descriptor, species, positions, edge):
    s, a = structures(spark, [(cube(edge), species, positions, {})])
    d = build("descriptor", descriptor)
    t = d.terms(a, find_neighbours(s, a, d.reach), d.table(spark, spread=True), spread=True)
    total = {r.col_id: r.e for r in t.groupBy("col_id").agg(F.sum("energy").alias("e")).collect()}
    force = {(r.col_id, r.atom_id): (r.x, r.y, r.z) for r in t.groupBy("col_id", "atom_id").agg(F.sum("fx").alias("x"), F.sum("fy").alias("y"), F.sum("fz").alias("z")).collect()}
    return total, force


def test_pair_kernel(spark):
    d = pair([2.0, 4.0]) | {"cutoff": {"type": "perriot", "cutoff": 10.0, "r_min": 9.3}}
    total, force = covariance(spark, d, ["Fe"] * 3, TRIANGLE, 100)
    assert total[0] == pytest.approx(6 * math.exp(-0.5), abs=2e-4)
    assert total[1] == pytest.approx(6 * math.exp(-0.5), abs=2e-4)
    assert force[0, 0][0] == pytest.approx(-force[1, 0][0], abs=1e-3)


def test_triplet_kernel(spark):
    d = triple((8, 2, 4)) | {"cutoff": {"type": "perriot", "cutoff": 10.0, "cutoff_transition_width": 0.5}}
    total, _ = covariance(spark, d, ["Fe"] * 3, RIGHT, 30)
    assert total[0] == pytest.approx(2 * (2 * math.exp(-1.5) + math.exp(-2)), abs=1e-9)


def test_triplet_kernel_of_species(spark):
    d = triple((8, 2, 4)) | {"cutoff": {"type": "perriot", "cutoff": 10.0, "cutoff_transition_width": 0.5}}
    d["sparse_data"] = {"Fe,Cr,Ni": d["sparse_data"]["Fe,Fe,Fe"]}
    total, force = covariance(spark, d, ["Fe", "Ni", "Cr"], RIGHT, 30)
    assert total[0] == pytest.approx(2 * math.exp(-1.5), abs=1e-9)
    k = -2 * math.exp(-1.5)
    assert force[0, 0] == pytest.approx((-3 * k, k, 0), abs=1e-9)
    assert force[0, 1] == pytest.approx((2.2 * k, 0.6 * k, 0), abs=1e-9)
    assert force[0, 2] == pytest.approx((0.8 * k, -1.6 * k, 0), abs=1e-9)


def test_density_kernel(spark):
    d = density([0.0, 2.0])
    d["pair_functions"] = [{"type": "polycutoff", "cutoff": 6.0, "r_min": 0}]
    total, force = covariance(spark, d, ["Fe"] * 3, TRIANGLE, 100)
    assert total[0] == pytest.approx(3 * math.exp(-0.5), abs=1e-4)
    assert total[1] == pytest.approx(3 * math.exp(-0.5), abs=1e-4)
    # Forces follow the energy's slope.
    along = (1 + 0.5) * 0.3125 * 2 * math.exp(-0.5)
    assert force[0, 0][0] == pytest.approx(along, abs=1e-3)
