"""Every potential's forces and virials against differences of its energy, and its symmetries."""

import numpy as np
import pytest

from atomloom.operators.neighbours import find_neighbours
from atomloom.operators.potentials import predict, read_potential
from atomloom.operators.structures import repeat
from helpers import KERNEL, structures

CELL = np.array([[6.0, 0.3, 0.0], [-1.2, 6.4, 0.5], [0.4, -0.7, 5.8]])
SPECIES = ["Fe", "Ni", "Fe", "Fe", "Ni"]
RNG = np.random.default_rng(3)
POSITIONS = (np.array([[0.1, 0.1, 0.1], [0.55, 0.1, 0.2], [0.2, 0.6, 0.15], [0.6, 0.55, 0.6], [0.15, 0.2, 0.65]]) @ CELL) + RNG.normal(0, 0.05, (5, 3))

PAIR = {
    "type": "2b",
    "kernel": KERNEL | {"energy_scale": 2.0},
    "cutoff": {"type": "coscutoff", "cutoff": 4.5, "cutoff_transition_width": 2.0},
    "sparse_data": {k: {"sparse_points": [2.0, 3.5], "coefficients": c} for k, c in (("Fe,Fe", [0.4, -0.7]), ("Fe,Ni", [0.2, 0.5]), ("Ni,Ni", [-0.3, 0.9]))},
}
TRIPLE = {
    "type": "3b",
    "kernel": KERNEL | {"length_scale": 1.5},
    "cutoff": {"type": "perriot", "cutoff": 4.2, "r_min": 2.0},
    "sparse_data": {
        "Fe,Fe,Ni": {"sparse_points": [{"x": 7.0, "y": 0.4, "z": 4.0}], "coefficients": [0.8]},
        "Fe,Fe,Fe": {"sparse_points": [{"x": 6.5, "y": 0.1, "z": 3.0}], "coefficients": [-0.6]},
        "Ni,Fe,Fe": {"sparse_points": [{"x": 7.5, "y": 0.9, "z": 5.0}], "coefficients": [0.5]},
    },
}
DENSITY = {
    "type": "eam",
    "kernel": KERNEL,
    "pair_functions": [{"type": "polycutoff", "cutoff": 4.4, "r_min": 1.0}, {"type": "fsgen", "cutoff": 4.0, "degree": 3, "prefactor": 1.5, "species_ordered": ["Ni", "Fe"]}],
    "sparse_data": {"Fe": {"sparse_points": [0.5, 2.0], "coefficients": [0.7, -0.4]}, "Ni": {"sparse_points": [1.0], "coefficients": [0.9]}},
}
ZBL = {
    "type": "zbl",
    "cutoff": {"type": "perriot", "cutoff": 4.5, "r_min": 1.0},
    "coefficients": {k: [0.2, 3.2, 0.5, 0.9, 0.3, 0.4] for k in ("26,26", "26,28", "28,28")},
}
SPLINE = {"type": "spline_pairpot", "pair_data": {k: {"r": [0.0, 1.5, 3.0, 4.5], "E": [4.0, 1.0, -0.6, 0.0]} for k in ("Fe,Fe", "Ni,Fe")}}
POTENTIALS = {
    "pair": {"type": "gap", "descriptors": {"a": PAIR}},
    "triple": {"type": "gap", "descriptors": {"a": TRIPLE}},
    "density": {"type": "gap", "descriptors": {"a": DENSITY}},
    "zbl": ZBL,
    "spline": SPLINE,
}
H = 1e-4


def boxes():
    """The box, each atom moved both ways along each axis, and the box strained both ways."""
    out = [(CELL, POSITIONS)]
    for k in range(len(POSITIONS)):
        for axis in range(3):
            for sign in (1, -1):
                p = POSITIONS.copy()
                p[k, axis] += sign * H
                out.append((CELL, p))
    for a, b in ((0, 0), (0, 1), (1, 2)):
        for sign in (1, -1):
            e = np.zeros((3, 3))
            e[a, b] += sign * H / 2
            e[b, a] += sign * H / 2
            m = np.eye(3) + e
            out.append((CELL @ m, POSITIONS @ m))
    return [(c, SPECIES, p, {}) for c, p in out]


@pytest.mark.parametrize("name", sorted(POTENTIALS))
def test_forces_and_virials_are_slopes(spark, name):
    s, a = structures(spark, boxes())
    p, f = predict(s, a, read_potential(POTENTIALS[name]))
    rows = {r.structure_id: r for r in p.collect()}
    forces = {r.atom_id: np.array([r.fx, r.fy, r.fz]) for r in f.where("structure_id = 0").collect()}
    e = [rows[n].energy for n in range(len(rows))]
    assert abs(e[0]) > 1e-3
    n = 1
    for k in range(len(POSITIONS)):
        for axis in range(3):
            assert forces[k][axis] == pytest.approx(-(e[n] - e[n + 1]) / (2 * H), abs=2e-6)
            n += 2
    assert sum(forces.values()) == pytest.approx(np.zeros(3), abs=1e-10)
    v = np.array(rows[0].virials)
    for a_, b_ in ((0, 0), (0, 1), (1, 2)):
        assert v[a_, b_] == pytest.approx(-(e[n] - e[n + 1]) / (2 * H), abs=5e-5)
        n += 2


def test_supercell_has_so_many_times_the_energy(spark):
    s, a = structures(spark, [(CELL, SPECIES, POSITIONS, {"energy": 1.0})])
    model = read_potential({"potentials": POTENTIALS})
    one = predict(s, a, model)[0].first()
    s2, a2 = repeat(s, a, 2, 1, 2)
    assert s2.first().energy == 4.0
    big = predict(s2, a2, model)[0].first()
    assert big.energy == pytest.approx(4 * one.energy, rel=1e-9)
    assert np.array(big.virials) == pytest.approx(4 * np.array(one.virials), rel=1e-7, abs=1e-8)


def test_order_of_atoms_does_not_matter(spark):
    order = [3, 0, 4, 2, 1]
    s, a = structures(spark, [(CELL, SPECIES, POSITIONS, {}), (CELL, [SPECIES[k] for k in order], POSITIONS[order], {})])
    e = [r.energy for r in predict(s, a, read_potential({"potentials": POTENTIALS}))[0].orderBy("structure_id").collect()]
    assert e[0] == pytest.approx(e[1], rel=1e-10)


def test_neighbours_by_brute_force(spark):
    s, a = structures(spark, [(CELL, SPECIES, POSITIONS, {})])
    got = sorted((r.i, r.j, round(r.d, 8)) for r in find_neighbours(s, a, 7.0).collect())
    want = []
    grid = np.stack(np.meshgrid(*[np.arange(-4, 5)] * 3, indexing="ij"), -1).reshape(-1, 3) @ CELL
    for i in range(5):
        for j in range(5):
            d = np.linalg.norm(POSITIONS[j] + grid - POSITIONS[i], axis=1)
            want += [(i, j, round(x, 8)) for x in d if 1e-12 < x <= 7.0]
    assert got == sorted(want)
