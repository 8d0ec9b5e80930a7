"""Dense blocks against the relational matrix, and the tree of factors."""

import numpy as np
import pytest

from atomloom.operators import blocks, fit
from atomloom.operators.descriptors import build
from atomloom.operators.neighbours import find_neighbours
from helpers import KERNEL, cube, structures

CUT = {"type": "coscutoff", "cutoff": 4.0, "cutoff_transition_width": 1.0}
PARTS = {
    "a": {"type": "2b", "kernel": KERNEL, "cutoff": CUT, "sparse_data": {"Fe,Ni": {"sparse_points": [1.5, 3.0]}, "Fe,Fe": {"sparse_points": [2.5]}}},
    "b": {"type": "3b", "kernel": KERNEL, "cutoff": CUT, "sparse_data": {"Fe,Fe,Ni": {"sparse_points": [{"x": 5.0, "y": 0.5, "z": 3.0}]}, "Ni,Fe,Fe": {"sparse_points": [[4.0, 0.1, 2.0], [6.0, 1.0, 4.0]]}}},
    "c": {"type": "eam", "kernel": KERNEL, "pair_functions": [{"type": "polycutoff", "cutoff": 3.5, "r_min": 0.5}], "sparse_data": {"Fe": {"sparse_points": [0.5, 2.0]}, "Ni": {"sparse_points": [1.0]}}},
}


def boxes(n=7, atoms=6):
    rng = np.random.default_rng(3)
    out = []
    for k in range(n):
        o = {"energy": float(rng.normal())} if k != 2 else {}
        if k % 3:
            o["forces"] = rng.normal(size=(atoms, 3)).tolist()
        if k in (1, 4):
            v = rng.normal(size=(3, 3))
            o["virials"] = (v + v.T).tolist()
        out.append((cube(5.0), list(rng.choice(["Fe", "Ni"], atoms)), rng.uniform(0, 5, (atoms, 3)).tolist(), o))
    return out


@pytest.fixture(scope="module")
def data(spark):
    s, a = structures(spark, boxes())
    rules = build("sigma_rules", {"type": "simple", "E_per_root_n_atoms": 0.1, "liquid": 1, "short_range": 1})
    s, a = rules(s, a)
    return s, a, find_neighbours(s, a, 4.0)


def gram_of_rows(s, a, n, d):
    matrix, m = fit.design(a, n, d)
    observed = fit.targets(s, a)
    rows = fit.weighted_design(matrix, observed, m).toPandas()
    key = {k: i for i, k in enumerate(sorted(set(zip(rows.structure_id, rows.obs))))}
    dense = np.zeros((len(key), m + 1))
    for x in rows.itertuples():
        dense[key[x.structure_id, x.obs], x.col_id] += x.a
    return dense.T @ dense


@pytest.mark.parametrize("names", ["a", "b", "c", "abc"])
def test_blocks_are_the_relational_matrix(data, names, monkeypatch):
    s, a, n = data
    d = {k: build("descriptor", PARTS[k]) for k in names}
    want = gram_of_rows(s, a, n, d)
    monkeypatch.setattr(blocks, "ROWS_AT_ONCE", 50)  # structures go on over batches
    monkeypatch.setattr(blocks, "PORTION", 64)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 13)
    r, m = fit.triangular_factor(fit.targets(s, a), a, n, d)
    assert m == len(want) - 1 and r.shape[0] <= m + 1
    assert r.T @ r == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_no_observations_give_an_empty_factor(data):
    s, a, n = data
    none = fit.targets(s, a).where("false")
    r, m = fit.triangular_factor(none, a, n, {"a": build("descriptor", PARTS["a"])})
    assert m == 3 and np.abs(r).sum() == 0


def test_rows_add_up():
    dense = np.zeros((4, 3))
    blocks.add_at(dense, np.array([2, -1, 2, 0]), 1, np.arange(8.0).reshape(4, 2))
    assert dense.tolist() == [[0, 6, 7], [0, 0, 0], [0, 4, 6], [0, 0, 0]]
