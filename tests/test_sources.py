"""XYZ, potential JSON, XML import, tables for other programs, and the programs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from atomloom.operators.potentials import natural_spline, predict, read_potential
from atomloom.operators.tabulate import Grids, cubic_coefficients, cubic_coefficients_3d, tabulate
from atomloom.plans import programs
from atomloom.sources import files, gap_xml, xyz
from helpers import KERNEL, TRIANGLE, cube, structures
from test_physics import DENSITY, PAIR, POTENTIALS, TRIPLE, ZBL

FRAMES = """2
Lattice="10 0 0 0 10 0 0 0 10" pbc="T T T" config_type=dimer energy=-1.5 energy_sigma=0.01 virial="1 2 3 2 4 5 3 5 6" virials_sigma=0.5 Properties=species:S:1:pos:R:3:force:R:3:force_sigma:R:3
Fe 0 0 0 0.1 0.2 0.3 0.1 0.2 0.4
Ni 2.5 0 0 -0.1 -0.2 -0.3 0.1 0.2 0.4

1
Lattice="9 0 0 0 9 0 0 0 9" pbc="T T T" Properties=species:S:1:pos:R:3:Z:I:1
Fe 1 2 3 26
"""


def test_read_xyz(spark, tmp_path):
    (tmp_path / "a.xyz").write_text(FRAMES)
    s, a = xyz.read_xyz(spark, str(tmp_path / "a.xyz"))
    one, two = s.orderBy("structure_id").collect()
    assert (one.config_type, one.energy, one.n_atoms, one.energy_sigma_inv) == ("dimer", -1.5, 2, 100.0)
    assert one.virials == [[1, 2, 3], [2, 4, 5], [3, 5, 6]] and one.virial_sigmas_inv == [[2.0] * 3] * 3
    assert two.energy is None and two.virials is None and two.config_type is None and two.virial_sigmas_inv is None
    atoms = a.orderBy("structure_id", "atom_id").collect()
    assert (atoms[1].species, atoms[1].x, atoms[1].fy) == ("Ni", 2.5, -0.2)
    assert (atoms[0].sx, atoms[0].sy, atoms[0].sz) == pytest.approx((10.0, 5.0, 2.5))
    assert atoms[2].fx is None


@pytest.mark.parametrize("bad", ["x\n", '1\npbc="T T F" Lattice="1 0 0 0 1 0 0 0 1"\nFe 0 0 0\n', '1\npbc="T T T"\nFe 0 0 0\n', '2\nLattice="1 0 0 0 1 0 0 0 1" pbc="T T T" Properties=species:S:1:pos:R:3\nFe 0 0 0\n'])
def test_malformed_xyz(bad):
    with pytest.raises(ValueError):
        list(xyz.frames(iter(bad.splitlines(True))))


def test_xyz_round_trip_and_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.xyz").write_text(FRAMES)
    s, a = xyz.read_xyz(spark, str(tmp_path / "in"))
    assert s.select("structure_id").distinct().count() == 6
    xyz.write_xyz(s, a, str(tmp_path / "out.xyz"))
    s2, a2 = xyz.read_xyz(spark, str(tmp_path / "out.xyz"))
    key = lambda t: sorted(map(repr, t.drop("structure_id", "sx", "sy", "sz").collect()))
    assert key(a) == key(a2)
    assert sorted(repr((r.energy, r.virials, r.config_type)) for r in s.collect()) == sorted(repr((r.energy, r.virials, r.config_type)) for r in s2.collect())


def test_potential_json_round_trip(spark, tmp_path):
    model = read_potential({"potentials": POTENTIALS | {"iso": {"type": "isolated_atom", "energies": {"Fe": -1.0}, "error_on_unknown": False}}})
    files.write_potential(model, str(tmp_path / "p.json"))
    again = files.load_potential(str(tmp_path / "p.json"))
    assert again.to_json() == model.to_json()
    s, a = structures(spark, [(cube(12.0), ["Fe", "Ni", "Fe"], TRIANGLE, {})])
    assert predict(s, a, again)[0].first() == predict(s, a, model)[0].first()


def test_keys_in_any_order_keep_their_coefficients():
    spec = json.loads(json.dumps(PAIR))
    spec["sparse_data"] = {"Ni,Ni": {"sparse_points": [1.0], "coefficients": [3.0]}, "Ni,Fe": {"sparse_points": [2.0], "coefficients": [2.0]}, "Fe,Fe": {"sparse_points": [3.0], "coefficients": [1.0]}}
    d = read_potential({"type": "gap", "descriptors": {"x": spec}}).descriptors["x"]
    assert [(c, p[0], v) for c, p, _, v in d.flat()] == [(("Fe", "Fe"), 3.0, 1.0), (("Fe", "Ni"), 2.0, 2.0), (("Ni", "Ni"), 1.0, 3.0)]


@pytest.mark.parametrize("spec", [{"type": "nothing"}, {"type": "gap", "descriptors": {"x": {"type": "2b", "kernel": KERNEL, "cutoff": {"type": "perriot", "cutoff": 3, "r_min": 1}}}}])
def test_unknown_or_incomplete_components_are_refused(spec):
    with pytest.raises((ValueError, KeyError)):
        read_potential(spec)


def test_types_may_have_a_prefix():
    for name in ("xgap", "in_ram_gap", "in_ram_xgap"):
        assert read_potential({"type": name, "descriptors": {"x": PAIR}}).to_json() == read_potential({"type": "gap", "descriptors": {"x": PAIR}}).to_json()
    for name in ("my_gap", "notagap", "gapx"):
        with pytest.raises(ValueError, match=name):
            read_potential({"type": name, "descriptors": {"x": PAIR}})


def test_ranges_of_a_file_have_all_frames(spark, tmp_path):
    rng = np.random.default_rng(0)
    text = []
    for k in range(40):
        n = int(rng.integers(0, 6))
        text += [""] if k == 20 else []
        text += [str(n), f'Lattice="9 0 0 0 9 0 0 0 9" pbc="T T T" energy={k} Properties=species:S:1:pos:R:3']
        text += [f"Fe {x[0]:.3f} {x[1]:.3f} {x[2]:.3f}" for x in rng.uniform(0, 9, (n, 3))]
    path = tmp_path / "many.xyz"
    path.write_text("\n".join(text) + "\n")
    want = None
    for size in (1 << 20, 400, 997):
        s, a = xyz.read_xyz(spark, str(path), size)
        got = [(r.structure_id, r.energy, r.n_atoms) for r in s.orderBy("structure_id").collect()]
        assert [e for _, e, _ in got] == list(range(40)) and a.count() == sum(n for *_, n in got)
        assert want in (None, got)
        want = got


def test_small_readers_and_writers(spark, tmp_path):
    from atomloom.functions import elements

    s, a = structures(spark, [(cube(6.0), ["Fe", "Ni"], [(0, 0, 0), (2, 0, 0)], {"energy": 1.5})])
    path = str(tmp_path / "one.xyz")
    xyz.write_xyz(s, a, path)
    _, atoms, near = xyz.read_with_neighbours(spark, path, 2.5)
    assert near.count() == 2 and atoms.count() == 2
    row = atoms.select(elements.number_of(F.col("species")).alias("z")).withColumn("s", elements.symbol_of(F.col("z"))).orderBy("z").collect()
    assert [tuple(r) for r in row] == [(26, "Fe"), (28, "Ni")]
    files.write_doubles(spark, [0.5, -1.25, 3.0], str(tmp_path / "numbers"))
    assert files.read_doubles(spark, str(tmp_path / "numbers")) == [0.5, -1.25, 3.0]
    assert files.split("Fe,Ni") == ["Fe", "Ni"] and files.split("") == []


def test_missing_screening_coefficients_are_an_error(spark):
    s, a = structures(spark, [(cube(12.0), ["Fe", "Cu"], [(0, 0, 0), (1.5, 0, 0)], {})])
    zbl = {"type": "zbl", "cutoff": {"type": "perriot", "cutoff": 2.2, "r_min": 1.2}, "coefficients": {"26,26": [0.2, 3.2, 0.5, 0.9, 0.3, 0.4]}}
    p, _ = predict(s, a, read_potential(zbl))
    with pytest.raises(Exception, match="no screening coefficients for Cu Fe"):
        p.collect()


def test_large_model_tables_are_not_broadcast(spark, monkeypatch):
    from atomloom.plans import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", 10)
    assert "Broadcast" not in session.driver_table(spark, [("a", 1)], "k string, v int")._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    assert "broadcast" in session.driver_table(spark, [("a", 1)], "k string, v int")._jdf.queryExecution().analyzed().toString()


def test_unknown_species_is_an_error(spark):
    s, a = structures(spark, [(cube(12.0), ["Cu"], [(0, 0, 0)], {})])
    with pytest.raises(ValueError, match="Cu"):
        predict(s, a, read_potential({"type": "isolated_atom", "energies": {"Fe": 1.0}}))


def test_natural_spline():
    x = np.array([0.0, 0.7, 1.5, 3.0])
    y = np.array([1.0, -0.5, 0.3, 0.9])
    c = natural_spline(x, y)
    for k in range(3):
        h = x[k + 1] - x[k]
        assert c[k] @ [1, h, h * h, h**3] == pytest.approx(y[k + 1])
        if k:
            h0 = x[k] - x[k - 1]
            assert c[k - 1][1] + 2 * c[k - 1][2] * h0 + 3 * c[k - 1][3] * h0**2 == pytest.approx(c[k][1])
    assert c[0][2] == pytest.approx(0) and 2 * c[2][2] + 6 * c[2][3] * 1.5 == pytest.approx(0, abs=1e-12)
    assert natural_spline([0, 1], [1, 3])[0] == pytest.approx([1, 2, 0, 0])


@pytest.mark.parametrize("n", [2, 3, 4, 17])
def test_cubic_coefficients(n):
    y = np.random.default_rng(n).normal(size=n)
    c = cubic_coefficients(y)
    assert (c[:-2] + 4 * c[1:-1] + c[2:]) / 6 == pytest.approx(y)
    assert c[0] - 2 * c[1] + c[2] == pytest.approx(0, abs=1e-12) and c[-1] - 2 * c[-2] + c[-3] == pytest.approx(0, abs=1e-12)


def test_cubic_coefficients_3d():
    y = np.random.default_rng(0).normal(size=(4, 5, 3))
    c = cubic_coefficients_3d(y)
    assert c.shape == (6, 7, 5)
    back = c
    for axis in range(3):
        m = np.moveaxis(back, axis, 0)
        back = np.moveaxis((m[:-2] + 4 * m[1:-1] + m[2:]) / 6, 0, axis)
    assert back == pytest.approx(y)


def test_tabulated_pairs_match_the_model(spark):
    s, a = structures(spark, [(cube(40.0), ["Fe", "Ni"], [(0, 0, 0), (2.4, 0, 0)], {})])
    grids = Grids(["Fe", "Ni"], 4.8, 11, 1.0, 4.0, 5, 4)
    model = read_potential({"potentials": {"p": POTENTIALS["pair"], "s": POTENTIALS["spline"], "z": ZBL}})
    want = predict(s, a, model)[0].first().energy
    t = tabulate(model, grids, spark).pair_table().where("k1 = 'Fe' and k2 = 'Ni' and i = 5").first()
    assert (t.r, t.energy) == pytest.approx((2.4, want))


def test_tabulated_triplets_match_the_model(spark):
    r1, r2, cos = 2.5, 3.25, -1.0 + 2 * 2 / 3
    apex = [(0, 0, 0), (r1, 0, 0), (r2 * cos, r2 * (1 - cos * cos) ** 0.5, 0)]
    s, a = structures(spark, [(cube(40.0), ["Ni", "Fe", "Fe"], apex, {})])
    only = json.loads(json.dumps(TRIPLE))
    only["sparse_data"] = {"Ni,Fe,Fe": only["sparse_data"]["Ni,Fe,Fe"]}
    model = read_potential({"type": "gap", "descriptors": {"x": only}})
    t = tabulate(model, Grids(["Fe", "Ni"], 4.0, 10, 1.0, 4.0, 5, 4), spark).triplet_table()
    assert t.count() == 5 * 5 * 4
    by = {(x.i, x.j, x.k): x.energy for x in t.collect()}
    assert all(by[i, j, k] == by[j, i, k] for i, j, k in by)
    grid = tabulate(model, Grids(["Fe", "Ni"], 4.0, 10, 2.5, 3.25, 2, 4), spark).triplet_table()
    assert grid.where("i = 0 and j = 1 and k = 2").first().energy == pytest.approx(predict(s, a, model)[0].first().energy)


XML = """<Potential>
<pairpot><Potential init_args="IP Glue"/><Glue_params>
<per_type_data type="1" atomic_num="26"/><per_type_data type="2" atomic_num="28"/>
<per_pair_data type1="2" type2="1"><potential_pair><point r="0" E="3"/><point r="2" E="1"/><point r="4" E="0"/></potential_pair></per_pair_data>
</Glue_params></pairpot>
<GAP_params><GAP_data><e0 Z="26" value="-3.5"/><e0 Z="28" value="0"/></GAP_data><gpSparse>
<gpCoordinates sparseX_filename="p2"><descriptor>distance_2b cutoff=4.5 cutoff_transition_width=1.0 delta=2.0 theta_uniform=1.0 covariance_type=ard_se Z1=28 Z2=26</descriptor><sparseX alpha="0.5"/><sparseX alpha="-0.25"/></gpCoordinates>
<gpCoordinates sparseX_filename="p3"><descriptor>angle_3b cutoff=4.0 delta=1.0 theta_uniform=1.5 covariance_type=ard_se Z=26 Z1=28 Z2=26</descriptor><sparseX alpha="0.75"/></gpCoordinates>
<gpCoordinates sparseX_filename="pe"><descriptor>eam_density cutoff=4.0 pair_function=FSgen order=3 mode=FSsym delta=1.0 theta_uniform=1.0 covariance_type=ard_se Z=26</descriptor><sparseX alpha="0.1"/></gpCoordinates>
<gpCoordinates sparseX_filename="pe"><descriptor>eam_density cutoff=4.0 pair_function=FSgen order=3 mode=FSsym delta=1.0 theta_uniform=1.0 covariance_type=ard_se Z=28</descriptor><sparseX alpha="0.2"/></gpCoordinates>
</gpSparse></GAP_params></Potential>"""


def test_xml_import(spark, tmp_path):
    (tmp_path / "gap.xml").write_text(XML)
    (tmp_path / "p2").write_text("2.0\n3.0\n")
    (tmp_path / "p3").write_text("6.0 0.5 3.0\n")
    (tmp_path / "pe").write_text("1.25\n")
    out = programs.convert(str(tmp_path / "gap.xml"), str(tmp_path / "gap.json"))
    gap = out["potentials"]["xml_gap"]["potentials"]
    assert gap["isolated_atom"]["energies"] == {"Fe": -3.5}
    two, three, eam = (next(d for d in gap["GAP"]["descriptors"].values() if d["type"] == k) for k in ("2b", "3b", "eam"))
    assert two["cutoff"] == {"type": "coscutoff", "cutoff": 4.5, "r_min": 3.5}
    assert two["sparse_data"] == {"Fe,Ni": {"sparse_points": [2.0, 3.0], "coefficients": [0.5, -0.25]}}
    assert three["sparse_data"] == {"Fe,Fe,Ni": {"sparse_points": [{"x": 6.0, "y": 0.5, "z": 3.0}], "coefficients": [0.75]}}
    assert sorted(eam["sparse_data"]) == ["Fe", "Ni"] and len(eam["pair_functions"]) == 5
    assert next(f for f in eam["pair_functions"] if f.get("species_ordered") == ["Ni", "Fe"])["prefactor"] == pytest.approx((26 * 28) ** 0.5 / 40)
    s, a = structures(spark, [(cube(12.0), ["Fe", "Ni", "Fe"], TRIANGLE, {})])
    direct, file = gap_xml.read_gap_xml(str(tmp_path / "gap.xml")), files.load_potential(str(tmp_path / "gap.json"))
    assert predict(s, a, direct)[0].first() == predict(s, a, file)[0].first()


def test_programs_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(1)
    s, a = structures(
        spark,
        [(cube(20.0), ["Fe"], [(0, 0, 0)], {"kind": "isolated_atom", "energy": -3.0, "forces": [(0, 0, 0)]})]
        + [(cube(20.0), ["Fe"] * 4, rng.uniform(0, 4, (4, 3)), {"energy": -13.0 + k, "forces": rng.normal(0, 0.1, (4, 3)).tolist()}) for k in range(3)],
    )
    xyz.write_xyz(s, a, str(tmp_path / "train.xyz"))
    sparsify = {"type": "sample_space_uniform", "n_sparse": 4}
    d = {
        "pair": {"type": "2b", "kernel": KERNEL, "cutoff": PAIR["cutoff"], "sparsify": sparsify},
        "eam": {"type": "eam", "kernel": KERNEL, "pair_functions": DENSITY["pair_functions"][:1], "sparsify": sparsify},
    }
    fit = {"type": "gap", "sigma_rules": {"type": "simple", "E_per_root_n_atoms": 0.001, "liquid": 5, "short_range": 5}, "descriptors": d}
    spec = {"training_data_xyz": str(tmp_path / "train.xyz"), "output_file": str(tmp_path / "pot.json"), "fits": {"isolated_atom": {"type": "isolated_atom"}, "gap": fit}, "external": {"type": "spline_pairpot", "pair_data": {"Fe,Fe": {"r": [0, 1, 2], "E": [2, 1, 0]}}}}
    programs.fit(spark, spec)
    out, _ = programs.predict(spark, {"potential_file": spec["output_file"], "input_xyz": spec["training_data_xyz"], "output_xyz": str(tmp_path / "out.xyz")})
    got = [r.energy for r in out.orderBy("structure_id").collect()]
    assert got[0] == pytest.approx(-3.0, abs=1e-2)
    assert got[1:] == pytest.approx([-13.0, -12.0, -11.0], abs=0.5)
    assert (tmp_path / "out.xyz").read_text().count("Lattice") == 4
    _, written = programs.tabulate_potential(
        spark, {"potential_file": spec["output_file"], "output_file_prefix": str(tmp_path / "tab"), "species": ["Fe"], "r_max_2b": 5.0, "n2b": 20, "n_densities": 30, "r_max_3b": 3.0, "n3b_r": 4, "n3b_angle": 4}
    )
    lines = open(written[0]).read().split("\n")
    assert lines[3].split() == ["1", "Fe"] and lines[4].split()[0] == "30"
    assert len(lines) == 5 + 1 + 30 + 20 + 20 + 1
    assert spark.read.parquet(str(tmp_path / "tab.tables" / "e0")).first().energy == pytest.approx(-3.0)


def test_fit_order_rules():
    from atomloom.operators.fit import read_fit

    iso = {"type": "isolated_atom"}
    with pytest.raises(ValueError):
        read_fit({"fits": {"a": iso, "b": iso}})
    with pytest.raises(ValueError):
        read_fit({"fits": {"external": iso}})
    assert read_fit({"fits": {"zz": iso, "isolated_atom": iso}}).order == ["isolated_atom", "zz"]
