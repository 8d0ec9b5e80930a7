"""Queries of the catalog: each operator on ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atomloom.functions import expr
from atomloom.operators import fit as fits
from atomloom.operators import neighbours as nb
from atomloom.operators import potentials as pot
from atomloom.operators import sigmas, sparse
from atomloom.operators import structures as st
from atomloom.operators import tabulate as tab
from atomloom.operators.descriptors import densities, density_edges, half, pair_index, triplet_index
from atomloom.plans.registry import build

from .adapters import event_points, order_atoms, order_structures, table

QUERIES: dict = {}

KERNEL = {"type": "squared_exp", "length_scale": 2.0, "energy_scale": 1.5}
CUTOFF = {"type": "coscutoff", "cutoff": 8.0, "cutoff_transition_width": 3.0}
PAIR_POINTS = {
    "A,A": ([1.5, 4.0], [0.4, -0.3]),
    "A,N": ([3.0], [0.25]),
    "A,R": ([2.0, 5.0], [-0.1, 0.2]),
    "N,N": ([2.5], [0.15]),
    "N,R": ([4.0], [-0.35]),
    "R,R": ([3.5], [0.05]),
}
TWO_BODY = {"type": "2b", "kernel": KERNEL, "cutoff": CUTOFF, "sparse_data": {k: {"sparse_points": p, "coefficients": c} for k, (p, c) in PAIR_POINTS.items()}}
TRIPLE_POINTS = [("A,A,A", (6.0, 1.0, 3.0), 0.3), ("A,N,R", (8.0, 0.5, 4.0), -0.2), ("N,N,N", (5.0, 2.0, 3.5), 0.1), ("R,A,R", (7.0, 0.0, 5.0), 0.45)]
THREE_BODY = {
    "type": "3b",
    "kernel": KERNEL,
    "cutoff": CUTOFF,
    "sparse_data": {k: {"sparse_points": [dict(zip("xyz", p))], "coefficients": [c]} for k, p, c in TRIPLE_POINTS},
}
EVENT_FUNCTIONS = [
    {"type": "polycutoff", "cutoff": 12.0, "r_min": 1.0},
    {"type": "fsgen", "cutoff": 9.0, "degree": 3, "prefactor": 0.5, "species": ["click", "purchase"]},
]
EVENT_POINTS = {"click": ([0.5, 3.0], [0.2, -0.1]), "purchase": ([1.0], [0.3]), "view": ([2.0], [0.05])}
EMBEDDED = {
    "type": "eam",
    "kernel": KERNEL,
    "pair_functions": EVENT_FUNCTIONS,
    "sparse_data": {k: {"sparse_points": p, "coefficients": c} for k, (p, c) in EVENT_POINTS.items()},
}
ISOLATED = {"A": -0.5, "R": -1.25}
SPLINE = {"r": [0.0, 2.0, 4.0, 6.0, 8.0], "E": [3.0, 1.0, -0.5, 0.25, 0.0]}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def line_key() -> list[Column]:
    return [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]


def _neighbours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    atoms = order_atoms(spark, sf_dir)
    return atoms, nb.open_neighbours(atoms, 8.0)


# Scalar functions


def _radial(spark, sf_dir, family, spec, column="l_quantity") -> DataFrame:
    f = build(family, spec)
    x = F.col(column)
    return table(spark, sf_dir, "lineitem").select(*line_key(), r(f.value(x), 9).alias("f"), r(f.slope(x), 9).alias("df"))


@query
def cutoff_cos(spark, sf_dir):
    return _radial(spark, sf_dir, "cutoff", {"type": "coscutoff", "cutoff": 40.0, "cutoff_transition_width": 25.0})


@query
def cutoff_perriot(spark, sf_dir):
    return _radial(spark, sf_dir, "cutoff", {"type": "perriot", "cutoff": 40.0, "r_min": 10.0})


@query
def pair_fn_poly(spark, sf_dir):
    return _radial(spark, sf_dir, "pair_function", {"type": "polycutoff", "cutoff": 46.0, "r_min": 5.0, "prefactor": 1.7})


@query
def pair_fn_cos(spark, sf_dir):
    return _radial(spark, sf_dir, "pair_function", {"type": "coscutoff", "cutoff": 45.0, "r_min": 5.0, "prefactor": 0.6})


@query
def pair_fn_fsgen(spark, sf_dir):
    return _radial(spark, sf_dir, "pair_function", {"type": "fsgen", "cutoff": 42.0, "degree": 4, "prefactor": 2.5})


@query
def se_kernel_1d(spark, sf_dir):
    x = [F.col("l_quantity")]
    k, s = expr.se_kernel(x, [20.0], 7.0, 1.3), expr.se_kernel_slopes(x, [20.0], 7.0, 1.3)[0]
    return table(spark, sf_dir, "lineitem").select(*line_key(), r(k, 9).alias("k"), r(s, 9).alias("dk"))


@query
def se_kernel_vec(spark, sf_dir):
    """The kernel between each embedding and that of the least vec_id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    one = e.agg(F.min_by("v", "vec_id").alias("w"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", r(expr.se_kernel_arrays(F.col("v"), F.col("w"), 1.5, 2.0), 7).alias("k"))


@query
def triplet_gradients(spark, sf_dir):
    """Invariants, their gradients and the cutoff that invariants imply, of three distances."""
    a, b, c = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    q = expr.triplet_invariants(a, b, c)
    s = expr.triplet_invariant_slopes(a, b)
    f = build("cutoff", {"type": "coscutoff", "cutoff": 40.0, "cutoff_transition_width": 30.0})
    cut = expr.invariant_cutoff(q[0], q[1], f.value)
    return table(spark, sf_dir, "lineitem").select(
        *line_key(), *[r(x).alias(f"q{n}") for n, x in enumerate(q, 1)], r(s["r01"][1]).alias("d01"), r(s["r02"][1]).alias("d02"), r(cut, 8).alias("fcut")
    )


@query
def vector_algebra(spark, sf_dir):
    a = (F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    b = (F.lit(1.0), F.lit(2.0), F.lit(-0.5))
    c = (F.lit(0.0), F.lit(1.0), F.lit(3.0))
    p, x, u = expr.project(a, b), expr.cross(a, b), expr.unit(a)
    q, q2 = expr.reject(a, b), expr.reject(a, b, c)
    return table(spark, sf_dir, "lineitem").select(
        *line_key(),
        r(expr.dot(a, b)).alias("dot"),
        r(expr.length(a)).alias("len"),
        r(x[0]).alias("cross_x"),
        r(p[1]).alias("project_y"),
        r(q[2]).alias("reject_z"),
        r(q2[0]).alias("reject2_x"),
        r(u[0]).alias("unit_x"),
        r(expr.least_magnitude(a)).alias("least"),
    )


@query
def cell_volume(spark, sf_dir):
    rows = F.array(
        F.array(F.col("l_quantity"), F.lit(1.0), F.lit(0.0)), F.array(F.lit(-2.0), F.col("l_discount") * 100, F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.0), F.col("l_tax") * 100)
    )
    return table(spark, sf_dir, "lineitem").select(*line_key(), r(st.volume(rows)).alias("volume"))


@query
def element_lookup(spark, sf_dir):
    """Parts' sizes as atomic numbers."""
    from atomloom.functions.elements import element_table

    dim = element_table(spark)  # a hundred rows or so
    return table(spark, sf_dir, "part").join(F.broadcast(dim), F.col("p_size") == F.col("z")).select("p_partkey", "species", F.col("z").cast("bigint").alias("z"), "mass")


@query
def spline_interval_lookup(spark, sf_dir):
    pieces = pot.natural_spline(SPLINE["r"], SPLINE["E"])
    k = F.array(*[F.lit(x) for x in SPLINE["r"]])
    p = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(row, "abcd")]) for row in pieces])
    v, s = expr.cubic_at(k, p, F.col("l_quantity") / 5.0)
    return table(spark, sf_dir, "lineitem").select(*line_key(), r(v, 8).alias("e"), r(s, 8).alias("de"))


# Neighbours, descriptors


@query
def pair_neighbours_count(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir)
    return n.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("d"), 5).alias("sum_d"))


@query
def periodic_neighbours(spark, sf_dir):
    """Neighbours with periodic images in a 60 x 12 x 12 cell."""
    atoms, s = order_atoms(spark, sf_dir), order_structures(spark, sf_dir)
    n = nb.find_neighbours(s, atoms, 5.0)
    return n.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("d"), 5).alias("sum_d"))


@query
def pair_index_by_species(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir)
    p = half(pair_index(n, build("cutoff", CUTOFF)))
    return p.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), r(F.sum("f"), 4).alias("sum_f"), r(F.sum("df"), 4).alias("sum_df"))


@query
def triplet_index_counts(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir)
    t = triplet_index(n, build("cutoff", CUTOFF))
    return t.groupBy("k1", "k2", "k3").agg(F.count(F.lit(1)).alias("n"))


@query
def triplet_invariants(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir)
    t = triplet_index(n, build("cutoff", CUTOFF))
    return t.groupBy("structure_id").agg(*[r(F.sum(c), 4).alias(c) for c in ("q1", "q2", "q3")], r(F.sum(F.col("f1") * F.col("f2")), 5).alias("ff"))


def _functions() -> dict:
    return build("descriptor", EMBEDDED).functions


@query
def eam_density(spark, sf_dir):
    atoms = event_points(spark, sf_dir)
    rho = densities(atoms, density_edges(nb.open_neighbours(atoms, 12.0), _functions()))
    return rho.select("structure_id", "i", "k1", r("rho", 7).alias("rho"))


def _spread(d, atoms: DataFrame, n: DataFrame) -> DataFrame:
    return d.terms(atoms, n, d.table(atoms.sparkSession, spread=True), spread=True)


@query
def pair_covariance(spark, sf_dir):
    """Energy covariance of each structure with each sparse pair distance."""
    atoms, n = _neighbours(spark, sf_dir)
    t = _spread(build("descriptor", TWO_BODY), atoms, n)
    return t.groupBy("structure_id", "col_id").agg(r(F.sum("energy"), 6).alias("cov"))


@query
def triplet_covariance(spark, sf_dir):
    atoms, n = _neighbours(spark, sf_dir)
    t = _spread(build("descriptor", THREE_BODY), atoms, n)
    return t.groupBy("structure_id", "col_id").agg(r(F.sum("energy"), 6).alias("cov"))


@query
def eam_covariance(spark, sf_dir):
    atoms = event_points(spark, sf_dir)
    d = build("descriptor", EMBEDDED)
    t = d.energies(atoms, nb.open_neighbours(atoms, 12.0), d.table(spark, spread=True))
    return t.groupBy("structure_id", "col_id").agg(r(F.sum("energy"), 5).alias("cov"))


@query
def pair_forces(spark, sf_dir):
    """Force covariance on each atom of each sparse pair distance."""
    atoms, n = _neighbours(spark, sf_dir)
    t = _spread(build("descriptor", TWO_BODY), atoms, n)
    return t.groupBy("structure_id", "atom_id", "col_id").agg(*[r(F.sum(c), 6).alias(c) for c in ("fx", "fy", "fz")])


@query
def pair_virials(spark, sf_dir):
    atoms, n = _neighbours(spark, sf_dir)
    t = _spread(build("descriptor", TWO_BODY), atoms, n)
    return t.groupBy("structure_id", "col_id").agg(*[r(F.sum(c), 5).alias(c) for c in ("vxx", "vxy", "vzz")])


@query
def triplet_forces(spark, sf_dir):
    """Force covariance on each atom of each sparse triplet."""
    atoms, n = _neighbours(spark, sf_dir)
    t = _spread(build("descriptor", THREE_BODY), atoms, n)
    return t.groupBy("structure_id", "atom_id", "col_id").agg(*[r(F.sum(c), 5).alias(c) for c in ("fx", "fy", "fz")])


@query
def triplet_virials(spark, sf_dir):
    atoms, n = _neighbours(spark, sf_dir)
    t = _spread(build("descriptor", THREE_BODY), atoms, n)
    return t.groupBy("structure_id", "col_id").agg(*[r(F.sum(c), 4).alias(c) for c in ("vxx", "vxy", "vzz")])


@query
def eam_forces(spark, sf_dir):
    """Force and virial covariance of each event with each sparse density."""
    atoms = event_points(spark, sf_dir)
    t = _spread(build("descriptor", EMBEDDED), atoms, nb.open_neighbours(atoms, 12.0))
    return t.groupBy("structure_id", "atom_id", "col_id").agg(r(F.sum("fx"), 5).alias("fx"), r(F.sum("vxx"), 5).alias("vxx"))


@query
def covariate_with_zeros(spark, sf_dir):
    """Covariances of all structures with all sparse points; those without pairs are 0."""
    atoms, n = _neighbours(spark, sf_dir)
    d = build("descriptor", TWO_BODY)
    points = d.table(spark, spread=True)
    t = _spread(d, atoms, n).groupBy("structure_id", "col_id").agg(F.sum("energy").alias("cov"))
    grid = atoms.select("structure_id").distinct().crossJoin(F.broadcast(points.select("col_id")))
    return grid.join(t, ["structure_id", "col_id"], "left").select("structure_id", "col_id", r(F.coalesce("cov", F.lit(0.0)), 6).alias("cov"))


@query
def self_covariance(spark, sf_dir):
    """Covariance of the pairs of sparse points of one category, from the data's sparse set."""
    atoms, n = _neighbours(spark, sf_dir)
    c = build("cutoff", CUTOFF)
    chosen = sparse.first_in_cells(half(pair_index(n, c)), ["d"], ["structure_id", "i", "j"], 6, ["k1", "k2"])
    p = chosen.select("k1", "k2", "b0", "d", c.value(F.col("d")).alias("f"))
    q = p.select("k1", "k2", F.col("b0").alias("b1"), F.col("d").alias("d1"), F.col("f").alias("f1"))
    k = build("kernel", KERNEL).value([F.col("d")], [F.col("d1")])
    return p.join(q, ["k1", "k2"]).select("k1", "k2", "b0", "b1", r(k * F.col("f") * F.col("f1"), 8).alias("k"))


@query
def sparse_self_covariance(spark, sf_dir):
    """The prior's blocks of the pair and triplet models, as a fit uses them."""
    rows = []
    for name, spec in (("pair", TWO_BODY), ("triple", THREE_BODY)):
        for cols, k in build("descriptor", spec).self_covariance():
            rows += [(name, a, b, float(k[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    out = spark.createDataFrame(rows, "descriptor string, c1 int, c2 int, k double")
    return out.select("descriptor", "c1", "c2", r("k", 8).alias("k"))


@query
def choose_sparse_points(spark, sf_dir):
    """Sparse pair distances as a fit chooses them from data: all cells of this grid are occupied, so none is drawn at random."""
    atoms, n = _neighbours(spark, sf_dir)
    spec = {k: v for k, v in TWO_BODY.items() if k != "sparse_data"} | {"sparsify": {"type": "sample_space_uniform", "n_sparse": 3, "grid_dimensions": [3]}}
    d = build("descriptor", spec)
    d.choose(atoms, n)
    rows = [(*cat, i, float(p[0])) for cat, points in sorted(d.points.items()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "k1 string, k2 string, n int, d double").select("k1", "k2", "n", r("d", 8).alias("d"))


@query
def sparsify_uniform_1d(spark, sf_dir):
    """First pair distance in each occupied of 12 cells, by category."""
    _, n = _neighbours(spark, sf_dir)
    out = sparse.first_in_cells(half(pair_index(n, build("cutoff", CUTOFF))), ["d"], ["structure_id", "i", "j"], 12, ["k1", "k2"])
    return out.select("k1", "k2", "b0", "structure_id", "i", "j", r("d", 8).alias("d"))


@query
def sparsify_uniform_3d(spark, sf_dir):
    _, n = _neighbours(spark, sf_dir)
    t = triplet_index(n, build("cutoff", CUTOFF)).withColumns({"n1": F.col("key1.j"), "n2": F.col("key2.j")})
    out = sparse.first_in_cells(t, ["q1", "q2", "q3"], ["structure_id", "i", "n1", "n2"], 27, ["k1", "k2", "k3"])
    return out.select("k1", "k2", "k3", "b0", "b1", "b2", "structure_id", "i", "n1", "n2")


# Potentials


def _potential(extra: dict | None = None):
    parts = {"gap": {"type": "gap", "descriptors": {"pair": TWO_BODY, "triple": THREE_BODY}}} | (extra or {})
    return build("potential", {"type": "composite", "potentials": parts})


def _predicted(spark, sf_dir, potential) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    atoms, n = _neighbours(spark, sf_dir)
    s = order_structures(spark, sf_dir)
    p, f = pot.collect_terms(s, atoms, potential.terms(s, atoms, n), has_forces=True)
    return s, atoms, p, f


@query
def predict_energy(spark, sf_dir):
    """Energy of the pair and triplet model, coefficients folded within each row."""
    _, _, p, _ = _predicted(spark, sf_dir, _potential())
    return p.select("structure_id", r("energy", 5).alias("energy"))


@query
def predict_pair_forces(spark, sf_dir):
    model = build("potential", {"type": "gap", "descriptors": {"pair": TWO_BODY}})
    _, _, p, f = _predicted(spark, sf_dir, model)
    v = p.select("structure_id", r(F.col("virials")[0][0], 5).alias("vxx"))
    return f.join(v, "structure_id").select("structure_id", "atom_id", *[r(c, 6).alias(c) for c in ("fx", "fy", "fz")], "vxx")


@query
def composite_sum(spark, sf_dir):
    """Null-aware sum of an isolated-atom part and the pair model."""
    model = build(
        "potential",
        {
            "type": "composite",
            "potentials": {"isolated_atom": {"type": "isolated_atom", "energies": ISOLATED, "error_on_unknown": False}, "gap": {"type": "gap", "descriptors": {"pair": TWO_BODY}}},
        },
    )
    _, _, p, _ = _predicted(spark, sf_dir, model)
    return p.select("structure_id", r("energy", 5).alias("energy"))


@query
def spline_pair_energy(spark, sf_dir):
    model = build("potential", {"type": "spline_pairpot", "pair_data": {"A,N": SPLINE, "R,R": SPLINE}})
    _, _, p, _ = _predicted(spark, sf_dir, model)
    return p.select("structure_id", r("energy", 5).alias("energy"))


ZBL = {"type": "zbl", "cutoff": {"type": "perriot", "cutoff": 6.0, "r_min": 2.0}, "coefficients": {"26,26": [0.2, 3.2, 0.5, 0.9, 0.3, 0.4], "26,28": [0.25, 3.0, 0.45, 1.0, 0.3, 0.35], "28,28": [0.18, 3.1, 0.52, 0.95, 0.3, 0.42]}}


@query
def zbl_energy(spark, sf_dir):
    """Screened repulsion of line items read as iron and nickel."""
    atoms = order_atoms(spark, sf_dir).withColumn("species", F.when(F.col("species") == "N", F.lit("Ni")).otherwise(F.lit("Fe")))
    s = order_structures(spark, sf_dir)
    model = build("potential", ZBL)
    p, _ = pot.collect_terms(s, atoms, model.terms(s, atoms, nb.open_neighbours(atoms, 8.0)), has_forces=True)
    return p.select("structure_id", r("energy", 5).alias("energy"))


@query
def isolated_fit(spark, sf_dir):
    """Least structure's energy of each species among the structures of one atom."""
    s = order_structures(spark, sf_dir).withColumn("config_type", F.when((F.col("n_atoms") == 1) & F.col("energy").isNotNull(), F.lit("isolated_atom")).otherwise(F.col("config_type")))
    out = fits.isolated_energies(s, order_atoms(spark, sf_dir))
    return out.select("species", r("energy").alias("energy"), r("spread").alias("spread"), "n_bad")


@query
def isolated_predict(spark, sf_dir):
    model = build("potential", {"type": "isolated_atom", "energies": ISOLATED, "error_on_unknown": False})
    s, atoms = order_structures(spark, sf_dir), order_atoms(spark, sf_dir)
    p, _ = pot.collect_terms(s, atoms, model.terms(s, atoms, atoms), has_forces=False)
    return p.select("structure_id", r("energy").alias("energy"))


@query
def unknown_species_anti(spark, sf_dir):
    return build("potential", {"type": "isolated_atom", "energies": ISOLATED}).unknown(order_atoms(spark, sf_dir))


@query
def residual_subtract(spark, sf_dir):
    """Orders' energies less the pair model's; orders without an energy stay without."""
    s, atoms, p, f = _predicted(spark, sf_dir, build("potential", {"type": "gap", "descriptors": {"pair": TWO_BODY}}))
    left, _ = st.adjust(s, atoms, p, f, subtract=True, set_empty=False)
    return left.select("structure_id", r("energy", 8).alias("energy"))


@query
def adjust_set_empty(spark, sf_dir):
    """The same added, also where there was none; forces too."""
    s, atoms, p, f = _predicted(spark, sf_dir, build("potential", {"type": "gap", "descriptors": {"pair": TWO_BODY}}))
    more, moved = st.adjust(s, atoms, p, f, subtract=False, set_empty=True)
    total = moved.groupBy("structure_id").agg(F.sum("fx").alias("fx"))
    return more.join(total, "structure_id").select("structure_id", r("energy", 8).alias("energy"), r("fx", 8).alias("sum_fx"))


@query
def supercell_repeat(spark, sf_dir):
    s, a = st.repeat(order_structures(spark, sf_dir), order_atoms(spark, sf_dir), 2, 1, 3)
    n = a.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 4).alias("sx"), r(F.sum("z"), 4).alias("sz"), F.size(F.collect_set("atom_id")).cast("bigint").alias("ids"))
    return s.join(n, "structure_id").select("structure_id", "n_atoms", "n", "ids", "sx", "sz", r("energy", 6).alias("energy"), r(st.volume(F.col("lattice"))).alias("volume"))


# Rules and targets

SIMPLE = {"type": "simple", "E_per_root_n_atoms": 0.01, "liquid": 5.0, "short_range": 3.0}
KEYWORDS = {"type": "per_ct", "E": 0.01, "F": 0.05, "V": 0.1, "per_keyword": [{"contains": "sta", "multiplier": 3.0}, {"contains": "a", "multiplier": 10.0}, {"contains": "ro", "multiplier": 0.5}]}


def _kinds(config: Column) -> Column:
    """Priorities as kinds of structures, some of which match several rules."""
    return (
        F.when(config.startswith("1"), F.lit("liquid_short"))
        .when(config.startswith("2"), F.lit("melt"))
        .when(config.startswith("3"), F.lit("dimer_scan"))
        .when(config.startswith("4"), F.lit("isolated_atom"))
        .otherwise(config)
    )


@query
def sigma_simple(spark, sf_dir):
    s = order_structures(spark, sf_dir).withColumn("config_type", _kinds(F.col("config_type")))
    out, _ = build("sigma_rules", SIMPLE)(s, order_atoms(spark, sf_dir))
    return out.select("structure_id", r("energy_sigma_inv", 7).alias("e"), r(F.col("virial_sigmas_inv")[1][2], 7).alias("v"))


@query
def sigma_per_keyword(spark, sf_dir):
    rules = [(x["contains"], x["multiplier"]) for x in KEYWORDS["per_keyword"]]
    return table(spark, sf_dir, "part").select("p_partkey", r(sigmas.keyword_factor(F.lower("p_type"), rules)).alias("factor"))


@query
def sigma_per_ct(spark, sf_dir):
    """Sigmas by the first keyword that a structure's kind has."""
    s = order_structures(spark, sf_dir).withColumn("config_type", _kinds(F.col("config_type")))
    rules = build("sigma_rules", {"type": "per_ct", "E": 0.01, "F": 0.05, "V": 0.1, "per_keyword": [{"contains": "melt", "multiplier": 3.0}, {"contains": "o", "multiplier": 10.0}, {"contains": "sh", "multiplier": 0.5}]})
    out, a = rules(s, order_atoms(spark, sf_dir))
    force = a.groupBy("structure_id").agg(F.max("sx").alias("sx"))
    return out.join(force, "structure_id").select("structure_id", r("energy_sigma_inv", 7).alias("e"), r(F.col("virial_sigmas_inv")[0][0], 7).alias("v"), r("sx", 7).alias("f"))


@query
def set_predictions(spark, sf_dir):
    """Energies and forces overwritten by the pair model's, virials taken away again."""
    s, atoms, p, f = _predicted(spark, sf_dir, build("potential", {"type": "gap", "descriptors": {"pair": TWO_BODY}}))
    new, moved = st.set_predictions(s, atoms, p, f)
    total = moved.groupBy("structure_id").agg(F.sum("fx").alias("fx"), F.max("fx").alias("top"))
    bare = st.strip_virials(new)
    return bare.join(total, "structure_id").select("structure_id", r("energy", 6).alias("energy"), r("top", 6).alias("top"), F.col("virials").isNull().alias("bare"))


def _observed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return build("sigma_rules", SIMPLE)(order_structures(spark, sf_dir), order_atoms(spark, sf_dir))


@query
def target_vector(spark, sf_dir):
    return fits.weighted_targets(*_observed(spark, sf_dir)).select("structure_id", "obs", r("b", 6).alias("b"))


@query
def normal_matrix(spark, sf_dir):
    """Products of the weighted design's columns, target included (a check of its entries; fits use QR)."""
    atoms, n = _neighbours(spark, sf_dir)
    d = {"pair": build("descriptor", TWO_BODY)}
    matrix, m = fits.design(atoms, n, d)
    out = fits.normal_products(matrix, fits.targets(*_observed(spark, sf_dir)), m)
    return out.select("c1", "c2", r(F.col("product") / 1e6, 5).alias("product"))


@query
def fit_solve(spark, sf_dir):
    """Coefficients of the pair model fitted to the orders by tall-skinny QR."""
    atoms, n = _neighbours(spark, sf_dir)
    d = {"pair": build("descriptor", TWO_BODY)}
    s, a = _observed(spark, sf_dir)
    factor, _ = fits.triangular_factor(fits.targets(s, a), atoms, n, d)
    c = fits.solve(factor, fits.prior_factor(d, 1e-8))
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(c)], "col_id int, coefficient double").select("col_id", r("coefficient", 6).alias("coefficient"))


@query
def composite_fit(spark, sf_dir):
    """The pair model fitted, with periodic images, to what a spline potential leaves of the orders' energies and forces."""
    spec = {
        "type": "composite",
        "external": {"type": "composite", "potentials": {"spline": {"type": "spline_pairpot", "pair_data": {"A,N": SPLINE, "R,R": SPLINE}}}},
        "fits": {"gap": {"type": "gap", "sigma_rules": SIMPLE, "descriptors": {"pair": TWO_BODY | {"sparse_data": {k: {"sparse_points": p} for k, (p, _) in PAIR_POINTS.items()}}}}},
    }
    out = fits.read_fit(spec).fit(order_structures(spark, sf_dir), order_atoms(spark, sf_dir))
    found = out.potentials["gap"].descriptors["pair"].flat()
    return spark.createDataFrame([(n, float(c)) for n, (_, _, _, c) in enumerate(found)], "col_id int, coefficient double").select("col_id", r("coefficient", 6).alias("coefficient"))


# Tabulation

GRIDS = {"species": ["Fe", "Ni"], "r_max_2b": 8.0, "n2b": 200, "r_min_3b": 0.5, "r_max_3b": 6.0, "n3b_r": 12, "n3b_angle": 9, "n_densities": 100}


@query
def tabulate_pair(spark, sf_dir):
    t = tab.tabulate_two_body(build("descriptor", TWO_BODY), tab.Grids.read(GRIDS), spark)
    return t.select("k1", "k2", "i", r("r").alias("r"), r("energy", 8).alias("energy"))


@query
def tabulate_triplet_grid(spark, sf_dir):
    t = tab.tabulate_three_body(build("descriptor", THREE_BODY), tab.Grids.read(GRIDS), spark)
    return t.select("k1", "k2", "k3", "i", "j", "k", r("energy", 8).alias("energy"))


@query
def tabulate_embedding(spark, sf_dir):
    e, _, _ = tab.tabulate_embedded(build("descriptor", EMBEDDED), tab.Grids.read(GRIDS), spark)
    return e.select("species", "i", r("rho").alias("rho"), r("energy", 8).alias("energy"))


@query
def tabulate_densities(spark, sf_dir):
    _, p, _ = tab.tabulate_embedded(build("descriptor", EMBEDDED), tab.Grids.read(GRIDS), spark)
    return p.select("giver", "receiver", "i", r("rho", 8).alias("rho"))


@query
def tabulate_zbl(spark, sf_dir):
    t = tab.tabulate(build("potential", ZBL), tab.Grids.read(GRIDS), spark).pair_table()
    return t.select("k1", "k2", "i", r("energy", 6).alias("energy"))


@query
def tabulate_merge(spark, sf_dir):
    """Two potentials' pair tables, added by key."""
    spline = {"type": "spline_pairpot", "pair_data": {"A,N": SPLINE, "R,R": SPLINE}}
    model = build("potential", {"type": "composite", "potentials": {"gap": {"type": "gap", "descriptors": {"pair": TWO_BODY}}, "spline": spline}})
    t = tab.tabulate(model, tab.Grids.read(GRIDS), spark).pair_table()
    return t.select("k1", "k2", "i", r("energy", 7).alias("energy"))


@query
def tabulate_splines(spark, sf_dir):
    """B-spline coefficients of the pair tables."""
    t = tab.pair_splines(tab.tabulate_two_body(build("descriptor", TWO_BODY), tab.Grids.read(GRIDS), spark))
    return t.select("k1", "k2", F.posexplode("coefficients").alias("n", "c")).select("k1", "k2", "n", r("c", 8).alias("c"))


@query
def tabulate_triplet_splines(spark, sf_dir):
    """Tensor-product B-spline coefficients of the triplet tables."""
    t = tab.triplet_splines(tab.tabulate_three_body(build("descriptor", THREE_BODY), tab.Grids.read(GRIDS), spark))
    return t.select("k1", "k2", "k3", F.posexplode("coefficients").alias("n", "c")).select("k1", "k2", "k3", "n", r("c", 7).alias("c"))


# Files


@query
def xyz_frames(spark, sf_dir):
    """Orders written as extended XYZ frames."""
    from atomloom.sources.xyz import frame_text

    return frame_text(order_structures(spark, sf_dir), order_atoms(spark, sf_dir))


def _through_files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The orders written to extended XYZ files of the shared folder and read again; structures have other numbers then."""
    from atomloom.plans.session import fresh_dir, remove_at_end
    from atomloom.sources.xyz import read_xyz, write_xyz

    folder = fresh_dir(spark, "xyz")
    write_xyz(order_structures(spark, sf_dir), order_atoms(spark, sf_dir), folder)
    remove_at_end(spark, folder)
    return read_xyz(spark, folder, once=True)


@query
def xyz_round_trip(spark, sf_dir):
    """What frames hold after writing and reading."""
    s, a = _through_files(spark, sf_dir)
    n = a.groupBy("structure_id").agg(F.count(F.lit(1)).alias("n"), *[r(F.sum(c), 6).alias(f"sum_{c}") for c in ("x", "y", "z", "fx", "fy", "fz")], F.sum(F.col("atom_id") * F.ascii("species")).alias("order_sum"))
    return s.join(n, "structure_id").select("config_type", F.col("n_atoms").alias("n_atoms"), r("energy", 9).alias("energy"), F.col("virials").isNull().alias("no_virials"), r(st.volume(F.col("lattice"))).alias("volume"), *[c for c in n.columns if c != "structure_id"])


@query
def xyz_predict(spark, sf_dir):
    """Frames read from files and predicted by the pair model with periodic images."""
    s, a = _through_files(spark, sf_dir)
    p, f = pot.predict(s, a, build("potential", {"type": "gap", "descriptors": {"pair": TWO_BODY}}), once=True)
    old = s.select("structure_id", F.col("energy").alias("read"))
    new, moved = st.set_predictions(s, a, p, f)
    total = moved.groupBy("structure_id").agg(F.sum(F.abs("fx")).alias("fx"))
    return new.join(old, "structure_id").join(total, "structure_id").select(r("read", 9).alias("read"), "n_atoms", r("energy", 5).alias("energy"), r("fx", 5).alias("sum_fx"), r(F.col("virials")[0][1], 4).alias("vxy"))
