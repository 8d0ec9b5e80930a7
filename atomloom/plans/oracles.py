"""SQL twins of the catalog's queries, written for DuckDB and from the definitions, not from the DataFrame code."""

from __future__ import annotations

from atomloom.functions.elements import MASS, SYMBOL

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

_AT = """atm AS (
  SELECT l_orderkey AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_returnflag AS s,
         l_quantity AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, l_extendedprice / 1e4 AS fx, l_discount AS fy, l_tax AS fz
  FROM lineitem)"""
_NB0 = """nb0 AS (
  SELECT a.g, a.i, b.i AS j, a.s AS si, b.s AS sj, b.x - a.x AS rx, b.y - a.y AS ry, b.z - a.z AS rz,
         sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS d
  FROM atm a JOIN atm b ON a.g = b.g AND a.i <> b.i)"""


def _cos(d: str, rc: float, w: float) -> str:
    return f"CASE WHEN {d} <= {rc - w} THEN 1.0 WHEN {d} >= {rc} THEN 0.0 ELSE (cos(pi() * ({d} - {rc - w}) / {w}) + 1) / 2 END"


def _dcos(d: str, rc: float, w: float) -> str:
    return f"CASE WHEN {d} <= {rc - w} OR {d} >= {rc} THEN 0.0 ELSE -pi() / (2 * {w}) * sin(pi() * ({d} - {rc - w}) / {w}) END"


_NB = f"{_AT}, {_NB0}, nb AS (SELECT *, least(si, sj) AS k1, greatest(si, sj) AS k2, {_cos('d', 8.0, 3.0)} AS f, {_dcos('d', 8.0, 3.0)} AS df FROM nb0 WHERE d > 0 AND d <= 8)"
_TR = f"""{_NB}, tr AS (
  SELECT a.g, a.i, a.j AS n1, b.j AS n2, a.si AS k1, least(a.sj, b.sj) AS k2, greatest(a.sj, b.sj) AS k3, a.d + b.d AS q1, (a.d - b.d) * (a.d - b.d) AS q2,
         sqrt((b.rx - a.rx) * (b.rx - a.rx) + (b.ry - a.ry) * (b.ry - a.ry) + (b.rz - a.rz) * (b.rz - a.rz)) AS q3, a.f * b.f AS ff
  FROM nb a JOIN nb b ON a.g = b.g AND a.i = b.i AND a.j < b.j)"""
_SP = f"""sp(k1, k2, p, c, col_id) AS (VALUES
  ('A', 'A', 1.5::DOUBLE, 0.4::DOUBLE, 0), ('A', 'A', 4, -0.3, 1), ('A', 'N', 3, 0.25, 2), ('A', 'R', 2, -0.1, 3), ('A', 'R', 5, 0.2, 4),
  ('N', 'N', 2.5, 0.15, 5), ('N', 'R', 4, -0.35, 6), ('R', 'R', 3.5, 0.05, 7)),
sf AS (SELECT *, {_cos('p', 8.0, 3.0)} AS fs FROM sp)"""
_ST = f"""st(k1, k2, k3, p1, p2, p3, c, col_id) AS (VALUES
  ('A', 'A', 'A', 6::DOUBLE, 1::DOUBLE, 3::DOUBLE, 0.3::DOUBLE, 0), ('A', 'N', 'R', 8, 0.5, 4, -0.2, 1), ('N', 'N', 'N', 5, 2, 3.5, 0.1, 2), ('R', 'A', 'R', 7, 0, 5, 0.45, 3)),
stf AS (SELECT *, ({_cos('(p1 + sqrt(p2)) / 2', 8.0, 3.0)}) * ({_cos('(p1 - sqrt(p2)) / 2', 8.0, 3.0)}) AS fs FROM st)"""
_K2 = "2.25 * exp(-(d - p) * (d - p) / 8)"
_K3 = "2.25 * exp(-((q1 - p1) * (q1 - p1) + (q2 - p2) * (q2 - p2) + (q3 - p3) * (q3 - p3)) / 8)"
_STR = """st0 AS (
  SELECT l_orderkey AS g, count(*) AS n_atoms, any_value(lower(o_orderpriority)) AS kind, any_value(o_totalprice / 1e5) AS energy
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)"""
_E2 = f"{_NB}, {_SP}, {_STR}, e2 AS (SELECT g, sum(c * fs * {_K2} * f) AS e FROM nb JOIN sf USING (k1, k2) GROUP BY g)"
_EV = """ev AS (
  SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_type AS s, value AS x FROM events),
en AS (SELECT a.g, a.i, a.s AS si, b.s AS sj, abs(b.x - a.x) AS d FROM ev a JOIN ev b ON a.g = b.g AND a.i <> b.i WHERE abs(b.x - a.x) > 0 AND abs(b.x - a.x) <= 12)"""
_POLY = "1 - pow(({r} - {a}) / {w}, 3) * (6 * pow(({r} - {a}) / {w}, 2) - 15 * ({r} - {a}) / {w} + 10)"


def _poly(r: str, rc: float, r0: float) -> str:
    return f"CASE WHEN {r} <= {r0} THEN 1.0 WHEN {r} >= {rc} THEN 0.0 ELSE {_POLY.format(r=r, a=r0, w=rc - r0)} END"


def _dpoly(r: str, rc: float, r0: float) -> str:
    x = f"(({r} - {r0}) / {rc - r0})"
    return f"CASE WHEN {r} <= {r0} OR {r} >= {rc} THEN 0.0 ELSE (-30 * pow({x}, 4) + 60 * pow({x}, 3) - 30 * pow({x}, 2)) / {rc - r0} END"


_RHO = f"""{_EV}, ed AS (
  SELECT g, i, CASE WHEN (si = 'click' AND sj = 'purchase') OR (si = 'purchase' AND sj = 'click') THEN CASE WHEN d >= 9 THEN 0.0 ELSE 0.5 * pow(1 - d / 9, 3) END
              ELSE {_poly('d', 12.0, 1.0)} END AS rho FROM en),
dens AS (SELECT ev.g, ev.i, ev.s AS k1, coalesce(sum(rho), 0) AS rho FROM ev LEFT JOIN ed ON ev.g = ed.g AND ev.i = ed.i GROUP BY ev.g, ev.i, ev.s)"""
_SE = "se(k1, p, c, col_id) AS (VALUES ('click', 0.5::DOUBLE, 0.2::DOUBLE, 0), ('click', 3, -0.1, 1), ('purchase', 1, 0.3, 2), ('view', 2, 0.05, 3))"


def _round(x: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0"


def _line(columns: str, where: str = "") -> str:
    return f"SELECT {_KEY}, {columns} FROM lineitem {where}"


def _spline(r: str, what: str) -> str:
    from atomloom.plans.queries import SPLINE

    knots, values = SPLINE["r"], SPLINE["E"]
    # Second derivatives of the natural spline, solved by hand-rolled elimination.
    n, h = len(knots), knots[1] - knots[0]
    m = [[0.0] * (n - 2) for _ in range(n - 2)]
    b = [6.0 * (values[k] - 2 * values[k + 1] + values[k + 2]) / h**2 for k in range(n - 2)]
    for k in range(n - 2):
        m[k][k] = 4.0
        if k:
            m[k][k - 1] = m[k - 1][k] = 1.0
    for k in range(1, n - 2):
        w = m[k][k - 1] / m[k - 1][k - 1]
        m[k][k] -= w * m[k - 1][k]
        b[k] -= w * b[k - 1]
    x = [0.0] * (n - 2)
    for k in reversed(range(n - 2)):
        x[k] = (b[k] - (m[k][k + 1] * x[k + 1] if k + 1 < n - 2 else 0.0)) / m[k][k]
    m2 = [0.0, *x, 0.0]
    cases = []
    for k in range(n - 1):
        a, c = f"({knots[k + 1]} - {r})", f"({r} - {knots[k]})"
        value = f"{m2[k] / (6 * h)} * pow({a}, 3) + {m2[k + 1] / (6 * h)} * pow({c}, 3) + {values[k] / h - m2[k] * h / 6} * {a} + {values[k + 1] / h - m2[k + 1] * h / 6} * {c}"
        slope = f"{-m2[k] / (2 * h)} * pow({a}, 2) + {m2[k + 1] / (2 * h)} * pow({c}, 2) - {values[k] / h - m2[k] * h / 6} + {values[k + 1] / h - m2[k + 1] * h / 6}"
        upper = "<=" if k == n - 2 else "<"
        cases.append(f"WHEN {r} >= {knots[k]} AND {r} {upper} {knots[k + 1]} THEN {value if what == 'value' else slope}")
    return f"CASE {' '.join(cases)} ELSE 0.0 END"


def _cells(axis: list[str], n: int, by: str, source: str, order: str) -> str:
    """First row of each occupied cell of an n-per-axis grid."""
    bounds = ", ".join(f"min({a}) AS lo{k}, greatest(max({a}) + 1e-4, 0) AS hi{k}" for k, a in enumerate(axis))
    bins = ", ".join(f"CAST(floor(({a} - lo{k}) / ((hi{k} - lo{k}) / {n})) AS BIGINT) AS b{k}" for k, a in enumerate(axis))
    names = ", ".join(f"b{k}" for k in range(len(axis)))
    return f"""bo AS (SELECT {by}, {bounds} FROM {source} GROUP BY {by}),
ce AS (SELECT s.*, {bins} FROM {source} s JOIN bo USING ({by})),
fi AS (SELECT *, row_number() OVER (PARTITION BY {by}, {names} ORDER BY {order}) AS rn FROM ce)"""


_ZBL_A = "(0.46848 / (pow(z1, 0.23) + pow(z2, 0.23)))"
_ZBL = f"""1.60217657e-19 / (4 * pi() * 8.854187817e-12 * 1e-10) * z1 * z2 / d
  * (c0 * exp(-c1 * d / {_ZBL_A}) + c2 * exp(-c3 * d / {_ZBL_A}) + c4 * exp(-c5 * d / {_ZBL_A})) * ({_poly('d', 6.0, 2.0)})"""
_ZC = """zc(k1, k2, z1, z2, c0, c1, c2, c3, c4, c5) AS (VALUES
  ('Fe', 'Fe', 26::DOUBLE, 26::DOUBLE, 0.2::DOUBLE, 3.2::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE),
  ('Fe', 'Ni', 26, 28, 0.25, 3.0, 0.45, 1.0, 0.3, 0.35), ('Ni', 'Ni', 28, 28, 0.18, 3.1, 0.52, 0.95, 0.3, 0.42))"""
_KIND = "CASE left(kind, 1) WHEN '1' THEN 'liquid_short' WHEN '2' THEN 'melt' WHEN '3' THEN 'dimer_scan' WHEN '4' THEN 'isolated_atom' ELSE kind END"
_SIMPLE = """CASE WHEN ct LIKE '%short%' OR ct LIKE '%traj%' OR ct LIKE '%low_volume%' OR ct LIKE '%dimer%' OR ct LIKE '%trimer%' THEN 3.0
  WHEN ct LIKE '%liquid%' OR ct LIKE '%melt%' THEN 5.0 WHEN ct = 'isolated_atom' THEN 0.001 ELSE 1.0 END"""
_OBS = f"""{_AT}, {_STR}, obs AS (
  SELECT g, 0 AS obs, energy / (0.01 * sqrt(n_atoms)) AS b, 1 / (0.01 * sqrt(n_atoms)) AS si FROM st0 WHERE energy IS NOT NULL
  UNION ALL SELECT g, i * 3 + 7, fx / 0.5, 1 / 0.5 FROM atm UNION ALL SELECT g, i * 3 + 8, fy / 0.5, 1 / 0.5 FROM atm UNION ALL SELECT g, i * 3 + 9, fz / 0.5, 1 / 0.5 FROM atm)"""
_GRID2 = "grid AS (SELECT i, CASE WHEN i = 199 THEN 8.0 ELSE i * (8.0 / 199) END AS d FROM range(200) t(i))"
_TAB2 = f"""{_GRID2}, {_SP}, t2 AS (
  SELECT k1, k2, i, any_value(d) AS r, 2 * sum(c * fs * {_K2}) * any_value({_cos('d', 8.0, 3.0)}) AS energy FROM grid, sf GROUP BY k1, k2, i)"""


_TF = f"""{_NB}, {_ST}, tt AS (
  SELECT a.g, a.i, a.j AS n1, b.j AS n2, a.si AS k1, least(a.sj, b.sj) AS k2, greatest(a.sj, b.sj) AS k3, a.d AS r01, b.d AS r02, a.f AS f1, b.f AS f2, a.df AS df1, b.df AS df2,
         a.rx AS x1, a.ry AS y1, a.rz AS z1, b.rx AS x2, b.ry AS y2, b.rz AS z2, b.rx - a.rx AS x3, b.ry - a.ry AS y3, b.rz - a.rz AS z3,
         a.d + b.d AS q1, (a.d - b.d) * (a.d - b.d) AS q2, sqrt((b.rx - a.rx) * (b.rx - a.rx) + (b.ry - a.ry) * (b.ry - a.ry) + (b.rz - a.rz) * (b.rz - a.rz)) AS q3
  FROM nb a JOIN nb b ON a.g = b.g AND a.i = b.i AND a.j < b.j),
tk AS (SELECT *, fs * {_K3} AS k FROM tt JOIN stf USING (k1, k2, k3)),
tg AS (SELECT *, 2 * ((k * (p1 - q1) / 4 + 2 * (r01 - r02) * k * (p2 - q2) / 4) * f1 * f2 + k * df1 * f2) / r01 AS g1,
         2 * ((k * (p1 - q1) / 4 - 2 * (r01 - r02) * k * (p2 - q2) / 4) * f1 * f2 + k * f1 * df2) / r02 AS g2,
         CASE WHEN q3 > 0 THEN 2 * k * (p3 - q3) / 4 * f1 * f2 / q3 ELSE 0 END AS g3 FROM tk)"""
#: Densities with signed distances, and their slopes.
_EF = f"""{_RHO}, {_SE}, es AS (
  SELECT a.g, a.i, b.i AS j, a.s AS k1, b.x - a.x AS rx, abs(b.x - a.x) AS d,
    CASE WHEN (a.s = 'click' AND b.s = 'purchase') OR (a.s = 'purchase' AND b.s = 'click') THEN CASE WHEN abs(b.x - a.x) >= 9 THEN 0.0 ELSE -0.5 * 3 / 9 * pow(1 - abs(b.x - a.x) / 9, 2) END
         ELSE {_dpoly('abs(b.x - a.x)', 12.0, 1.0)} END AS dr
  FROM ev a JOIN ev b ON a.g = b.g AND a.i <> b.i WHERE abs(b.x - a.x) > 0 AND abs(b.x - a.x) <= 12),
eg AS (SELECT es.g, es.i, es.j, col_id, rx, 2.25 * exp(-(rho - p) * (rho - p) / 8) * (p - rho) / 4 * dr / d AS k FROM es JOIN dens USING (g, i) JOIN se ON se.k1 = es.k1)"""
#: Neighbours with periodic images in the cell of 60 x 12 x 12.
_NBP = f"""{_AT}, img AS (SELECT a * 60.0 AS ox, b * 12.0 AS oy, c * 12.0 AS oz FROM range(-1, 2) x(a), range(-1, 2) y(b), range(-1, 2) z(c)),
nb0 AS (SELECT a.g, a.i, b.i AS j, a.s AS si, b.s AS sj, b.x + ox - a.x AS rx, b.y + oy - a.y AS ry, b.z + oz - a.z AS rz FROM atm a JOIN atm b USING (g), img
        WHERE abs(b.x + ox - a.x) <= 8 AND abs(b.y + oy - a.y) <= 8 AND abs(b.z + oz - a.z) <= 8),
nb1 AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS d, least(si, sj) AS k1, greatest(si, sj) AS k2 FROM nb0),
nb AS (SELECT *, {_cos('d', 8.0, 3.0)} AS f, {_dcos('d', 8.0, 3.0)} AS df FROM nb1 WHERE d > 0 AND d <= 8)"""


def _least_squares(observed: str) -> str:
    """Coefficients of the pair model from CTEs nb, sf and ``observed`` (g, obs, b, si), by normal equations and elimination."""
    return f"""
raw AS (
  SELECT g, 0 AS obs, col_id, sum({_K2} * f * fs) AS a FROM nb JOIN sf USING (k1, k2) GROUP BY g, col_id
  UNION ALL
  SELECT g, i * 3 + 7 + k, col_id, sum(2 * fs * ({_K2} * (p - d) / 4 * f + {_K2} * df) / d * CASE k WHEN 0 THEN rx WHEN 1 THEN ry ELSE rz END)
  FROM nb JOIN sf USING (k1, k2), range(3) t(k) GROUP BY g, i, k, col_id),
m AS (SELECT g, obs, col_id, a * si AS a FROM raw JOIN {observed} USING (g, obs) UNION ALL SELECT g, obs, 8, b FROM {observed}),
ata AS (SELECT x.col_id AS c1, y.col_id AS c2, sum(x.a * y.a) AS v FROM m x JOIN m y ON x.g = y.g AND x.obs = y.obs WHERE x.col_id < 8 GROUP BY x.col_id, y.col_id),
prior AS (SELECT x.col_id AS c1, y.col_id AS c2, 2.25 * exp(-(x.p - y.p) * (x.p - y.p) / 8) * x.fs * y.fs + CASE WHEN x.col_id = y.col_id THEN 1e-8 ELSE 0 END AS v FROM sf x JOIN sf y USING (k1, k2)),
cell AS (SELECT c1, c2, coalesce(sum(v), 0) AS v FROM (SELECT a.i AS c1, b.i AS c2, 0.0::DOUBLE AS v FROM range(8) a(i), range(9) b(i) UNION ALL SELECT * FROM ata UNION ALL SELECT * FROM prior) GROUP BY c1, c2),
line AS (SELECT c1, list(v ORDER BY c2) AS v FROM cell GROUP BY c1),
gj(k, m) AS (
  SELECT 0, (SELECT list(v ORDER BY c1) FROM line)
  UNION ALL
  SELECT k + 1, [[CASE WHEN i = k + 1 THEN m[i][j] / m[k + 1][k + 1] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END FOR j IN range(1, 10)] FOR i IN range(1, 9)] FROM gj WHERE k < 8)
SELECT CAST(i AS INTEGER) AS col_id, {_round('m[i + 1][9]')} AS coefficient FROM gj, range(8) t(i) WHERE k = 8"""


def _spline_map(name: str, n: int) -> str:
    """CTE (c, j, w): coefficient c of the straight-ended B-spline through n values is the sum of w times value j.

    Inside, the inverse of the matrix with 4 on and 1 beside the diagonal is
    known: products of hyperbolic sines of the angle of cosh 2.
    """
    m, t = n - 2, "1.3169578969248166e0"
    sinh = lambda x: f"((exp({t} * ({x})) - exp(-{t} * ({x}))) / 2)"
    green = f"(CASE WHEN (i + j) % 2 = 0 THEN 1 ELSE -1 END) * {sinh('least(i, j)')} * {sinh(f'{m + 1} - greatest(i, j)')} / ({sinh('1')} * {sinh(str(m + 1))})"
    return f"""{name}_g AS (SELECT i, j, {green} AS w FROM range(1, {m + 1}) a(i), range(1, {m + 1}) b(j)),
{name}_i AS (
  SELECT i, j, 6 * w AS w FROM {name}_g UNION ALL SELECT i, 0, -w FROM {name}_g WHERE j = 1 UNION ALL SELECT i, {n - 1}, -w FROM {name}_g WHERE j = {m}
  UNION ALL SELECT 0, 0, 1.0 UNION ALL SELECT {n - 1}, {n - 1}, 1.0),
{name} AS (
  SELECT c, j, sum(w) AS w FROM (
    SELECT i + 1 AS c, j, w FROM {name}_i
    UNION ALL SELECT 0, j, 2 * w FROM {name}_i WHERE i = 0 UNION ALL SELECT 0, j, -w FROM {name}_i WHERE i = 1
    UNION ALL SELECT {n + 1}, j, 2 * w FROM {name}_i WHERE i = {n - 1} UNION ALL SELECT {n + 1}, j, -w FROM {name}_i WHERE i = {n - 2}) GROUP BY c, j)"""


ORACLE_SQL: dict[str, str] = {
    "cutoff_cos": _line(f"{_round(_cos('l_quantity', 40.0, 25.0), 9)} AS f, {_round(_dcos('l_quantity', 40.0, 25.0), 9)} AS df"),
    "cutoff_perriot": _line(f"{_round(_poly('l_quantity', 40.0, 10.0), 9)} AS f, {_round(_dpoly('l_quantity', 40.0, 10.0), 9)} AS df"),
    "pair_fn_poly": _line(f"{_round('1.7 * (' + _poly('l_quantity', 46.0, 5.0) + ')', 9)} AS f, {_round('1.7 * (' + _dpoly('l_quantity', 46.0, 5.0) + ')', 9)} AS df"),
    "pair_fn_cos": _line(f"{_round('0.6 * (' + _cos('l_quantity', 45.0, 40.0) + ')', 9)} AS f, {_round('0.6 * (' + _dcos('l_quantity', 45.0, 40.0) + ')', 9)} AS df"),
    "pair_fn_fsgen": _line(
        f"{_round('CASE WHEN l_quantity >= 42 THEN 0.0 ELSE 2.5 * pow(1 - l_quantity / 42, 4) END', 9)} AS f, "
        f"{_round('CASE WHEN l_quantity >= 42 THEN 0.0 ELSE -2.5 * 4 / 42 * pow(1 - l_quantity / 42, 3) END', 9)} AS df"
    ),
    "se_kernel_1d": _line(
        f"{_round('1.69 * exp(-pow(l_quantity - 20, 2) / 98)', 9)} AS k, {_round('1.69 * exp(-pow(l_quantity - 20, 2) / 98) * (20 - l_quantity) / 49', 9)} AS dk"
    ),
    "se_kernel_vec": f"""
WITH w AS (SELECT embedding AS w FROM embeddings ORDER BY vec_id LIMIT 1),
e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest(w)::DOUBLE AS b FROM embeddings, w)
SELECT vec_id, {_round('4 * exp(-sum((a - b) * (a - b)) / 4.5)', 7)} AS k FROM e GROUP BY vec_id""",
    "triplet_gradients": f"""
WITH t AS (SELECT {_KEY}, l_quantity AS a, l_discount * 100 AS b, l_tax * 100 AS c, abs(l_quantity - l_discount * 100) AS d FROM lineitem)
SELECT {_KEY}, {_round('a + b')} AS q1, {_round('(a - b) * (a - b)')} AS q2, {_round('c')} AS q3, {_round('2 * (a - b)')} AS d01, {_round('2 * (b - a)')} AS d02,
  {_round('(' + _cos('((a + b + d) / 2)', 40.0, 30.0) + ') * (' + _cos('((a + b - d) / 2)', 40.0, 30.0) + ')', 8)} AS fcut FROM t""",
    "vector_algebra": f"""
WITH t AS (SELECT {_KEY}, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem),
u AS (SELECT *, x + 2 * y - 0.5 * z AS ab, sqrt(x * x + y * y + z * z) AS n FROM t)
SELECT {_KEY}, {_round('ab')} AS "dot", {_round('n')} AS len, {_round('y * -0.5 - z * 2')} AS cross_x, {_round('2 * ab / 5.25')} AS project_y,
  {_round('z + 0.5 * ab / 5.25')} AS reject_z, {_round('6.5 * (6.5 * x - 3 * y + z) / 52.25')} AS reject2_x, {_round('x / n')} AS unit_x,
  {_round('least(abs(x), abs(y), abs(z))')} AS "least" FROM u""",
    "cell_volume": f"""
WITH t AS (SELECT {_KEY}, l_quantity AS q, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem)
SELECT {_KEY}, {_round('abs(q * (y * z - 0) - 1 * (-2 * z - 0.5) + 0)')} AS volume FROM t""",
    "element_lookup": "WITH el(z, species, mass) AS (VALUES "
    + ", ".join(f"({z}, '{SYMBOL[z]}', {MASS[SYMBOL[z]]}::DOUBLE)" for z in sorted(SYMBOL))
    + ") SELECT p_partkey, species, CAST(z AS BIGINT) AS z, mass FROM part JOIN el ON p_size = z",
    "spline_interval_lookup": _line(f"{_round(_spline('(l_quantity / 5.0)', 'value'), 8)} AS e, {_round(_spline('(l_quantity / 5.0)', 'slope'), 8)} AS de"),
    "pair_neighbours_count": f"WITH {_NB} SELECT g AS structure_id, count(*) AS n, {_round('sum(d)', 5)} AS sum_d FROM nb GROUP BY g",
    "periodic_neighbours": f"""
WITH {_AT}, o AS (SELECT a * 60.0 AS ox, b * 12.0 AS oy, c * 12.0 AS oz FROM range(-2, 3) x(a), range(-2, 3) y(b), range(-2, 3) z(c)),
p AS (SELECT a.g, sqrt(pow(b.x + ox - a.x, 2) + pow(b.y + oy - a.y, 2) + pow(b.z + oz - a.z, 2)) AS d FROM atm a JOIN atm b USING (g), o
      WHERE abs(b.x + ox - a.x) <= 5 AND abs(b.y + oy - a.y) <= 5 AND abs(b.z + oz - a.z) <= 5)
SELECT g AS structure_id, count(*) AS n, {_round('sum(d)', 5)} AS sum_d FROM p WHERE d > 0 AND d <= 5 GROUP BY g""",
    "pair_index_by_species": f"WITH {_NB} SELECT k1, k2, count(*) AS n, {_round('sum(f)', 4)} AS sum_f, {_round('sum(df)', 4)} AS sum_df FROM nb WHERE j >= i GROUP BY k1, k2",
    "triplet_index_counts": f"WITH {_TR} SELECT k1, k2, k3, count(*) AS n FROM tr GROUP BY k1, k2, k3",
    "triplet_invariants": f"WITH {_TR} SELECT g AS structure_id, {_round('sum(q1)', 4)} AS q1, {_round('sum(q2)', 4)} AS q2, {_round('sum(q3)', 4)} AS q3, {_round('sum(ff)', 5)} AS ff FROM tr GROUP BY g",
    "eam_density": f"WITH {_RHO} SELECT g AS structure_id, i, k1, {_round('rho', 7)} AS rho FROM dens",
    "pair_covariance": f"WITH {_NB}, {_SP} SELECT g AS structure_id, col_id, {_round(f'sum({_K2} * f * fs)')} AS cov FROM nb JOIN sf USING (k1, k2) GROUP BY g, col_id",
    "triplet_covariance": f"WITH {_TR}, {_ST} SELECT g AS structure_id, col_id, {_round(f'sum(2 * {_K3} * ff * fs)')} AS cov FROM tr JOIN stf USING (k1, k2, k3) GROUP BY g, col_id",
    "eam_covariance": f"""WITH {_RHO}, {_SE}
SELECT g AS structure_id, col_id, {_round('sum(2.25 * exp(-(rho - p) * (rho - p) / 8))', 5)} AS cov FROM dens JOIN se USING (k1) GROUP BY g, col_id""",
    "pair_forces": f"""WITH {_NB}, {_SP}, gr AS (SELECT g, i, col_id, rx, ry, rz, 2 * fs * ({_K2} * (p - d) / 4 * f + {_K2} * df) / d AS k FROM nb JOIN sf USING (k1, k2))
SELECT g AS structure_id, i AS atom_id, col_id, {_round('sum(k * rx)')} AS fx, {_round('sum(k * ry)')} AS fy, {_round('sum(k * rz)')} AS fz FROM gr GROUP BY g, i, col_id""",
    "pair_virials": f"""WITH {_NB}, {_SP}, gr AS (SELECT g, col_id, rx, ry, rz, 2 * fs * ({_K2} * (p - d) / 4 * f + {_K2} * df) / d AS k FROM nb JOIN sf USING (k1, k2) WHERE j > i)
SELECT g AS structure_id, col_id, {_round('-sum(k * rx * rx)', 5)} AS vxx, {_round('-sum(k * rx * ry)', 5)} AS vxy, {_round('-sum(k * rz * rz)', 5)} AS vzz FROM gr GROUP BY g, col_id""",
    "covariate_with_zeros": f"""WITH {_NB}, {_SP}, c AS (SELECT g, col_id, sum({_K2} * f * fs) AS cov FROM nb JOIN sf USING (k1, k2) GROUP BY g, col_id)
SELECT t.g AS structure_id, t.col_id, {_round('coalesce(cov, 0)')} AS cov FROM (SELECT DISTINCT g, col_id FROM atm, sf) t LEFT JOIN c ON c.g = t.g AND c.col_id = t.col_id""",
    "self_covariance": f"""WITH {_NB}, hp AS (SELECT * FROM nb WHERE j >= i), {_cells(['d'], 6, 'k1, k2', 'hp', 'g, i, j')}, ch AS (SELECT k1, k2, b0, d, f FROM fi WHERE rn = 1)
SELECT a.k1, a.k2, a.b0, b.b0 AS b1, {_round('2.25 * exp(-(a.d - b.d) * (a.d - b.d) / 8) * a.f * b.f', 8)} AS k FROM ch a JOIN ch b ON a.k1 = b.k1 AND a.k2 = b.k2""",
    "sparsify_uniform_1d": f"""WITH {_NB}, hp AS (SELECT * FROM nb WHERE j >= i), {_cells(['d'], 12, 'k1, k2', 'hp', 'g, i, j')}
SELECT k1, k2, b0, g AS structure_id, i, j, {_round('d', 8)} AS d FROM fi WHERE rn = 1""",
    "sparsify_uniform_3d": f"""WITH {_TR}, {_cells(['q1', 'q2', 'q3'], 3, 'k1, k2, k3', 'tr', 'g, i, n1, n2')}
SELECT k1, k2, k3, b0, b1, b2, g AS structure_id, i, n1, n2 FROM fi WHERE rn = 1""",
    "predict_energy": f"""WITH {_TR}, {_SP}, {_ST}, {_STR}, e AS (
  SELECT g, sum(c * fs * {_K2} * f) AS e FROM nb JOIN sf USING (k1, k2) GROUP BY g
  UNION ALL SELECT g, sum(2 * c * fs * {_K3} * ff) FROM tr JOIN stf USING (k1, k2, k3) GROUP BY g)
SELECT st0.g AS structure_id, {_round('coalesce(sum(e), 0)', 5)} AS energy FROM st0 LEFT JOIN e USING (g) GROUP BY st0.g""",
    "predict_pair_forces": f"""WITH {_NB}, {_SP}, gr AS (SELECT g, i, j, rx, ry, rz, 2 * c * fs * ({_K2} * (p - d) / 4 * f + {_K2} * df) / d AS k FROM nb JOIN sf USING (k1, k2)),
v AS (SELECT g, -sum(k * rx * rx) AS vxx FROM gr WHERE j > i GROUP BY g), fo AS (SELECT g, i, sum(k * rx) AS fx, sum(k * ry) AS fy, sum(k * rz) AS fz FROM gr GROUP BY g, i)
SELECT atm.g AS structure_id, atm.i AS atom_id, {_round('coalesce(fo.fx, 0)')} AS fx, {_round('coalesce(fo.fy, 0)')} AS fy, {_round('coalesce(fo.fz, 0)')} AS fz, {_round('coalesce(vxx, 0)', 5)} AS vxx
FROM atm LEFT JOIN fo ON fo.g = atm.g AND fo.i = atm.i LEFT JOIN v ON v.g = atm.g""",
    "composite_sum": f"""WITH {_E2}, iso AS (SELECT g, sum(CASE s WHEN 'A' THEN -0.5 WHEN 'R' THEN -1.25 ELSE 0 END) AS e0 FROM atm GROUP BY g)
SELECT g AS structure_id, {_round('e0 + coalesce(e, 0)', 5)} AS energy FROM iso LEFT JOIN e2 USING (g)""",
    "spline_pair_energy": f"""WITH {_NB}, {_STR}, e AS (SELECT g, sum({_spline('d', 'value')}) AS e FROM nb WHERE j > i AND ((k1 = 'A' AND k2 = 'N') OR (k1 = 'R' AND k2 = 'R')) GROUP BY g)
SELECT g AS structure_id, {_round('coalesce(e, 0)', 5)} AS energy FROM st0 LEFT JOIN e USING (g)""",
    "zbl_energy": f"""WITH {_NB}, {_STR}, {_ZC}, p AS (
  SELECT g, d, CASE WHEN si = 'N' THEN 'Ni' ELSE 'Fe' END AS a, CASE WHEN sj = 'N' THEN 'Ni' ELSE 'Fe' END AS b FROM nb WHERE j > i AND d <= 6),
e AS (SELECT g, sum({_ZBL}) AS e FROM p JOIN zc ON k1 = least(a, b) AND k2 = greatest(a, b) GROUP BY g)
SELECT g AS structure_id, {_round('coalesce(e, 0)', 5)} AS energy FROM st0 LEFT JOIN e USING (g)""",
    "isolated_fit": f"""WITH {_AT}, {_STR}, one AS (SELECT s, energy, g FROM st0 JOIN atm USING (g) WHERE n_atoms = 1 AND energy IS NOT NULL)
SELECT s AS species, {_round('arg_min(energy, g)')} AS energy, {_round('max(energy) - min(energy)')} AS spread, CAST(0 AS BIGINT) AS n_bad FROM one GROUP BY s""",
    "isolated_predict": f"WITH {_AT} SELECT g AS structure_id, {_round('''sum(CASE s WHEN 'A' THEN -0.5 WHEN 'R' THEN -1.25 ELSE 0 END)''')} AS energy FROM atm GROUP BY g",
    "unknown_species_anti": "SELECT DISTINCT l_returnflag AS species FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')",
    "residual_subtract": f"WITH {_E2} SELECT g AS structure_id, {_round('energy - coalesce(e, 0)', 8)} AS energy FROM st0 LEFT JOIN e2 USING (g)",
    "adjust_set_empty": f"""WITH {_E2}, gr AS (SELECT g, sum(2 * c * fs * ({_K2} * (p - d) / 4 * f + {_K2} * df) / d * rx) AS k FROM nb JOIN sf USING (k1, k2) GROUP BY g),
t AS (SELECT g, sum(fx) AS fx FROM atm GROUP BY g)
SELECT st0.g AS structure_id, {_round('coalesce(energy, 0) + coalesce(e, 0)', 8)} AS energy, {_round('t.fx + coalesce(k, 0)', 8)} AS sum_fx
FROM st0 JOIN t USING (g) LEFT JOIN e2 USING (g) LEFT JOIN gr USING (g)""",
    "supercell_repeat": f"""WITH {_AT}, {_STR}, r AS (
  SELECT g, count(*) AS n, sum(x + 60.0 * a) AS sx, sum(z + 12.0 * c) AS sz FROM atm, range(2) u(a), range(3) w(c) GROUP BY g)
SELECT g AS structure_id, n_atoms * 6 AS n_atoms, n, n_atoms * 6 AS ids, {_round('sx', 4)} AS sx, {_round('sz', 4)} AS sz, {_round('energy * 6')} AS energy, {_round('120.0 * 12 * 36')} AS volume
FROM st0 JOIN r USING (g)""",
    "sigma_simple": f"""WITH {_STR}, k AS (SELECT *, {_KIND} AS ct FROM st0), m AS (SELECT *, {_SIMPLE} AS f FROM k)
SELECT g AS structure_id, {_round('1 / (0.01 * f * sqrt(n_atoms))', 7)} AS e, {_round('1 / (1.0 * f * sqrt(n_atoms))', 7)} AS v FROM m""",
    "sigma_per_keyword": "SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%sta%' THEN 3.0::DOUBLE WHEN lower(p_type) LIKE '%a%' THEN 10.0 WHEN lower(p_type) LIKE '%ro%' THEN 0.5 ELSE 1.0 END AS factor FROM part",
    "target_vector": f"WITH {_OBS} SELECT g AS structure_id, obs, {_round('b')} AS b FROM obs",
    "normal_matrix": f"""WITH {_NB}, {_SP}, {_OBS[len(_AT) + 2 :]},
raw AS (
  SELECT g, 0 AS obs, col_id, sum({_K2} * f * fs) AS a FROM nb JOIN sf USING (k1, k2) GROUP BY g, col_id
  UNION ALL
  SELECT g, i * 3 + 7 + k, col_id, sum(2 * fs * ({_K2} * (p - d) / 4 * f + {_K2} * df) / d * CASE k WHEN 0 THEN rx WHEN 1 THEN ry ELSE rz END)
  FROM nb JOIN sf USING (k1, k2), range(3) t(k) GROUP BY g, i, k, col_id),
m AS (SELECT g, obs, col_id, a * si AS a FROM raw JOIN obs USING (g, obs) UNION ALL SELECT g, obs, 8, b FROM obs)
SELECT x.col_id AS c1, y.col_id AS c2, {_round('sum(x.a * y.a) / 1e6', 5)} AS product FROM m x JOIN m y ON x.g = y.g AND x.obs = y.obs AND x.col_id <= y.col_id GROUP BY x.col_id, y.col_id""",
    "tabulate_pair": f"WITH {_TAB2} SELECT k1, k2, i, {_round('r')} AS r, {_round('energy', 8)} AS energy FROM t2",
    "tabulate_triplet_grid": f"""WITH {_ST}, gr AS (
  SELECT i, j, k, 0.5 + i * (5.5 / 11) AS r1, 0.5 + j * (5.5 / 11) AS r2, -1.0 + k * 0.25 AS u FROM range(12) a(i), range(12) b(j), range(9) c(k)),
q AS (SELECT *, r1 + r2 AS q1, (r1 - r2) * (r1 - r2) AS q2, sqrt(greatest(r1 * r1 + r2 * r2 - 2 * r1 * r2 * u, 0)) AS q3 FROM gr)
SELECT k1, k2, k3, i, j, k, {_round(f"2 * c * fs * {_K3} * ({_cos('r1', 8.0, 3.0)}) * ({_cos('r2', 8.0, 3.0)})", 8)} AS energy FROM q, stf""",
    "tabulate_embedding": f"""WITH {_SE}, gr AS (SELECT i, i * (6.5 / 99) AS rho FROM range(100) t(i))
SELECT k1 AS species, i, {_round('rho')} AS rho, {_round('sum(c * 2.25 * exp(-(rho - p) * (rho - p) / 8))', 8)} AS energy FROM gr, se GROUP BY k1, i, rho""",
    "tabulate_densities": f"""WITH {_GRID2}, s(x) AS (VALUES ('click'), ('purchase'), ('view'))
SELECT a.x AS giver, b.x AS receiver, i, {_round(f"CASE WHEN (a.x = 'click' AND b.x = 'purchase') OR (a.x = 'purchase' AND b.x = 'click') THEN 0.5 * pow(1 - d / 9, 3) ELSE {_poly('d', 12.0, 1.0)} END", 8)} AS rho
FROM grid, s a, s b""",
    "tabulate_zbl": f"""WITH {_GRID2}, {_ZC}
SELECT k1, k2, i, {_round(f'CASE WHEN d < 1e-4 OR d > 6 THEN 0.0 ELSE {_ZBL} END')} AS energy FROM (SELECT i, CASE WHEN d = 0 THEN 1e-5 ELSE d END AS d FROM grid), zc""",
    "tabulate_merge": f"""WITH {_TAB2}
SELECT k1, k2, i, {_round(f"energy + CASE WHEN (k1 = 'A' AND k2 = 'N') OR (k1 = 'R' AND k2 = 'R') THEN {_spline('r', 'value')} ELSE 0 END", 7)} AS energy FROM t2""",
    "triplet_forces": f"""WITH {_TF}, fo AS (
  SELECT g, i AS a, col_id, g1 * x1 + g2 * x2 AS fx, g1 * y1 + g2 * y2 AS fy, g1 * z1 + g2 * z2 AS fz FROM tg
  UNION ALL SELECT g, n1, col_id, g3 * x3 - g1 * x1, g3 * y3 - g1 * y1, g3 * z3 - g1 * z1 FROM tg
  UNION ALL SELECT g, n2, col_id, -g2 * x2 - g3 * x3, -g2 * y2 - g3 * y3, -g2 * z2 - g3 * z3 FROM tg)
SELECT g AS structure_id, a AS atom_id, col_id, {_round('sum(fx)', 5)} AS fx, {_round('sum(fy)', 5)} AS fy, {_round('sum(fz)', 5)} AS fz FROM fo GROUP BY g, a, col_id""",
    "triplet_virials": f"""WITH {_TF} SELECT g AS structure_id, col_id, {_round('-sum(g1 * x1 * x1 + g2 * x2 * x2 + g3 * x3 * x3)', 4)} AS vxx,
  {_round('-sum(g1 * x1 * y1 + g2 * x2 * y2 + g3 * x3 * y3)', 4)} AS vxy, {_round('-sum(g1 * z1 * z1 + g2 * z2 * z2 + g3 * z3 * z3)', 4)} AS vzz FROM tg GROUP BY g, col_id""",
    "eam_forces": f"""WITH {_EF}, fo AS (
  SELECT g, i AS a, col_id, k * rx AS fx, -k * rx * rx AS vxx FROM eg UNION ALL SELECT g, j, col_id, -k * rx, 0 FROM eg
  UNION ALL SELECT g, i, col_id, 0, 0 FROM dens JOIN se USING (k1))
SELECT g AS structure_id, a AS atom_id, col_id, {_round('sum(fx)', 5)} AS fx, {_round('sum(vxx)', 5)} AS vxx FROM fo GROUP BY g, a, col_id""",
    "sparse_self_covariance": f"""WITH {_SP}, {_ST}
SELECT 'pair' AS descriptor, x.col_id AS c1, y.col_id AS c2, {_round('2.25 * exp(-(x.p - y.p) * (x.p - y.p) / 8) * x.fs * y.fs', 8)} AS k FROM sf x JOIN sf y USING (k1, k2)
UNION ALL SELECT 'triple', x.col_id, y.col_id, {_round('2.25 * exp(-(pow(x.p1 - y.p1, 2) + pow(x.p2 - y.p2, 2) + pow(x.p3 - y.p3, 2)) / 8) * x.fs * y.fs', 8)} FROM stf x JOIN stf y USING (k1, k2, k3)""",
    "choose_sparse_points": f"""WITH {_NB}, hp AS (SELECT * FROM nb WHERE j >= i), {_cells(['d'], 3, 'k1, k2', 'hp', 'g, i, j')}
SELECT k1, k2, row_number() OVER (PARTITION BY k1, k2 ORDER BY b0) - 1 AS n, {_round('d', 8)} AS d FROM fi WHERE rn = 1""",
    "sigma_per_ct": f"""WITH {_STR}, k AS (SELECT *, {_KIND} AS ct FROM st0), m AS (
  SELECT *, CASE WHEN ct LIKE '%melt%' THEN 3.0 WHEN ct LIKE '%o%' THEN 10.0 WHEN ct LIKE '%sh%' THEN 0.5 ELSE 1.0 END AS f FROM k)
SELECT g AS structure_id, {_round('1 / (0.01 * f * sqrt(n_atoms))', 7)} AS e, {_round('1 / (0.1 * f * sqrt(n_atoms))', 7)} AS v, {_round('1 / (0.05 * f)', 7)} AS f FROM m""",
    "set_predictions": f"""WITH {_E2}, gr AS (SELECT g, i, sum(2 * c * fs * ({_K2} * (p - d) / 4 * f + {_K2} * df) / d * rx) AS k FROM nb JOIN sf USING (k1, k2) GROUP BY g, i),
t AS (SELECT atm.g, max(coalesce(k, 0)) AS top FROM atm LEFT JOIN gr ON gr.g = atm.g AND gr.i = atm.i GROUP BY atm.g)
SELECT st0.g AS structure_id, {_round('coalesce(e, 0)')} AS energy, {_round('top')} AS top, true AS bare FROM st0 JOIN t USING (g) LEFT JOIN e2 USING (g)""",
    "fit_solve": f"WITH RECURSIVE {_NB}, {_SP}, {_OBS[len(_AT) + 2 :]}, {_least_squares('obs')}",
    "composite_fit": f"""WITH RECURSIVE {_NBP}, {_SP}, {_STR},
sp2 AS (SELECT g, i, rx, ry, rz, d, {_spline('d', 'value')} AS u, {_spline('d', 'slope')} AS du FROM nb WHERE (k1 = 'A' AND k2 = 'N') OR (k1 = 'R' AND k2 = 'R')),
se2 AS (SELECT g, sum(u) / 2 AS e FROM sp2 GROUP BY g), sf2 AS (SELECT g, i, sum(du / d * rx) AS sx, sum(du / d * ry) AS sy, sum(du / d * rz) AS sz FROM sp2 GROUP BY g, i),
left_atm AS (SELECT atm.g, atm.i, fx - coalesce(sx, 0) AS fx, fy - coalesce(sy, 0) AS fy, fz - coalesce(sz, 0) AS fz FROM atm LEFT JOIN sf2 ON sf2.g = atm.g AND sf2.i = atm.i),
obs AS (
  SELECT g, 0 AS obs, (energy - coalesce(e, 0)) / (0.01 * sqrt(n_atoms)) AS b, 1 / (0.01 * sqrt(n_atoms)) AS si FROM st0 LEFT JOIN se2 USING (g) WHERE energy IS NOT NULL
  UNION ALL SELECT g, i * 3 + 7, fx / 0.5, 1 / 0.5 FROM left_atm UNION ALL SELECT g, i * 3 + 8, fy / 0.5, 1 / 0.5 FROM left_atm UNION ALL SELECT g, i * 3 + 9, fz / 0.5, 1 / 0.5 FROM left_atm), {_least_squares('obs')}""",
    "tabulate_splines": f"""WITH {_TAB2}, {_spline_map('bs', 200)}
SELECT k1, k2, CAST(c AS INTEGER) AS n, {_round('sum(w * energy)', 8)} AS c FROM t2 JOIN bs ON j = i GROUP BY k1, k2, bs.c""",
    "tabulate_triplet_splines": f"""WITH {_ST}, {_spline_map('br', 12)}, {_spline_map('ba', 9)}, gr AS (
  SELECT i, j, k, 0.5 + i * (5.5 / 11) AS r1, 0.5 + j * (5.5 / 11) AS r2, -1.0 + k * 0.25 AS u FROM range(12) a(i), range(12) b(j), range(9) c(k)),
q AS (SELECT *, r1 + r2 AS q1, (r1 - r2) * (r1 - r2) AS q2, sqrt(greatest(r1 * r1 + r2 * r2 - 2 * r1 * r2 * u, 0)) AS q3 FROM gr),
e0 AS (SELECT k1, k2, k3, i, j, k, 2 * c * fs * {_K3} * ({_cos('r1', 8.0, 3.0)}) * ({_cos('r2', 8.0, 3.0)}) AS e FROM q, stf),
e1 AS (SELECT k1, k2, k3, i, e0.j, ba.c AS z, sum(w * e) AS e FROM e0 JOIN ba ON ba.j = k GROUP BY k1, k2, k3, i, e0.j, ba.c),
e2 AS (SELECT k1, k2, k3, i, br.c AS y, z, sum(w * e) AS e FROM e1 JOIN br ON br.j = e1.j GROUP BY k1, k2, k3, i, br.c, z),
e3 AS (SELECT k1, k2, k3, br.c AS x, y, z, sum(w * e) AS e FROM e2 JOIN br ON br.j = i GROUP BY k1, k2, k3, br.c, y, z)
SELECT k1, k2, k3, CAST((x * 14 + y) * 11 + z AS INTEGER) AS n, {_round('e', 7)} AS c FROM e3""",
    "xyz_round_trip": f"""WITH {_AT}, {_STR}
SELECT any_value(kind) AS config_type, any_value(n_atoms) AS n_atoms, {_round('any_value(energy)', 9)} AS energy, true AS no_virials, {_round('60.0 * 12 * 12')} AS volume, count(*) AS n,
  {_round('sum(x)')} AS sum_x, {_round('sum(y)')} AS sum_y, {_round('sum(z)')} AS sum_z, {_round('sum(fx)')} AS sum_fx, {_round('sum(fy)')} AS sum_fy, {_round('sum(fz)')} AS sum_fz, CAST(sum(i * ascii(s)) AS BIGINT) AS order_sum
FROM atm JOIN st0 USING (g) GROUP BY g""",
    "xyz_predict": f"""WITH {_NBP}, {_SP}, {_STR}, e AS (SELECT g, sum(c * fs * {_K2} * f) AS e FROM nb JOIN sf USING (k1, k2) GROUP BY g),
gr AS (SELECT g, i, rx, ry, 2 * c * fs * ({_K2} * (p - d) / 4 * f + {_K2} * df) / d AS k FROM nb JOIN sf USING (k1, k2)),
v AS (SELECT g, -sum(k * rx * ry) / 2 AS vxy FROM gr GROUP BY g), fo AS (SELECT g, sum(abs(fx)) AS fx FROM (SELECT g, i, sum(k * rx) AS fx FROM gr GROUP BY g, i) GROUP BY g)
SELECT {_round('energy', 9)} AS read, n_atoms, {_round('coalesce(e, 0)', 5)} AS energy, {_round('coalesce(fx, 0)', 5)} AS sum_fx, {_round('coalesce(vxy, 0)', 4)} AS vxy
FROM st0 LEFT JOIN e USING (g) LEFT JOIN v USING (g) LEFT JOIN fo USING (g)""",
}
