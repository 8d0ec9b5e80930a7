"""Small structures and a comparison with SQL."""

from __future__ import annotations

import os

import pandas as pd

from atomloom.operators.structures import ATOM_SCHEMA, STRUCTURE_SCHEMA

TRIANGLE = [(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (1.5, 2.598, 0.0)]
KERNEL = {"type": "squared_exp", "length_scale": 1.0, "energy_scale": 1.0}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def cube(edge: float) -> list[list[float]]:
    return [[edge, 0.0, 0.0], [0.0, edge, 0.0], [0.0, 0.0, edge]]


def structures(spark, boxes):
    """boxes: (lattice, species, positions, options), one a structure; options may have energy, forces, kind."""
    s, a = [], []
    for n, (lattice, species, positions, o) in enumerate(boxes):
        lattice = [[float(x) for x in row] for row in lattice]
        s.append((n, o.get("kind", "x"), len(positions), lattice, o.get("energy"), o.get("virials"), None, None))
        forces = o.get("forces") or [(None, None, None)] * len(positions)
        for k, (x, p, f) in enumerate(zip(species, positions, forces)):
            a.append((n, k, x, *map(float, p), *[None if v is None else float(v) for v in f], None, None, None))
    return spark.createDataFrame(s, STRUCTURE_SCHEMA), spark.createDataFrame(a, ATOM_SCHEMA)


def in_duckdb(sql: str, folder: str = SF) -> pd.DataFrame:
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c.sql(sql).df()


def rows_of(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float) and v == int(v):
            return int(v)
        return v

    cols = sorted(df.columns)
    return sorted(repr([plain(v) for v in r]) for r in df[cols].astype(object).values.tolist())
