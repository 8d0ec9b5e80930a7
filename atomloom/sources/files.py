"""Small files that live on the driver: configurations, potentials, and tables for other programs."""

from __future__ import annotations

import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession

from atomloom.functions import elements
from atomloom.operators.potentials import read_potential
from atomloom.operators.tabulate import Grids, Tables, pair_splines, triplet_splines

log = logging.getLogger("atomloom")


def split(text: str, delimiter: str = ",") -> list[str]:
    return text.split(delimiter) if text else []


def read_json(path: str) -> dict:
    with open(path) as f:
        return json.load(f)


def check_writable(path: str) -> None:
    """Fail before the work, not after it."""
    with open(path, "a"):
        pass
    if os.path.getsize(path) == 0:
        os.remove(path)


def write_potential(potential, path: str) -> None:
    with open(path, "w") as f:
        json.dump(potential.to_json(), f, indent=4)


def load_potential(path: str):
    if path.endswith(".xml"):
        from .gap_xml import read_gap_xml

        return read_gap_xml(path)
    return read_potential(read_json(path))


def write_doubles(spark: SparkSession, values: list[float], path: str) -> None:
    spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, value double").write.mode("overwrite").parquet(path)


def read_doubles(spark: SparkSession, path: str) -> list[float]:
    return [r.value for r in spark.read.parquet(path).orderBy("i").collect()]


def write_tables(tables: Tables, grids: Grids, spec: dict, potential, folder: str) -> None:
    """Spline coefficients as Parquet: e0, pairs (only if there is no embedding), triplets, meta."""
    parts = [t for name in ("isolated", "pairs", "triplets", "embedding", "pair_densities") for t in getattr(tables, name)]
    if not parts:
        raise ValueError("there is nothing to write")
    spark = parts[0].sparkSession
    meta = {"comment1": json.dumps(potential.to_json()), "comment2": json.dumps(spec)}
    meta["grid_limits_2b"] = json.dumps([0.0, grids.r_max_2b])
    meta["n2b"] = str(grids.n2b)
    meta["grid_limits_3b"] = json.dumps([grids.r_min_3b, grids.r_min_3b, -1.0, grids.r_max_3b, grids.r_max_3b, 1.0])
    meta["n3b"] = json.dumps([grids.n3b_r, grids.n3b_r, grids.n3b_angle])
    parts = {"e0": tables.isolated_table()}
    if not tables.embedding and tables.pairs:
        parts["pairs"] = pair_splines(tables.pair_table())
    if tables.triplets:
        parts["triplets"] = triplet_splines(tables.triplet_table())
    n = {}
    for name, df in parts.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            n[name] = spark.read.parquet(f"{folder}/{name}").count()
    meta["npots"] = json.dumps([n.get("pairs", 0), n.get("triplets", 0)])
    spark.createDataFrame(sorted(meta.items()), "key string, value string").write.mode("overwrite").parquet(f"{folder}/meta")


def eam_fs_lines(tables: Tables, grids: Grids, index: int):
    """Lines of the eam/fs text format for one embedding table."""
    number = lambda x: f"{x:.17f}"
    keep = lambda parts: [r for p in parts for r in p.where(f"tab = {index}").collect()]
    embedding: dict[str, list[float]] = {}
    for r in sorted(keep(tables.embedding), key=lambda r: (r.species, r.i)):
        embedding.setdefault(r.species, []).append(r.energy)
    density: dict[tuple[str, str], list[float]] = {}
    for r in sorted(keep(tables.pair_densities), key=lambda r: (r.giver, r.receiver, r.i)):
        density.setdefault((r.giver, r.receiver), []).append(r.rho)
    species = sorted(embedding)
    yield from ("# UNITS: metal", "# Tabulated potential", "# pair_style eam/fs")
    yield f"{len(species)} {' '.join(species)}"
    dr = grids.r_max_2b / (grids.n2b - 1)
    yield f"{grids.n_densities} {number(tables.max_density[index] / (grids.n_densities - 1))} {grids.n2b} {number(dr)} {number(grids.r_max_2b)}"
    for a in species:
        yield f"{elements.NUMBER[a]} {elements.MASS[a]} 1.0 ZZZ"
        yield from map(number, embedding[a])
        for b in species:
            yield from map(number, density[a, b])
    pairs: dict[tuple[str, str], list[float]] = {}
    if index == 0 and tables.pairs:
        for r in tables.pair_table().orderBy("k1", "k2", "i").collect():
            pairs.setdefault((r.k1, r.k2), []).append(r.energy * r.r)
    # Only the first file carries the pair part, as all files are summed.
    for i, a in enumerate(species):
        for b in species[: i + 1]:
            yield from map(number, pairs.get((b, a), [0.0] * grids.n2b))


def write_eam_fs(tables: Tables, grids: Grids, prefix: str) -> list[str]:
    out = []
    for index in sorted(tables.max_density):
        path = prefix + (f"#{index}" if index else "") + ".eam.fs"
        with open(path, "w") as f:
            f.writelines(line + "\n" for line in eam_fs_lines(tables, grids, index))
        out.append(path)
    return out
