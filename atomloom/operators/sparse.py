"""Selection of sparse points: the first point in each occupied cell of a uniform grid."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.plans.registry import register


def grid_cells(points: DataFrame, coordinates: list[str], n_sparse: int, by: list[str], dimensions: list[int] | None = None) -> DataFrame:
    """Points with their cell number on each axis (b0, b1, ...), per category."""
    dims = dimensions or [math.ceil(round(n_sparse ** (1.0 / len(coordinates)), 9))] * len(coordinates)
    bounds = points.groupBy(*by).agg(*[f(c).alias(f"{n}_{k}") for k, c in enumerate(coordinates) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    # One row per category; without the hint all points would be shuffled to a task per category.
    joined = points.join(F.broadcast(bounds), by)
    cells = {}
    for k, c in enumerate(coordinates):
        lo = F.col(f"lo_{k}")
        step = (F.greatest(F.col(f"hi_{k}") + 1e-4, F.lit(0.0)) - lo) / dims[k]
        cells[f"b{k}"] = F.floor((F.col(c) - lo) / step)
    return joined.withColumns(cells)


def first_in_cells(points: DataFrame, coordinates: list[str], order: list[str], n_sparse: int, by: list[str], dimensions: list[int] | None = None) -> DataFrame:
    """One point per occupied cell and category: the first in ``order``.

    A group-by with a minimum, not a sort: partial aggregation keeps one row per
    cell in each task.
    """
    cells = grid_cells(points, coordinates, n_sparse, by, dimensions)
    names = [f"b{k}" for k in range(len(coordinates))]
    first = cells.groupBy(*by, *names).agg(F.min(F.struct(*order, *coordinates)).alias("first"))
    return first.select(*by, *names, *[F.col(f"first.{c}").alias(c) for c in (*order, *coordinates)])


def select(points: DataFrame, coordinates: list[str], order: list[str], n_sparse: int, by: list[str], dimensions: list[int] | None = None, seed: int = 799) -> dict[tuple, list[list[float]]]:
    """Sparse points of each category: occupied cells' points, filled up at random within occupied cells to n_sparse.

    More occupied cells than n_sparse are all returned.  The result is as large
    as a model, so it is collected; the filling draws from a seeded generator
    (the same points on every run, but no other program's stream).
    """
    cells = grid_cells(points, coordinates, n_sparse, by, dimensions)
    dims = dimensions or [math.ceil(round(n_sparse ** (1.0 / len(coordinates)), 9))] * len(coordinates)
    chosen = first_in_cells(points, coordinates, order, n_sparse, by, dimensions)
    bounds = {}
    edges = [F.max(F.struct(*[F.col(f"{n}_{k}") for k in range(len(coordinates)) for n in ("lo", "hi")])).alias("e")]
    for row in cells.groupBy(*by).agg(*edges).collect():
        bounds[tuple(row[b] for b in by)] = [(row.e[2 * k], max(row.e[2 * k + 1] + 1e-4, 0.0)) for k in range(len(coordinates))]
    out: dict[tuple, list[list[float]]] = {}
    occupied: dict[tuple, list[tuple]] = {}
    for row in chosen.orderBy(*by, *[f"b{k}" for k in range(len(coordinates))]).collect():
        key = tuple(row[b] for b in by)
        out.setdefault(key, []).append([row[c] for c in coordinates])
        occupied.setdefault(key, []).append(tuple(row[f"b{k}"] for k in range(len(coordinates))))
    rng = np.random.default_rng(seed)
    for key in sorted(out):
        while len(out[key]) < n_sparse:
            at = occupied[key][rng.integers(len(occupied[key]))]
            point = []
            for k, (lo, hi) in enumerate(bounds[key]):
                step = (hi - lo) / dims[k]
                point.append(float(lo + step * (at[k] + rng.random())))
            out[key].append(point)
    return out


@register("sparsifier", "sample_space_uniform")
def _uniform(spec: dict):
    """A sparsifier takes points, their coordinates, their order and the columns of their category, and gives points by category."""
    return lambda points, coordinates, order, by: select(points, coordinates, order, int(spec["n_sparse"]), by, spec.get("grid_dimensions"), int(spec.get("seed", 799)))
