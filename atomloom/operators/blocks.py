"""Dense blocks of a fit's matrix, made and reduced where the structures are.

The JVM side gives index rows: a row per pair, triplet, density or density
edge, and one per observation, none per sparse point.  They meet by structure,
in one shuffle; each task then evaluates the kernel between its rows and all
sparse points of their category in numpy, adds them up to the observations'
rows, weights these, and reduces blocks of whole structures to a triangular
factor (tall-skinny QR).  The tasks' factors are reduced further in a tree on the
executors, so the driver gets a set number of factors, however many tasks there
were.

A task holds the observations of one structure at least: (3 n + 7) rows of m + 1
numbers.  Index rows are expanded by sparse points in portions of PORTION
numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a dense block before it is reduced.
BLOCK_ROWS = 8192
#: Kernel values that are held at a time.
PORTION = 1 << 21
#: Index rows that are solved at a time, in whole structures.
ROWS_AT_ONCE = 1 << 18
#: Factors that are left at each step of the tree; the last number goes to the driver.
TREE = (64, 8)
OBSERVED = -1


def index_rows(observed: DataFrame, atoms: DataFrame, neighbours: DataFrame, descriptors: dict) -> DataFrame:
    """Observations (part OBSERVED; a0 the number, v value and inverse sigma) and the descriptors' rows, in one table."""
    zero = F.lit(0).cast("bigint")
    out = observed.select(
        "structure_id", F.lit(OBSERVED).alias("part"), F.lit(0).alias("cat"), F.col("obs").alias("a0"), zero.alias("a1"), zero.alias("a2"), F.array("value", "sigma_inv").alias("v")
    )
    part = 0
    for _, d in sorted(descriptors.items()):
        for rows in d.index_rows(atoms, neighbours):
            known = rows.withColumn("cat", d.category_number())
            out = out.unionByName(known.where("cat is not null").select("structure_id", F.lit(part).alias("part"), "cat", "a0", "a1", "a2", "v"))
            part += 1
    return out


def add_at(dense: np.ndarray, row: np.ndarray, first: int, values: np.ndarray) -> None:
    """dense[row, first:] += values, where rows may repeat; negative rows are left out."""
    ok = np.flatnonzero(row >= 0)
    if not len(ok):
        return
    order = ok[np.argsort(row[ok], kind="stable")]
    r = row[order]
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    dense[r[at], first : first + values.shape[1]] += np.add.reduceat(values[order], at, axis=0)


def reduced(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


class _Block:
    """Whole structures of a task: index rows in, weighted rows [A | b] out."""

    def __init__(self, table: pa.Table, parts: list, m: int):
        col = {n: table[n].combine_chunks() for n in table.schema.names}
        structure, part = col["structure_id"].to_numpy(), col["part"].to_numpy()
        a0 = col["a0"].to_numpy()
        lists = col["v"]
        flat, cuts = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        cuts = cuts - cuts[0]
        seen = np.flatnonzero(part == OBSERVED)
        # Observations are numbered by structure, then by their own number.
        order = seen[np.lexsort((a0[seen], structure[seen]))]
        self.key = structure[order], a0[order]
        self.names, rank = np.unique(structure, return_inverse=True)
        self.width = int(a0[order].max(initial=0)) + 1
        self.flat_key = rank[order] * self.width + self.key[1]
        value = flat[cuts[order]]
        sigma = flat[cuts[order] + 1]
        self.dense = np.zeros((len(order), m + 1))
        for k, (solve, categories) in enumerate(parts):
            mine = np.flatnonzero(part == k)
            cat = col["cat"].to_numpy()[mine]
            for c, (first, points, weights) in enumerate(categories):
                rows = mine[cat == c]
                if not len(rows):
                    continue
                step = max(1, PORTION // len(points))
                for s in range(0, len(rows), step):
                    r = rows[s : s + step]
                    v = flat[cuts[r][:, None] + np.arange(cuts[r[0] + 1] - cuts[r[0]])]
                    ints = [a0[r], col["a1"].to_numpy()[r], col["a2"].to_numpy()[r]]
                    for obs, values in solve(v, ints, points, weights):
                        add_at(self.dense, self.place(rank[r], obs), first, values)
        self.dense *= sigma[:, None]
        self.dense[:, m] = value * sigma

    def place(self, rank: np.ndarray, obs: np.ndarray | int) -> np.ndarray:
        """Row of an observation, -1 if there is none."""
        obs = np.broadcast_to(obs, rank.shape)
        key = rank * self.width + obs
        at = np.searchsorted(self.flat_key, key)
        at[at == len(self.flat_key)] = 0
        there = (obs < self.width) & (self.flat_key[at] == key) if len(self.flat_key) else np.zeros(len(key), bool)
        return np.where(there, at, -1)


def _rows(r: np.ndarray, key: int) -> pa.RecordBatch:
    data = [x.tobytes() for x in np.ascontiguousarray(r)]
    return pa.RecordBatch.from_arrays([pa.array([key] * len(data), pa.int32()), pa.array(data, pa.binary())], ["key", "row"])


def triangular_factor(observed: DataFrame, atoms: DataFrame, neighbours: DataFrame, descriptors: dict) -> tuple[np.ndarray, int]:
    """The R factor of [A | b] of all observations, and the number of columns of A."""
    m, parts = 0, []
    for _, d in sorted(descriptors.items()):
        parts += d.block_parts(m)
        m += d.n_sparse()
    n = m + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, held, size = np.zeros((0, n)), [], 0

        def solve(table: pa.Table) -> None:
            nonlocal r
            dense = _Block(table, parts, m).dense
            for k in range(0, len(dense), BLOCK_ROWS):
                r = reduced([r, dense[k : k + BLOCK_ROWS]])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            # The last structure may go on in the next batch.
            ids = table["structure_id"].to_numpy()
            upto = int(np.searchsorted(ids, ids[-1]))
            if upto:
                solve(table.slice(0, upto))
                table = table.slice(upto)
            held, size = table.to_batches(), table.num_rows
        if size:
            solve(pa.Table.from_batches(held))
        if len(r):
            from pyspark import TaskContext

            yield _rows(r, TaskContext.get().partitionId() % TREE[0])

    # A window is sure to get a structure's rows together and in order. A repartition isn't: above
    # a union of tables that are by structure already, AQE leaves it out, and coalesces each table's shuffle by itself.
    at = F.row_number().over(Window.partitionBy("structure_id").orderBy("part"))
    factors = index_rows(observed, atoms, neighbours, descriptors).withColumn("at", at).mapInArrow(run, "key int, row binary")
    for keys in TREE[1:]:
        factors = _step(factors, n, keys)
    rows = [np.frombuffer(x.row, float) for x in factors.collect()]
    return reduced([np.zeros((0, n)), np.array(rows).reshape(-1, n)]) if rows else np.zeros((0, n)), m


def _step(factors: DataFrame, n: int, keys: int) -> DataFrame:
    """Factors of one key reduced to one, which goes on under one of ``keys`` keys."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = reduced([np.frombuffer(b"".join(pdf.row), float).reshape(-1, n)])
        return pd.DataFrame({"key": np.full(len(r), pdf.key.iloc[0] % keys, np.int32), "row": [x.tobytes() for x in np.ascontiguousarray(r)]})

    return factors.groupBy("key").applyInPandas(run, "key int, row binary")


# The kernel's parts, in numpy


def kernel(x: np.ndarray, points: np.ndarray, weights: np.ndarray, length: float, energy: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weighted kernel values (rows, points) and their derivatives by each coordinate of x."""
    away = [points[None, :, k] - x[:, k, None] for k in range(x.shape[1])]
    k0 = weights * (energy**2 * np.exp(-sum(a * a for a in away) / (2 * length**2)))
    return k0, [k0 * a / length**2 for a in away]


def force_and_virial(atom: np.ndarray, g: np.ndarray, r: np.ndarray, virial: bool = True):
    """g (rows, points) along r (rows, 3) on the atoms, and minus g r r in the virial."""
    for c in range(3):
        yield atom * 3 + 7 + c, g * r[:, c, None]
    if virial:
        for n, (a, b) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))):
            yield n + 1, -g * (r[:, a] * r[:, b])[:, None]
