"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search.

A test item leaks into a document if the document holds at least THRESHOLD of
the item's distinct SHINGLE-word shingles.  Documents are cut into partitions
by their number of distinct shingles, as a containment over sets of very
different sizes is a Jaccard similarity that falls with the larger size.  A
partition of documents of up to u shingles uses a one-permutation MinHash of
u bins: the shingle hashes fall into bins and each bin keeps its least hash.
An item is sketched with each partition's bins too, and is a candidate for a
document if they agree in any bin.  With u bins a document has at most one
shingle a bin on average, so a shingle that both hold is its document's bin
minimum with a probability of at least (1 - 1/e) = 0.63; a leak of 8 shingles is
missed with a probability of 0.37**8 = 0.0004, a larger one with less.  (Fewer
bins would miss more: at Jaccard similarities of 0.001 and less, which
containment in long documents means, short signatures find nothing.)  Items that
leak with fewer than EXACT_BELOW shingles aren't sketched: all the document's
shingles are probed for theirs, so none is missed.  Each candidate is verified
by exact containment of its shingles.

The items' sketches are broadcast in blocks of at most ITEM_BLOCK items, each
block one pass over the documents; documents are never moved.

Defined cases: null texts and texts without a word hold nothing and leak
nothing; an item or a document of 1 to SHINGLE - 1 words has one shingle, of all
its words, so such an item leaks only into a document that is equal to it; items
of equal text are separate items; null ids are carried as nulls; repeated
document rows each give their pairs; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import read, require

SHINGLE = 5
THRESHOLD = 0.5
#: Items whose sketches are broadcast at a time (about 1 kB each).
ITEM_BLOCK = 20_000
#: Items for which fewer shared shingles are a leak are searched by all their shingles.
EXACT_BELOW = 8
#: Document size partitions: up to 2**i distinct shingles.
MAX_EXPONENT = 40


class Items:
    """A block of test items: their distinct shingles and, by partition, their sketches."""

    def __init__(self, ids: list, texts: pa.Array, k: int):
        words, _, _, cuts, _ = tk.word_hashes(texts)
        sh, sc = tk.shingle_hashes(words, cuts, k)
        item = np.repeat(np.arange(len(ids)), np.diff(sc))
        key = np.lexsort((sh, item))
        sh, item = sh[key], item[key]
        new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (item[1:] != item[:-1])]) if len(sh) else np.zeros(0, bool)
        self.ids = ids
        self.shingle, self.item = sh[new], item[new]
        self.size = np.bincount(self.item, minlength=len(ids))
        self._sketch: dict[int, tuple] = {}
        self._few: dict[float, tuple] = {}
        order = np.argsort(self.shingle, kind="stable")
        self.by_shingle, self.by_item = self.shingle[order], self.item[order]

    def __getstate__(self):
        return self.__dict__ | {"_sketch": {}, "_few": {}}

    def few(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, item), sorted by shingle, of the items that leak with fewer than EXACT_BELOW shingles."""
        if threshold not in self._few:
            mine = np.ceil(threshold * self.size)[self.by_item] < EXACT_BELOW
            self._few[threshold] = self.by_shingle[mine], self.by_item[mine]
        return self._few[threshold]

    def sketch(self, exponent: int) -> tuple[np.ndarray, np.ndarray]:
        """(minimum hash, item), sorted by hash: each item's bin minima under 2**exponent bins."""
        if exponent not in self._sketch:
            value, group = bin_minima(self.shingle, self.item, exponent)
            order = np.argsort(value, kind="stable")
            self._sketch[exponent] = value[order], group[order]
        return self._sketch[exponent]


def bin_minima(sh: np.ndarray, group: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, group) of the least hash in each bin of each group.

    The bin is a hash's top bits, so that equal minima are in equal bins; the
    order within a bin is that of the remaining bits.  Input is sorted by
    group, then hash.
    """
    if not len(sh):
        return sh, group
    b = sh >> tk.U64(64 - exponent) if exponent else np.zeros(len(sh), tk.U64)
    first = np.concatenate([[True], (b[1:] != b[:-1]) | (group[1:] != group[:-1])])
    return sh[first], group[first]


def _matches(sorted_keys: np.ndarray, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probe index, key index) of all equal pairs."""
    if not len(sorted_keys) or not len(probes):
        z = np.zeros(0, np.int64)
        return z, z
    # A small table rules out most probes at once.
    bits = 20
    seen = np.zeros(1 << bits, bool)
    seen[(sorted_keys & tk.U64((1 << bits) - 1)).astype(np.int64)] = True
    may = np.flatnonzero(seen[(probes & tk.U64((1 << bits) - 1)).astype(np.int64)])
    lo = np.searchsorted(sorted_keys, probes[may], "left")
    many = np.searchsorted(sorted_keys, probes[may], "right") - lo
    last = np.cumsum(many)
    at = np.arange(last[-1] if len(last) else 0) + np.repeat(lo - (last - many), many)
    return np.repeat(may, many), at


def search(column: pa.Array, items: Items, k: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item index, shared shingles) of all leaks."""
    rows, found, shared = [], [], []
    _, offsets = tk.flat_text(column)
    for i, j in tk.chunks(offsets):
        words, _, _, cuts, _ = tk.word_hashes(column.slice(i, j - i))
        sh, sc = tk.shingle_hashes(words, cuts, k)
        if not len(sh):
            continue
        doc = np.repeat(np.arange(j - i), np.diff(sc))
        bits = max(1, int(j - i - 1).bit_length())
        # Sorted by document, then hash. The document takes the low bits' place for the sort alone.
        order = np.argsort((doc.astype(tk.U64) << tk.U64(64 - bits)) | (sh >> tk.U64(bits)))
        sh, doc = sh[order], doc[order]
        new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])])
        sh, doc = sh[new], doc[new]
        n = np.bincount(doc, minlength=j - i)
        exponent = np.ceil(np.log2(np.maximum(n, 1))).astype(int)
        cand = []
        for e in np.unique(exponent[n > 0]):
            mine = exponent[doc] == e
            value, group = bin_minima(sh[mine], doc[mine], int(e))
            keys, owner = items.sketch(int(e))
            p, q = _matches(keys, value)
            cand.append(group[p] * len(items.ids) + owner[q])
        keys, owner = items.few(threshold)
        p, q = _matches(keys, sh)
        cand.append(doc[p] * len(items.ids) + owner[q])
        cand = np.unique(np.concatenate(cand)) if cand else np.zeros(0, np.int64)
        if not len(cand):
            continue
        # Exact containment of the candidates.
        of = np.zeros(j - i, bool)
        of[cand // len(items.ids)] = True
        sub = of[doc]
        p, q = _matches(items.by_shingle, sh[sub])
        pair, count = np.unique(doc[sub][p] * len(items.ids) + items.by_item[q], return_counts=True)
        ok = np.isin(pair, cand) & (count >= threshold * items.size[pair % len(items.ids)])
        rows.append(i + pair[ok] // len(items.ids))
        found.append(pair[ok] % len(items.ids))
        shared.append(count[ok])
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z
    return tuple(map(np.concatenate, (rows, found, shared)))


def _blocks(spark: SparkSession, bench: DataFrame, k: int):
    """Broadcast blocks of at most ITEM_BLOCK items, one after another."""
    import math

    items = bench.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    n = max(1, math.ceil(items.count() / ITEM_BLOCK))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        t = part.toArrow()
        texts = t["text"].combine_chunks() if t.num_rows else pa.array([], pa.string())
        yield spark.sparkContext.broadcast(Items(t["item_id"].to_pylist(), texts, k))


def leaks(docs: DataFrame, bench: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) of all leaks."""
    require(docs, "doc_id", "text")
    require(bench, "item_id", "text")
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = None
    for block in _blocks(docs.sparkSession, bench, k):
        found = narrow.mapInArrow(_leak_rows(block, k, threshold), "doc_id long, item_id long, n_shared long, n_shingles long")
        out = found if out is None else out.unionByName(found)
    return out


def _leak_rows(block, k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for b in batches:
            row, item, shared = search(b.column(1), items, k, threshold)
            ids = pa.array([items.ids[x] for x in item], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), ids, pa.array(shared.astype(np.int64)), pa.array(items.size[item].astype(np.int64))],
                ["doc_id", "item_id", "n_shared", "n_shingles"],
            )
        tk.release()

    return run


def _clean_rows(block, at: int, k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[search(b.column(at), items, k, threshold)[0]] = False
            yield b.filter(pa.array(keep))
        tk.release()

    return run


def drop_leaks(docs: DataFrame, bench: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, into which no test item leaks."""
    require(docs, "text")
    require(bench, "item_id", "text")
    for block in _blocks(docs.sparkSession, bench, k):
        docs = docs.mapInArrow(_clean_rows(block, docs.columns.index("text"), k, threshold), docs.schema)
    return docs


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _shingled(table: str, key: str) -> str:
    return f"""
  SELECT r, {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE [list_aggregate(w[i:i + {SHINGLE} - 1], 'string_agg', ' ') FOR i IN range(1, len(w) - {SHINGLE} + 2)] END) AS s
  FROM (SELECT row_number() OVER () AS r, {key}, {tk.WORDS_SQL} AS w FROM {table})"""


OP7_SQL = f"""
WITH d AS (SELECT DISTINCT r, doc_id, s FROM ({_shingled('documents', 'doc_id')})),
b AS (SELECT DISTINCT r, item_id, s FROM ({_shingled('benchmark', 'item_id')})),
n AS (SELECT r, count(*) AS n_shingles FROM b GROUP BY r)
SELECT any_value(d.doc_id) AS doc_id, any_value(b.item_id) AS item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM d JOIN b ON d.s = b.s JOIN n ON n.r = b.r
GROUP BY d.r, b.r HAVING count(*) >= {THRESHOLD} * any_value(n_shingles)
"""
