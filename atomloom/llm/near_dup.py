"""Operator 2: SimHash near-duplicates, searched with BK-trees.

A document's fingerprint has 128 bits: each bit is the majority, over the
document's distinct words, of that bit of the words' hashes.  Two documents
are near duplicates if their fingerprints differ in at most RADIUS bits;
groups are the connected components of that relation.

Search.  The fingerprint is cut into eight 16-bit blocks.  If two fingerprints
differ in at most 18 bits, then in one of the first three blocks they differ in
at most 2 bits, or in one of the others in at most 1 (otherwise there were
3*3 + 5*2 = 19 differing bits).  So each block has a BK-tree over the block's
values that occur, children keyed by integer Hamming distance to the parent;
a query follows only the edges within the block's radius, and full fingerprints
of the values found are compared.  The search is exact: it finds the pairs that
comparing all pairs finds.

Scale.  A block tree has 65,536 nodes at most, whatever the corpus.  The
fingerprints that a tree's nodes lead to are broadcast in shards of about
SHARD_ROWS (24 MB each), one after another; every shard is searched by all
fingerprints, and what crowded block values pair is compared in portions of
PAIRS_AT_ONCE, so memory doesn't grow with them.  Equal
fingerprints collapse before the search and each task passes on only a
spanning forest of the pairs it found, so a group of a million copies costs a
million rows, not their square.  Components come from alternating large-star
and small-star joins.

Defined cases: documents that own no word (null, empty, or only punctuation)
and documents of null doc_id are never duplicates: each is a group of its own
and is kept.  Rows that share a doc_id count as one document: their group is
one, and one row stays.  The document kept of each group is that of least
doc_id.  An empty table gives an empty result.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernels as tk
from .common import cut, discard, read, require, shielded, sized, unshielded

RADIUS = 18
BLOCKS = 8
#: Rows of a broadcast shard of fingerprints.
SHARD_ROWS = 1 << 20
#: Fingerprint pairs that are compared at a time.
PAIRS_AT_ONCE = 1 << 20
#: A block's values are searched in ranges of this many, one task each.
VALUE_RANGE = 1 << 13

_LANES = np.zeros(256, tk.U64)
for _k in range(8):
    _LANES += ((np.arange(256) >> _k) & 1).astype(tk.U64) << tk.U64(8 * _k)


def block_radii(radius: int = RADIUS) -> list[int]:
    """Radius of each block; the sum of radius + 1 is radius + 1 of the whole."""
    base, more = divmod(radius + 1, BLOCKS)
    return [base - 1 + (j < more) for j in range(BLOCKS)]


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) fingerprints, and which texts own a word."""
    n = len(column)
    out, has = np.zeros((n, 2), tk.U64), np.zeros(n, bool)
    _, offsets = tk.flat_text(column)
    for i, j in tk.chunks(offsets):
        words, _, _, cuts, _ = tk.word_hashes(column.slice(i, j - i))
        doc = np.repeat(np.arange(j - i), np.diff(cuts))
        # Distinct words by document. Numbers of words serve for the sort alone: the bits are those of the whole
        # hash, so a text has one fingerprint whatever texts share its chunk.
        word, number = np.unique(words, return_inverse=True)
        key = np.sort(doc * len(word) + number)
        if not len(key):
            continue
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        doc, number = np.divmod(key, len(word))
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        size = np.diff(np.concatenate([first, [len(doc)]]))
        # Segments of at most 255 words, so that counts fit the 8-bit lanes.
        pieces = -(-size // 255)
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        seg = np.repeat(first, pieces) + within * 255
        to_doc = np.cumsum(pieces) - pieces
        rows = i + doc[first]
        has[rows] = True
        for half, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
            h = tk.mix(word + tk.U64(salt))[number].view(np.uint8).reshape(-1, 8)
            value = np.zeros(len(first), tk.U64)
            for byte in range(8):
                lanes = np.add.reduceat(_LANES[h[:, byte]], seg).view(np.uint8).reshape(-1, 8)
                counts = np.add.reduceat(lanes.astype(np.int64), to_doc, axis=0)
                for k in range(8):
                    value |= (counts[:, k] * 2 > size).astype(tk.U64) << tk.U64(8 * byte + k)
            out[rows, half] = value
    return out, has


def block_values(fp: np.ndarray) -> np.ndarray:
    """(n, 8) 16-bit blocks."""
    return np.ascontiguousarray(fp).view(np.uint16).reshape(-1, BLOCKS)


class BKTree:
    """BK-tree of distinct integers under Hamming distance, in flat arrays."""

    def __init__(self, values: np.ndarray, bits: int = 16):
        self.bits = bits
        self.node = np.asarray(values)
        n = len(self.node)
        self.edge = np.zeros((n, bits + 2), np.int32)  # where children of a distance begin in self.child
        child_parent, child_dist, child_node = [], [], []
        rest, parent = np.arange(1, n), np.zeros(max(n - 1, 0), np.int64)
        while len(rest):
            d = np.bitwise_count(self.node[rest] ^ self.node[parent]).astype(np.int64)
            order = np.lexsort((rest, d, parent))
            rest, parent, d = rest[order], parent[order], d[order]
            new = np.concatenate([[True], (parent[1:] != parent[:-1]) | (d[1:] != d[:-1])])
            child_parent.append(parent[new])
            child_dist.append(d[new])
            child_node.append(rest[new])
            head = rest[new][np.cumsum(new) - 1]
            rest, parent = rest[~new], head[~new]
        if child_node:
            p, d, c = map(np.concatenate, (child_parent, child_dist, child_node))
            order = np.lexsort((d, p))
            self.child = c[order].astype(np.int32)
            key = p[order] * (bits + 2) + d[order]
            grid = np.arange(n * (bits + 2))
            self.edge = np.searchsorted(key, grid).astype(np.int32).reshape(n, bits + 2)
        else:
            self.child = np.zeros(0, np.int32)

    def within(self, queries: np.ndarray, radius: int, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Indices (query, node) of all pairs at most ``radius`` apart."""
        hits = []
        for start in range(0, len(queries), batch):
            part = queries[start : start + batch]
            q = np.arange(len(part), dtype=np.int32)
            at = np.zeros(len(part), np.int32)
            while len(q) and len(self.node):
                d = np.bitwise_count(part[q] ^ self.node[at]).astype(np.int32)
                near = d <= radius
                hits.append(np.stack([q[near] + start, at[near]]))
                lo = self.edge[at, np.maximum(d - radius, 0)]
                many = self.edge[at, np.minimum(d + radius, self.bits) + 1] - lo
                go = many > 0
                q, lo, many = q[go], lo[go], many[go]
                last = np.cumsum(many, dtype=np.int64)
                total = int(last[-1]) if len(last) else 0
                at = self.child[np.arange(total) + np.repeat(lo - (last - many), many)]
                q = np.repeat(q, many)
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = np.concatenate(hits, axis=1)
        return found[0].astype(np.int64), found[1].astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest that connects what the edges connect: (node, least node of its component)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


class Shard:
    """A broadcast shard of fingerprints; trees and postings are made in each worker once."""

    def __init__(self, fp: np.ndarray, rep: np.ndarray):
        self.fp, self.rep = fp, rep
        self._block: dict[int, tuple] = {}

    def __getstate__(self):
        return self.fp, self.rep

    def __setstate__(self, state):
        self.fp, self.rep = state
        self._block = {}

    def block(self, j: int):
        if j not in self._block:
            v = block_values(self.fp)[:, j]
            order = np.argsort(v, kind="stable")
            values, first = np.unique(v[order], return_index=True)
            # A seeded order keeps the tree shallow.
            shuffled = np.random.default_rng(j).permutation(len(values))
            size = np.diff(np.concatenate([first, [len(v)]]))
            self._block[j] = BKTree(values[shuffled]), order, first[shuffled], size[shuffled]
        return self._block[j]

    def pairs(self, j: int, radius: int, fp: np.ndarray, rep: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray]:
        """(rep, rep) of fingerprints at most ``whole`` apart, by block j."""
        tree, order, first, size = self.block(j)
        v = block_values(fp)[:, j]
        by = np.argsort(v, kind="stable")
        values, start = np.unique(v[by], return_index=True)
        count = np.diff(np.concatenate([start, [len(v)]]))
        out = [np.zeros((2, 0), np.int64)]
        for lo in range(0, len(values), 512):
            vq, node = tree.within(values[lo : lo + 512], radius)
            vq = vq + lo
            # A value pair stands for count[vq] * size[node] fingerprint pairs; crowded ones are cut, by the queries' rows.
            for begin, rows, post, many in _portions(start[vq], count[vq], first[node], size[node]):
                other = order[_spans(post, many)]
                per = np.repeat(rows, many)
                mine = by[_spans(np.repeat(begin, many), per)]
                other = np.repeat(other, per)
                keep = rep[mine] < self.rep[other]
                mine, other = mine[keep], other[keep]
                d = np.bitwise_count(fp[mine, 0] ^ self.fp[other, 0]).astype(np.int16)
                d += np.bitwise_count(fp[mine, 1] ^ self.fp[other, 1])
                near = d <= whole
                if near.any():
                    out.append(np.stack(forest(rep[mine[near]], self.rep[other[near]])))
        return tuple(np.concatenate(out, axis=1))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. start + size, one after another."""
    last = np.cumsum(size)
    return np.arange(last[-1] if len(last) else 0) + np.repeat(start - (last - size), size)


def _portions(begin: np.ndarray, rows: np.ndarray, post: np.ndarray, many: np.ndarray, limit: int = PAIRS_AT_ONCE):
    """The products rows x many of value pairs, in portions of about ``limit`` fingerprint pairs."""
    wide = rows * many > limit
    if wide.any():
        step = np.maximum(1, limit // many[wide])
        pieces = -(-rows[wide] // step)
        of = np.repeat(np.flatnonzero(wide), pieces)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * np.repeat(step, pieces)
        cut_rows = np.minimum(np.repeat(step, pieces), rows[of] - at)
        begin, rows = np.concatenate([begin[~wide], begin[of] + at]), np.concatenate([rows[~wide], cut_rows])
        post, many = np.concatenate([post[~wide], post[of]]), np.concatenate([many[~wide], many[of]])
    portion = np.cumsum(rows * many) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(portion)) + 1, [len(rows)]]).astype(int)
    for a, b in zip(cuts[:-1], cuts[1:]):
        if a < b:
            yield begin[a:b], rows[a:b], post[a:b], many[a:b]


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, f0, f1) of the documents that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, has = fingerprints(b.column(1))
            ids = b.column(0)
            yield pa.RecordBatch.from_arrays(
                [ids.filter(pa.array(has)), pa.array(fp[has, 0].view(np.int64)), pa.array(fp[has, 1].view(np.int64))], ["doc_id", "f0", "f1"]
            )
        tk.release()

    return docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, f0 long, f1 long")


def _searcher(shard, radii: list[int], radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        j = int(pdf.j.iloc[0])
        fp = np.stack([pdf.f0.to_numpy(), pdf.f1.to_numpy()], 1).view(tk.U64)
        a, b = shard.value.pairs(j, radii[j], fp, pdf.rep.to_numpy(), radius)
        if len(a):
            a, b = forest(a, b)
        tk.release()
        return pd.DataFrame({"a": a, "b": b})

    return run


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the near fingerprints; ``prints`` has distinct (f0, f1) and their rep."""
    spark = prints.sparkSession
    radii = block_radii(radius)
    n = prints.count()
    n_shards = max(1, -(-n // SHARD_ROWS))
    prints = cut(prints.withColumn("shard", F.pmod(F.xxhash64("f0", "f1"), F.lit(n_shards))), "prints")
    blocks = [F.shiftright(f, 16 * k).bitwiseAND(0xFFFF) for f in (F.col("f0"), F.col("f1")) for k in range(4)]
    spread = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), (v / VALUE_RANGE).cast("int").alias("r")) for j, v in enumerate(blocks)])).alias("x")
    # Whole tasks by (block, value range), and by shares of a range where it is crowded.
    share = max(1, n // (1 << 18))
    probes = prints.select("f0", "f1", "rep", spread).select("f0", "f1", "rep", "x.j", "x.r", F.pmod(F.col("f0"), F.lit(share)).alias("s"))
    # A set number of tasks: the search is long for its few bytes, so tasks must not be merged by size.
    tasks = BLOCKS * (65536 // VALUE_RANGE) * share
    edges = []
    for s in range(n_shards):
        t = prints.where(F.col("shard") == s).select("f0", "f1", "rep").toArrow()
        shard = spark.sparkContext.broadcast(
            Shard(np.stack([t["f0"].to_numpy(), t["f1"].to_numpy()], 1).view(tk.U64) if len(t) else np.zeros((0, 2), tk.U64), t["rep"].to_numpy())
        )
        found = probes.repartition(tasks, "j", "r", "s").groupBy("j", "r", "s").applyInPandas(_searcher(shard, radii, radius), "a long, b long")
        # A shard's search ends before the next shard is made, so the driver and the executors hold one.
        edges.append(cut(found, "edges"))
        shard.unpersist()
    discard(prints)
    return _union(edges)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component, by alternating large and small stars."""
    e = cut(edges.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct(), "stars")
    while True:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "stars")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = cut(small, "stars")
        # Done when no edge changed: all are stars with the least node as centre.
        changed = new.select("a", "b").exceptAll(e.select("a", "b")).limit(1).count() + e.select("a", "b").exceptAll(new.select("a", "b")).limit(1).count()
        discard(e, large)
        e = new
        if not changed:
            return e.select(F.col("a").alias("node"), F.col("b").alias("label"))


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id) of every non-null doc_id that owns a word; group_id is the group's least doc_id."""
    require(docs, "doc_id", "text")
    prints = cut(with_fingerprints(docs))
    distinct = cut(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep")))
    # Rows that share a doc_id but not a text connect their fingerprints.
    reps = prints.join(distinct, ["f0", "f1"]).select("doc_id", "rep")
    reps = cut(reps.groupBy("doc_id").agg(F.min("rep").alias("rep")))
    # Fingerprints are told apart by (rep); two of them may share one only if one doc_id has both.
    label = components(near_pairs(distinct, radius).unionByName(_shared_ids(prints, distinct)))
    out = reps.join(label, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.coalesce("label", "rep").alias("group_id"))


def _shared_ids(prints: DataFrame, distinct: DataFrame) -> DataFrame:
    rep = prints.join(distinct, ["f0", "f1"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    return rep.where("a <> b").select("a", "b")


def mark(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of every document row's id; a document outside any group has its own id and size 1."""
    g = cut(groups(docs, radius))
    size = g.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    known = g.join(size, "group_id")
    once = ids.where("doc_id is not null").distinct().join(known, "doc_id", "left")
    null = ids.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("group_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("keep"))
    filled = once.select("doc_id", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"))
    return filled.withColumn("keep", F.col("group_id") == F.col("doc_id")).unionByName(null)


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents that stay: one of each group, with the columns of ``docs``."""
    gone = cut(groups(docs, radius).where("doc_id <> group_id").select(F.col("doc_id").alias("gone")))
    repeated = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("again")))
    plain, back = shielded(docs, "doc_id", "text")
    kept = plain.join(sized(gone, gone.count(), 16), F.col("doc_id") == F.col("gone"), "left_anti")
    n = repeated.count()
    if not n:
        return unshielded(kept, back)
    # Only the rows that share a doc_id are moved.
    again = sized(repeated, n, 16)
    single = kept.join(again, F.col("doc_id") == F.col("again"), "left_anti")
    rows = kept.join(again, F.col("doc_id") == F.col("again"), "left_semi")
    w = Window.partitionBy("doc_id").orderBy(F.length("text").desc_nulls_last(), "text")
    one = rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    return unshielded(single.unionByName(one), back)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(read(spark, sf_dir, "documents"))
