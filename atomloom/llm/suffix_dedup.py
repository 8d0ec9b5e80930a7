"""Operator 8: repeated passages by suffix arrays.

A *window* is WINDOW consecutive words of a document.  A window is a repeat if
an equal one occurs earlier, in the order of (doc_id, word position); the
result is, for each document, its maximal runs of repeated windows as spans of
words, with the document in which the span's first window occurs first of all.
So every passage of at least WINDOW words that occurs twice is found, and its
first occurrence is left alone.  ``drop_repeats`` cuts the spans out.

1. Anchors.  Of each span of SPREAD + 1 consecutive ANCHOR-word shingles the
   one of least hash is an anchor (winnowing); each window has its own anchor
   this way, and equal windows have equal anchors.  Only windows whose anchor
   occurs twice can be repeats; documents keep the positions of those anchors,
   and all other text is left out from here on.
2. Shards.  The remaining stretches of the documents of a partition make shards
   of about SHARD_WORDS words.  Each shard's suffix array is sorted by
   Larsson-Sadakane refinement (groups that share a prefix are split by the
   ranks of what follows, the prefix doubles, finished groups are left alone),
   common prefixes are found after Kasai (a common prefix that only loses its
   first word isn't computed again).  Suffixes next to each other that share at
   least WINDOW words are one class of equal windows; all but the first are
   repeats.
3. Merging across shards.  The classes' first windows go, sorted by their
   fingerprint, to the merge task of their anchor, where shards' sorted runs
   are merged pair by pair by binary search; a class's least (doc_id, position)
   stays, the others are repeats.  As neighbouring windows share anchors, they
   arrive together and leave as runs.  A shard's own spans go along, one row
   each, to learn where their first window occurs first; so the result doesn't
   depend on which documents share a shard.

What is shuffled: the anchors' hashes to be counted (with map-side sums, so an
anchor of a million pages isn't one task's work), and 32 bytes a window of text
that is repeated.  The repeated hashes and the anchors' positions are broadcast
if their counted size allows, else joined by shuffles, in which case the texts
move too.

Words compare by 64-bit hashes, windows by 64-bit hashes of these.

Defined cases: a text of fewer than WINDOW words (null and empty ones too) has
no window; rows of null doc_id are left out, as they can't be named
(``drop_repeats`` keeps them as they are); rows that share a doc_id are compared
like documents of their own, in the order of their text hash, identical ones too
(all but one are repeats); a passage repeated within one document counts;
passages never span two documents; bytes that aren't UTF-8 read as U+FFFD; an
empty table gives an empty result; other columns aren't read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import cut, discard, read, require, shielded, sized, unshielded

WINDOW = 50
ANCHOR = 24
SPREAD = WINDOW - ANCHOR
SHARD_WORDS = 1 << 20
SPAN_SCHEMA = "doc_id long, copy long, start_word long, end_word long, first_doc_id long"


# One shard


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of whole numbers, by Larsson-Sadakane refinement.

    With a depth, suffixes that agree in so many numbers may stay in the order
    of their positions.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    sa = np.argsort(text, kind="stable")
    head = np.concatenate([[True], text[sa[1:]] != text[sa[:-1]]])
    # A suffix's rank is the first place of its group.
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[sa] = place
    rank[n] = -1
    single = head & np.concatenate([head[1:], [True]])
    todo = np.flatnonzero(~single)  # places in groups that aren't finished
    h = 1
    while len(todo) and (depth is None or h < depth):
        s = sa[todo]
        group, follow = rank[s], rank[np.minimum(s + h, n)]
        order = np.argsort(group * (n + 1) + follow + 1, kind="stable")
        s, group, follow = s[order], group[order], follow[order]
        sa[todo] = s
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        rank[s] = np.maximum.accumulate(np.where(head, todo, 0))
        todo = todo[~(head & np.concatenate([head[1:], [True]]))]
        h *= 2
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: numbers that the suffixes sa[i - 1] and sa[i] share; lcp[0] is 0.

    Kasai's order of work, in bulk: a suffix whose predecessor in the array
    follows the predecessor of the suffix before it has one number less in
    common; only the other suffixes are compared, by doubling steps.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    carried = np.zeros(n, bool)
    ok = (before[1:] > 0)
    carried[1:] = ok & (text[:-1] == text[np.maximum(before[1:], 1) - 1])
    # Carried only if the one before indeed had this predecessor; by the order of suffixes it is at least as long then.
    carried[1:] &= before[:-1] == before[1:] - 1
    todo = np.flatnonzero(~carried & (before >= 0))
    length = np.zeros(n, np.int64)
    i, j = todo.copy(), before[todo]
    live = np.arange(len(todo))
    got = np.zeros(len(todo), np.int64)
    while len(live):
        a, b = i[live] + got[live], j[live] + got[live]
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        same = text[a] == text[b]
        live = live[same]
        got[live] += 1
    length[todo] = got
    anchor = np.maximum.accumulate(np.where(carried, 0, at))
    length = length[anchor] - (at - anchor)
    lcp[1:] = length[sa[1:]]
    return lcp


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words of one array."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, tk.U64)
    base, inverse = tk._P, tk._PINV
    up, down = np.full(len(words), base, tk.U64), np.full(n, inverse, tk.U64)
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    total = np.concatenate([[tk.U64(0)], np.cumsum(words * up)])
    return tk.mix((total[k:] - total[:-k]) * down)


def anchor_of(words: np.ndarray) -> np.ndarray:
    """The position of each window's anchor: the least, then first, of its ANCHOR-word hashes."""
    h = window_hashes(words, ANCHOR)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Sliding minimum by doubling: place of the least of 2**k neighbours, then two overlapping ones.
    place, size = np.arange(len(h)), 1
    while size * 2 <= SPREAD + 1:
        a, b = place[:-size], place[size:]
        place = np.where(h[a] <= h[b], a, b)
        size *= 2
    a, b = place[:n], place[SPREAD + 1 - size :][:n]
    return np.where(h[a] <= h[b], a, b)


class Stretches:
    """Stretches of documents collected for a shard."""

    def __init__(self):
        self.words, self.doc, self.copy, self.start, self.size = [], [], [], [], 0

    def add(self, doc: int, copy: int, start: int, words: np.ndarray) -> None:
        self.words.append(words)
        self.doc.append(doc)
        self.copy.append(copy)
        self.start.append(start)
        self.size += len(words)


def solve_shard(st: Stretches) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Spans that repeat within the shard (by their first windows, with the end), and the first windows of its classes."""
    m = len(st.words)
    size = np.array([len(w) for w in st.words], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    words = np.empty(int(size.sum()) + m, tk.U64)
    owner = np.repeat(np.arange(m), size + 1)
    for b, w in zip(begin, st.words):
        words[b : b + len(w)] = w
    ends = begin + size
    words[ends] = 0
    _, text = np.unique(words, return_inverse=True)
    text = text.astype(np.int64) + m
    text[ends] = np.arange(m)  # each end is different from all words and ends
    inside = np.arange(len(text)) - begin[owner]
    whole = inside + WINDOW <= size[owner]
    # Sorting deeper than a window wouldn't change any class.
    sa = suffix_array(text, WINDOW)
    lcp = common_prefixes(text, sa)
    doc, copy, start = (np.array(x, np.int64) for x in (st.doc, st.copy, st.start))
    # Classes: runs of the array that share WINDOW words.
    rows = whole[sa]
    cls = np.cumsum(lcp < WINDOW)[rows]
    sfx = sa[rows]
    o = owner[sfx]
    order = np.lexsort((inside[sfx] + start[o], copy[o], doc[o], cls))
    cls, sfx, o = cls[order], sfx[order], o[order]
    first = np.concatenate([[True], cls[1:] != cls[:-1]]) if len(cls) else np.zeros(0, bool)
    repeated = np.zeros(len(text), bool)
    repeated[sfx[~first]] = True
    # Anchor and fingerprint of windows; those that reach into the next stretch are never looked at.
    h, anchors, fps = window_hashes(words, ANCHOR), anchor_of(words), window_hashes(words, WINDOW)

    def windows(at: np.ndarray) -> dict[str, np.ndarray]:
        o = owner[at]
        return {"anchor": h[anchors[at]], "fp": fps[at], "doc": doc[o], "copy": copy[o], "pos": inside[at] + start[o]}

    head, tail = _runs(repeated, owner)
    spans = windows(head)
    spans["end"] = inside[tail] + start[owner[tail]] + WINDOW
    return spans, windows(sfx[first])


def _runs(repeated: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of neighbouring repeated windows."""
    at = np.flatnonzero(repeated)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
    return at[new], at[np.concatenate([new[1:], [True]])]


# Merging


def merge_pair(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two runs (fp, doc, copy, pos), sorted by fp and without equal ones, into one that keeps the least of equals."""
    if len(a[0]) < len(b[0]):
        a, b = b, a
    at = np.searchsorted(a[0], b[0])
    known = at < len(a[0])
    known[known] = a[0][at[known]] == b[0][known]
    hit, k = at[known], np.flatnonzero(known)
    less = b[1][k] < a[1][hit]
    tie = b[1][k] == a[1][hit]
    less |= tie & ((b[2][k] < a[2][hit]) | ((b[2][k] == a[2][hit]) & (b[3][k] < a[3][hit])))
    out = []
    for c in range(4):
        x = a[c].copy()
        if c:
            x[hit[less]] = b[c][k[less]]
        out.append(np.insert(x, at[~known], b[c][~known]))
    return tuple(out)


def merge_runs(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    while len(runs) > 1:
        runs = [merge_pair(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


_SPAN = [c.split()[0] for c in SPAN_SCHEMA.split(", ")]


def _merge_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """All shards' runs of one range of anchors: spans of windows that another shard has earlier, and the shards' own spans."""
    runs, asked = [], []
    for row in pdf.itertuples():
        if row.run is not None:
            a = np.frombuffer(row.run, np.int64).reshape(4, -1)
            runs.append((a[0].view(tk.U64), a[1], a[2], a[3]))
        if row.asks is not None:
            asked.append(np.frombuffer(row.asks, np.int64).reshape(5, -1))
    total = merge_runs(runs)
    parts = []
    for fp, doc, copy, pos in runs:
        at = np.searchsorted(total[0], fp)
        late = (total[1][at] != doc) | (total[2][at] != copy) | (total[3][at] != pos)
        if late.any():
            parts.append(np.stack([doc[late], copy[late], pos[late], total[1][at][late]]))
    spans = np.zeros((5, 0), np.int64)
    if parts:
        doc, copy, pos, early = np.concatenate(parts, axis=1)
        order = np.lexsort((pos, copy, doc))
        doc, copy, pos, early = doc[order], copy[order], pos[order], early[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (pos[1:] != pos[:-1] + 1)])
        last = np.concatenate([new[1:], [True]])
        spans = np.stack([doc[new], copy[new], pos[new], pos[last] + WINDOW, early[new]])
    for fp, doc, copy, pos, end in asked:
        early = total[1][np.searchsorted(total[0], fp.view(tk.U64))]
        spans = np.concatenate([spans, np.stack([doc, copy, pos, end, early])], axis=1)
    return pd.DataFrame(dict(zip(_SPAN, spans)))


# Dataflow


def _anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, h, at): the anchors of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, col = b.column(0), b.column(1)
            for i, j in tk.chunks(tk.flat_text(col)[1]):
                words, _, _, cuts, _ = tk.word_hashes(col.slice(i, j - i))
                if not len(words):
                    continue
                place = anchor_of(words)
                h = window_hashes(words, ANCHOR)
                # Windows that span two documents don't count.
                doc = np.searchsorted(cuts, np.arange(len(place)), side="right") - 1
                ok = np.arange(len(place)) + WINDOW <= cuts[doc + 1]
                place, doc = place[ok], doc[ok]
                if not len(place):
                    continue
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
                place, doc = place[new], doc[new]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(i + doc)), pa.array(h[place].view(np.int64)), pa.array((place - cuts[doc]).astype(np.int32))], ["doc_id", "h", "at"]
                )

    return docs.mapInArrow(run, "doc_id long, h long, at int")


def _stretches(words: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges that hold all windows around the given anchor positions."""
    lo, hi = np.maximum(places - SPREAD, 0), np.minimum(places + WINDOW, len(words))
    out: list[tuple[int, int]] = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        # Windows that only the overlap of two stretches holds must not be lost, so any that meet become one.
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if b - a >= WINDOW]


def _solve(tasks: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = Stretches()

        def flush() -> Iterator[pa.RecordBatch]:
            out: dict[int, list] = {}
            for k, (w, names) in enumerate(zip(solve_shard(st), (("fp", "doc", "copy", "pos", "end"), ("fp", "doc", "copy", "pos")))):
                task = (w["anchor"] % tk.U64(tasks)).astype(np.int64)
                order = np.lexsort((w["fp"], task))
                data = np.stack([w[n].view(np.int64) for n in names])[:, order]
                there, first = np.unique(task[order], return_index=True)
                for t, a, e in zip(there.tolist(), first, np.append(first, len(order))[1:]):
                    out.setdefault(t, [None, None])[k] = np.ascontiguousarray(data[:, a:e]).tobytes()
            both = list(out.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), *[pa.array([x[k] for x in both], pa.binary()) for k in (0, 1)]], ["task", "asks", "run"])

        for b in batches:
            ids, col, places = b.column(0).to_pylist(), b.column(1), b.column(2)
            copies = b.column(3).to_pylist()
            for i, j in tk.chunks(tk.flat_text(col)[1]):
                words, _, _, cuts, _ = tk.word_hashes(col.slice(i, j - i))
                for k in range(i, j):
                    own = words[cuts[k - i] : cuts[k - i + 1]]
                    for a, e in _stretches(own, np.sort(places[k].values.to_numpy())):
                        st.add(ids[k], copies[k], a, own[a:e])
                if st.size >= shard_words:
                    yield from flush()
                    st = Stretches()
        if st.size:
            yield from flush()

    return run


def _numbered(narrow: DataFrame) -> DataFrame:
    """Rows (doc_id, text, ...) with a number that tells those of one doc_id apart; only the rows that share one are moved."""
    again = cut(narrow.groupBy(F.col("doc_id").alias("r_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r_id"), "again")
    n = again.count()
    if not n:
        return narrow.withColumn("copy", F.lit(0).cast("bigint"))
    again = sized(again, n, 16)
    same = F.col("doc_id") == F.col("r_id")
    one = narrow.join(again, same, "left_anti").withColumn("copy", F.lit(0).cast("bigint"))
    many = narrow.join(again, same, "left_semi")
    return one.unionByName(many.withColumn("copy", F.expr("row_number() over (partition by doc_id order by xxhash64(text))").cast("bigint")))


def _spans(docs: DataFrame, shard_words: int) -> DataFrame:
    """(doc_id, copy, start_word, end_word, first_doc_id) of all repeated spans."""
    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    anchors = cut(_anchors(narrow), "anchors")
    repeated = cut(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "hashes")
    # Positions of the anchors that occur twice, by document.
    places = anchors.join(sized(repeated, repeated.count(), 32), "h", "left_semi")
    twice = cut(places.groupBy("doc_id").agg(F.collect_set("at").alias("places")), "places")
    discard(anchors, repeated)
    n_docs, n_places = twice.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("places")), F.lit(0))).first()
    joined = _numbered(narrow.join(sized(twice, 1, 120 * n_docs + 8 * n_places), "doc_id"))
    tasks = max(1, n_places * (SPREAD // 2) >> 20)
    mixed = cut(joined.select("doc_id", "text", "places", "copy").mapInArrow(_solve(tasks, shard_words), "task long, asks binary, run binary"), "runs")
    return _join_spans(mixed.groupBy("task").applyInPandas(_merge_task, SPAN_SCHEMA))


def repeats(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, first_doc_id): the repeated spans of all documents."""
    require(docs, "doc_id", "text")
    out = _spans(docs, shard_words)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans; the lower-cased text, by which words are numbered, has as many characters."""
    data, offsets = tk.flat_text(pc.utf8_lower(pa.array([text], pa.large_string())))
    starts, ends, _ = tk.word_spans(data, offsets)
    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out, at = [], 0
    for a, e in sorted(spans):
        out.append(text[at : char[starts[a]]])
        at = char[ends[e - 1]]
    return "".join(out) + text[at:]


def drop_repeats(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The documents, with all their columns, without the words of their repeated spans."""
    require(docs, "doc_id", "text")
    plain, back = shielded(docs, "doc_id", "text")
    spans = _spans(docs, shard_words).groupBy(F.col("doc_id").alias("s_id"), F.col("copy").alias("s_copy")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    spans = cut(spans, "spans")
    n, m = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    named = _numbered(plain.withColumn("doc_id", F.col("doc_id").cast("bigint")).where("doc_id is not null"))
    joined = named.join(sized(spans, 1, 120 * n + 32 * m), (F.col("doc_id") == F.col("s_id")) & (F.col("copy") == F.col("s_copy")), "left")
    at = next(a for a, c in back if c == "text")
    names = [a for a, _ in back]
    cut_texts = joined.select(*names, "spans")
    schema = cut_texts.drop("spans").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = names.index(at)
        for b in batches:
            hit = np.flatnonzero(b.column(len(names)).is_valid().to_numpy(zero_copy_only=False))
            columns = list(b.columns[:-1])
            if len(hit):
                texts = tk.sound(columns[k]).to_pylist()
                for i in hit.tolist():
                    texts[i] = without_words(texts[i], [(x["start_word"], x["end_word"]) for x in b.column(len(names))[i].as_py()])
                columns[k] = pa.array(texts, columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return unshielded(cut_texts.mapInArrow(run, schema).unionByName(plain.where("doc_id is null").select(*names)), back)


def _join_spans(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap by a window's length less one, or meet as windows, become one."""
    by = "partition by doc_id, copy order by start_word, end_word"
    # A window run [s, e) covers windows s .. e - WINDOW; the next run joins if it starts at most one window later.
    reach = F.expr(f"max(end_word) over ({by} rows between unbounded preceding and 1 preceding)")
    new = spans.withColumn("new", F.when(reach.isNull() | (F.col("start_word") > reach - WINDOW + 1), 1).otherwise(0))
    run = new.withColumn("g", F.expr(f"sum(new) over ({by} rows between unbounded preceding and current row)"))
    return run.groupBy("doc_id", "copy", "g").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min_by("first_doc_id", "start_word").alias("first_doc_id")
    ).drop("g")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents"))


#: Of tables whose doc_ids are told apart.
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {tk.WORDS_SQL} AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS p FROM d WHERE len(w) >= {WINDOW}),
s AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + {WINDOW}], ' ')) AS s FROM p),
f AS (SELECT doc_id, p, first_value(doc_id) OVER v AS fd, row_number() OVER v AS n FROM s WINDOW v AS (PARTITION BY s ORDER BY doc_id, p)),
r AS (SELECT doc_id, p, fd, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM f WHERE n > 1)
SELECT doc_id, min(p) AS start_word, max(p) + {WINDOW} AS end_word, max(p) + {WINDOW} - min(p) AS n_words, arg_min(fd, p) AS first_doc_id FROM r GROUP BY doc_id, run
"""
