"""Operator 4: language identification by sparse multinomial logistic regression.

Features are the TF-IDF weights of character n-grams of 1 to 3 characters of
the lower-cased text, hashed to 2**HASH_BITS columns: term frequency is the
share of the text's n-grams, inverse document frequency is counted over all
documents.  The weights are trained with follow-the-regularised-leader (FTRL
proximal), whose elastic-net penalty (L1 and L2) leaves most of them at zero,
on a bounded sample of labelled rows (SAMPLE_ROWS, those of least hash of
doc_id and text); a fifth of it is held out, on which one temperature is fitted
that calibrates the probabilities.  All documents are then scored, whole.

As TF-IDF is linear in the counts, a document's score is the mean of its
n-grams' weights: scoring is a table lookup per n-gram, in one pass without any
shuffle; what is broadcast is 2**HASH_BITS rows whatever the corpus.

A document is accepted if its text has at least one letter and the calibrated
probability of its best language is at least MIN_PROB.

Defined cases: a null or empty text, and one without letters, has no language
(null), confidence 0 and is not accepted; of languages of equal probability the
first by name is given; bytes that aren't UTF-8 read as U+FFFD; a null label takes no part in
training; with no labelled row nothing is accepted; with labels of one language
that language is given to every text with letters; repeated rows are scored
alike, each; n-grams never span two documents; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import read, require

ORDERS = (1, 2, 3)
HASH_BITS = 15
SAMPLE_ROWS = 3000
EPOCHS = 3
HELD_OUT = 5
#: The best language must be likelier than all others together.
MIN_PROB = 0.5
#: Mean TF-IDF is brought to a scale that suits the learning rate.
SCALE = 64.0
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
_MUL = np.array([[2654435761, 0, 0], [2246822519, 3266489917, 0], [668265263, 374761393, 3266489917]], np.uint32)


def ngrams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed n-grams at each character, by order, and the texts' character offsets."""
    low = pc.utf8_lower(pc.fill_null(tk.sound(column), ""))
    data, _ = tk.flat_text(low)
    cuts = np.concatenate([[0], np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64))])
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = []
    for order in ORDERS:
        if len(cp) < order:
            out.append(np.zeros(0, np.int32))
            continue
        n = len(cp) - order + 1
        h = cp[:n] * _MUL[order - 1, 0]
        for k in range(1, order):
            h += cp[k : n + k] * _MUL[order - 1, k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
        out.append((h >> np.uint32(32 - HASH_BITS)).astype(np.int32))
    return out, cuts


def _segments(cuts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have n-grams of this order, and reduceat's begin and end pairs."""
    n = np.diff(cuts) - order + 1
    rows = np.flatnonzero(n > 0)
    pairs = np.empty(2 * len(rows), np.int64)
    pairs[0::2], pairs[1::2] = cuts[rows], cuts[rows] + n[rows]
    return rows, pairs


def totals(cuts: np.ndarray) -> np.ndarray:
    """N-grams of all orders in each text."""
    return sum(np.maximum(np.diff(cuts) - order + 1, 0) for order in ORDERS)


def _counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, count) and each text's total; a few texts at a time, as all n-grams together are large."""
    found, total = [], np.zeros(len(column), np.int64)
    for i, j in tk.chunks(tk.flat_text(column)[1]):
        grams, cuts = ngrams(column.slice(i, j - i))
        total[i:j] = totals(cuts)
        keys = []
        for order, h in zip(ORDERS, grams):
            n = np.maximum(np.diff(cuts) - order + 1, 0)
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) + np.repeat(cuts[:-1] - (np.cumsum(n) - n), n)
            keys.append(row << HASH_BITS | h[at])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        found.append(((i + (key >> HASH_BITS)).astype(np.int32), (key & ((1 << HASH_BITS) - 1)).astype(np.int32), count.astype(np.int32)))
    row, feature, count = (np.concatenate(x) for x in zip(*found))
    return row, feature, count, total


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each column occurs, and how many documents there are, over all rows."""
    width = 1 << HASH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(width, np.int64), 0
        for b in batches:
            col = b.column(0)
            n += len(col)
            for i, j in tk.chunks(tk.flat_text(col)[1]):
                # A table of flags per document, a few hundred documents at a time.
                for a in range(i, j, 256):
                    part = col.slice(a, min(j, a + 256) - a)
                    grams, cuts = ngrams(part)
                    seen = np.zeros(len(part) * width, bool)
                    for order, h in zip(ORDERS, grams):
                        m = np.maximum(np.diff(cuts) - order + 1, 0)
                        base = np.repeat(np.arange(len(m), dtype=np.int32) << HASH_BITS, np.diff(cuts))[: len(h)]
                        if order == 1:
                            seen[base + h] = True
                        else:
                            inside = np.ones(len(h), bool)
                            for back in range(1, order):
                                ends = cuts[1:] - back
                                inside[ends[(ends >= 0) & (ends < len(h))]] = False
                            # An n-gram that starts just before its text's end isn't one.
                            seen[(base + h)[inside]] = True
                    df += seen.reshape(len(part), width).sum(0)
        tk.release()
        feature = np.flatnonzero(df)
        # Row -1 counts the documents.
        yield pa.RecordBatch.from_arrays([pa.array(np.append(feature, -1).astype(np.int32)), pa.array(np.append(df[feature], n))], ["feature", "n"])

    # Each task sends its own counts; executors add them, and the driver gets a row a feature, whatever the corpus.
    sums = docs.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = sums["feature"].to_numpy(), sums["n"].to_numpy()
    df = np.zeros(width, np.int64)
    df[feature[feature >= 0]] = n[feature >= 0]
    return df, int(n[feature < 0].sum())


@dataclass
class Model:
    classes: list[str]
    table: np.ndarray  # (2**HASH_BITS, classes): idf * weight
    bias: np.ndarray
    temperature: float
    scale: float = SCALE

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(n, classes) calibrated probabilities, and which texts have a letter."""
        n, c = len(column), len(self.classes)
        out = np.zeros((n, c), np.float64)
        column = tk.sound(column)
        has = pc.match_substring_regex(pc.fill_null(column, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        for i, j in tk.chunks(tk.flat_text(column)[1]):
            grams, cuts = ngrams(column.slice(i, j - i))
            z = np.zeros((j - i, c))
            for order, h in zip(ORDERS, grams):
                rows, pairs = _segments(cuts, order)
                if not len(rows):
                    continue
                for k in range(c):
                    # One more place, as the last segment may end behind the last n-gram.
                    w = np.append(self.table[:, k][h], np.float32(0)).astype(np.float64)
                    z[rows, k] += np.add.reduceat(w, pairs)[::2]
            out[i:j] = z / np.maximum(totals(cuts), 1)[:, None]
        z = (out * self.scale + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True) if c else 0
        e = np.exp(z)
        return e / np.maximum(e.sum(axis=1, keepdims=True), 1e-300), has


def train(texts: pa.Array, labels: list[str], df: np.ndarray, n_docs: int, seed: int = 7) -> Model | None:
    """FTRL-proximal with elastic net on the rows but every HELD_OUT-th, which give the temperature."""
    classes = sorted(set(labels))
    if not classes:
        return None
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    row, feature, count, total = _counts(texts)
    value = count / np.maximum(total[row], 1) * idf[feature] * SCALE
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    y = np.array([classes.index(x) for x in labels])
    c, width = len(classes), 1 << HASH_BITS
    z, n = np.zeros((width + 1, c)), np.zeros((width + 1, c))  # the last row is the bias, which isn't penalised

    def weights(f: np.ndarray) -> np.ndarray:
        zf = z[f]
        w = -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2)
        w[np.abs(zf) <= L1] = 0
        w[-1] = -zf[-1] / ((BETA + np.sqrt(n[f[-1]])) / ALPHA)
        return w

    held = np.arange(len(texts)) % HELD_OUT == HELD_OUT - 1
    if held.all() or not held.any():
        held[:] = False
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~held)):
            f = np.append(feature[first[i] : first[i + 1]], width)
            x = np.append(value[first[i] : first[i + 1]], 1.0)
            w = weights(f)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[f] += g - (np.sqrt(n[f] + g2) - np.sqrt(n[f])) / ALPHA * w
            n[f] += g2
    w = weights(np.arange(width + 1))
    model = Model(classes, (w[:-1] * idf[:, None]).astype(np.float32), w[-1].copy(), 1.0)
    if held.any():
        keep = np.flatnonzero(held)
        logits = np.zeros((len(keep), c))
        for k, i in enumerate(keep):
            f = feature[first[i] : first[i + 1]]
            logits[k] = value[first[i] : first[i + 1]] @ w[f] + w[-1]
        model.temperature = temperature(logits, y[keep])
    return model


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature, 0.05 to 20, of least held-out cross entropy (golden section on its logarithm).

    Targets are smoothed by one observation per class, so that a held-out part
    without any error doesn't ask for endless certainty.
    """
    n, c = logits.shape
    target = np.full((n, c), 1 / (n + c))
    target[np.arange(n), y] += n / (n + c)

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (s * target).sum(axis=1)).mean())

    lo, hi, g = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if loss(a) <= loss(b):
            hi = b
        else:
            lo = a
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    require(docs, "doc_id", "text", "lang")
    labelled = docs.where("lang is not null and length(text) > 0").select("text", F.col("lang").alias("y"), F.xxhash64("doc_id", "text").alias("h"))
    # First the hash up to which rows are taken, then these rows alone; so texts aren't sorted.
    last = labelled.select("h").orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if last is None:
        return None
    sample = labelled.where(F.col("h") <= last).orderBy("h", "y", "text").limit(sample_rows).toArrow()
    if not sample.num_rows:
        return None
    df, n = document_frequency(docs)
    return train(sample["text"].combine_chunks(), sample["y"].to_pylist(), df, n)


def _score(model: Model | None, column: pa.Array, min_prob: float) -> tuple[list, np.ndarray, np.ndarray]:
    n = len(column)
    if model is None:
        return [None] * n, np.zeros(n), np.zeros(n, bool)
    p, has = model.probabilities(column)
    best = p.argmax(axis=1) if n else np.zeros(0, int)
    prob = np.where(has, p[np.arange(n), best], 0.0)
    lang = [model.classes[k] if h else None for k, h in zip(best, has)]
    return lang, prob, has & (prob >= min_prob)


def identify(docs: DataFrame, model: Model | None = None, min_prob: float = MIN_PROB) -> DataFrame:
    """(doc_id, lang_pred, confidence, accepted) of every document."""
    require(docs, "doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(model if model is not None else fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, prob, ok = _score(shared.value, b.column(1), min_prob)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(np.round(prob, 6)), pa.array(ok)], ["doc_id", "lang_pred", "confidence", "accepted"])
        tk.release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, confidence double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model | None = None, min_prob: float = MIN_PROB) -> DataFrame:
    """The accepted documents, with all their columns."""
    require(docs, "doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(model if model is not None else fit(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_score(shared.value, b.column(at), min_prob)[2]))
        tk.release()

    return docs.mapInArrow(run, docs.schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
