"""Operator 5: unigram token counts by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its whitespace-separated words, each with the word mark
in front.  A pre-token's tokens are those of its segmentation of highest score
under a unigram model (the sum of its pieces' log probabilities).  The model's
pieces and their order are those of a public vocabulary file, whose path is a
parameter; the log probability of the piece of rank r is -log(r + 1), Zipf's
law.  A character that is no piece costs UNKNOWN below the least piece and
counts as its UTF-8 bytes.

Each task keeps a trie of the distinct pre-tokens that it has met.  A node is
a prefix, with its best (forward) score and the token count of that best
segmentation, so a prefix is solved once, however many words share it and
whenever they come; a word's last node has its terminal count.  The distinct
words of a chunk go down the trie together, a character at a time: known
prefixes are found in a hash table of (node, character), and the new nodes of a
level are solved at once, by the pieces that end there (the states of a second
trie, of the vocabulary, tell which do).  Documents then sum the counts of
their words.  All of it happens where the documents are: no shuffle.

Defined cases: of segmentations of equal score, the one whose last piece is
longer counts (and so on backwards, as prefixes are solved by the same rule); a
null, empty or blank text has 0 pre-tokens and 0 tokens; a null doc_id is
carried; repeated rows are counted each; a word of any length is solved whole,
in time linear in its length (beyond TRIE_DEPTH characters without keeping its
nodes); bytes that aren't UTF-8 read as U+FFFD; an empty table gives an empty
result; other columns aren't read, but for those that are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import read, require

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_MARK = "▁"
UNKNOWN = 10.0
#: Characters of a word that have nodes of their own.
TRIE_DEPTH = 48
#: A task starts a new trie when it has so many nodes (about 50 bytes each).
TRIE_NODES = 1 << 20
#: Words that go down the trie together.
WORDS_AT_ONCE = 1 << 14

_MODELS: dict[str, dict[str, float]] = {}
_CHAR_BITS = np.uint64(21)


def pieces(path: str) -> dict[str, float]:
    """Log probabilities of the vocabulary's ordinary pieces."""
    if path not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        _MODELS[path] = {sp.id_to_piece(i): -math.log(rank + 1.0) for rank, i in enumerate(ordinary)}
    return _MODELS[path]


class Edges:
    """Hash table from (node, character) to the child node, by open addressing in flat arrays."""

    def __init__(self, size: int = 1 << 12):
        self.n = 0
        self._make(size)

    def _make(self, size: int) -> None:
        self.mask = np.uint64(size - 1)
        self.key = np.zeros(size, np.uint64)  # 0 is free, as no key is
        self.child = np.zeros(size, np.int32)

    @staticmethod
    def keys(node: np.ndarray, char: np.ndarray) -> np.ndarray:
        return ((node.astype(np.uint64) + np.uint64(1)) << _CHAR_BITS) | char.astype(np.uint64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Children, -1 where there is none."""
        out = np.full(len(key), -1, np.int32)
        slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) & self.mask
        open_ = np.arange(len(key))
        while len(open_):
            s = slot[open_]
            there = self.key[s]
            hit = there == key[open_]
            out[open_[hit]] = self.child[s[hit]]
            open_ = open_[~hit & (there != 0)]
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
        return out

    def add(self, key: np.ndarray, child: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        self.n += len(key)
        if self.n * 2 > len(self.key):
            old = self.key != 0
            old_key, old_child = self.key[old], self.child[old]
            self._make(1 << (2 * self.n).bit_length())
            self._place(old_key, old_child)
        self._place(key, child)

    def _place(self, key: np.ndarray, child: np.ndarray) -> None:
        slot = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) & self.mask
        open_ = np.arange(len(key))
        while len(open_):
            s = slot[open_]
            free = self.key[s] == 0
            self.key[s[free]] = key[open_[free]]  # of several that want a place, the last one gets it
            won = self.key[s] == key[open_]
            self.child[s[won]] = child[open_[won]]
            open_ = open_[~won]
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask


class Vocabulary:
    """The pieces as a trie; ``score`` of a node is that of its piece, NaN if it is none."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        child: dict[tuple[int, int], int] = {}
        score = [math.nan]
        for piece, s in scores.items():
            at = 0
            for c in piece:
                key = (at, ord(c))
                if key not in child:
                    child[key] = len(score)
                    score.append(math.nan)
                at = child[key]
            score[at] = s
        self.edges, self.score = Edges(), np.array(score)
        if child:
            k = np.array(list(child), np.int64)
            self.edges.add(Edges.keys(k[:, 0], k[:, 1]), np.fromiter(child.values(), np.int32, len(child)))


def utf8_size(char: np.ndarray) -> np.ndarray:
    return 1 + (char > 0x7F).astype(np.int64) + (char > 0x7FF) + (char > 0xFFFF)


class Trie:
    """Trie of pre-tokens that outlives the chunks; node 0 is the empty prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.edges = Edges()
        self.best, self.count = np.zeros(1024), np.zeros(1024, np.int32)
        self.nodes = 1

    def _grow(self, n: int) -> None:
        if self.nodes + n > len(self.best):
            size = 1 << (self.nodes + n - 1).bit_length()
            for name in ("best", "count"):
                old = getattr(self, name)
                new = np.zeros(size, old.dtype)
                new[: self.nodes] = old[: self.nodes]
                setattr(self, name, new)

    def counts(self, words: pa.Array) -> np.ndarray:
        """Token counts of distinct words, none of them null."""
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros(len(words), np.int64)
        short = np.flatnonzero(length <= TRIE_DEPTH)
        # Words of like length go together, so that few have ended before the others.
        short = short[np.argsort(length[short], kind="stable")]
        for a in range(0, len(short), WORDS_AT_ONCE):
            part = short[a : a + WORDS_AT_ONCE]
            out[part] = self._down(words.take(pa.array(part)), length[part])
        for k in np.flatnonzero(length > TRIE_DEPTH):
            out[k] = self._alone(words[int(k)].as_py())
        return out

    def _down(self, words: pa.Array, length: np.ndarray) -> np.ndarray:
        data, _ = tk.flat_text(words)
        flat = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n, deep = len(length), int(length.max(initial=0))
        chars = np.zeros((deep, n), np.uint32)
        begin = np.cumsum(length) - length
        path = np.zeros((deep + 1, n), np.int32)
        fresh = np.full(n, deep + 1)  # where a word leaves the known trie
        walk = np.arange(n)
        for d in range(deep):
            walk = walk[length[walk] > d]
            chars[d, walk] = flat[begin[walk] + d]
            known = self.edges.find(Edges.keys(path[d, walk], chars[d, walk]))
            path[d + 1, walk] = known
            fresh[walk[known < 0]] = d
            walk = walk[known >= 0]
        new = np.flatnonzero(fresh <= deep)
        if len(new):
            for d in range(int(fresh.min()), deep):
                walk = new[length[new] > d]
                chars[d, walk] = flat[begin[walk] + d]
            self._extend(new, chars, path, length, fresh)
        return self.count[path[length, np.arange(n)]].astype(np.int64)

    def _extend(self, new: np.ndarray, chars: np.ndarray, path: np.ndarray, length: np.ndarray, fresh: np.ndarray) -> None:
        """Add the missing nodes of the words ``new``, level by level."""
        v = self.vocabulary
        # state[m]: the vocabulary's node of the word's last m + 1 characters, -1 if no piece begins so.
        state = np.full((v.longest, len(new)), -1, np.int32)
        for d in range(len(chars)):
            alive = np.flatnonzero(length[new] > d)
            w = new[alive]
            c = chars[d, w]
            state[1:] = state[:-1].copy()
            state[0] = 0
            for m in range(min(v.longest, d + 1)):
                go = alive[state[m, alive] >= 0]
                state[m, go] = v.edges.find(Edges.keys(state[m, go], chars[d, new[go]]))
            missing = fresh[w] <= d
            if not missing.any():
                continue
            w, c, at = w[missing], c[missing], alive[missing]
            key = Edges.keys(path[d, w], c)
            distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
            at, rep, ch = at[first], w[first], c[first]
            # Nodes that an earlier word of this very level made are in the table; all others are new.
            node = np.arange(self.nodes, self.nodes + len(distinct), dtype=np.int32)
            top, tokens = np.full(len(rep), -np.inf), np.zeros(len(rep), np.int64)
            for m in range(min(v.longest, d + 1) - 1, -1, -1):
                s = state[m, at]
                piece = np.where(s >= 0, v.score[np.maximum(s, 0)], np.nan)
                before = path[d - m, rep]
                total = piece + self.best[before]
                better = total > top  # never with NaN
                top[better], tokens[better] = total[better], self.count[before[better]] + 1
            single = np.isnan(np.where(state[0, at] >= 0, v.score[np.maximum(state[0, at], 0)], np.nan))
            total = self.best[path[d, rep]] + v.unknown
            better = single & (total > top)
            top[better], tokens[better] = total[better], self.count[path[d, rep[better]]] + utf8_size(ch[better])
            self._grow(len(node))
            self.best[node], self.count[node] = top, tokens
            self.nodes += len(node)
            self.edges.add(distinct, node)
            path[d + 1, w] = node[which]

    def _alone(self, word: str) -> int:
        """A long word, whose nodes aren't kept."""
        v = self.vocabulary
        get, longest = v.scores.get, v.longest
        best, count = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, tokens = -math.inf, 0
            for begin in range(max(0, end - longest), end):
                s = get(word[begin:end])
                if s is not None:
                    s += best[begin]
                    if s > top:
                        top, tokens = s, count[begin] + 1
            if word[end - 1] not in v.scores:
                s = best[end - 1] + v.unknown
                if s > top:
                    top, tokens = s, count[end - 1] + len(word[end - 1].encode())
            best.append(top)
            count.append(tokens)
        return count[-1]


_VOCABULARIES: dict[str, Vocabulary] = {}


class Counter:
    """Counts texts with one trie."""

    def __init__(self, path: str):
        if path not in _VOCABULARIES:
            _VOCABULARIES[path] = Vocabulary(pieces(path))
        self.trie = Trie(_VOCABULARIES[path])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each text."""
        lists = pc.utf8_split_whitespace(pc.fill_null(tk.sound(column), ""))
        cuts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if self.trie.nodes > TRIE_NODES:
            self.trie = Trie(self.trie.vocabulary)
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False).astype(np.int64)
        per = self.trie.counts(pc.binary_join_element_wise(WORD_MARK, words, "")) * real
        at = coded.indices.to_numpy(zero_copy_only=False)
        sums = [np.concatenate([[0], np.cumsum(x[at])])[cuts] for x in (real, per)]
        return np.diff(sums[0]), np.diff(sums[1])


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, carried columns, n_pretokens, n_tokens) of every document."""
    require(docs, "doc_id", "text", *carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(vocabulary)
        for b in batches:
            words, tokens = [], []
            for i, j in tk.chunks(tk.flat_text(b.column(1))[1], 2 * tk.CHUNK_BYTES):
                w, t = count(b.column(1).slice(i, j - i))
                words.append(w)
                tokens.append(t)
            w, t = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, tokens))
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(w), pa.array(t)], ["doc_id", *carry, "n_pretokens", "n_tokens"])
        # Workers live on; what a task has made of the texts doesn't.
        del count
        tk.release()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *carry)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema[2:])
    return narrow.mapInArrow(run, f"doc_id long, {kinds}n_pretokens long, n_tokens long")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))
