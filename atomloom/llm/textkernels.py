"""Vectorised text kernels over Arrow string buffers.

Everything works on flat numpy arrays cut by per-document offsets, so that one
call handles thousands of documents without a Python loop over words.

A *word* is a maximal run of ASCII letters, ASCII digits or non-ASCII
characters of the lower-cased text; everything else separates words.  Null
texts count as empty texts: they own no word.  Bytes of a text that aren't
UTF-8 (Spark doesn't check what files bring) read as U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: The words of a text in SQL.
WORDS_SQL = r"[x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+') IF x <> '']"
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes of text that one kernel call handles (a longer document is handled alone).
CHUNK_BYTES = 1 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all its bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 65536)
            for name, base in (("up", _P), ("down", _PINV)):
                a = np.full(size, base, U64)
                a[0] = 1
                np.multiply.accumulate(a, out=a)
                setattr(self, name, a)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def sound(column: pa.Array) -> pa.Array:
    """The column with valid UTF-8 only; a valid one is returned as it is."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
        raw = column.view(kind).to_pylist()
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], column.type)
    return column


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return data, offsets - (offsets[0] if len(offsets) else 0)


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes that cover all rows."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the offsets of each text's words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    is_word = _WORD[data]
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begin[inner] = is_word[inner]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:]
    last = offsets[1:]
    last = last[last > 0] - 1
    end[last] = is_word[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, case folded.

    Returns (hash, start byte, end byte, word offsets by text, byte offsets by
    text); the bytes are those of the lower-cased column.
    """
    data, offsets = flat_text(pc.utf8_lower(pc.fill_null(sound(column), "")))
    starts, ends, cuts = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, U64), starts, ends, cuts, offsets
    up, down = _POWERS.get(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.multiply(data + U64(1), up[:-1], out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends, cuts, offsets


def shingle_hashes(words: np.ndarray, cuts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their offsets by text.

    A text of fewer than k words (but at least one) has one shingle, of all
    its words.
    """
    n = np.diff(cuts)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_cuts = np.concatenate([[0], np.cumsum(count)])
    total = int(out_cuts[-1])
    if not total:
        return np.zeros(0, U64), out_cuts
    at = np.arange(total) + np.repeat(cuts[:-1] - out_cuts[:-1], count)
    last = np.repeat(cuts[1:], count)
    h = np.zeros(total, U64)
    short = bool((n[n > 0] < k).any())
    for j in range(k):
        h *= U64(0xD6E8FEB86659FD93)
        if short:
            ok = at + j < last
            h[ok] += words[np.minimum(at + j, len(words) - 1)][ok]
        else:
            h += words[at + j]
    return mix(h), out_cuts


def release() -> None:
    """Give freed memory back to the system: workers live on after a task, and executors' limits count what they keep."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
