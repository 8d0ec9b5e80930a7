"""Operator 9: token ids as Arrow stream files of fixed-size-list batches.

Each document is tokenised with a public byte-level BPE vocabulary, closed with
the end-of-text id and cut into sequences of SEQUENCE ids; the last one is
padded with the end-of-text id, and its mask tells ids (1) from padding (0).
Sequences are written as Arrow IPC streams of the columns doc_id, position,
input_ids (fixed_size_list<uint16>[SEQUENCE]) and mask
(fixed_size_list<uint8>[SEQUENCE]).  Record batches aren't compressed and
have no nulls, so in each batch the ids of all sequences lie in one buffer of
n * SEQUENCE values: sequence i of a mapped file is a slice of it, without a
copy (``read_sequence``).

A row of the result is one stream: its sequences' doc_ids and positions and the
file's bytes; ``write_streams`` puts them into a folder, with names that don't
depend on the attempt.  The vocabulary's path is a parameter; it is read on the
executors.

Texts are tokenised where they are, one by one by the vocabulary's own compiled
program (which is twice as fast as looking distinct words up in a table, as
measured), and there is no shuffle.

Defined cases: a null or empty text gives one sequence that holds the
end-of-text id alone; a null doc_id is -1 in the stream and null in doc_ids;
repeated rows are written again, each; a text of any length is cut, never
shortened, and long runs of white space are tokenised by the same rules without
the pattern, whose program overflows on them; bytes that aren't UTF-8 read as
U+FFFD; the strings of special tokens are ordinary text; an empty table gives no
stream; other columns aren't read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import read, require

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the pattern has it; runs of so many characters are tokenised apart.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2000,}")
END_OF_TEXT = 50256
SEQUENCE = 1024
#: Sequences of a record batch, and of a stream (about 12 MB).
BATCH_SEQUENCES = 256
STREAM_SEQUENCES = 4096
SCHEMA = "n_sequences long, n_tokens long, doc_ids array<long>, positions array<int>, stream binary"

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class Tokeniser:
    def __init__(self, path: str):
        self.encoder = encoder(path)

    def encode(self, text: str) -> list[int]:
        # A long run covers sixteen characters at some multiple of 1000.
        if len(text) < 2000 or not any(text[k : k + 16].isspace() for k in range(0, len(text), 1000)):
            return self.encoder.encode_ordinary(text)
        # The pattern takes a run of white space as one piece, but for its last character if a word follows.
        ids, at = [], 0
        for run in LONG_SPACE.finditer(text):
            begin, end = run.start(), run.end() - (run.end() < len(text))
            ids += self.encoder.encode_ordinary(text[at:begin])
            ids += self.encoder._encode_single_piece(text[begin:end])
            at = end
        return ids + self.encoder.encode_ordinary(text[at:])

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their offsets by text."""
        parts = [np.array(self.encode(t or ""), np.uint16) for t in tk.sound(column).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16), offsets


def sequences(ids: np.ndarray, offsets: np.ndarray, length: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, ids, mask) of all sequences; ids and mask have the shape (n, length)."""
    n = np.diff(offsets) + 1  # with the end of text
    many = -(-n // length)
    row = np.repeat(np.arange(len(n)), many)
    position = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    out = np.full(int(many.sum()) * length, END_OF_TEXT, np.uint16)
    begin = (np.cumsum(many) - many) * length
    at = np.arange(len(ids)) + np.repeat(begin - offsets[:-1], np.diff(offsets))
    out[at] = ids
    held = np.minimum(n[row] - position * length, length)
    mask = (np.arange(length)[None, :] < held[:, None]).astype(np.uint8)
    return row, position.astype(np.int32), out.reshape(-1, length), mask


def stream_schema(length: int) -> pa.Schema:
    return pa.schema(
        [
            pa.field("doc_id", pa.int64(), False),
            pa.field("position", pa.int32(), False),
            pa.field("input_ids", pa.list_(pa.field("item", pa.uint16(), False), length), False),
            pa.field("mask", pa.list_(pa.field("item", pa.uint8(), False), length), False),
        ]
    )


class StreamWriter:
    """Writes sequences as they come, in whole record batches; only the file and part of a batch are held."""

    def __init__(self, length: int):
        self.schema, self.rest = stream_schema(length), []
        self.doc_ids: list[int | None] = []
        self.positions: list[int] = []
        self.tokens = 0
        self.sink = pa.BufferOutputStream()
        self.writer = pa.ipc.new_stream(self.sink, self.schema)

    def __len__(self) -> int:
        return len(self.positions)

    def add(self, doc: np.ndarray, null: np.ndarray, position: np.ndarray, ids: np.ndarray, mask: np.ndarray) -> None:
        self.doc_ids += [None if z else int(x) for x, z in zip(doc, null)]
        self.positions += position.tolist()
        self.tokens += int(mask.sum())
        self.rest.append((doc, position, ids, mask))
        if sum(len(x[0]) for x in self.rest) >= BATCH_SEQUENCES:
            self._write(whole=False)

    def _write(self, whole: bool) -> None:
        parts = [np.concatenate(x) for x in zip(*self.rest)]
        n = len(parts[0])
        upto = n if whole else n - n % BATCH_SEQUENCES
        for at in range(0, upto, BATCH_SEQUENCES):
            doc, position, ids, mask = (x[at : min(at + BATCH_SEQUENCES, upto)] for x in parts)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), type=self.schema.field(i).type) for i, x in ((2, ids), (3, mask))]
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.array(doc), pa.array(position), *lists], schema=self.schema))
        self.rest = [tuple(x[upto:].copy() for x in parts)] if upto < n else []

    def row(self) -> pa.RecordBatch:
        """The finished stream as a row of SCHEMA; the file's bytes aren't copied."""
        if self.rest:
            self._write(whole=True)
        self.writer.close()
        data = self.sink.getvalue()
        offsets = pa.py_buffer(np.array([0, data.size], np.int32))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(self)], pa.int64()),
                pa.array([self.tokens], pa.int64()),
                pa.array([self.doc_ids], pa.list_(pa.int64())),
                pa.array([self.positions], pa.list_(pa.int32())),
                pa.Array.from_buffers(pa.binary(), 1, [None, offsets, data]),
            ],
            ["n_sequences", "n_tokens", "doc_ids", "positions", "stream"],
        )


def read_sequence(source, index: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(doc_id, position, ids, mask) of one sequence of a stream (bytes, buffer or memory map); ids and mask are views."""
    for batch in pa.ipc.open_stream(source):
        if index < batch.num_rows:
            length = batch.schema.field(2).type.list_size
            view = [batch.column(k).flatten().to_numpy(zero_copy_only=True)[index * length : (index + 1) * length] for k in (2, 3)]
            return batch.column(0)[index].as_py(), batch.column(1)[index].as_py(), *view
        index -= batch.num_rows
    raise IndexError("the stream has fewer sequences")


def token_streams(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = SEQUENCE) -> DataFrame:
    """One row a stream: n_sequences, n_tokens, doc_ids, positions, stream."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenise, out = Tokeniser(vocabulary), StreamWriter(length)
        for b in batches:
            column, ids = b.column(1), b.column(0)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = pc.fill_null(ids, -1).to_numpy()
            for i, j in tk.chunks(tk.flat_text(column)[1]):
                row, pos, tokens, mask = sequences(*tokenise(column.slice(i, j - i)), length)
                at = 0
                while at < len(row):
                    part = slice(at, at + STREAM_SEQUENCES - len(out))
                    out.add(doc[i:j][row[part]], null[i:j][row[part]], pos[part], tokens[part], mask[part])
                    at = part.stop
                    if len(out) >= STREAM_SEQUENCES:
                        yield out.row()
                        out = StreamWriter(length)
        if len(out):
            yield out.row()
        del tokenise, out
        tk.release()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def write_streams(streams: DataFrame, folder: str) -> DataFrame:
    """Write each stream to ``folder`` (any file system that Arrow knows); (file, n_sequences, n_tokens, doc_ids, positions).

    A file is named after its content, written under another name and then
    moved, so a task that runs twice leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for b in batches:
            names = []
            for data in b.column(4):
                body = data.as_buffer()
                name = hashlib.sha256(body).hexdigest()[:32] + ".arrows"
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(body)
                system.move(part, f"{root}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names), *b.columns[:4]], ["file", *b.schema.names[:4]])

    return streams.mapInArrow(run, "file string, n_sequences long, n_tokens long, doc_ids array<long>, positions array<int>")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_streams(read(spark, sf_dir, "documents"))
