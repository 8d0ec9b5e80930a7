"""Operator 3: normalise monolithic gzip WARC files to one gzip member a record.

A WARC file that was compressed as a whole can only be read from its start.
The normaliser inflates each file's stream once, in blocks, follows the record
headers' Content-Length, and writes every record as a gzip member of its own; a
sidecar index has each record's offset and length in the new file, so any
record can be read alone.  A block of input, one record's compressed member and
the file's index rows are held, never the file.  Files are the unit of work;
there is no shuffle.

Output files and their index are written under a name of the attempt and then
moved, so a task that runs twice leaves one whole file.  A file's new name has
its old base name and a hash of its whole path, so files of one name in two
folders don't meet.

Defined cases: input of several members, or not compressed, is read alike, with
any zero padding behind a member; a record without a header or a usable
Content-Length gives a row of warc_type ``error`` with the reason in target_uri
and no offset, and reading goes on at the next line that begins with WARC/; so
do the records behind a wrong Content-Length; a file that ends within a record,
or whose compressed stream is broken or fails its checksum, gives its whole
records and then one such row; an empty file gives no row; a null path is
skipped, and a path that is given twice is read once; a page of null html is a
record of empty payload, one of null url has no target, and null page_ids are
told apart by their number in the file; repeated pages are records each; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import cut, fresh_dir, read, remove, remove_at_end, require

BLOCK = 1 << 20
LEVEL = 6
MARK = b"WARC/"
#: A longer header is an error.
HEADER_BYTES = 16 << 20
INDEX_SCHEMA = (
    "file string, record_no long, offset long, length long, n_bytes long, warc_type string, record_id string, target_uri string, digest string"
)
_NAMES = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]


class BadWarc(ValueError):
    """What ends a file; ``resume`` tells whether its next record can be looked for."""

    def __init__(self, reason: str, resume: bool = False):
        super().__init__(reason)
        self.resume = resume


def inflate(source) -> Iterator[bytes]:
    """The inflated blocks of a file that is one gzip stream, several, or none."""
    data = source.read(BLOCK)
    if data[:2] != b"\x1f\x8b":
        while data:
            yield data
            data = source.read(BLOCK)
        return
    stream = zlib.decompressobj(31)
    while data:
        try:
            out = stream.decompress(data, BLOCK)
        except zlib.error as e:
            raise BadWarc(str(e)) from e
        if out:
            yield out
        if stream.eof:
            data = stream.unused_data or source.read(BLOCK)
            while data and not (data := data.lstrip(b"\0")):  # padding behind a member
                data = source.read(BLOCK)
            if not data:
                return
            stream = zlib.decompressobj(31)
        else:
            data = stream.unconsumed_tail or source.read(BLOCK)
    while True:
        out = stream.decompress(b"", BLOCK)
        if not out:
            break
        yield out
    raise BadWarc("the gzip stream ends early")


class _Reader:
    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, b""

    def more(self) -> bool:
        block = next(self.blocks, None)
        if block is None:
            return False
        self.held += block
        return True

    def head(self) -> bytes | None:
        """The next record's header with the empty line, None at the end."""
        while not self.held.lstrip(b"\r\n"):
            self.held = b""
            if not self.more():
                return None
        self.held = self.held.lstrip(b"\r\n")
        start = 0
        while (end := self.held.find(b"\r\n\r\n", start)) < 0:
            if len(self.held) > HEADER_BYTES or not self.held.startswith(MARK[: len(self.held)]):
                raise BadWarc("a header has no end" if self.held.startswith(MARK) else f"no WARC header: {self.held[:40]!r}", resume=True)
            start = max(0, len(self.held) - 3)
            if not self.more():
                raise BadWarc("the file ends within a header")
        if not self.held.startswith(MARK):
            raise BadWarc(f"no WARC header: {self.held[:40]!r}", resume=True)
        head, self.held = self.held[: end + 4], self.held[end + 4 :]
        return head

    def resume(self) -> None:
        """Go on to the next line that begins like a record, or to the end."""
        self.held = self.held[1:]
        while (at := self.held.find(b"\n" + MARK)) < 0:
            self.held = self.held[-len(MARK) :]
            if not self.more():
                self.held = b""
                return
        self.held = self.held[at + 1 :]

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise BadWarc("the file ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def normalise(source, sink) -> Iterator[tuple]:
    """Rewrite one file; index rows (record_no, offset, length, n_bytes, type, id, uri, digest)."""
    reader, offset, number = _Reader(inflate(source)), 0, 0
    while True:
        try:
            head = reader.head()
            if head is None:
                return
            lines = head.split(b"\r\n")
            fields = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:] if x)}
            length = fields.get(b"content-length", "")
            if not re.fullmatch("[0-9]{1,18}", length):
                reader.held = b"\r\n" + reader.held  # the next record may begin right here
                raise BadWarc("no Content-Length", resume=True)
            member, digest = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), hashlib.sha1()
            # The member is held back until the record is whole, so a cut record leaves no trace.
            out = [member.compress(head)]
            for part in reader.body(int(length)):
                digest.update(part)
                out.append(member.compress(part))
            out.append(member.compress(b"\r\n\r\n"))
            out.append(member.flush())
        except BadWarc as e:
            yield number, None, None, None, "error", None, str(e), None
            number += 1
            if not e.resume:
                return
            try:
                reader.resume()
            except BadWarc as e:
                yield number, None, None, None, "error", None, str(e), None
                return
            continue
        size = sum(map(len, out))
        for part in out:
            sink.write(part)
        yield number, offset, size, len(head) + int(length) + 4, fields.get(b"warc-type"), fields.get(b"warc-record-id"), fields.get(b"warc-target-uri"), digest.hexdigest()
        offset += size
        number += 1


def normalise_files(paths: DataFrame, folder: str) -> DataFrame:
    """Normalise the files named in column path into ``folder``; one row a record."""
    require(paths, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for b in batches:
            for path in b.column(0).to_pylist():
                source, at = fs.FileSystem.from_uri(path)
                name = member_name(path)
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                rows: list[tuple] = []
                with source.open_input_stream(at, compression=None) as f, target.open_output_stream(part, compression=None) as g:
                    rows.extend(normalise(f, g))
                with target.open_output_stream(part + ".idx", compression=None) as g:
                    for r in rows:
                        g.write("\t".join("" if x is None else str(x) for x in r).encode() + b"\n")
                target.move(part + ".idx", f"{root}/{name}.idx")
                target.move(part, f"{root}/{name}")
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(rows[a : a + 10_000]), pa.string())]
                        + [pa.array(list(c), pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows[a : a + 10_000]))],
                        _NAMES,
                    )

    names = paths.select("path").where("path is not null").distinct()
    # A file a task: the work is in the files, not in their names.
    return names.repartitionByRange(max(1, min(names.count(), 100_000)), "path").mapInArrow(run, INDEX_SCHEMA)


def member_name(path: str) -> str:
    stem = path.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".warc")
    return f"{stem}-{hashlib.sha256(path.encode()).hexdigest()[:16]}.warc.gz"


def record(page_id, number: int, url: str | None, html: str | None) -> bytes:
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{page_id if page_id is not None else f'null-{number}'}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def write_monoliths(pages: DataFrame, folder: str) -> DataFrame:
    """Write each partition of pages as one WARC file in a single gzip stream; (path, n_records)."""
    require(pages, "page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        part = f"{name}.{uuid.uuid4().hex}"
        stream, n = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        with system.open_output_stream(part, compression=None) as f:
            for b in batches:
                for page_id, url, html in zip(*(tk.sound(c).to_pylist() if pa.types.is_string(c.type) else c.to_pylist() for c in b.columns)):
                    f.write(stream.compress(record(page_id, n, url, html)))
                    n += 1
            f.write(stream.flush())
        if not n:
            system.delete_file(part)
            return
        system.move(part, name)
        scheme = folder.split("://")[0] + "://" if "://" in folder else ""
        yield pa.RecordBatch.from_arrays([pa.array([scheme + name]), pa.array([n])], ["path", "n_records"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string, n_records long")


def op3_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of all pages' records: the pages as monolithic files, normalised; the monolithic files go at once, the others with the driver."""
    folder = fresh_dir(spark, "warc")
    files = cut(write_monoliths(read(spark, sf_dir, "pages"), f"{folder}/monolithic"), "files")
    remove_at_end(spark, folder)
    index = cut(normalise_files(files, f"{folder}/members"), "index")
    remove(spark, f"{folder}/monolithic")
    page = F.regexp_extract("record_id", r"<urn:page:(\d+)>", 1)
    return index.withColumn("page_id", F.when(page != "", page).cast("bigint"))
