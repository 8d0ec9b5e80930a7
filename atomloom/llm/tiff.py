"""Operator 10: decode TIFF media columns to one row per page.

A TIFF file is a chain of image file directories.  Each is read (classic and
BigTIFF, either byte order), its strips or tiles are decoded (none, PackBits,
LZW, deflate), predictors (horizontal differences, floating point) are undone,
and the page is emitted as a row of its shape, sample type and pixels: C order
(height, width, samples), little-endian; samples of 1, 2 or 4 bits become one
byte each.  Files are decoded where they are; there is no shuffle.

Defined cases: a null file gives one row of null shape and the error ``null``;
an empty or malformed file, or one whose directories form a ring, gives its
sound pages and then a row with the error; a page that can't be decoded (unknown
compression, short data, sizes or offsets that aren't whole numbers, more pixels
than a binary value can hold) has its error in its own row, and the next page is
still read; other columns aren't read; a key column that is named like one of
the page's columns comes out as ``file_`` and its name; repeated rows are decoded
each.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernels as tk
from .common import read, require

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
#: What a binary value can hold, with room for the rest of its row.
MAX_PAGE_BYTES = (1 << 31) - (1 << 20)
#: No compression makes more of a byte than this, so a size that would need more is wrong.
MAX_RATIO = {NONE: 1, PACKBITS: 64, DEFLATE: 1100, OLD_DEFLATE: 1100, LZW: 4096}


class BadTiff(ValueError):
    pass


def unpackbits(data: bytes, size: int) -> bytes:
    out, i, n, held = [], 0, len(data), 0
    while i < n and held < size:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            held += k + 1
            i += k + 2
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            held += 257 - k
            i += 2
        else:
            i += 1
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    size = np.diff(np.concatenate([start, [len(a)]]))
    out, literal = bytearray(), 0

    def flush(upto: int) -> None:
        for s in range(literal, upto, 128):
            part = data[s : min(s + 128, upto)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, n in zip(start[size >= 3].tolist(), size[size >= 3].tolist()):
        flush(s)
        literal = s + n
        while n:
            k = min(n, 128)
            if k == 1:
                out.extend((0, data[s]))
            else:
                out.extend((257 - k, data[s]))
            n -= k
    flush(len(a))
    return bytes(out)


_STEP = np.arange(1 << 16)
#: Width of each code behind a clear code, and where it begins in bits: the table has grown by one entry for each but the first.
_WIDTH = np.select([_STEP < 254, _STEP < 766, _STEP < 1790], [9, 10, 11], 12)
_BEGIN = np.cumsum(_WIDTH) - _WIDTH


def _lzw_codes(window: np.ndarray, at: int, n_bits: int) -> np.ndarray:
    """Codes from bit ``at`` up to and with the next clear or end code, or to the end of the data."""
    tried = 4200
    while True:
        n = min(tried, len(_STEP), int(np.searchsorted(_BEGIN + _WIDTH, n_bits - at, side="right")))
        bit = at + _BEGIN[:n]
        codes = window[bit >> 3] >> (24 - _WIDTH[:n] - (bit & 7)) & ((1 << _WIDTH[:n]) - 1)
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        if len(stop):
            return codes[: stop[0] + 1]
        if n < tried:
            return codes
        if tried >= len(_STEP):
            raise BadTiff("LZW never clears its table")
        tried *= 4


def _lzw_strings(codes: np.ndarray, size: int) -> tuple[bytes, bool]:
    """What codes without a clear code between them say, and whether all are known.

    Entry 258 + j is code j's string and the next byte of the output, so a code
    is a pointer to earlier output: lengths and bytes are found by doubling
    pointers, all at once.
    """
    known = codes <= 257 + np.arange(len(codes))
    known[:1] = codes[:1] < 256
    bad = np.flatnonzero(~known)
    if len(bad):
        codes = codes[: bad[0]]
    parent = np.where(codes < 256, -1, codes - 258)
    length = np.ones(len(codes), np.int64)
    up = parent.copy()
    while (go := np.flatnonzero(up >= 0)).size:
        length[go] += length[up[go]]
        up[go] = up[up[go]]
    last = np.cumsum(length)
    start = last - length
    total = int(last[-1]) if len(last) else 0
    if len(bad) and total < size:
        return b"", False
    owner = np.repeat(np.arange(len(codes)), length)
    at = np.arange(total)
    literal = parent[owner] < 0
    source = np.where(literal, at, start[parent[owner]] + at - start[owner])
    value = np.where(literal, codes[owner], 0).astype(np.uint8)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return value[source].tobytes(), True


def unlzw(data: bytes, size: int) -> bytes:
    """LZW with the most significant bit first and the code width raised one code early."""
    raw = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    window = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    out, held, at, n_bits = [], 0, 0, 8 * len(data)
    while held < size and n_bits - at >= 9:
        codes = _lzw_codes(window, at, n_bits)
        if not len(codes):
            break
        ends = codes[-1] in (256, 257)
        text, sound = _lzw_strings(codes[:-1] if ends else codes, size - held)
        if not sound:
            raise BadTiff("LZW has an unknown code")
        out.append(text)
        held += len(text)
        if codes[-1] != 256:
            break
        at += int(_BEGIN[len(codes) - 1] + _WIDTH[len(codes) - 1])
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(256, 9)]
    table: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    n, width, cur = 258, 9, b""
    for k in range(len(data)):
        grown = cur + data[k : k + 1]
        if grown in table:
            cur = grown
            continue
        codes.append((table[cur], width))
        table[grown] = n
        n += 1
        if n >= 512:  # the reader's table is one entry behind
            width = 10 if n < 1024 else 11 if n < 2048 else 12
        if n == 4095:
            codes.append((256, width))
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        cur = data[k : k + 1]
    if cur:
        codes.append((table[cur], width))
        n += 1
        if n >= 512:
            width = 10 if n < 1024 else 11 if n < 2048 else 12
    codes.append((257, width))
    out, value, bits = bytearray(), 0, 0
    for code, w in codes:
        value = value << w | code
        bits += w
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1
    if bits:
        out.append(value << (8 - bits))
    return bytes(out)


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression not in MAX_RATIO:
        raise BadTiff(f"compression {compression} isn't known")
    if size > len(data) * MAX_RATIO[compression] + 64:
        raise BadTiff("a strip or tile is short")
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from e
    if compression == LZW:
        return unlzw(data, size)
    return unpackbits(data, size)


@dataclass
class Page:
    number: int
    width: int | None = None
    height: int | None = None
    samples: int | None = None
    bits: int | None = None
    sample_format: str | None = None
    compression: int | None = None
    predictor: int | None = None
    tiled: bool | None = None
    pixels: bytes | None = None
    error: str | None = None


class _File:
    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM") or len(data) < 8:
            raise BadTiff("no TIFF header")
        self.order = "<" if data[:2] == b"II" else ">"
        magic = self.get("H", 2)
        if magic not in (42, 43):
            raise BadTiff("no TIFF header")
        self.big = magic == 43
        self.first = self.get("Q", 8) if self.big else self.get("I", 4)

    def get(self, code: str, at: int):
        if at + struct.calcsize("=" + code) > len(self.data):
            raise BadTiff("an offset leads out of the file")
        return struct.unpack_from(self.order + code, self.data, at)[0]

    def directory(self, at: int) -> tuple[dict[int, tuple], int]:
        n, at = (self.get("Q", at), at + 8) if self.big else (self.get("H", at), at + 2)
        entry, inline, word = (20, 8, "Q") if self.big else (12, 4, "I")
        if at + n * entry > len(self.data):
            raise BadTiff("a directory leads out of the file")
        tags = {}
        for k in range(n):
            e = at + k * entry
            tag, kind, count = self.get("H", e), self.get("H", e + 2), self.get(word, e + 4)
            if kind not in _CODES:
                continue
            size = _SIZES[kind] * count
            place = e + entry - inline if size <= inline else self.get(word, e + entry - inline)
            if place + size > len(self.data):
                raise BadTiff(f"tag {tag} leads out of the file")
            tags[tag] = struct.unpack_from(f"{self.order}{count}{_CODES[kind]}", self.data, place)
        return tags, self.get(word, at + n * entry)


def _samples(block: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str, kind: str) -> np.ndarray:
    """A decoded strip or tile as an array (rows, width, samples)."""
    line = -(-width * samples * bits // 8)
    if len(block) < rows * line:
        raise BadTiff("a strip or tile is short")
    a = np.frombuffer(block, np.uint8, rows * line)
    if bits < 8:
        if predictor != 1:
            raise BadTiff("a predictor needs samples of whole bytes")
        b = np.unpackbits(a.reshape(rows, line), axis=1)[:, : width * samples * bits].reshape(rows, width * samples, bits)
        return (b * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8).reshape(rows, width, samples)
    size = bits // 8
    if predictor == 3:
        if kind != "float":
            raise BadTiff("the floating-point predictor needs floating-point samples")
        d = np.add.accumulate(a.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, size, width * samples)
        whole = np.ascontiguousarray(d.transpose(0, 2, 1))  # the most significant byte is first
        return whole.reshape(-1).view(f">f{size}").astype(f"<f{size}").reshape(rows, width, samples)
    v = a.view(f"{order}u{size}").astype(f"<u{size}").reshape(rows, width, samples)
    if predictor == 2:
        v = np.add.accumulate(v, axis=1, dtype=v.dtype)
    elif predictor != 1:
        raise BadTiff(f"predictor {predictor} isn't known")
    return v.view(f"<f{size}") if kind == "float" else v


def _page(f: _File, tags: dict[int, tuple], page: Page) -> None:

    def whole(tag: int, default: tuple = ()) -> tuple:
        values = tags.get(tag) or default
        if values and (not isinstance(values[0], int) or min(values) < 0):
            raise BadTiff(f"tag {tag} isn't of whole numbers")
        return values

    def one(tag: int, default: int | None = None) -> int | None:
        return (whole(tag) or (default,))[0]

    page.width, page.height = one(256), one(257)
    page.samples, page.compression, page.predictor = one(277, 1), one(259, 1), one(317, 1)
    depths = whole(258, (1,))
    page.bits, page.tiled = depths[0], 322 in tags
    page.sample_format = {1: "uint", 2: "int", 3: "float"}.get(one(339, 1), "uint")
    w, h, s, bits = page.width, page.height, page.samples, page.bits
    if not w or not h or not s:
        raise BadTiff("a page has no size")
    if len(set(depths)) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64) or (page.sample_format == "float" and bits < 16):
        raise BadTiff("samples of this depth aren't supported")
    if one(266, 1) != 1:
        raise BadTiff("the reversed fill order isn't supported")
    if w * h * s * max(bits, 8) // 8 > MAX_PAGE_BYTES:
        raise BadTiff("the page is too large")
    planes = s if one(284, 1) == 2 and s > 1 else 1
    per = s // planes
    if page.tiled:
        bw, bh = one(322), one(323)
        offsets, sizes = whole(324), whole(325)
    else:
        bw, bh = w, min(one(278, h), h)
        offsets, sizes = whole(273), whole(279)
    if not bw or not bh:
        raise BadTiff("strips or tiles have no size")
    across, down = -(-w // bw), -(-h // bh)
    if len(offsets) < across * down * planes or len(sizes) < across * down * planes:
        raise BadTiff("strips or tiles are missing")
    out = None
    for k in range(across * down * planes):
        plane, rest = divmod(k, across * down)
        row, col = divmod(rest, across)
        rows = bh if page.tiled else min(bh, h - row * bh)
        raw = f.data[offsets[k] : offsets[k] + sizes[k]]
        need = rows * (-(-bw * per * bits // 8))
        block = _samples(expand(raw, page.compression, need), rows, bw, per, bits, page.predictor, f.order, page.sample_format)
        if out is None:
            out = np.zeros((h, w, s), block.dtype)
        y, x = row * bh, col * bw
        ch, cw = min(bh, h - y), min(bw, w - x)
        out[y : y + ch, x : x + cw, plane * per : (plane + 1) * per] = block[:ch, :cw]
    page.pixels = out.tobytes()


def pages(data: bytes | None) -> Iterator[Page]:
    """All pages of a file, in the order of their directories."""
    number = 0
    if data is None:
        yield Page(0, error="null")
        return
    try:
        f = _File(data)
        at, seen = f.first, set()
        while at:
            if at in seen:
                raise BadTiff("the directories form a ring")
            seen.add(at)
            tags, at = f.directory(at)
            page = Page(number)
            number += 1
            try:
                _page(f, tags, page)
            except BadTiff as e:
                page.error = str(e)
            yield page
    except BadTiff as e:
        yield Page(number, error=str(e))


def write(images: list[tuple[np.ndarray, dict]], order: str = "<", big: bool = False) -> bytes:
    """A TIFF file of (height, width, samples) arrays; options: compression, predictor, rows (of a strip), tile."""
    pack = lambda code, *v: struct.pack(order + code, *v)
    out = bytearray(b"II" if order == "<" else b"MM")
    out += pack("H", 43 if big else 42) + (pack("HHQ", 8, 0, 0) if big else pack("I", 0))
    link = 8 if big else 4
    word = "Q" if big else "I"
    for a, o in images:
        h, w, s = a.shape
        size, predictor, compression = a.dtype.itemsize, o.get("predictor", 1), o.get("compression", NONE)
        tile = o.get("tile")
        bh, bw = tile if tile else (o.get("rows", h), w)
        offsets, sizes = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                b = a[y : y + bh, x : x + bw]
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = b.copy()
                    b[:, 1:] -= b[:, :-1].copy()
                if predictor == 3:
                    rows = b.astype(b.dtype.newbyteorder(">")).tobytes()
                    d = np.frombuffer(rows, np.uint8).reshape(b.shape[0], -1, size).transpose(0, 2, 1).reshape(b.shape[0], -1, s).copy()
                    d[:, 1:] -= d[:, :-1].copy()
                    raw = d.tobytes()
                else:
                    raw = b.astype(b.dtype.newbyteorder(order)).tobytes()
                raw = {NONE: bytes, LZW: lzw, DEFLATE: zlib.compress, OLD_DEFLATE: zlib.compress, PACKBITS: packbits}[compression](raw)
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw
        long = (16, word) if big else (4, "I")
        tags = [(256, *long, [w]), (257, *long, [h]), (258, 3, "H", [8 * size] * s), (259, 3, "H", [compression]), (262, 3, "H", [1]), (277, 3, "H", [s]), (317, 3, "H", [predictor]), (339, 3, "H", [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]])]
        tags += [(322, *long, [bw]), (323, *long, [bh]), (324, *long, offsets), (325, *long, sizes)] if tile else [(273, *long, offsets), (278, *long, [bh]), (279, *long, sizes)]
        body, inline = [], 8 if big else 4
        for tag, kind, code, values in sorted(tags):
            data = pack(f"{len(values)}{code}", *values)
            if len(data) > inline:
                place = len(out)
                out += data
                data = pack(word, place)
            body.append(pack("HH" + word, tag, kind, len(values)) + data.ljust(inline, b"\0"))
        struct.pack_into(order + word, out, link, len(out))
        out += pack("Q" if big else "H", len(body)) + b"".join(body)
        link = len(out)
        out += pack(word, 0)
    return bytes(out)


ROW_SCHEMA = "page_number int, width long, height long, samples int, bits int, sample_format string, compression int, predictor int, tiled boolean, pixels binary, error string"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def decode(files: DataFrame, key: str, column: str) -> DataFrame:
    """One row per page of the TIFF files in ``column``, with the row's ``key`` (a whole number)."""
    require(files, key, column)
    fields = [x.split() for x in ROW_SCHEMA.split(", ")]
    name = f"file_{key}" if key.lower() in [n for n, _ in fields] else key
    schema = pa.schema([(name, pa.int64())] + [(n, _KINDS[k]) for n, k in fields])

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(len(schema))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                for p in pages(data.as_py()):
                    rows.append((k, p.number, p.width, p.height, p.samples, p.bits, p.sample_format, p.compression, p.predictor, p.tiled, p.pixels, p.error))
                    size += len(p.pixels or b"")
                    if size > 8 << 20:
                        yield emit(rows)
                        rows, size = [], 0
            if rows:
                yield emit(rows)

    return files.select(F.col(f"`{key}`").cast("bigint").alias(name), column).mapInArrow(run, f"`{name}` long, {ROW_SCHEMA}")


#: Width and rows of the rasters that pages are printed on, for the query.
RASTER_WIDTH, RASTER_ROWS = 128, 256


def raster(key: int | None, body: bytes) -> bytes:
    """A page's bytes as a TIFF of 8-bit rasters, whose layout and compression vary with the key."""
    k = key or 0
    per = RASTER_WIDTH * RASTER_ROWS
    images = []
    for n, at in enumerate(range(0, max(len(body), 1), per)):
        part = np.frombuffer(body[at : at + per], np.uint8)
        rows = max(1, -(-len(part) // RASTER_WIDTH))
        a = np.zeros(rows * RASTER_WIDTH, np.uint8)
        a[: len(part)] = part
        options = {"compression": (NONE, PACKBITS, LZW, DEFLATE)[(k + n) % 4], "predictor": 1 + (k // 4) % 2}
        options |= {"tile": (32, 64)} if (k // 8) % 2 else {"rows": 64}
        images.append((a.reshape(rows, RASTER_WIDTH, 1), options))
    return write(images, "<>"[(k // 16) % 2], big=(k // 32) % 2 == 1)


def as_rasters(table: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tiff): the text of each row as a TIFF file; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 500):
                part = b.slice(a, 500)
                files = [None if t is None else raster(k, t.encode()) for k, t in zip(part.column(0).to_pylist(), tk.sound(part.column(1)).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], [key, "tiff"])

    return table.select(F.col(key).cast("bigint").alias(key), text).mapInArrow(run, f"{key} long, tiff binary")


def op10_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All TIFF pages of a media column made of the pages table's bodies."""
    return decode(as_rasters(read(spark, sf_dir, "pages"), "page_id", "html"), "page_id", "tiff")
