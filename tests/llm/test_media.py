"""Operators 1, 3 and 10."""

import gzip
import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from atomloom.llm import common, tiff, url_filter, warc
from helpers import in_duckdb, rows_of

SF = "/root/testdata/sf0.001"

# 1: URLs


def test_url_filter_against_sql(spark):
    got = url_filter.op1_url_filter(spark, SF).toPandas()
    assert rows_of(got) == rows_of(in_duckdb(url_filter.OP1_SQL))


def by_hand(url):
    """Expressions of a URL, from the definition."""
    rest = url.split("//", 1)[1]
    for k, c in enumerate(rest):
        if c in "/?#":
            host, tail = rest[:k], rest[k:]
            break
    else:
        host, tail = rest, ""
    host = host.rsplit("@", 1)[-1]
    host = (host[: host.index("]") + 1] if host[:1] == "[" else host.split(":")[0]).lower().removesuffix(".")
    tail = tail.split("#")[0]
    path, mark, query = tail.partition("?")
    path = path or "/"
    labels = host.split(".")
    hosts = {host}
    if not host.replace(".", "").isdigit() and host[:1] != "[":
        hosts |= {".".join(labels[-n:]) for n in range(2, min(5, len(labels)))}
        if len(labels) > 5:
            hosts.add(".".join(labels[-5:]))
    dirs = path.split("/")[1:-1]
    paths = {path + mark + query, path, *("/" + "".join(f"{d}/" for d in dirs[:n]) for n in range(min(4, len(dirs) + 1)))}
    return {h + p for h in hosts for p in paths}


URLS = [
    "http://a.b.c.d.e.f.g/1/2/3/4/5.html?x=1#q",
    "http://1.2.3.4/",
    "ftp://u:p@H.Example.com:80",
    "https://example.com?q",
    "http://a.b/c/d/",
    "http://localhost/x",
    "http://one.two.three.four.five/",
    "//cdn.example.net./x//y?a=b?c",
    "http://u@[2001:DB8::1.2.3.4]:8080/a/b",
]


def test_expressions(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, URLS[0], None, "nonsense", ""]], "url string")
    got = {}
    for r in url_filter.expressions(df).collect():
        got.setdefault(r.url, []).append(r.expression)
    assert {u: sorted(x) for u, x in got.items()} == {u: sorted(by_hand(u)) for u in URLS}


def test_rule_precedence_and_edges(spark):
    rules = spark.createDataFrame(
        [(1, "b.com/", "block", 1), (2, "a.b.com/", "allow", 1), (3, "a.b.com/x/", "review", 0), (4, "c.com/", "block", 5), (5, "c.com/", "allow", 5), (6, None, "block", 9), (7, "", "block", 9), (8, "d.com/", None, 9), (9, "e.com/", "block", None)],
        "rule_id long, expression string, action string, priority int",
    )
    rows = [(1, "http://a.b.com/x/y"), (2, "http://q.b.com/"), (3, "http://c.com/"), (4, "http://d.com/"), (5, None), (6, "no url"), (None, "http://b.com"), (2, "http://q.b.com/"), (7, "http://e.com/")]
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in rows], "page_id long, url string, verdict string, rule_id string, digest string")
    got = sorted((repr(r.page_id), r.verdict, r.rule_id) for r in url_filter.apply_rules(pages, rules).collect())
    want = [(1, "allow", 2), (2, "block", 1), (3, "block", 4), (4, "allow", None), (5, "invalid", None), (6, "invalid", None), (None, "block", 1), (2, "block", 1), (7, "block", 9)]
    assert got == sorted((repr(a), b, c) for a, b, c in want)
    assert url_filter.apply_rules(pages.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.apply_rules(pages, rules.where("false")).collect()} == {"allow", "invalid"}


def test_deep_rules_match(spark):
    rules = spark.createDataFrame(
        [(1, "example.com/a/b/c/d/", "block", 1), (2, "c.d.e.f.g.com/", "review", 1), (3, "deep.org/1/2/3/4/5/6/", "block", 1)], "rule_id long, expression string, action string, priority int"
    )
    rows = [(1, "http://www.example.com/a/b/c/d/e/f.html"), (2, "http://a.b.c.d.e.f.g.com/x"), (3, "http://deep.org/1/2/3/4/5/6/7/?q=1"), (4, "http://example.com/a/b/c/x/"), (5, "http://d.e.f.g.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.rule_id) for r in url_filter.apply_rules(pages, rules).collect()}
    assert got == {1: ("block", 1), 2: ("review", 2), 3: ("block", 3), 4: ("allow", None), 5: ("allow", None)}


# 3: WARC


def records(n=5):
    return [warc.record(k, k, f"http://x/{k}", "é" * (k * 1000)) for k in range(n)]


@pytest.mark.parametrize("pack", [gzip.compress, lambda b: b, lambda b: b"".join(gzip.compress(b[k : k + 7001]) for k in range(0, len(b), 7001))])
def test_members_are_records(pack):
    sink = io.BytesIO()
    rows = list(warc.normalise(io.BytesIO(pack(b"".join(records()))), sink))
    data = sink.getvalue()
    assert [r[0] for r in rows] == list(range(5)) and sum(r[2] for r in rows) == len(data)
    for (_, offset, length, size, kind, rid, uri, _), whole in zip(rows, records()):
        assert gzip.decompress(data[offset : offset + length]) == whole and size == len(whole)
        assert kind == "response" and uri.endswith(rid[10:-1])
    assert gzip.decompress(data) == b"".join(records())
    again = io.BytesIO()
    assert list(warc.normalise(io.BytesIO(data), again)) == rows and again.getvalue() == data


def test_broken_files():
    whole = gzip.compress(b"".join(records()))
    for bad in (whole[: len(whole) // 2], whole[:-4] + b"\0\0\0\0", gzip.compress(b"".join(records()) + b"junk\r\n\r\n"), gzip.compress(b"".join(records())[:-3000])):
        sink = io.BytesIO()
        rows = list(warc.normalise(io.BytesIO(bad), sink))
        assert rows[-1][4] == "error" and rows[-1][1] is None
        assert [gzip.decompress(sink.getvalue()[r[1] : r[1] + r[2]]) for r in rows[:-1]] == records()[: len(rows) - 1]
    assert list(warc.normalise(io.BytesIO(b""), io.BytesIO())) == []


def test_reading_goes_on_behind_a_bad_record():
    good = records()
    no_length = b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"
    odd = b"WARC/1.0\r\nContent-Length: \xc2\xb2\r\n\r\nab\r\n\r\n"
    huge = b"WARC/1.0\r\nContent-Length: " + b"9" * 5000 + b"\r\n\r\n"
    short = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabcdefgh WARC/ \r\n\r\n"
    endless = b"WARC/1.0\r\n" + b"X: y\r\n" * (25 << 17)
    for bad in (no_length, odd, huge, b"junk\r\n\r\n", b"junk" * 400_000 + b"\r\n", endless):
        for pack in (gzip.compress, bytes):
            sink = io.BytesIO()
            rows = list(warc.normalise(io.BytesIO(pack(b"".join([*good[:2], bad, *good[2:]]))), sink))
            assert [r[4] for r in rows] == ["response"] * 2 + ["error"] + ["response"] * 3
            assert [r[0] for r in rows] == list(range(6))
            data = sink.getvalue()
            assert [gzip.decompress(data[r[1] : r[1] + r[2]]) for r in rows if r[1] is not None] == good
    rows = list(warc.normalise(io.BytesIO(b"".join([good[0], short, good[1]])), io.BytesIO()))
    assert [r[4] for r in rows] == ["response", None, "error", "response"]
    padded = gzip.compress(good[0]) + b"\0" * (3 * warc.BLOCK) + gzip.compress(good[1]) + b"\0" * (2 * warc.BLOCK + 5)
    assert [r[4] for r in warc.normalise(io.BytesIO(padded), io.BytesIO())] == ["response"] * 2


def test_files_of_one_name_do_not_meet(spark, tmp_path):
    paths = []
    for k, name in enumerate(("a/x.warc.gz", "b/x.warc.gz", "b/x.warc")):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"".join(records(k + 2)))
        paths.append((f"file://{f}",))
    table = spark.createDataFrame([*paths, paths[0], (None,)], "path string")
    rows = warc.normalise_files(table, f"file://{tmp_path}/out").collect()
    assert len(rows) == 2 + 3 + 4 and len({r.file for r in rows}) == 3
    for r in rows:
        data = (tmp_path / "out" / r.file).read_bytes()[r.offset : r.offset + r.length]
        assert len(gzip.decompress(data)) == r.n_bytes


def test_warc_query_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>", 1), (2, None, None, 2), (None, "http://b", "", 3), (1, "http://a", "<p>é</p>", 4), (3, "http://c", "x" * 3_000_000, 5)], "page_id long, url string, html string, offset int")
    folder = f"file://{tmp_path}"
    paths = warc.write_monoliths(pages.repartition(2), folder + "/in")
    assert paths.count() == 2
    rows = warc.normalise_files(paths, folder + "/out").collect()
    assert len(rows) == 5
    for r in rows:
        data = (tmp_path / "out" / r.file).read_bytes()[r.offset : r.offset + r.length]
        body = gzip.decompress(data)
        assert len(body) == r.n_bytes and body.endswith(b"\r\n\r\n") and zlib.decompressobj(31).decompress(data) == body
        assert (r.target_uri is None) == (b"WARC-Target-URI" not in body)
    for f in {r.file for r in rows}:
        index = (tmp_path / "out" / f"{f}.idx").read_text().splitlines()
        assert [x.split("\t")[1] for x in index] == [str(r.offset) for r in sorted((r for r in rows if r.file == f), key=lambda r: r.record_no)]
    assert warc.write_monoliths(pages.where("false"), folder + "/none").count() == 0
    assert warc.normalise_files(spark.createDataFrame([(None,)], "path string"), folder + "/o2").count() == 0


def test_warc_query_has_all_pages(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(warc, "fresh_dir", lambda s, n: folders.append(common.fresh_dir(s, n)) or folders[-1])
    got = warc.op3_warc_members(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages)
    root = folders[0].removeprefix("file://") + "/members/"
    for r in got:
        with open(root + r.file, "rb") as f:
            f.seek(r.offset)
            whole = gzip.decompress(f.read(r.length))
        page = pages[r.page_id]
        assert whole == warc.record(r.page_id, 0, page.url, page.html) and r.target_uri == page.url
        assert hashlib.sha1(whole.split(b"\r\n\r\n", 1)[1][:-4]).hexdigest() == r.digest


# 10: TIFF


def test_codecs_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 300, 4095, 70_000):
        for data in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), rng.integers(0, 3, n).astype(np.uint8).tobytes(), b"a" * n):
            assert tiff.unlzw(tiff.lzw(data), n) == data
            assert tiff.unpackbits(tiff.packbits(data), n) == data


def test_known_streams():
    # The usual example of PackBits, and an LZW stream packed by hand: clear, 7, 258, 8, 8, 258, 6, end.
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert tiff.unpackbits(packed, 24).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 257))
    data = int(bits.ljust(72, "0"), 2).to_bytes(9, "big")
    assert tiff.unlzw(data, 100) == bytes([7, 7, 7, 8, 8, 7, 7, 6])
    assert tiff.lzw(bytes([7, 7, 7, 8, 8, 7, 7, 6])) == data


@pytest.mark.parametrize("dtype", ["u1", "u2", "u4", "i2", "f4", "f8"])
def test_pages_round_trip(dtype):
    rng = np.random.default_rng(1)
    for compression in (1, 5, 8, 32946, 32773):
        for predictor in (1, 3) if dtype[0] == "f" else (1, 2):
            for layout in ({"rows": 7}, {"tile": (16, 32)}):
                for order in "<>":
                    a = (rng.random((33, 50, 3)) * 200).astype(dtype)
                    b = (rng.random((5, 4, 1)) * 200).astype(dtype)
                    o = layout | {"compression": compression, "predictor": predictor}
                    got = list(tiff.pages(tiff.write([(a, o), (b, o)], order, big=order == ">")))
                    assert [p.error for p in got] == [None, None]
                    assert got[0].pixels == a.tobytes() and got[1].pixels == b.tobytes()
                    assert (got[0].width, got[0].height, got[0].samples, got[0].bits) == (50, 33, 3, 8 * a.itemsize)


def test_bilevel_page():
    raw = bytes([0b10110000, 0b00100000])  # two rows of four pixels and padding
    head = bytearray(tiff.write([(np.frombuffer(raw, np.uint8).reshape(2, 1, 1), {})]))
    at = int.from_bytes(head[4:8], "little")
    for k in range(int.from_bytes(head[at : at + 2], "little")):
        e = at + 2 + 12 * k
        tag = int.from_bytes(head[e : e + 2], "little")
        if tag == 256:
            head[e + 8 : e + 12] = (4).to_bytes(4, "little")
        if tag == 258:
            head[e + 8 : e + 12] = (1).to_bytes(4, "little")
    (p,) = tiff.pages(bytes(head))
    assert p.error is None and list(p.pixels) == [1, 0, 1, 1, 0, 0, 1, 0]


def test_malformed_files():
    good = tiff.write([(np.zeros((4, 4, 1), np.uint8), {"compression": 5})])
    assert [p.error for p in tiff.pages(None)] == ["null"]
    for bad in (b"", b"II", b"hello world", good[:20]):
        (p,) = tiff.pages(bad)
        assert p.error
    ring = bytearray(good)
    ring[-4:] = ring[4:8]
    got = list(tiff.pages(bytes(ring)))
    assert got[0].error is None and "ring" in got[1].error
    unknown = good.replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x05\x00", b"\x03\x01\x03\x00\x01\x00\x00\x00\x63\x00")
    assert "99" in next(tiff.pages(unknown)).error
    rng = np.random.default_rng(2)
    for _ in range(300):  # never anything but rows
        b = bytearray(good)
        for k in rng.integers(0, len(b), 4):
            b[k] = rng.integers(0, 256)
        list(tiff.pages(bytes(b)))


def test_no_tag_ends_a_job():
    """Any kind and value of any tag gives rows, never an exception."""
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 255, (9, 7, 3)).astype(np.uint8), np.ones((3, 3, 1), np.uint8)
    files = [tiff.write([(a, {"compression": c, "rows": 4} | tile), (b, {})], o, big) for c in (1, 5, 8, 32773) for o in "<>" for big in (False, True) for tile in ({}, {"tile": (16, 16)})]
    errors = 0
    for n in range(1500):
        data = bytearray(files[n % len(files)])
        f = tiff._File(bytes(data))
        entry, size = (f.first + 8, 20) if f.big else (f.first + 2, 12)
        e = entry + size * int(rng.integers(0, f.get("Q" if f.big else "H", f.first)))
        struct.pack_into(f.order + "H", data, e + 2, int(rng.choice([1, 3, 4, 6, 8, 9, 11, 12, 13, 16, 17, 18, 5, 99])))
        for k in rng.integers(0, size - 4, int(rng.integers(0, 8))):
            data[e + 4 + int(k)] = int(rng.choice([0, 255, 128, 1, int(rng.integers(0, 256))]))
        errors += sum(p.error is not None for p in tiff.pages(bytes(data)))
    assert errors > 500


def test_sizes_that_the_data_can_not_fill():
    good = bytearray(tiff.write([(np.zeros((4, 4, 1), np.uint8), {"compression": 8, "tile": (16, 16)})]))
    f = tiff._File(bytes(good))
    for k in range(f.get("H", f.first)):
        e = f.first + 2 + 12 * k
        if f.get("H", e) in (322, 323):  # tile sizes of 2**32 - 1
            struct.pack_into("<I", good, e + 8, (1 << 32) - 1)
    (p,) = tiff.pages(bytes(good))
    assert p.error == "a strip or tile is short" and p.pixels is None


def test_key_named_like_a_page_column(spark):
    files = spark.createDataFrame([(1, bytearray(tiff.write([(np.ones((2, 3, 1), np.uint8), {})])))], "width long, f binary")
    (r,) = tiff.decode(files, "width", "f").collect()
    assert r.file_width == 1 and (r.width, r.height) == (3, 2)


def test_long_url(spark):
    rules = spark.createDataFrame([(1, "example.com/a/", "block", 1)], "rule_id long, expression string, action string, priority int")
    pages = spark.createDataFrame([(1, "http://example.com/a/" + "b/" * 200_000 + "?" + "q" * 100_000), (2, "http://" + "x." * 5000 + "example.com/a/b")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_filter.apply_rules(pages, rules).collect()} == {1: "block", 2: "block"}


def test_tiff_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()}
    body = {}
    for r in tiff.op10_tiff_pages(spark, SF).orderBy("page_id", "page_number").collect():
        assert r.error is None
        body[r.page_id] = body.get(r.page_id, b"") + bytes(r.pixels)
    assert {k: v.rstrip(b"\0") for k, v in body.items()} == {k: v.encode() for k, v in pages.items()}


def test_tiff_edges(spark):
    table = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x", "c"), (3, "y" * 200_000, "d"), (3, "y", "e")], "page_id long, html string, pixels string")
    got = tiff.decode(tiff.as_rasters(table, "page_id", "html"), "page_id", "tiff").collect()
    assert sorted((repr(r.page_id), r.page_number) for r in got) == sorted([("1", 0), ("2", 0), ("None", 0), ("3", 0), *(("3", k) for k in range(7))])
    assert [r.error for r in got if r.page_id == 1] == ["null"]
    assert tiff.decode(tiff.as_rasters(table.where("false"), "page_id", "html"), "page_id", "tiff").count() == 0
