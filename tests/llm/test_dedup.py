"""Operators 2 and 8 against brute force."""

import functools
import re

import numpy as np
import pyarrow as pa
import pytest

from atomloom.llm import common, near_dup, source_mix, suffix_dedup, url_filter
from atomloom.llm import textkernels as tk
from conftest import CLASHES, words
from helpers import in_duckdb, rows_of

SF = "/root/testdata/sf0.001"


M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ x >> 33


@functools.lru_cache(None)
def word_bits(word):
    h = 0
    for b in reversed(word.encode()):
        h = (h * BASE + b + 1) & M64
    h = mixed(h)
    return mixed((h + 0x5851F42D4C957F2D) & M64) | mixed((h + 0x14057B7EF767814F) & M64) << 64


def simhash(text):
    """The fingerprint from its definition, or None of a text without words."""
    ws = set(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower()))
    if not ws:
        return None
    out, bits = 0, [word_bits(w) for w in ws]
    for k in range(128):
        if 2 * sum(b >> k & 1 for b in bits) > len(ws):
            out |= 1 << k
    return out


def brute_groups(ids, texts):
    rows = [(i, f) for i, f in zip(ids, map(simhash, texts)) if f is not None and i is not None]
    label = {i: i for i, _ in rows}
    changed = True
    pairs = [(i, j) for i, f in rows for j, g in rows if (f ^ g).bit_count() <= near_dup.RADIUS]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def edge_rows():
    rng = np.random.default_rng(0)
    base = words(rng, 300)
    near = " ".join(w if k % 40 else "changed" for k, w in enumerate(base.split()))
    return [
        (5, base, "en", "a"),
        (3, base, "en", "a"),
        (9, near, "en", None),
        (3, base, "en", "a"),
        (7, words(rng, 250), None, "b"),
        (8, words(rng, 40_000, "long"), "en", "b"),
        (1, "", "en", "a"),
        (2, None, "en", "a"),
        (4, "?!", "en", "a"),
        (None, base, "en", "a"),
        (6, words(rng, 200), "en", "c"),
        (6, words(rng, 200), "en", "c"),
    ]


def test_near_duplicates_edges(documents):
    rows = edge_rows()
    docs = documents(rows)
    got = {r.doc_id: r for r in near_dup.mark(docs).collect()}
    want = brute_groups([r[0] for r in rows], [r[1] for r in rows])
    for i, g in want.items():
        assert got[i].group_id == g
    assert got[1].keep and got[2].keep and got[4].keep and got[None].keep
    assert got[9].group_id == 3 and not got[9].keep and got[3].group_size == 3
    left = near_dup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 6, 7, 8, None]


def test_a_fingerprint_does_not_depend_on_its_neighbours():
    rng = np.random.default_rng(8)
    text, others = words(rng, 200), [words(rng, 5) for _ in range(600)]
    alone = near_dup.fingerprints(pa.array([text]))[0][0].tolist()
    for n in (1, 2, 300, 600):
        for at in (0, n // 2, n):
            column = pa.array([*others[:at], text, *others[at:n]])
            assert near_dup.fingerprints(column)[0][at].tolist() == alone
    long = words(rng, 300_000)  # ends the chunk before it
    assert near_dup.fingerprints(pa.array([*others[:40], text, long, text]))[0][[40, 42]].tolist() == [alone, alone]


def test_fingerprints_by_hand():
    rng = np.random.default_rng(11)
    texts = [words(rng, 200), "", None, "One one ONE two", words(rng, 4000), "é É 漢", "?!", "a b"]
    fp, has = near_dup.fingerprints(pa.array(texts))
    for t, f, h in zip(texts, fp.tolist(), has):
        want = simhash(t)
        assert h == (want is not None)
        if h:
            assert f[0] | f[1] << 64 == want


def test_groups_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (sorted(map(tuple, near_dup.mark(docs.repartition(n)).collect())) for n in (1, 64))
    assert one == many


def test_crowded_blocks_are_compared_in_portions():
    rng = np.random.default_rng(12)
    fp = rng.integers(0, 2**63, (900, 2)).astype(np.uint64)
    fp[:, 0] &= ~np.uint64(0xFFFF)  # all share a block's value
    fp[450:] = fp[:450] ^ np.uint64(1 << 20)
    rep = np.arange(900)
    shard = near_dup.Shard(fp, rep)
    want = {tuple(x) for x in np.stack(shard.pairs(0, 2, fp, rep, 18)).T.tolist()}
    assert len(want) == 450
    begin, rows, post, many = (np.array(x) for x in ([0, 900, 7], [900, 3, 1], [0, 5, 900], [900, 4, 2000]))
    seen = []
    for b, r, p, m in near_dup._portions(begin, rows, post, many, 1000):
        assert (r * m).sum() <= 3000
        seen += [(x, y) for i in range(len(b)) for x in range(b[i], b[i] + r[i]) for y in range(p[i], p[i] + m[i])]
    assert sorted(seen) == sorted((x, y) for i in range(3) for x in range(begin[i], begin[i] + rows[i]) for y in range(post[i], post[i] + many[i]))


def test_invalid_utf8(spark):
    docs = spark.createDataFrame([(1, bytearray(b"some \xff words here")), (2, bytearray(b"some \xff words here"))], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) as text")
    got = near_dup.mark(docs).collect()
    assert {r.group_id for r in got} == {1}


def test_copies_in_unequal_chunks_are_one_group(documents):
    rng = np.random.default_rng(9)
    text = words(rng, 300)
    rows = [(1, text, "en", "a"), *[(2 + k, words(rng, 500), "en", "a") for k in range(500)], (600, text, "en", "a")]
    got = {r.doc_id: r.group_id for r in near_dup.groups(documents(rows).coalesce(1)).collect()}
    assert got[600] == 1 and len(got) == 502


def test_near_duplicates_empty(documents):
    docs = documents([(1, "a", "en", "s")]).where("false")
    assert near_dup.mark(docs).count() == 0 and near_dup.drop_near_duplicates(docs).count() == 0


def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pdf = docs.toPandas()
    want = brute_groups(pdf.doc_id.tolist(), pdf.text.tolist())
    got = {r.doc_id: r.group_id for r in near_dup.op2_near_duplicates(spark, SF).collect()}
    assert {k: got[k] for k in want} == want and len(got) == len(pdf)


def test_shards_of_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SHARD_ROWS", 70)  # three shards
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pdf = docs.toPandas()
    want = brute_groups(pdf.doc_id.tolist(), pdf.text.tolist())
    assert {r.doc_id: r.group_id for r in near_dup.groups(docs).collect()} == want


def test_bk_tree_is_exact():
    rng = np.random.default_rng(1)
    values = rng.permutation(65536)[:4000].astype(np.uint16)
    queries = rng.integers(0, 65536, 300).astype(np.uint16)
    tree = near_dup.BKTree(values)
    for radius in (0, 1, 2, 5):
        q, n = tree.within(queries, radius)
        got = set(zip(q.tolist(), n.tolist()))
        d = np.bitwise_count(queries[:, None] ^ values[None])
        assert got == set(zip(*map(list, np.nonzero(d <= radius)))) and len(q) == len(got)
    assert len(near_dup.BKTree(values[:1]).within(queries, 16)[0]) == 300
    assert len(near_dup.BKTree(values[:0]).within(queries, 16)[0]) == 0


def test_block_radii_miss_nothing():
    rng = np.random.default_rng(2)
    radii = near_dup.block_radii()
    assert sum(r + 1 for r in radii) == near_dup.RADIUS + 1
    for _ in range(2000):
        bits = rng.permutation(128)[: near_dup.RADIUS]
        per = np.bincount(bits // 16, minlength=8)
        assert (per <= np.array(radii)).any()


def test_shard_pairs_match_all_pairs():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 2**63, (400, 2)).astype(np.uint64)
    for k in range(200, 400):  # neighbours of the first ones
        fp[k] = fp[k - 200]
        for b in rng.permutation(128)[: rng.integers(1, 25)]:
            fp[k, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    rep = np.arange(400)
    shard = near_dup.Shard(fp, rep)
    edges = [np.stack(shard.pairs(j, r, fp, rep, near_dup.RADIUS)) for j, r in enumerate(near_dup.block_radii())]
    a, b = near_dup.forest(*np.concatenate(edges, axis=1))
    d = np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1)
    i, j = np.nonzero((d <= near_dup.RADIUS) & (rep[:, None] < rep[None]))
    c, e = near_dup.forest(i, j)
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(c.tolist(), e.tolist())) and len(a) > 50


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    got = {r.node: r.label for r in near_dup.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100, 102: 100}


# Op 8


def brute_repeats(rows):
    first = {}
    for d, c, w in sorted(rows, key=lambda r: (r[0], r[1])):
        for p in range(len(w) - suffix_dedup.WINDOW + 1):
            first.setdefault(tuple(w[p : p + suffix_dedup.WINDOW]), (d, c, p))
    out = []
    for d, c, w in rows:
        run = []
        for p in range(len(w) - suffix_dedup.WINDOW + 1):
            if first[tuple(w[p : p + suffix_dedup.WINDOW])] != (d, c, p):
                if run and p <= run[-1][1] - suffix_dedup.WINDOW + 1:
                    run[-1][1] = p + suffix_dedup.WINDOW
                else:
                    run.append([p, p + suffix_dedup.WINDOW])
        out += [(d, a, b) for a, b in run]
    return sorted(out)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(4)
    for _ in range(60):
        x = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 120)))
        sa = suffix_dedup.suffix_array(x)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: tuple(x[i:].tolist()))
        lcp = suffix_dedup.common_prefixes(x, sa)
        for i in range(1, len(x)):
            a, b = x[sa[i - 1] :], x[sa[i] :]
            n = min(len(a), len(b))
            same = np.cumprod(a[:n] == b[:n]).sum()
            assert lcp[i] == same


@pytest.mark.parametrize("shard_words", [300, 1 << 20])
def test_repeats_edges(documents, shard_words):
    rng = np.random.default_rng(5)
    shared, other = words(rng, 70, "s"), words(rng, 50, "o")
    rows = [(20 + k, f"{words(rng, 90)} {shared} {words(rng, 60)}", "en", "a") for k in range(12)]
    rows += [
        (1, f"{shared} {other}", "en", "a"),
        (2, f"{words(rng, 5)} {other}", "en", "a"),
        (3, " ".join(other.split()[:49]), "en", "a"),  # a word too short
        (4, "", "en", "a"),
        (5, None, None, None),
        (6, f"{shared} x {shared}", "en", "a"),
        (7, words(rng, 30_000, "long"), "en", "a"),
        (None, shared, "en", "a"),
        (8, shared.upper().replace(" ", ",  "), "en", "a"),
    ]
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeats(documents(rows).repartition(5), shard_words).collect())
    lists = [(i, 0, (t or "").lower().replace(",", " ").split()) for i, t, _, _ in rows if i is not None]
    want = brute_repeats(lists)
    assert got == want
    assert {d for d, _, _ in got} == {2, 6, 8, *range(20, 32)}


def test_repeats_of_a_document_of_id_minus_one(documents):
    rng = np.random.default_rng(10)
    shared = words(rng, 60)
    docs = documents([(-2, " ".join(shared.split()[:30]), "en", "a"), (-1, shared, "en", "a"), (0, shared, "en", "a"), (5, shared, "en", "a")])
    for n in (1, 4):
        got = suffix_dedup.repeats(docs.repartition(n)).collect()
        assert sorted((r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in got) == [(0, 0, 60, -1), (5, 0, 60, -1)]


def test_repeats_do_not_depend_on_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = sorted(in_duckdb(suffix_dedup.OP8_SQL, "/root/testdata/sf0.01").astype(int)[["doc_id", "start_word", "end_word", "n_words", "first_doc_id"]].values.tolist())
    for n, size in ((1, 1 << 20), (12, 3000)):
        assert sorted(map(list, suffix_dedup.repeats(docs.repartition(n), size).collect())) == want


def test_dropping_repeats(documents):
    rng = np.random.default_rng(14)
    passage = words(rng, 60, "É")
    rows = [(1, f"Start, {passage}. End", "en", "a"), (2, f"«Un» {passage}! fin\n", "fr", "a"), (3, passage, "fr", "a"), (3, "Other", "fr", "a"), (None, passage, "en", "a"), (4, None, "en", "a"), (5, "", None, None)]
    docs = documents(rows)
    left = suffix_dedup.drop_repeats(docs)
    assert left.columns == docs.columns
    got = sorted((repr(r.doc_id), r.text or "") for r in left.collect())
    assert got == sorted([("1", rows[0][1]), ("2", "«Un» ! fin\n"), ("3", ""), ("3", "Other"), ("None", passage), ("4", ""), ("5", "")])
    again = suffix_dedup.repeats(left)
    assert again.count() == 0
    assert suffix_dedup.drop_repeats(docs.where("false")).count() == 0


def test_shuffles_instead_of_broadcasts(spark, monkeypatch, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    small = (sorted(map(tuple, suffix_dedup.repeats(docs).collect())), sorted(map(tuple, near_dup.drop_near_duplicates(docs).select("doc_id").collect())))
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    out = suffix_dedup.repeats(docs)
    assert sorted(map(tuple, out.collect())) == small[0]
    assert sorted(map(tuple, near_dup.drop_near_duplicates(docs).select("doc_id").collect())) == small[1]
    mixed = source_mix.select_documents(docs)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(in_duckdb(f"SELECT doc_id FROM ({source_mix.OP6_SQL})").doc_id)
    assert rows_of(url_filter.op1_url_filter(spark, SF).toPandas()) == rows_of(in_duckdb(url_filter.OP1_SQL))


def test_repeated_rows_and_empty_tables(documents):
    rng = np.random.default_rng(6)
    t = words(rng, 80)
    got = suffix_dedup.repeats(documents([(1, t, "en", "a"), (1, t, "en", "a"), (2, words(rng, 80), "en", "a")])).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.first_doc_id) for r in got] == [(1, 0, 80, 1)]
    assert suffix_dedup.repeats(documents([(1, t, "en", "a")]).where("false")).count() == 0


def test_repeats_of_the_test_table(spark):
    pdf = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    rows = []
    for i, t in zip(pdf.doc_id, pdf.text):
        rows.append((i, 0, tk.word_hashes(pa.array([t]))[0].tolist()))
    got = sorted((r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.op8_suffix_dedup(spark, SF).collect())
    assert got == brute_repeats(rows) and got


def test_merging_runs_keeps_the_least():
    rng = np.random.default_rng(7)
    runs, least = [], {}
    for shard in range(7):
        fp = np.unique(rng.integers(0, 300, 120)).astype(np.uint64)
        doc, pos = rng.integers(0, 50, len(fp)), rng.integers(0, 9, len(fp))
        runs.append((fp, doc, np.zeros(len(fp), np.int64), pos))
        for f, d, p in zip(fp.tolist(), doc.tolist(), pos.tolist()):
            least[f] = min(least.get(f, (99, 0, 0)), (d, 0, p))
    total = suffix_dedup.merge_runs(runs)
    assert {f: (d, c, p) for f, d, c, p in zip(*(x.tolist() for x in total))} == least
    assert (np.diff(total[0].astype(np.int64)) > 0).all()


def test_clashing_names_stay(documents):
    assert set(CLASHES) <= set(documents([(1, "a b", "en", "s")]).columns)
