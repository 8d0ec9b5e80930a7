"""Operators 4, 5, 6, 7 and 9."""

import math
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from atomloom.llm import decontaminate, language_id, source_mix, token_count, token_file
from atomloom.llm import textkernels as tk
from conftest import words

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def by_hand(t):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())


def test_words_by_hand():
    texts = ["Ab, cd-EF 12", None, "", "ÉtÉ été\nx", "...", "a" * 5000, "Ünï ü", "b"]
    h, s, e, cuts, off = tk.word_hashes(pa.array(texts))
    low = "".join((t or "").lower() for t in texts).encode()
    flat = [low[a:b].decode() for a, b in zip(s, e)]
    assert [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])] == [by_hand(t) for t in texts]
    seen = {}
    for w, x in zip(flat, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# 4: language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    model = language_id.fit(docs, sample_rows=400)
    got = language_id.identify(docs, model).join(docs.selectExpr("doc_id", "lang", "xxhash64(doc_id, text) AS h"), "doc_id").toPandas().sort_values("h")
    unseen = got.iloc[400:]  # the sample is of the least hashes
    assert len(unseen) > 500 and (unseen.lang_pred == unseen.lang).mean() > 0.97
    assert got.accepted.mean() > 0.99
    # Texts in none of the languages.
    rng = np.random.default_rng(15)
    junk = ["".join(rng.choice(list(a), 600)) for a in ("0123456789abcdef", "абвгдежзиклмнопрстуфх ", "abcdefghijklmnopqrstuvwxyz ") for _ in range(50)]
    p, _ = model.probabilities(pa.array(junk))
    assert (p.max(axis=1) < language_id.MIN_PROB).mean() > 0.9
    assert 0.01 < (model.table != 0).mean() < 0.5


def test_language_scores_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    pdf = docs.limit(5).toPandas()
    p, has = model.probabilities(pa.array([x[:400] for x in pdf.text]))
    for t, row in zip((x[:400] for x in pdf.text), p):
        z, n = np.zeros(len(model.classes)), 0
        cp = np.array([ord(c) for c in t.lower()], np.uint32)
        for order in language_id.ORDERS:
            for i in range(len(cp) - order + 1):
                g, _ = language_id.ngrams(pa.array(["".join(map(chr, cp[i : i + order]))]))
                z += model.table[g[order - 1][0]]
                n += 1
        z = (z / n * model.scale + model.bias) / model.temperature
        e = np.exp(z - z.max())
        assert row == pytest.approx(e / e.sum(), abs=1e-5)


def ftrl_by_hand(rows, n_features, classes, epochs, seed, held):
    """Follow the regularised leader, a weight at a time."""
    import math

    A, B, L1, L2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    z = {}
    n = {}

    def weight(f, k):
        v = z.get((f, k), 0.0)
        if f == n_features:
            return -v / ((B + math.sqrt(n.get((f, k), 0.0))) / A)
        return 0.0 if abs(v) <= L1 else -(v - math.copysign(L1, v)) / ((B + math.sqrt(n.get((f, k), 0.0))) / A + L2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation([i for i in range(len(rows)) if not held(i)]):
            x, y = rows[i]
            x = {**x, n_features: 1.0}
            w = {(f, k): weight(f, k) for f in x for k in range(classes)}
            s = [sum(x[f] * w[f, k] for f in x) for k in range(classes)]
            e = [math.exp(v - max(s)) for v in s]
            for f in x:
                for k in range(classes):
                    g = x[f] * (e[k] / sum(e) - (k == y))
                    old = n.get((f, k), 0.0)
                    z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / A * w[f, k]
                    n[f, k] = old + g * g
    return weight


def test_training_by_hand():
    texts = ["der und die", "the and of", "le la les", "und das der", "of the is", "les des la", "die das", "is and", "la le un"]
    labels = ["de", "en", "fr"] * 3
    df = np.ones(1 << language_id.HASH_BITS, np.int64)
    model = language_id.train(pa.array(texts), labels, df, 3)
    idf = math.log((1 + 3) / (1 + 1)) + 1
    rows = []
    for t, y in zip(texts, labels):
        grams = np.concatenate(language_id.ngrams(pa.array([t]))[0]).tolist()
        rows.append(({f: grams.count(f) / len(grams) * idf * language_id.SCALE for f in set(grams)}, ["de", "en", "fr"].index(y)))
    weight = ftrl_by_hand(rows, 1 << language_id.HASH_BITS, 3, language_id.EPOCHS, 7, lambda i: i % language_id.HELD_OUT == language_id.HELD_OUT - 1)
    for f in {f for x, _ in rows for f in x}:
        assert model.table[f] == pytest.approx([weight(f, k) * idf for k in range(3)], abs=1e-5)
    assert model.bias == pytest.approx([weight(1 << language_id.HASH_BITS, k) for k in range(3)], abs=1e-9)


def test_document_frequency_by_hand(documents):
    texts = ["abc", "abc abc", None, "", "é", "b"]
    docs = documents([(i, t, "en", "s") for i, t in enumerate(texts)])
    df, n = language_id.document_frequency(docs)
    want = np.zeros_like(df)
    for t in texts:
        g, _ = language_id.ngrams(pa.array([t or ""]))
        for f in set(np.concatenate(g).tolist()):
            want[f] += 1
    assert n == 6 and (df == want).all()


def test_language_edges(documents):
    rows = [(i, f"the cat and the dog {i}", "en", "a") for i in range(30)] + [(100 + i, f"der Hund und die Katze {i}", "de", "a") for i in range(30)]
    rows += [(200, None, "en", "a"), (201, "", None, None), (202, "123 !!", "en", "a"), (None, "the dog and the cat", None, "a"), (203, "der und die " * 50_000, None, "a"), (203, "der und die", None, "a")]
    docs = documents(rows)
    got = language_id.identify(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert by[None].lang_pred == "en" and by[203].lang_pred == "de" and by[5].lang_pred == "en" and by[103].accepted
    assert [by[i].lang_pred for i in (200, 201, 202)] == [None] * 3 and not any(by[i].accepted for i in (200, 201, 202))
    left = language_id.keep_accepted(docs)
    assert left.columns == docs.columns and left.count() == len(rows) - 3
    assert language_id.identify(docs.where("false")).count() == 0
    none = language_id.identify(documents([(1, "x y", None, "a")])).collect()
    assert none[0].lang_pred is None and not none[0].accepted
    one = language_id.identify(documents([(1, "x y", "en", "a"), (2, "zz", None, "a")])).collect()
    assert all(r.lang_pred == "en" for r in one)


def test_temperature():
    rng = np.random.default_rng(0)
    true = rng.normal(0, 2, (4000, 3))
    p = np.exp(true) / np.exp(true).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert language_id.temperature(true * 5, y) == pytest.approx(5, rel=0.15)


# 5: token counts


def test_counts_match_another_unigram_program(spark):
    from tokenizers import Tokenizer, models

    scores = token_count.pieces(token_count.VOCABULARY)
    program = Tokenizer(models.Unigram([("<unk>", -5.0), *scores.items()], 0, False))
    pdf = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {r.doc_id: r for r in token_count.op5_token_count(spark, SF).collect()}
    for i, t in zip(pdf.doc_id, pdf.text):
        assert got[i].n_tokens == sum(len(program.encode(token_count.WORD_MARK + w).ids) for w in t.split())
        assert got[i].n_pretokens == len(t.split())


def best_segmentation(w, scores, unknown):
    """(score, tokens) by trying all; of equal scores the longer last piece, then the same for what is before it."""
    if not w:
        return 0.0, 0
    top = (-np.inf, 0)
    for k in range(len(w)):
        if w[k:] in scores:
            s, n = best_segmentation(w[:k], scores, unknown)
            if scores[w[k:]] + s > top[0]:
                top = scores[w[k:]] + s, n + 1
    if w[-1] not in scores:
        s, n = best_segmentation(w[:-1], scores, unknown)
        if s + unknown > top[0]:
            top = s + unknown, n + len(w[-1].encode())
    return top


def test_counts_by_brute_force():
    scores = {"a": -1.0, "b": -1.5, "ab": -1.7, "ba": -3.0, "aba": -2.9, "▁": -0.5, "▁a": -0.9}
    trie = token_count.Trie(token_count.Vocabulary(scores))
    rng = np.random.default_rng(1)
    some = sorted({"▁" + "".join(rng.choice(list("abé🙂"), rng.integers(1, 8))) for _ in range(200)})
    for part in (some[::3], some[1::3], some[2::3], some):  # later chunks find the nodes of earlier ones
        got = trie.counts(pa.array(part)).tolist()
        assert got == [best_segmentation(w, scores, trie.vocabulary.unknown)[1] for w in part]
    assert trie.nodes - 1 == len({w[:k] for w in some for k in range(1, len(w) + 1)})


def test_ties_take_the_longer_last_piece():
    scores = {"a": -1.0, "aa": -2.0, "aaa": -3.0}
    trie = token_count.Trie(token_count.Vocabulary(scores))
    assert trie.counts(pa.array(["a", "aa", "aaa", "aaaa", "aaaaa"])).tolist() == [1, 1, 1, 2, 2]


def test_prefixes_are_shared_between_chunks(monkeypatch):
    trie = token_count.Trie(token_count.Vocabulary(token_count.pieces(token_count.VOCABULARY)))
    a = trie.counts(pa.array(["▁international"]))
    before = trie.nodes
    b = trie.counts(pa.array(["▁internationally", "▁inter"]))
    assert trie.nodes - before == 2
    assert trie.counts(pa.array(["▁inter", "▁international"])).tolist() == [b[1], a[0]] and trie.nodes - before == 2
    long = pa.array(["▁" + "internationally" * 20, "▁ab"])
    want = trie.counts(long).tolist()
    monkeypatch.setattr(token_count, "TRIE_DEPTH", 1000)
    assert trie.counts(long).tolist() == want


def test_edges_grow():
    rng = np.random.default_rng(13)
    node, char = np.divmod(np.unique(rng.integers(0, 1 << 40, 50_000)), 1 << 20)
    key = token_count.Edges.keys(node, char)
    e = token_count.Edges(16)
    for a in range(0, len(key), 999):
        e.add(key[a : a + 999], np.arange(a, min(a + 999, len(key)), dtype=np.int32))
    assert (e.find(key) == np.arange(len(key))).all() and (e.find(key + np.uint64(1 << 20)) == -1).mean() > 0.9


def test_count_edges(documents):
    docs = documents([(1, None, None, None), (2, "", "en", "a"), (3, " \n ", "en", "a"), (None, "hello", "en", "a"), (4, "x" * 50_000, "en", "a"), (5, "hello", "en", "a"), (5, "hello", "en", "a")])
    got = token_count.count_tokens(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and [by[i].n_tokens for i in (1, 2, 3)] == [0, 0, 0]
    assert by[None].n_tokens == by[5].n_tokens > 0 and by[4].n_tokens > 1000
    assert token_count.count_tokens(docs.where("false")).count() == 0


# 6: mixing


def brute_mix(rows):
    d = duckdb.connect()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    d.register("documents", documents)
    return sorted(map(repr, d.sql("SELECT doc_id, source, n_tokens, mix_level FROM (" + source_mix.OP6_SQL + ")").fetchall()))


def test_mix_edges(documents):
    rng = np.random.default_rng(2)
    rows = [(i, words(rng, int(rng.integers(1, 60))), "en", ["src0", "src0", "a", "b", None, ""][i % 6]) for i in range(150)]
    rows += [(500, None, "en", "a"), (501, "", "en", "b"), (502, words(rng, 5000), "en", "c"), (None, "x y", "en", "a"), (7, "same id", "en", "src0"), (7, "same id", "en", "src0")]
    docs = documents(rows)
    got = sorted(repr(tuple(r)) for r in source_mix.assign_levels(docs).collect())
    assert got == brute_mix(rows)
    whole = source_mix.select_documents(docs)
    assert whole.columns == docs.columns and whole.count() == len(got)
    assert source_mix.assign_levels(docs.where("false")).count() == 0
    assert source_mix.assign_levels(docs, {"a": 1}, 0).select("source").distinct().count() == 1
    only_empty = documents([(1, None, "en", "a"), (2, "", "en", "a")])
    assert source_mix.assign_levels(only_empty).count() == 2


def test_mix_in_all_refinements(spark, monkeypatch):
    """Budgets whose boundary lies deep in the hash, with a histogram at each step."""
    monkeypatch.setattr(source_mix, "FINISH_ROWS", -1)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('a ', 1 + cast(id % 7 as int)) as text", "'en' as lang", "concat('s', id % 3) as source")
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in source_mix.assign_levels(docs).collect()) == brute_mix(rows)


def test_mix_holds_the_weights(documents):
    rng = np.random.default_rng(5)
    rows = [(i, words(rng, 10), "en", f"src{i % 4}") for i in range(1200)] + [(5000, "tiny", "en", "z")]
    got = source_mix.assign_levels(documents(rows)).toPandas()
    for level in (1, 2, 3):
        t = got[got.mix_level <= level].groupby("source").n_tokens.sum()
        assert abs(t["src0"] / t.drop("z", errors="ignore").sum() - 4 / 7) < 0.01
    assert t["src0"] == 3000 and t["z"] == 1  # the scarce source whole; the tiny one doesn't bound the mix


def test_shares_are_within_a_document_of_the_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    got = source_mix.assign_levels(docs).toPandas()
    longest = source_mix.spaced_counts(docs).groupBy("source").agg({"n_tokens": "max"}).toPandas().set_index("source")["max(n_tokens)"]
    for level, percent in enumerate(source_mix.LEVELS, 1):
        t = got[got.mix_level <= level].groupby("source").n_tokens.sum()
        unit = 188878 // 4 * percent // 100  # src0 is the scarcest for its weight
        for s, n in t.items():
            w = source_mix.WEIGHTS.get(s, 1)
            assert 0 <= unit * w + w - n <= longest[s] + w


# 7: decontamination


def test_short_items_are_all_found():
    rng = np.random.default_rng(6)
    texts = [words(rng, 5 + k % 14, "q") for k in range(140)]
    docs, truth = [], set()
    for k, t in enumerate(texts):
        w = t.split()
        n = len(w) - decontaminate.SHINGLE + 1
        part = w[: -(-n // 2) + decontaminate.SHINGLE - 1]  # just half of the shingles
        for size in (200, 4000):
            body = words(rng, size).split()
            truth.add((len(docs), k))
            docs.append(" ".join([*body[: size // 2], *part, *body[size // 2 :]]))
    items = decontaminate.Items(list(range(len(texts))), pa.array(texts), decontaminate.SHINGLE)
    row, item, _ = decontaminate.search(pa.array(docs), items)
    assert set(zip(row.tolist(), item.tolist())) == truth


def test_leaks_recall_and_precision(documents, spark):
    rng = np.random.default_rng(3)
    items = [(k, words(rng, int(rng.integers(14, 60)), "q")) for k in range(60)]
    items += [(60, "one two"), (61, ""), (62, None), (63, items[0][1])]
    rows, truth = [], set()
    for n in range(120):
        k = int(rng.integers(0, 60))
        w = items[k][1].split()
        part = w[: max(10, int(len(w) * 0.9))]
        body = words(rng, int(rng.integers(0, 3000 if n % 4 else 15000))).split()
        at = int(rng.integers(0, len(body) + 1))
        rows.append((n, " ".join(body[:at] + part + body[at:]), "en", "a"))
    rows += [(900, words(rng, 500), "en", "a"), (901, None, "en", "a"), (902, "", "en", "a"), (903, "One, TWO!", "en", "a"), (None, items[5][1], "en", "a"), (904, items[5][1], "en", "a"), (904, items[5][1], "en", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    k = decontaminate.SHINGLE
    cut = lambda t: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if (w := by_hand(t)) else set()
    sets = {i: cut(t) for i, t in items}
    for i, t, _, _ in rows:
        own = cut(t)
        truth |= {(i, j) for j, s in sets.items() if s and len(s & own) >= decontaminate.THRESHOLD * len(s)}
    docs = documents(rows)
    found = [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()]
    assert set(found) <= truth and len(set(found)) >= 0.99 * len(truth)
    assert found.count((904, 5)) == 2 and (903, 60) in found
    clean = decontaminate.drop_leaks(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in rows if i is not None and i not in {d for d, _ in found})
    assert decontaminate.leaks(docs.where("false"), bench).count() == 0
    assert decontaminate.leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.drop_leaks(docs, bench.where("false")).count() == len(rows)


def test_leaks_in_blocks_of_items(documents, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 2)
    rng = np.random.default_rng(4)
    items = [(k, words(rng, 20, "q")) for k in range(7)]
    docs = documents([(k, words(rng, 50) + " " + t, "en", "a") for k, t in items] + [(99, words(rng, 50), "en", "a")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == [(k, k) for k in range(7)]
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [99]


# 9: token files


def test_token_streams_round_trip(documents, spark, tmp_path):
    rng = np.random.default_rng(5)
    texts = ["", None, "Hello world.\nNew line", "two  spaces   three", " lead", "trail ", "a \n b", "é ü 漢字 🙂", "<|endoftext|> is text", "\t\ttabs it's", words(rng, 3000), "x" * 9000]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(None, "no id", "en", "a"), (2, texts[2], "en", "a")]
    docs = documents(rows).repartition(2)
    streams = token_file.token_streams(docs).collect()
    encode = token_file.encoder(token_file.VOCABULARY)
    pieces = {}
    for r in streams:
        assert len(r.doc_ids) == len(r.positions) == r.n_sequences
        for k in range(r.n_sequences):
            doc, pos, ids, mask = token_file.read_sequence(bytes(r.stream), k)
            assert len(ids) == len(mask) == token_file.SEQUENCE and (r.doc_ids[k] if r.doc_ids[k] is not None else -1) == doc and r.positions[k] == pos
            assert (ids[mask == 0] == token_file.END_OF_TEXT).all() and (np.diff(mask.astype(int)) <= 0).all()
            pieces.setdefault((doc, pos), []).append(ids[mask == 1].tolist())
    want = {}
    for i, t, *_ in rows:
        ids = [*encode.encode_ordinary(t or ""), token_file.END_OF_TEXT]
        for p, a in enumerate(range(0, len(ids), token_file.SEQUENCE)):
            want.setdefault((-1 if i is None else i, p), []).append(ids[a : a + token_file.SEQUENCE])
    assert pieces == want
    assert token_file.token_streams(docs.where("false")).count() == 0
    folder = f"file://{tmp_path}/out"
    written = token_file.write_streams(token_file.token_streams(docs), folder).collect()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(r.file for r in written)
    with pa.memory_map(str(tmp_path / "out" / written[0].file)) as source:
        before = pa.total_allocated_bytes()
        _, _, ids, _ = token_file.read_sequence(source, 0)
        assert not ids.flags.owndata and pa.total_allocated_bytes() - before < 10_000


def test_long_white_space():
    tokenise = token_file.Tokeniser(token_file.VOCABULARY)
    whole = tokenise.encoder.encode_ordinary
    for space in (" ", "\n", "\t ", "\u3000", "\x85"):
        for before, after in (("", ""), ("a.", "b"), ("x", " "), (" ", "1"), ("", "'s")):
            t = before + (space * 2100)[:2100] + after
            assert tokenise.encode(t + "mid" + t) == whole(t + "mid" + t)
    ids, cuts = tokenise(pa.array([" " * 1_000_000, "a" + "\n" * 3_000_000 + "b", "x" * 500_000]))
    assert (np.diff(cuts) > 0).all() and ids[cuts[2] - 1] == whole("b")[0]


def test_token_query_and_invalid_utf8(spark):
    pdf = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = {}
    for r in token_file.op9_token_file(spark, SF).collect():
        for k in range(r.n_sequences):
            doc, pos, ids, mask = token_file.read_sequence(bytes(r.stream), k)
            got.setdefault(doc, {})[pos] = ids[mask == 1].tolist()
    whole = token_file.encoder(token_file.VOCABULARY).encode_ordinary
    assert {d: [x for p in sorted(v) for x in v[p]] for d, v in got.items()} == {i: [*whole(t), token_file.END_OF_TEXT] for i, t in zip(pdf.doc_id, pdf.text)}
    bad = spark.createDataFrame([(1, bytearray(b"some \xff words of the text and the "), "en")], "doc_id long, b binary, lang string").selectExpr("doc_id", "cast(b as string) as text", "lang", "'a' as source")
    assert token_file.token_streams(bad).count() == 1 and token_count.count_tokens(bad).first().n_pretokens == 8
    assert language_id.identify(bad).first().lang_pred == "en" and source_mix.assign_levels(bad).count() == 1
    assert decontaminate.leaks(bad, bad.selectExpr("doc_id as item_id", "text")).count() == 1


def test_random_texts_tokenise_as_whole_texts_do():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encode = token_file.encoder(token_file.VOCABULARY).encode_ordinary
    tokenise = token_file.Tokeniser(token_file.VOCABULARY)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=" ab.'\n\t1é  s!", max_size=25), min_size=1, max_size=4))
    def check(texts):
        ids, cuts = tokenise(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])] == [encode(t) for t in texts]

    check()
