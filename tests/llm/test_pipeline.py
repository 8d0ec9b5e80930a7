"""The pipeline, stage by stage, against brute force."""

import hashlib

import pyarrow as pa

import corpus_pipeline
from atomloom.llm import decontaminate, language_id, source_mix, token_count, token_file
from conftest import CLASHES
from helpers import SF
from test_dedup import brute_groups
from test_text import by_hand


def mix_by_hand(docs):
    """doc_ids of the largest mix at which the weights hold, in tokens of operator 5."""
    tokens = token_count.Counter(token_count.VOCABULARY)(pa.array(docs.text))[1].tolist()
    by = {}
    for i, source, n in zip(docs.doc_id, docs.source, tokens):
        by.setdefault(source, []).append((int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:15], 16), i, n))
    weight = {s: source_mix.WEIGHTS.get(s, source_mix.DEFAULT_WEIGHT) for s in by}
    total = {s: sum(n for _, _, n in rows) for s, rows in by.items()}
    part = sum(total.values()) / sum(weight.values())
    unit = min(total[s] // weight[s] for s in by if total[s] > 0 and total[s] >= source_mix.TINY_PERCENT / 100 * part * weight[s])
    out = set()
    for s, rows in by.items():
        left = unit * weight[s]
        for _, i, n in sorted(rows):
            left -= n
            if left < 0:
                break
            out.add(i)
    return out


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    kept = [docs.toPandas()]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(n))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            kept.append(docs.toPandas())
    ids = [set(k.doc_id) for k in kept]
    assert all(len(i) == len(k) for i, k in zip(ids, kept))

    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    p, has = model.probabilities(pa.array(kept[0].text))
    assert ids[1] == set(kept[0].doc_id[has & (p.max(axis=1) >= language_id.MIN_PROB)])

    label = brute_groups(kept[1].doc_id.tolist(), kept[1].text.tolist())
    assert ids[2] == {i for i in ids[1] if label.get(i, i) == i} and len(ids[2]) < len(ids[1])

    def shingles(t):
        w, k = by_hand(t), decontaminate.SHINGLE
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    items = [s for s in map(shingles, bench.text) if s]
    leak = {i for i, t in zip(kept[2].doc_id, kept[2].text) if any(len(s & shingles(t)) >= decontaminate.THRESHOLD * len(s) for s in items)}
    assert ids[3] == ids[2] - leak and leak

    assert ids[4] == mix_by_hand(kept[3])

    encode = token_file.encoder(token_file.VOCABULARY).encode_ordinary
    got = {}
    for r in docs.collect():
        for k in range(r.n_sequences):
            doc, pos, seq, mask = token_file.read_sequence(bytes(r.stream), k)
            got.setdefault(doc, {})[pos] = seq[mask == 1].tolist()
    whole = {d: [x for p in sorted(parts) for x in parts[p]] for d, parts in got.items()}
    assert whole == {i: [*encode(t), token_file.END_OF_TEXT] for i, t in zip(kept[4].doc_id, kept[4].text)}


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["n_sequences", "n_tokens", "doc_ids", "positions", "stream"] and out.count() >= 1
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_odd_rows(spark, documents):
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "the of and is", "en", "a"), *[(10 + k, f"the house of the {k} and a {k * k}", "en", "a") for k in range(20)]]
    rows += [(40, " " * 1_000_000 + "the house and the of" + "\n" * 3_000_000, "en", "a"), (41, "the of a is " * 40_000, "en", "b"), (10, rows[3][1], "en", "a")]
    docs = documents(rows)
    language, dedup, clean, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))
    everything = sorted((r[0] for r in rows if r[0] is not None))
    kept = language(spark, docs, SF)
    assert ids(kept) == [i for i in everything if i > 2] + [None]
    once = dedup(spark, docs, SF)
    got = ids(once)
    assert {1, 2, None, 10} <= set(got) and got.count(10) == 1  # without words, without an id, least of its group
    assert ids(clean(spark, docs, SF)) == everything + [None]
    mixed = ids(mix(spark, docs, SF))
    assert {1, 2} <= set(mixed) <= {*everything, None}
    assert set(CLASHES) <= set(kept.columns) and docs.columns == once.columns
    held = [i for r in tokens(spark, docs, SF).collect() for i in r.doc_ids]
    assert set(held) == {*everything, None} and held.count(10) == 2
    empty = documents(rows).where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
