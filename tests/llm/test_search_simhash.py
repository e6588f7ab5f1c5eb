"""Exact top-k and SimHash near-duplicates against brute force, and the pipeline against its parts."""

import math
import random
import re

import numpy as np
import pytest
import xxhash

from formline.llm import components, pivots, simhash


def brute_top(rows, k=10, every=100):
    ok = {}
    known = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    vectors = [(i, np.array([math.floor(1024 * float(np.float32(x))) for x in v], object)) for i, v in known]
    for q, a in vectors:
        if q % every == 0:
            ok[q] = sorted((-int(a @ b), i) for i, b in vectors if i != q)[:k]
    return sorted((q, n + 1, i, -s) for q, found in ok.items() for n, (s, i) in enumerate(found))


@pytest.mark.parametrize("n, d", [(700, 16), (30, 3), (5, 1)])
def test_top_k_equals_brute_force(spark, n, d):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[n // 2 :: 3] = x[1]  # many equal vectors
    rows = [(i * 10, v.tolist()) for i, v in enumerate(x)] + [(7, None), (8, [None] * d), (9, [float("nan")] * d), (11, [float("inf")] * d), (None, [0.0] * d)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    assert sorted(tuple(r) for r in pivots.top_k(df).collect()) == brute_top(rows)


@pytest.mark.parametrize("big", [1e9, 1e17, 1e30])
def test_top_k_of_large_components(spark, big):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 6)).astype(np.float32)
    x[[0, 4, 9, 20]] *= np.float32(big)
    x[30] = x[20]
    rows = [(i * 10, v.tolist()) for i, v in enumerate(x)]
    got = sorted(tuple(r) for r in pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(q, n, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, n, i, s in brute_top(rows)]


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e306, 1.0]), (1, [1.0, 5.0]), (2, [-3.0, 1e306]), (3, []), (100, [2.0, 2.0])]
    got = pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in sorted(got) if r.query_id == 0] == [100, 1, 3, 2]


def test_elimination_leaves_few_candidates(spark):
    x = np.random.default_rng(5).normal(size=(3000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    counts = pivots.elimination(df, pivots=18).collect()
    assert len(counts) == 30 and all(r.candidates == 3000 for r in counts)
    assert sum(r.evaluated for r in counts) < 0.4 * 30 * 3000


def test_a_query_id_of_two_rows_is_answered_once(spark):
    df = spark.createDataFrame([(0, [2.0]), (0, [1.0]), (5, [1.0]), (5, [1.0]), (6, [-1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in pivots.top_k(df).collect()) == [(0, 1, 5, 1 << 20), (0, 2, 5, 1 << 20), (0, 3, 6, -(1 << 20))]


def test_top_k_of_an_empty_table(spark):
    assert pivots.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in values) * 2 > len(values))


def brute_components(fps):
    parent = {d: d for d in fps}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def near_copies():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdeABC") for _ in range(rnd.randint(1, 6)))
    texts = {}
    for g in range(8):
        base = [word() for _ in range(rnd.randint(150, 400))]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = word()
            texts[len(texts) + 5] = " ".join(w)
    return texts | {1: None, 2: "", 3: "one", 4: "one two", 900: " \t\n", 901: "one", 902: "\x1cone", 903: "é É ß"}


TEXTS = near_copies()


def test_fingerprints_and_components_equal_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x") for d, t in TEXTS.items()] + [(6, TEXTS[6], "x")], "doc_id long, text string, fp string").repartition(5)
    fps = {d: brute_fingerprint(t) for d, t in TEXTS.items()}
    expected = brute_components(fps)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(TEXTS) + 1
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{fps[d]:016x}", expected[d]) for d in TEXTS}
    assert len(set(expected.values())) < len(TEXTS) - 40
    kept = simhash.keep_one(df).collect()
    assert {r.doc_id for r in kept} == set(expected.values())


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(df).collect()) == [(0, 0), (0, 4), (4, 4)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(None, "a b c d"), (None, "x y z w"), (None, "x y z w"), (4, "a b c d"), (4, "a b c d"), (4, "other words here now"), (7, "a b c d")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "x y z w"), (4, "a b c d"), (4, "other words here now")]


@pytest.mark.parametrize("most", [3, 4096])
def test_links_connect_every_pair_at_three_bits(spark, most):
    rnd = random.Random(12)
    base = [rnd.getrandbits(64) for _ in range(5)]
    values = {b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(0, 3))) for b in base for _ in range(80)} | {rnd.getrandbits(64) for _ in range(200)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    roots = {r.node: r.root for r in components.connected(simhash.links(df, most=most)).collect()}
    expected = brute_components({signed(v) : v for v in values})
    for a, x in expected.items():
        assert (roots.get(a, a) == roots.get(x, x)) and roots.get(a, a) == x


def test_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)], "a long, b long")
    assert {r.node: r.root for r in components.connected(edges).collect()} == {i: 0 for i in range(41)} | {200: 200, 201: 200}


def jaccard_groups(texts, words=5, similarity=0.8):
    """The smallest id of each document's group, over all pairs of shingle sets."""
    sets = {}
    for d, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t)) if x]
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    root = {d: d for d in ids}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (both and both >= similarity * (len(sets[a]) + len(sets[b]) - both)):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in ids}


def subsequence_share(passage, text):
    """The greatest share of the passage's words that follow each other somewhere in about one and a half its length."""
    n, best = len(passage), 0
    for s in range(0, max(1, len(text)), max(1, n // 4)):
        row = [0] * (n + 1)
        for x in text[s : s + n + n // 2 + 4]:
            before = 0
            for j, y in enumerate(passage):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        best = max(best, row[n])
    return best / n


def test_pipeline_equals_its_stages(spark, sf):
    """Each stage by plain means on what the one before it kept: pairs of shingle sets, exact passages, patterns, the public tokenizer."""
    import hashlib

    import corpus_pipeline
    import public_tokenizers
    from formline.llm import pii
    from formline.llm.queries import toxicity_chain
    from formline.session import table
    from tokenizers import Tokenizer

    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    chain = toxicity_chain(spark, docs, sf)
    kept = {d: t for d, t in texts.items() if chain.probabilities(t.encode())[1] < 0.5}
    group = jaccard_groups(kept)
    kept = {d: t for d, t in kept.items() if group[d] == d}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    leaked = set(kept) - set(got)
    assert set(got) <= set(kept)
    tokens = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [tokens(r.text) for r in table(spark, sf, "benchmark").collect()]
    exact = {d for d, t in kept.items() if any(" " + " ".join(i) + " " in " " + " ".join(tokens(t)) + " " for i in items)}
    assert exact <= leaked
    for d in leaked:
        words = tokens(kept[d])
        assert max(subsequence_share(i, words) for i in items if len(set(i) & set(words)) >= 0.6 * len(set(i))) >= 0.55
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, r in got.items():
        t, out, at = kept[d], [], 0
        secret = [(m.start(), m.end(), 4) for m in re.finditer("(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])", t) if re.search("[0-9]", m[0]) and re.search("[A-Fa-f]", m[0])]
        for s, e, k in sorted(pii.base_spans(t) + secret, key=lambda x: (x[0], x[2])):
            if e <= at:
                continue
            if s >= at:
                out += [t[at:s], f"[{pii.KINDS[k].upper()}]"]
            at = e
        ids = tokenizer.encode("".join(out) + t[at:], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids, null and empty texts, repeated rows and empty tables: clean rows stay, one of each group."""
    import corpus_pipeline

    rows = [(None, "alpha beta gamma delta epsilon zeta"), (None, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six"), (7, "a text of its own that is here"), (8, None), (9, ""), (10, None), (None, "mail x@y.org now please or later"), (11, "long words " * 30_000)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, t, "en", None, len(t or "")) for d, t in rows], columns)
    empty = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}

    def run(frame, name):
        place = str(tmp_path / name)
        frame.write.parquet(f"{place}/documents.parquet")
        for t, kinds in empty.items():
            spark.createDataFrame([], kinds).write.parquet(f"{place}/{t}.parquet")
        return corpus_pipeline.run(spark, place).collect()

    got = run(docs, "some")
    # null and empty texts are one group of texts without words, whose smallest id stays
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in got) == [(0, True), (0, True), (7, True), (7, True), (8, False), (11, True)]
    assert run(docs.limit(0), "none") == []
    first = corpus_pipeline.STAGES[0][1]
    assert first(spark, docs, str(tmp_path / "some")).columns == docs.columns


def test_twins_in_sql(spark, sf):
    import duckdb
    from formline.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, sf)
        result = con.execute(sql)
        named = [d[0] for d in result.description]
        assert sorted(named) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*named).collect()), key=repr) == sorted(result.fetchall(), key=repr)
