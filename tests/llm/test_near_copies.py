"""Near-duplicates at a Jaccard of 0.8 against brute force, and the rows that are kept."""

import random
import time

import numpy as np
import pytest

import corpus_pipeline
from formline.llm import near_copies, simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def edited():
    """Copies with up to nine words in 100 changed: most pairs at 0.8 differ in over three bits."""
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(80, 500))]
        for _ in range(8):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 45))):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
    return texts + ["one two", "ONE  two", "one two three four five six", "", None]


def brute_groups(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if 5 * shared >= 4 * (len(a) + len(sets[j]) - shared):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(d) for d in range(len(texts))]


def test_stage_equals_brute_force(spark):
    texts = edited()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(brute_groups(texts)))
    assert corpus_pipeline.drop_near_copies(spark, df.limit(0), "").count() == 0


def test_forest_reaches_what_brute_force_reaches():
    sets = [np.array(sorted(hash(x) & (1 << 63) - 1 for x in shingles(t)), np.uint64) for t in edited()[:-2]]
    root = list(range(len(sets)))
    for a, b in near_copies.forest(np.arange(len(sets)), sets):
        x, y = root[a], root[b]
        assert x != y
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == brute_groups(edited()[:-2])


def test_users_columns_stay():
    from formline.llm.textops import free_name

    assert free_name(["__ROW", "a"], "row") == "__row_"


@pytest.mark.parametrize("keep", [near_copies.keep_one, simhash.keep_one])
def test_a_column_called_like_the_row_number_stays(spark, keep):
    docs = spark.createDataFrame([(1, "one two three four five six", "x", 7), (2, "one two three four five six", "y", 8)], "doc_id long, text string, __row string, row long")
    assert [tuple(r) for r in keep(docs).collect()] == [(1, "one two three four five six", "x", 7)] and keep(docs).columns == docs.columns


def test_pages_of_one_template_are_not_compared_with_each_other():
    """Thousands of sets that share most of their shingles, below the bound, and a few pairs above it."""
    rng = np.random.default_rng(8)
    common = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    sets = [np.unique(np.r_[common, rng.integers(0, 1 << 62, 100, dtype=np.uint64)]) for _ in range(4000)]
    for k in range(0, 40, 2):
        sets[k + 1] = np.unique(np.r_[sets[k][:-20], rng.integers(0, 1 << 62, 20, dtype=np.uint64)])
    began = time.time()
    got = near_copies.forest(np.arange(4000), sets)
    assert {tuple(sorted(e)) for e in got} == {(k, k + 1) for k in range(0, 40, 2)} and time.time() - began < 20


def brute_roots(names, linked):
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {x: find(x) for x in names}


@pytest.mark.parametrize("at_once, pairs", [(1 << 17, 256), (40, 3)])
def test_variants_propose_every_pair_with_a_segment_at_one_bit(spark, monkeypatch, at_once, pairs):
    """All pairs of fingerprints: one bit at most in some segment, and few of the whole bits."""
    monkeypatch.setattr(near_copies, "SLICE", at_once)
    monkeypatch.setattr(near_copies, "PAIRS", pairs)
    segments, bits, within = 5, 6, 20
    rng = np.random.default_rng(4)
    width = near_copies.WHOLE + segments * bits
    base = rng.integers(0, 2, (8, width), dtype=np.uint8)
    prints = np.concatenate([base[rng.integers(0, 8, 160)] ^ (rng.random((160, width)) < rng.choice([0.02, 0.06], (160, 1))), rng.integers(0, 2, (60, width), dtype=np.uint8)])
    got = near_copies.proposed(spark.createDataFrame([(k, bytearray(np.packbits(p).tobytes())) for k, p in enumerate(prints)], "node long, print binary").repartition(3), segments, bits, within)
    roots = {r.node: r.root for r in near_copies.connected(got).collect()}

    def linked(a, b):
        differ = prints[a] != prints[b]
        return differ[: near_copies.WHOLE].sum() <= within and differ[near_copies.WHOLE :].reshape(segments, bits).sum(1).min() <= 1

    expected = brute_roots(range(len(prints)), linked)
    assert {k: roots.get(k, k) for k in expected} == expected and len(set(expected.values())) < 120


@pytest.mark.parametrize("one, two, both", [(4, 5, 4), (9, 9, 8), (90, 90, 80), (80, 100, 80), (1800, 1800, 1600)])
def test_fingerprints_reach_a_jaccard_of_four_fifths(one, two, both):
    """Pairs at the bound itself, of all kinds of sizes, have a segment that differs in one bit at most; other pairs are told apart."""
    segments, bits, within = near_copies.plan(1000)
    rng = np.random.default_rng(one + two)
    last = None
    for _ in range(200):
        x = rng.integers(0, 1 << 63, one + two - both, dtype=np.uint64)
        a, b = (near_copies.fingerprint(g, near_copies.WHOLE + segments * bits) for g in (x[:one], x[-two:]))
        differ = a != b
        assert differ[: near_copies.WHOLE].sum() <= within and differ[near_copies.WHOLE :].reshape(segments, bits).sum(1).min() <= 1
        assert last is None or (a != last)[: near_copies.WHOLE].sum() > within
        last = a


def test_longer_segments_for_larger_tables():
    (few, short, _), (more, long, _) = near_copies.plan(1000), near_copies.plan(10**9)
    assert long > short and more > few and near_copies.plan(10, 1.0)[0] == 1


def test_only_what_simhash_proposes_is_linked(spark, monkeypatch):
    texts = edited()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [frozenset(shingles(t)) for t in texts]
    monkeypatch.setattr(near_copies, "proposed", lambda prints, *plan: spark.createDataFrame([], "a long, b long"))
    kept = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({sets.index(x) for x in sets}) and len(kept) > len(set(brute_groups(texts)))
