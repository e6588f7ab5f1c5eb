"""Substring and suffix deduplication against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from formline.llm import automaton, repeats, suffix_merge, textops


def test_merge_never_loses_order_or_prefixes():
    rnd = random.Random(3)
    for _ in range(100):
        runs = []
        for _ in range(rnd.randint(1, 6)):
            strings = sorted(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 8))) for _ in range(rnd.randint(1, 12)))
            coded = suffix_merge.front_coded(strings)
            assert suffix_merge.front_decoded(*coded) == strings
            runs.append((strings, coded[0].tolist()))
        order, shared = suffix_merge.merged(runs)
        out = [runs[k][0][i] for k, i in order]
        assert out == sorted(s for r in runs for s in r[0])
        assert all(shared[i] == suffix_merge.common_prefix(out[i - 1] if i else b"", out[i]) for i in range(len(out)))


def test_automaton_knows_first_owners():
    rnd = random.Random(4)
    for _ in range(200):
        texts = [[bytes([rnd.choice(b"abc")]) for _ in range(rnd.randint(1, 14))] for _ in range(rnd.randint(1, 5))]
        owners = [rnd.randint(0, 9) for _ in texts]
        a = automaton.Automaton()
        for t, o in zip(texts, owners):
            a.add(t, o)
        a.finish()
        w = rnd.randint(2, 4)
        for q in [*texts, [bytes([rnd.choice(b"abcd")]) for _ in range(10)]]:
            expected = [min([o for t, o in zip(texts, owners) if any(t[j : j + w] == q[i : i + w] for j in range(len(t) - w + 1))], default=1 << 63) for i in range(len(q) - w + 1)]
            assert a.first_owners(q, w) == expected


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    common = rng.integers(1, 1 << 62, 120, dtype=np.uint64)
    sides = [np.concatenate([rng.integers(1, 1 << 62, n, dtype=np.uint64), common, rng.integers(1, 1 << 62, 40, dtype=np.uint64)]) for n in (30, 57)]
    found = []
    for s, n in zip(sides, (30, 57)):
        a = repeats.anchors(s, np.full(len(s), len(s)), 50, 16)
        found.append({p - o - n: (int(g), int(o)) for p, low, high, g in zip(a["place"], a["low"], a["high"], a["gram"]) for o in range(low, high + 1)})
    inside = range(len(common) - 50 + 1)
    assert all(found[0][i] == found[1][i] for i in inside)


def fixture():
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, line = prose(80), prose(30)
    docs = {i: f"{prose(rnd.randint(5, 120))} {line} {passage if i % 3 == 0 else ''}\n{prose(rnd.randint(5, 90))}" for i in range(30)}
    docs |= {100: docs[4], 101: docs[4].replace("a", "b", 1), 102: "", 103: "ha " * 300, 104: "ha " * 60, 105: "x" * 450, 106: "é" * 260, 107: f"{passage}\t{passage}", 50: f"\x1c {passage}\x85"}
    return docs


DOCS = fixture()


def brute_words(rows, window=50):
    """rows: (doc_id, text), ids null or repeated; null ids neither remove nor lose words."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for d, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows, window=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(t[i : i + window] for _, t in data for i in range(len(t) - window + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, *[x or 0 for x in r[:2]], r[2:]))


#: Ids that are null, repeated with one text, or repeated with different texts are rows of their own.
ROWS = [*DOCS.items(), (200, None), (None, DOCS[3]), (None, DOCS[8]), (None, DOCS[8]), (300, "tail " * 70 + DOCS[5]), (300, " ".join(f"only{i}" for i in range(90))), (300, DOCS[5]), (301, DOCS[6]), (301, DOCS[6])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "doc_id long, text string, words string").withColumnRenamed("words", "row").repartition(3)


@pytest.mark.parametrize("many", [1, 1000])
def test_words_equal_brute_force(docs, many):
    assert ordered(automaton.removed(docs, digest=True, many=many).collect()) == ordered(brute_words(ROWS))


@pytest.mark.parametrize("many", [1, 1000])
def test_bytes_equal_brute_force(docs, many):
    assert ordered(suffix_merge.removed(docs, digest=True, many=many).collect()) == ordered(brute_bytes(ROWS))


def test_long_texts_in_pieces(spark, monkeypatch):
    """Texts longer than a piece are cut with overlap: passages across the borders are found."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(70) for _ in range(3)]
    long = " ".join(prose(rnd.randint(150, 260)) + " " + s for s in shared * 2)
    rows = [(1, long), (2, prose(120)), (3, f"{shared[0]} {prose(40)} {shared[1]}"), (4, long + " x")]
    texts = [t.encode() for _, t in rows]
    monkeypatch.setattr(repeats, "PIECE", 97)
    for symbols, window in ((automaton.word_symbols, 50), (suffix_merge.byte_symbols, 200)):
        seen = {(t, p) for _, ends, text, place in repeats.pieces(texts, symbols, window) for t, p, e, i in zip(text.tolist(), place.tolist(), ends.tolist(), range(len(text))) if i + window <= e}
        assert seen == {(t, i) for t, x in enumerate(texts) for i in range(len(symbols(x)[0]) - window + 1)}
    df = spark.createDataFrame([(d, t * 40) for d, t in rows], "doc_id long, text string")
    assert ordered(automaton.removed(df, digest=True).collect()) == ordered(brute_words([(d, t * 40) for d, t in rows]))


def test_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in automaton.removed(df).collect()) == [(1, 0), (1, 0), (2, 60)]
    assert {r.n_removed for r in suffix_merge.removed(df).collect()} == {len(text)}


def test_empty_tables(docs):
    assert automaton.removed(docs.limit(0)).count() == 0
    assert suffix_merge.removed(docs.limit(0)).count() == 0


def test_one_table_of_powers_is_kept():
    for n in (5, 5000, 70_000, 9000):
        up, down = textops.powers(n)
        assert len(up) == len(down) == n and (up * down == 1).all() and int(up[3]) == pow(textops.BASE, 3, 1 << 64)
    assert textops.powers(10)[0].base is textops.powers(70_000)[0].base
