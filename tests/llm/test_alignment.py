"""Token alignment against both libraries and brute force."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formline.llm import alignment, textops

MODEL = textops.vocabulary_bytes(public_tokenizers.path("piece_bpe_32k.model"))
VOCABULARY = textops.vocabulary_bytes(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
BYTES = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
BYTES.encode_special_tokens = True
A_BYTES, B_BYTES = alignment.byte_tokens(VOCABULARY), alignment.piece_tokens(PIECES)
PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "▁", "　", "\x1c", "\x85", "\xa0", "'s", "1", "２", "<|endoftext|>", "<s>", "<0x41>", "字", "😀", "\x00", "...", "Th", "ing", " \n", "\n "]
texts = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=14).map("".join))


def expected(text):
    """(A ids, B ids, groups as text, linked id pairs, overlapping places)."""
    whole = b" " + (text or "").encode()
    a, b = BYTES.encode(" " + (text or ""), add_special_tokens=False).ids, PIECES.encode(text or "")
    if not text or b"".join(A_BYTES[i] for i in a) != whole or b"".join(B_BYTES[i] for i in b) != whole:
        return [], [], "", [], []
    a_ends, b_ends = (np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((A_BYTES, a), (B_BYTES, b)))
    groups, links, last = [], [], 0
    for end in sorted({*a_ends} & {*b_ends}):
        part = [[str(i) for i, e in zip(ids, ends) if last < e <= end] for ids, ends in ((a, a_ends), (b, b_ends))]
        groups.append("|".join(map(",".join, part)))
        links.append((a[a_ends.index(end)], b[b_ends.index(end)]))
        last = end
    over = [(i, j) for i, (s, e) in enumerate(zip([0, *a_ends], a_ends)) for j, (t, f) in enumerate(zip([0, *b_ends], b_ends)) if s < f and t < e]
    return a, b, ";".join(groups), links, over


def check(text, most=alignment.SLICE):
    words, doc = alignment.loaded(VOCABULARY, MODEL), alignment.Document()
    for rows in alignment._sliced([text.encode()], most):
        alignment.align_slice(words, [(doc, part) for _, part in rows], True)
    if not doc.sound:
        doc = alignment.Document()
    a, b, groups, links, over = expected(text)
    joined = {c: [x for d in doc.detail for x in d[c].tolist()] for c in ("a_ids", "b_ids", "a", "b", "a_ends")}
    assert (doc.n_a, doc.n_b, doc.n_groups) == (len(a), len(b), len(links))
    assert (joined["a_ids"], joined["b_ids"]) == (a, b)
    assert list(zip(joined["a"], joined["b"])) == over
    assert joined["a_ends"] == np.cumsum([len(A_BYTES[i]) for i in a]).tolist()
    pairs = words.pairs.keys[np.frombuffer(b"".join(doc.links), np.int32)]
    assert [(x >> 32, x & 0xFFFFFFFF) for x in pairs.tolist()] == links
    assert not links or doc.hash.hexdigest() == hashlib.sha256(groups.encode()).hexdigest()


@settings(max_examples=500, deadline=None)
@given(texts)
def test_alignment_equals_brute_force(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 9))
def test_parts_of_a_text_align_like_the_whole(text, most):
    check(text, most)


def test_pairs_are_found_by_hashing():
    pairs = alignment.loaded(VOCABULARY, MODEL).pairs
    assert (pairs.of(pairs.keys >> 32, pairs.keys & 0xFFFFFFFF) == np.arange(len(pairs.keys))).all()
    some = {(i, j) for i in range(0, 50_000, 997) for j in range(300, 31_000, 7) if A_BYTES[i].endswith(B_BYTES[j]) or B_BYTES[j].endswith(A_BYTES[i])}
    assert some <= {(x >> 32, x & 0xFFFFFFFF) for x in pairs.keys.tolist()}


ROWS = [(1, "The the erntre, the thing's end.", "x"), (2, None, "x"), (3, "", None), (None, "a b", None), (1, "The the erntre, the thing's end.", "x"), (4, "ab the " * 5000, "x"), (5, "x" * 20000, "x"), (6, "a▁b", "x"), (7, "字 <|endoftext|> \n\n x", "x")]


def test_counts_of_a_table(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, n_a string")
    told = {i: expected(t) for i, (_, t, _) in enumerate(ROWS)}
    count = Counter(p for x in told.values() for p in x[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    want = []
    for i, (doc_id, _, _) in enumerate(ROWS):
        a, b, groups, links, _ = told[i]
        want.append((doc_id, len(a), len(b), len(links), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    got = alignment.digest(docs, VOCABULARY, MODEL)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert alignment.digest(docs.limit(0), VOCABULARY, MODEL).count() == 0
    aligned = alignment.align(docs, VOCABULARY, MODEL, detail=True)
    assert {(r.a_id, r.b_id): r.n for r in alignment.pair_counts(aligned, VOCABULARY, MODEL).collect()} == count
    assert sorted((list(zip(r.a, r.b)) for r in aligned.collect()), key=repr) == sorted((x[4] for x in told.values()), key=repr)
