"""Token counts and BPE against the public libraries."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from formline.llm import bpe, textops, token_count

MODEL = textops.vocabulary_bytes(public_tokenizers.path("piece_bpe_32k.model"))
VOCABULARY = textops.vocabulary_bytes(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "▁", "　", "\x1c", "\x85", "\xa0", "'s", "1", "２", "<|endoftext|>", "<s>", "字", "😀", "\x00", "...", "Th", "ing"]
texts = st.one_of(st.text(max_size=40), st.lists(st.sampled_from(PARTS), max_size=14).map("".join))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_counts_equal_the_library(text):
    assert token_count.loaded(MODEL).count(text) == len(LIBRARY.encode(text))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_encoding_and_decoding_equal_the_library(text):
    codec = bpe.loaded(VOCABULARY)
    packed = codec.encode(text)
    ids = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert packed == b"".join(i.to_bytes(4, "little") for i in ids)
    assert codec.decode(packed) == TOKENIZER.decode(ids, skip_special_tokens=False)


ROWS = [(1, "The the erntre", "x"), (2, None, "x"), (3, "", None), (None, "a b", None), (1, "The the erntre", "x"), (4, "ab " * 5000, "x"), (5, "x" * 20000, "x")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")


def test_counts_of_a_table(spark, docs):
    got = sorted(map(tuple, token_count.token_counts(docs, MODEL).collect()), key=repr)
    count = lambda t: len(LIBRARY.encode(t or ""))
    assert got == sorted(((i, len((t or "").encode()), count(t), count(t) > 4096) for i, t, _ in ROWS), key=repr)
    assert token_count.token_counts(docs.limit(0), MODEL).count() == 0


def test_codec_of_a_table(spark, docs):
    got = bpe.encode(docs, VOCABULARY)
    for r in got.collect():
        assert len(r.ids) == r.n_tokens
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in r.ids)).hexdigest()
    assert sorted(map(tuple, bpe.decode(got, VOCABULARY).collect()), key=repr) == sorted(((i, t or "") for i, t, _ in ROWS), key=repr)
    assert bpe.encode(docs.limit(0), VOCABULARY).count() == 0


def test_what_is_remembered_is_bounded():
    from formline.llm.textops import Recent

    class Squares(Recent):
        def __missing__(self, x):
            value = self.older.get(x)
            self.made += value is None
            value = x * x if value is None else value
            self.keep(x, value, 10)
            return value

    made = Squares(1000)
    made.made = 0
    for x in [*range(40), *range(40), *range(500), *range(490, 500)]:
        assert made[x] == x * x
    assert len(made) + len(made.older) <= 102 and made.made < 530
