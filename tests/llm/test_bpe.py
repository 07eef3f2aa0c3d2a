import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkcorpus.llm import bpe
from sparkcorpus.llm.queries import token_ids

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.DEFAULT_DIR), reason="the vocabulary is not here")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{bpe.DEFAULT_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aabehinorst 'lé\n\t 01日本ก", max_size=80)))
def test_equals_merging(reference, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids = bpe.tokenizer().encode(text)
    assert ids == reference.encode_ordinary(text)
    assert bpe.tokenizer().decode(ids) == text


def test_long_words(reference):
    for text in ("a" * 3000, "ab" * 2000, " " * 500 + "x", "ท" * 400, "<|endoftext|>" * 3):
        assert bpe.tokenizer().encode(text) == reference.encode_ordinary(text)


def test_every_token_is_its_own_encoding():
    automaton = bpe.tokenizer().automaton
    assert all(automaton.encode_word(t) == [i] for t, i in list(automaton.ids.items())[::7])


def test_small_automaton():
    vocab = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4}
    automaton = bpe.MergeAutomaton(vocab, [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b")])
    assert automaton.encode_word(b"aaab") == [2, 3]
    assert automaton.encode_word(b"aab") == [4]
    assert automaton.encode_word(b"aaaa") == [2, 2] and automaton.encode_word(b"aaa") == [2, 0]


def test_rows(spark):
    df = spark.createDataFrame([(1, "hej", "x"), (2, "", "x"), (3, None, "x"), (1, "hej", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in token_ids(df, "doc_id", "text").collect())
    assert got[0] == got[1] and got[0][1] and got[2:] == [(2, []), (3, [])]
    assert token_ids(df.where("false"), "doc_id", "text").count() == 0
