"""Encoding against two other encoders of the same vocabulary, and back."""

import os
import random

import pytest
from hypothesis import given, settings, strategies as st

from fernmill.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no vocabulary")
TEXTS = ["Hello  world", "a" * 1000 + " " + "ab" * 700, "<|endoftext|> x", "​ é가각\n\n\n  \t x", "가나다" * 300, "!!!!!!????....", "   ", "it's we'll 12345", "😀👩‍💻", "", None, "x" * 20_000]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.DEFAULT_VOCABULARY), special_tokens={})
    return lambda t: enc.encode_ordinary(t) if t else []


@pytest.fixture(scope="module")
def duck():
    return bpe.DuckBpe()


def test_encode(duck, reference):
    got = duck.encode_batch(TEXTS)
    assert got == [reference(t) for t in TEXTS]
    assert [duck.decode(i) for i in got] == [t or "" for t in TEXTS]


def test_second_encoder(duck):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.DEFAULT_VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert duck.encode_batch(TEXTS) == [t.encode(x or "", add_special_tokens=False).ids for x in TEXTS]


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=60))
def test_any_text(duck, reference, text):
    ids = duck.encode_batch([text])[0]
    assert ids == reference(text) and duck.decode(ids) == text


@pytest.mark.parametrize("seed", range(12))
def test_long_words(duck, reference, seed):
    rnd = random.Random(seed)
    parts = [["a", "b"], list("abcdefghijklmnopqrstuvwxyz"), ["the", "ing", "er", "un", "Java"], list("가나개발자"), ["a" * 50, "b"], list("ABCdef")][seed % 6]
    word = "".join(rnd.choice(parts) for _ in range(rnd.randint(30, 1500)))
    for text in (word, word * 3, "=" * rnd.randint(60, 3000), " " * rnd.randint(60, 300) + word):
        assert duck.encode_batch([text])[0] == reference(text)


def test_windows_cover(duck):
    for n in (1, 31, 32, 33, 48, 49, 64, 65, 1000):
        seen = {i for at in bpe.windows(n, 32) for i in range(at, min(at + 32, n))}
        assert seen == set(range(n))


def test_no_shared_token_widens(duck, reference):
    word = b"abcabcabc" * 40
    assert duck._encoded([word], 4)[word] == reference(word.decode())


def test_rows(spark, reference):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(None, "x", None)], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.encode(df, key="doc_id", text="text").collect()}
    assert got == {i: reference(t) for i, t in enumerate(TEXTS)} | {None: reference("x")}
    assert bpe.encode(df.limit(0), key="doc_id", text="text").count() == 0
