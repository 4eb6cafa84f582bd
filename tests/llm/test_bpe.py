"""Ids equal those of the tiktoken library; decoding gives the text back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lifeframe.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(PATH), special_tokens={})


def pieces_of(text):
    encoder = bpe.encoder_for(PATH, PATTERN)
    cut = encoder.split(text)
    assert cut == encoder.pattern.findall(text)
    encoder.encode_pieces(set(cut))
    ids = np.frombuffer(b"".join(encoder.known[p] for p in cut), "<i4")
    return ids.tolist(), encoder.decode(ids, [len(ids)])[0]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80) | st.text(st.characters(max_codepoint=0x17F), max_size=80) | st.text("ab '\n", max_size=400) | st.text("etainos", min_size=150, max_size=600))
def test_any_text(text):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(PATH), special_tokens={})
    ids, back = pieces_of(text)
    assert ids == library.encode_ordinary(text)
    assert back == text.encode()


def test_table(spark, documents, awkward, library):
    rng = random.Random(2)
    more = [(100 + i, "".join(rng.choice("the an' é\n1<|endoftext|>") for _ in range(rng.randrange(300)))) for i in range(40)]
    docs = documents(awkward + more, extra=("ids", "n_tokens", "n_tokens_"))
    got = bpe.encode(docs, PATH, PATTERN, keep=["doc_id"], digests=True).collect()
    expected = []
    for i, t in awkward + more:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
    whole = bpe.encode(docs, PATH, PATTERN)
    assert whole.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids_", "n_tokens", "n_tokens_", "ids", "decoded"]
    for r in bpe.decode(whole.drop("decoded"), PATH, PATTERN).collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(documents([]), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("words", [500, 2000, 8000])
def test_many_distinct_long_words(library, words):
    """A recursion keeps all its rounds; texts like these go through it in many calls. In the middle, ids of empty texts."""
    rng = random.Random(words)
    text = " ".join("".join(rng.choice("acgt") for _ in range(190)) for _ in range(words))
    ids, back = pieces_of(text)
    assert ids == library.encode_ordinary(text) and back == text.encode()


def test_decoding_in_slices(library, monkeypatch):
    texts = ["", "some words", "", "é\U0001f600" * 40, "x" * 3000, ""]
    encoder = bpe.encoder_for(PATH, PATTERN)
    coded = [library.encode_ordinary(t) for t in texts]
    for rows in (1, 7, 10_000):
        monkeypatch.setattr(bpe, "DECODE_ROWS", rows)
        assert encoder.decode(np.array(sum(coded, []), np.int32), list(map(len, coded))) == [t.encode() for t in texts]
    assert encoder.decode(np.zeros(0, np.int32), [0, 0]) == [b"", b""]
