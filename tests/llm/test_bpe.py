import base64
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from brute import sha
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import docs, no_docs, rows  # noqa: F401

from slantscope.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TOKENS = bpe.read_ranks(PATH)
VOCAB = bpe.Vocabulary(TOKENS)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def ids(text):
    return np.frombuffer(bpe.Encoder(VOCAB, P.PATTERN).encode(text), "<u4").tolist()


def test_perfect_hash_is_minimal_and_complete():
    assert sorted(VOCAB.hash.slot.tolist()) == list(range(len(TOKENS)))
    assert VOCAB.hash.candidates(TOKENS).tolist() == list(range(len(TOKENS)))
    small = bpe.PerfectHash([b"a"])
    assert small.candidates([b"a", b"zz"]).tolist() == [0, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encodes_like_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_long_words_and_long_texts(monkeypatch):
    word = "ab" * 3000 + "é" * 500 + "zq" * 50
    assert ids(word) == LIBRARY.encode_ordinary(word)
    text = "some words, 12 don't \n\n  split " * 300
    want = ids(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 40)
    assert ids(text) == want == LIBRARY.encode_ordinary(text)


def test_memory_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 3 * bpe.ENTRY_BYTES)
    e = bpe.Encoder(VOCAB, P.PATTERN)
    for text in ("one two three four", "five one six", "seven"):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert len(e.memo) <= 4


def test_round_trip_of_whole_rows(docs, rows):
    out = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH)
    want = Counter()
    for r in rows:
        text = r["text"] or ""
        k = LIBRARY.encode_ordinary(text)
        want[(r["doc_id"], len(k), sha(np.array(k, "<u4").tobytes()), sha(text.encode()))] += 1
    assert Counter(map(tuple, bpe.digests(out).collect())) == want


def test_nothing_and_bad_files(no_docs, tmp_path):
    assert bpe.digests(bpe.decode(bpe.encode(no_docs, PATH, P.PATTERN), PATH)).count() == 0
    bad = tmp_path / "ranks"
    bad.write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(bad))
    with pytest.raises(ValueError):
        bpe.Vocabulary([b"a"])
