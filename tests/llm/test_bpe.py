"""BPE against the tokenizers library, and the round trip."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracklens.llm import bpe

PATH = bpe.tokenizer_path()
ODD = ["a", "ab", "the", "ing", " ", "  ", "\n", "\t", "é", "漢字", "😀", "'s", "'ll", "12", "!!", "<|endoftext|>", "\x1c", "\x85", " ", "==", "ZZZ", "́"]


@pytest.fixture(scope="module")
def tool():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.load(PATH)


def same(own, tool, text):
    ids = np.frombuffer(own.encode(text), dtype="<u4")
    want = tool.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want, text[:80]
    assert own.decode(ids).decode() == tool.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=40).map("".join))
def test_mixed_pieces(text):
    same(bpe.load(PATH), Tokenizer.from_file(PATH) if not hasattr(test_mixed_pieces, "t") else test_mixed_pieces.t, text)


test_mixed_pieces.t = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehinrst", min_size=65, max_size=2000))
def test_long_unsplit_words(text):
    same(bpe.load(PATH), test_mixed_pieces.t, text)


@pytest.mark.parametrize("text", ["a" * 5000, "漢" * 900, "=" * 3001, "ab" * 4096 + "c", "=" * 64, "a" * 65, "é́" * 500])
def test_runs(own, tool, text):
    same(own, tool, text)


def test_join_grows_its_window(own):
    raw = b"in" * 40 + b"ternationalization" * 5
    for cut in range(1, len(raw), 7):
        assert own.join(own.plain(raw[:cut]), own.plain(raw[cut:])) == own.plain(raw)


def test_table(spark, tool):
    texts = ["Hello world, it's 2024.", "", None, "x" * 1000 + " tail " + "=" * 700, "word " * 300, "<|endoftext|>a", "Hello world, it's 2024."]
    rows = [("i", i, t, "c") for i, t in enumerate(texts)] + [("i", None, "null id", None), ("i", 0, texts[0], "c")]
    kinds = "ids string, doc_id long, text string, n_tokens string"
    df = spark.createDataFrame(rows, kinds)
    for long in (bpe.LONG, 50):  # the second sends most texts over the spread path
        got = bpe.encode_texts(df, ["doc_id"], long=long).collect()
        assert len(got) == len(rows)
        want = []
        for _, i, t, _ in rows:
            ids = tool.encode(t or "", add_special_tokens=False).ids
            packed = np.array(ids, dtype="<u4").tobytes()
            want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
        assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert bpe.encode_texts(spark.createDataFrame([], kinds)).count() == 0
