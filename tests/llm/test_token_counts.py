"""Token counts: the transducer and its chunk maps against the tokenizers library."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracklens.llm import bpe, queries
from tracklens.llm import token_counts as T

PATH = bpe.tokenizer_path()
TOOL = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"
KINDS = "n_bytes string, text string, at string, doc_id long"
ODD = [
    "a", "ab", "the", "ing", " ", "  ", "\n", "\t", "é", "漢字", "😀", "'s", "'ll", "'r", "'", "'v", "12", "!!", "!'s", "<|endoftext|>", "<|", "|>",
    "endoftext", "\x1c", "\x85", " ", "　", "==", "ZZZ", "́", "e", "l",
]


def want(text):
    return len(TOOL.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def machine():
    return T.load(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=40).map("".join), st.integers(1, 9))
def test_pieces_in_any_chunks(text, size):
    assert T.text_tokens(T.load(PATH), text, size) == T.text_tokens(T.load(PATH), text) == want(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehinrst", min_size=65, max_size=2000))
def test_long_unsplit_words(text):
    assert T.text_tokens(T.load(PATH), text, 100) == want(text)


@pytest.mark.parametrize("text", ["a" * 5000, "漢" * 900, "漢字、" * 900, "=" * 3001, "ab" * 4096 + "c", " " * 3000 + "x", "\n" * 700, "é́" * 500])
def test_runs(machine, text):
    assert T.text_tokens(machine, text, 64) == want(text)


def test_the_sum_of_a_path_is_the_count_of_every_prefix(machine):
    text = "It's  what they'll\n\nre-encode: 'tis 1234é!!  'r 'rex 'l"
    state, n = machine.fresh, 0
    for i, char in enumerate(text):
        state, added = state[char]
        n += added
        assert n == want(text[: i + 1]), text[: i + 1]


def test_pairs_follow_as_merging_leaves_them(machine):
    pairs, rng = machine.pairs, random.Random(7)
    ids = [i for raw, i in pairs.token.items() if len(raw) < 6]
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids)
        raw = pairs.bpe.token_bytes[a] + pairs.bpe.token_bytes[b]
        assert pairs.follows(a, b) == (pairs.bpe.plain(raw) == [a, b])


def test_maps_compose_in_any_grouping(machine):
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(ODD) for _ in range(60))
        maps = [T.chunk_map(machine, c) for c in T.chunks(text, 5)]
        prefixes = T.scan(machine, maps)
        assert [T.total(machine, p) for p in prefixes] == [want(text[: 5 * (i + 1)]) for i in range(len(maps))]
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [T.compose(machine, maps[i], maps[i + 1])]
        assert T.total(machine, maps[0]) == want(text)


def test_a_full_machine_starts_anew(monkeypatch):
    monkeypatch.setattr(T, "STATES", 50)
    monkeypatch.setattr(T, "WORDS", 20)
    monkeypatch.setattr(T, "PAIRS", 30)
    machine = T.Machine(bpe.load(PATH))
    for i in range(300):
        text = f"word{i * 7919} and more'll {i}"
        assert machine.count(text) == want(text)
    assert len(machine.states) <= 51 and len(machine.words) <= 20


def test_rows(spark):
    texts = [None, "", " ", "plain words", "x" * 70_000, "two words " * 9_000, "<|endoftext|>" * 300, "漢字、" * 5_000, "same", "same", " ".join(f"{i}th word's" for i in range(9_000)), "".join(f"{i}th" for i in range(700))]
    rows = [("clash", t, "clash", i // 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, KINDS).repartition(3)
    expected = sorted((i // 2, len((t or "").encode()), want(t)) for i, t in enumerate(texts))
    for long in (T.LONG, 1000, 7):  # spread over tasks, in one and more levels of groups
        if long == 7:
            docs = docs.filter("length(text) < 5000 OR text IS NULL")
            expected = [e for e in expected if e[1] < 5000]
        got = T.count_tokens(docs, long=long).collect()
        assert sorted(map(tuple, got)) == expected
    assert T.count_tokens(docs.limit(0)).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.token_limits(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = sorted((d.doc_id, len((d.text or "").encode()), want(d.text), want(d.text) > 512) for d in docs)
    assert sorted(map(tuple, got.collect())) == expected
