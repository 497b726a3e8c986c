"""Packing: the tokenizer's own ids, gapless sequences, few of them."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import packing

from .conftest import awkward, make

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as f:
        return packing.PieceEncoder(f.read())


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aAzZäÖßéİ09½'’.,-_<|>&́   \n\t日本👩‍"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_encode_as_whole_texts(encoder, tokenizer, text):
    for t in (text, "", text.upper()):
        assert np.frombuffer(encoder.encode(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids(spark, tokenizer, encoder):
    assert np.frombuffer(encoder.encode(b"a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]
    rows = [(1, "a <|endoftext|> b"), (2, "<|startoftext|>" * 3 + "x" * 200), (3, "<|ENDOFTEXT|> | endoftext|>")]
    check(rows, packing.pack_documents(make(spark, rows), PATH, 16).collect(), 16, tokenizer)


def test_the_cache_is_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    with open(PATH, "rb") as f:
        small = packing.PieceEncoder(f.read())
    for i in range(50):
        text = f"word{i} other{i}, " + "spaceless" * 40 + f"{i} 日本語{i}"
        assert np.frombuffer(small.encode(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(small) < 40 and max(map(len, small), default=0) <= packing.CACHED_PIECE


def check(rows, got, capacity: int, tokenizer) -> int:  # noqa: ANN001
    wanted = []
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            x = np.array(ids[s : s + capacity], "<u4")
            wanted.append((r[0], k, s, len(x), zlib.crc32(x.tobytes())))
    assert sorted(((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got), key=repr) == sorted(wanted, key=repr)
    placed = sorted((g["sequence_id"], g["offset"], g["length"]) for g in got)
    for _, own in itertools.groupby(placed, key=lambda p: p[0]):
        at = 0
        for _, offset, length in own:
            assert offset == at
            at += length
        assert at <= capacity
    return len({p[0] for p in placed})


def test_awkward_documents(docs, tokenizer):
    got = packing.pack_documents(docs, PATH, 64).collect()
    n = check(awkward(), got, 64, tokenizer)
    assert n <= -(-sum(g["length"] for g in got) // 64) + 1


def test_sequences_are_within_one_of_the_bound(spark, tokenizer):
    rows = [(i, "word " * (i * 37 % 900)) for i in range(300)]
    got = packing.pack_documents(make(spark, rows), PATH, 1024).collect()
    assert check(rows, got, 1024, tokenizer) <= -(-sum(g["length"] for g in got) // 1024) + 1


def test_one_length_holds_most_pieces(spark, tokenizer):
    rows = [(i, "same text") for i in range(500)] + [(600, None), (601, "")]
    got = packing.pack_documents(make(spark, rows), PATH, 10).collect()
    check(rows, got, 10, tokenizer)


def test_empty_table(nothing):
    assert packing.pack_documents(nothing, PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 50)), max_size=25))
def test_plans_use_every_piece_once(counts):
    have = np.zeros(61, np.int64)
    for x, n in counts:
        have[x] += n
    for plan in (packing.plan(have), packing.plan(have, exact=False), packing.best_plan(have)):
        used = np.zeros(61, np.int64)
        for lengths, times in plan:
            assert times > 0 and sum(lengths) <= 60
            for x in lengths:
                used[x] += times
        assert (used == have).all()


def test_every_triple_is_found():
    have = np.zeros(4097, np.int64)
    have[1000], have[1032] = 1, 3
    for i in range(81):  # these need the piece of 1000, which is used
        have[1050 + i] = have[3096 - 1000 - 1050 - i] = 1
    assert packing.Complements(have).exact(3096, {1000: 1}) is not None
    only = np.zeros(4097, np.int64)
    only[1032] = 3
    assert packing.Complements(only).exact(3096, {}) == [1032, 1032, 1032]
    assert packing.Complements(only).exact(3096, {1032: 1}) is None


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 14), st.integers(1, 3)), max_size=6), st.integers(1, 40), st.lists(st.integers(0, 5), max_size=3))
def test_exact_is_exhaustive(counts, gap, taken):
    have = np.zeros(41, np.int64)
    for x, n in counts:
        have[x] = n
    used = {}
    for i in taken:
        if i < len(counts) and used.get(counts[i][0], 0) < have[counts[i][0]]:
            used[counts[i][0]] = used.get(counts[i][0], 0) + 1
    left = [x for x in range(41) for _ in range(int(have[x]) - used.get(x, 0))]
    there = any(sum(c) == gap for n in (1, 2, 3) for c in itertools.combinations(left, n))
    found = packing.Complements(have).exact(gap, used)
    assert (found is not None) == there
    if found:
        rest = list(left)
        for x in found:
            rest.remove(x)
        assert sum(found) == gap


def test_other_columns_play_no_part(docs):
    wider = docs.withColumns({c: F.lit(c) for c in ("piece", "start", "length", "sequence_id", "offset", "_salt", "_rank")})
    got = sorted(map(tuple, packing.cut_pieces(wider, PATH).collect()), key=repr)
    assert got == sorted(map(tuple, packing.cut_pieces(docs, PATH).collect()), key=repr)
    assert packing.pack_documents(wider, PATH, 64).columns == packing.pack_documents(docs, PATH, 64).columns


def test_combinations_fill_gaps_exactly():
    have = np.zeros(101, np.int64)
    for x, n in ((70, 4), (10, 8), (15, 2), (5, 2), (30, 1)):
        have[x] = n
    plan = packing.plan(have)
    assert sum(n for lengths, n in plan if sum(lengths) == 100) == 4
    assert packing.Complements(have).exact(30, {70: 1}) == [30]
    assert sorted(packing.Complements(have).exact(25, {})) == [10, 15]
    assert sorted(packing.Complements(have).exact(35, {})) in ([5, 30], [10, 10, 15])


def test_ids_can_be_kept(docs):
    row = packing.cut_pieces(docs.where("doc_id = 10"), PATH, with_ids=True).first()
    assert row["ids"][-1] == 1 and len(row["ids"]) == row["length"]
