"""Count-only Viterbi against a plain one and against the tokenizer library in unigram mode."""

from __future__ import annotations

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import tokencount

from .conftest import awkward

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = st.text(st.one_of(st.sampled_from("the and▁ ein  aé日\n\t0▁12."), st.characters(exclude_categories=["Cs"])), max_size=40)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _write(value: int) -> bytes:
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def as_unigram(data: bytes) -> bytes:
    """The model file with model_type (field 3 of field 2) set to unigram, so that the library itself runs Viterbi."""

    def fields(x: bytes):
        at = 0
        while at < len(x):
            begin = at
            tag, at = _varint(x, at)
            if tag & 7 == 2:
                n, at = _varint(x, at)
                body, at = x[at : at + n], at + n
            else:
                body, at = b"", (_varint(x, at)[1] if tag & 7 == 0 else at + (8 if tag & 7 == 1 else 4))
            yield tag >> 3, x[begin:at], body

    out = b""
    for number, raw, body in fields(data):
        if number == 2:
            trainer = b"".join(r for k, r, _ in fields(body) if k != 3) + bytes([3 << 3, 1])
            raw = bytes([2 << 3 | 2]) + _write(len(trainer)) + trainer
        out += raw
    return out


@pytest.fixture(scope="module")
def data():
    with open(PATH, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def counter(data):
    return tokencount.UnigramCounter(data)


def plain(counter, text: str) -> tuple[int, float]:  # noqa: ANN001
    """Viterbi by definition over the whole normalised text."""
    text = tokencount.MARK + text.replace(" ", tokencount.MARK) if text else ""
    longest = max(map(len, counter.pieces))
    best, count = [0.0], [0]
    for e in range(1, len(text) + 1):
        found = None
        for s in range(max(0, e - longest), e):
            score = counter.pieces.get(text[s:e])
            n = 1
            if score is None:
                if s < e - 1:
                    continue
                score, n = min(counter.pieces.values()) - 10.0, len(text[s:e].encode())
            if found is None or best[s] + score > found[0]:
                found = (best[s] + score, count[s] + n)
        best.append(found[0])
        count.append(found[1])
    return count[-1], best[-1]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_equals_plain_viterbi(counter, text):
    got = counter.count(text)
    assert got == plain(counter, text)
    whole = counter.solve(tokencount.MARK + text.replace(" ", tokencount.MARK)) if text else (0, 0.0)
    assert got == whole  # chunks and whole texts agree


@pytest.fixture(scope="module")
def library(data):
    return sentencepiece.SentencePieceProcessor(model_proto=as_unigram(data))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_equals_the_library(counter, library, text):
    if "\0" in text:
        return
    assert counter.count(text)[0] == len(library.encode(text))


def test_awkward_documents(docs, counter):
    got = sorted(map(tuple, tokencount.count_tokens(docs, PATH).collect()), key=repr)
    assert got == sorted(((r[0], *counter.count(r[1] or "")) for r in awkward()), key=repr)
    assert all(r[1] == 0 and r[2] == 0 for r in got if r[0] in (7, 8))


def test_empty_table(nothing):
    assert tokencount.count_tokens(nothing, PATH).collect() == []


def test_other_columns_play_no_part_and_the_cache_is_bounded(docs, monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_BYTES", 4000)
    wider = docs.withColumns({c: F.lit(c) for c in ("n_tokens", "score")})
    assert sorted(map(tuple, tokencount.count_tokens(wider, PATH).collect()), key=repr) == sorted(map(tuple, tokencount.count_tokens(docs, PATH).collect()), key=repr)
    with open(PATH, "rb") as f:
        data = f.read()
    small, large = tokencount.UnigramCounter(data), tokencount.UnigramCounter(data)
    monkeypatch.setattr(tokencount, "CACHE_BYTES", 1 << 30)
    wanted = [large.count(f"word{i} " + "x" * 200 + f" other{i}") for i in range(60)]
    monkeypatch.setattr(tokencount, "CACHE_BYTES", 4000)
    assert [small.count(f"word{i} " + "x" * 200 + f" other{i}") for i in range(60)] == wanted
    assert len(small._cache) < 40 and max(map(len, small._cache)) <= tokencount.CACHED_CHUNK
