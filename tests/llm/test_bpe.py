"""Byte-level BPE against the tokenizer library."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import bpe

from .conftest import awkward

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.ByteBpe(f.read(), bpe.code_point_classes())


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aZ 's'll'retvedm\n\t  09½.!é日 "), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_boundaries_and_ids(codec, library, texts):
    ids, n = codec.encode(texts)
    wanted = [library.encode_ordinary(t) for t in texts]
    assert ids.tolist() == sum(wanted, []) and n.tolist() == list(map(len, wanted))
    raw, size = codec.decode(ids)
    assert raw.tobytes() == "".join(texts).encode() and size.sum() == len(raw)


def test_scan_equals_composition_one_by_one():
    rng = np.random.default_rng(1)
    gens, table, _, _ = bpe._monoid()
    for n in (1, 63, 64, 65, 5000):
        x = gens[rng.integers(0, len(gens), n)]
        slow = x.copy()
        for i in range(1, n):
            slow[i] = table[slow[i - 1], x[i]]
        assert (bpe._scan(x) == slow).all()


def test_awkward_documents(docs, library):
    got = sorted(map(tuple, bpe.digest_round_trip(docs, PATH).collect()), key=repr)
    wanted = []
    for doc_id, text, *_ in awkward():
        ids = library.encode_ordinary(text or "")
        wanted.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(wanted, key=repr)


def test_offsets_and_decoding(docs, library):
    coded = bpe.encode_table(docs, PATH)
    rows = {r["doc_id"]: r for r in coded.collect()}
    text = dict(r[:2] for r in awkward())[81].encode()
    ids, ends = rows[81]["ids"], rows[81]["ends"]
    assert ends[-1] == len(text)
    assert [text[a:b] for a, b in zip([0, *ends], ends, strict=False)] == [library.decode_single_token_bytes(i) for i in ids]
    back = {r["doc_id"]: bytes(r["bytes"]) for r in bpe.decode_table(coded, PATH).collect()}
    assert back[81] == text and back[8] == b"" and back[7] == b""


def test_the_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 5000)
    with open(PATH, "rb") as f:
        small = bpe.ByteBpe(f.read(), bpe.code_point_classes())
    for i in range(60):
        texts = [f"word{i} and more{i}", "long" * 40 + str(i), "long" * 40 + str(i)]
        ids, _ = small.encode(texts)
        assert ids.tolist() == sum(map(library.encode_ordinary, texts), [])
        assert len(small._index) < 60 and max(map(len, small._index)) <= bpe.CACHED_PIECE


def test_other_columns_play_no_part(docs):
    wider = docs.withColumns({c: F.lit(c) for c in ("ids", "ends", "n_tokens", "bytes")})
    assert sorted(map(tuple, bpe.digest_round_trip(wider, PATH).collect()), key=repr) == sorted(map(tuple, bpe.digest_round_trip(docs, PATH).collect()), key=repr)
    assert bpe.encode_table(wider, PATH).columns == ["doc_id", "ids", "ends"]


def test_empty_table(nothing):
    assert bpe.digest_round_trip(nothing, PATH).collect() == []
    assert bpe.encode_table(nothing, PATH).collect() == []
