"""Matroska: round trips, lacing, unknown sizes, packet tables."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.llm import matroska as mk

from .conftest import awkward, make


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=9000))
def test_payloads_come_back(payload):
    padded = mk.pad(payload)
    assert len(padded) % 64 == 0 and len(padded) > 0 and padded.startswith(payload) and len(padded) - len(payload) <= 64
    data = mk.mux(padded)
    media = mk.parse(data)
    assert mk.payload_of(data, media) == padded
    assert list(media.tracks) == [1] and media.tracks[1]["bits"] == 8


@pytest.mark.parametrize("n", [64, 512, 4096, 4096 * 32, 4096 * 32 + 64, 2_000_000 - 2_000_000 % 64])
def test_clusters_cues_and_timestamps(n):
    payload = bytes(i * 7 % 251 for i in range(n))
    data = mk.mux(payload)
    media = mk.parse(data)
    assert mk.payload_of(data, media) == payload
    assert [t for _, t, *_ in media.packets] == [i * 64 for i in range(len(media.packets))]
    segment = data.index(mk.write_id(mk.SEGMENT))
    body = mk.read_vint(data, segment + 4, False)[1]
    for time, track, position in media.cues:
        assert track == 1 and data[body + position : body + position + 4] == mk.write_id(mk.CLUSTER)
        assert any(t == time for _, t, *_ in media.packets)
    assert media.duration == n / 8


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
@settings(max_examples=40, deadline=None)
@given(sizes=st.lists(st.integers(0, 700), min_size=1, max_size=9))
def test_every_lacing(lacing, sizes):
    if lacing == 0:
        sizes = sizes[:1]
    elif lacing == 2:
        sizes = [sizes[0]] * len(sizes)
    frames = [bytes([i + 1]) * n for i, n in enumerate(sizes)]
    body = mk.block(5, -3, frames, lacing)
    track, relative, key, found = mk._frames(body, 0, len(body))
    assert (track, relative, key) == (5, -3, True) and [body[o : o + n] for o, n in found] == frames


def _file(*segment: bytes, unknown: bool = False) -> bytes:
    body = b"".join(segment)
    return mk._HEADER + (mk.write_id(mk.SEGMENT) + b"\x01" + b"\xff" * 7 + body if unknown else mk.element(mk.SEGMENT, body))


def test_unknown_sizes_and_block_groups():
    cluster = lambda t, *blocks: mk.write_id(mk.CLUSTER) + b"\xff" + mk.unsigned(mk.CLUSTER_TIME, t) + b"".join(blocks)
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, mk.block(2, 5, [b"later"], 0)), mk.unsigned(0xFB, 1))
    data = _file(mk._TRACKS, cluster(0, mk.element(mk.SIMPLE_BLOCK, mk.block(1, 0, [b"abc"], 0)), group), cluster(1000, mk.element(mk.SIMPLE_BLOCK, mk.block(1, 7, [b"de", b"f"], 1))), unknown=True)
    media = mk.parse(data)
    assert [(t, ms, data[o : o + n], k) for t, ms, o, n, k in media.packets] == [
        (1, 0, b"abc", True), (2, 5, b"later", False), (1, 1007, b"de", True), (1, 1007, b"f", True),
    ]


def test_awkward_documents(docs):
    got = sorted(map(tuple, mk.read_back(mk.mux_table(docs)).collect()), key=repr)
    rows = []
    for doc_id, text, *_ in awkward():
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        rows.append((doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert [g[:5] for g in got] == sorted(rows, key=repr)
    by_text: dict = {}
    for (doc_id, *_), g in zip(sorted(rows, key=repr), got, strict=True):
        assert g[0] == doc_id
        assert by_text.setdefault((g[1], g[3]), g[5:]) == g[5:]


def test_features_by_definition(spark):
    texts = ["", "a", "\x00\xffA" * 100, "ä" * 5000, "some text " * 3000]
    df = make(spark, list(enumerate(texts))).withColumns({c: F.lit(c) for c in ("media", "n_bytes", "feature", "payload_bytes")})
    got = {r["doc_id"]: r for r in mk.read_back(mk.mux_table(df)).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        samples = [b - 128 for b in raw + bytes(-len(raw) % 64 or (0 if raw else 64))]
        said = dict(x.split("=") for x in got[i]["feature"].split(";"))
        frames = -(-len(samples) // mk.FRAME)
        clusters = -(-frames // (mk.LACED * mk.BLOCKS))
        wanted = {
            "tracks": 1, "packets": frames, "cues": clusters, "longest": min(mk.FRAME, len(samples)), "ms": len(samples) // 8, "sum": sum(samples),
            "squares": sum(x * x for x in samples), "crossings": sum(x * y < 0 for x, y in zip(samples, samples[1:], strict=False)), "peak": max(map(abs, samples)),
        }
        assert {k: int(v) for k, v in said.items()} == wanted
        file = bytes(mk.mux_table(df.where(F.col("doc_id") == i)).first()["media"])
        assert got[i]["media_bytes"] == len(file) and got[i]["media_sha256"] == hashlib.sha256(file).hexdigest()


def test_packet_tables(spark, docs):
    files = mk.mux_table(docs.where("doc_id = 80"))
    row = files.first()
    packets = mk.packet_table(files).orderBy("byte_offset").collect()
    assert b"".join(bytes(row["media"])[p["byte_offset"] : p["byte_offset"] + p["byte_size"]] for p in packets).rstrip(b"\0").decode() == dict(r[:2] for r in awkward())[80]
    assert {p["codec"] for p in packets} == {"A_PCM/INT/LIT"}
    bad = spark.createDataFrame([(1, b"no media"), (2, None), (3, b""), (4, bytes(row["media"])[:300])], "doc_id long, media binary")
    out = {r["doc_id"]: r for r in mk.packet_table(bad).collect()}
    assert set(out) == {1, 3, 4} and all(r["error"] and r["track"] is None for r in out.values())


def test_empty_table(nothing):
    assert mk.read_back(mk.mux_table(nothing)).collect() == []
