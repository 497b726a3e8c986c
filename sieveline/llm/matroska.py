"""Operator 10: media columns in Matroska.

``mux`` stores a payload as 8-bit PCM in a Matroska file (EBML header, Segment, Info, Tracks, Clusters of laced
SimpleBlocks, Cues); ``parse`` reads any such file: variable-length EBML elements (unknown sizes included),
clusters, the four lacings, block groups and cues become packet tables with track, timestamp and byte range.

Defined results: null media gives no tracks and no packets; null or empty payloads are padded to one unit of
64 zero bytes; bytes that are no Matroska file raise ``ValueError`` in ``parse`` and give an ``error`` column in
``packet_table``. Rows that repeat are each stored, equal texts alike; an empty table gives an empty one; other columns
play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

UNIT = 64  # payloads are padded to a multiple of this
FRAME = 512  # bytes a frame: 64 ms at 8 samples a ms
LACED = 8  # frames a block
BLOCKS = 32  # blocks a cluster: 16 s, within the 16-bit block timestamps
RATE = 8000

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
SIMPLE_BLOCK, BLOCK, CLUSTER_TIME, TIMESTAMP_SCALE = 0xA3, 0xA1, 0xE7, 0x2AD7B1
#: Elements that contain elements; the others are leaves.
MASTERS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_TRACK_POSITIONS}
#: An element of unknown size ends where one of these, at its own level or above, begins.
LEVEL = {EBML: 0, SEGMENT: 0, 0x114D9B74: 1, INFO: 1, TRACKS: 1, CLUSTER: 1, CUES: 1, 0x1043A770: 1, 0x1941A469: 1, 0x1254C367: 1}


def write_id(number: int) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big")


def write_size(n: int, width: int = 0) -> bytes:
    """EBML variable-length size; all ones is kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return write_id(number) + write_size(len(body)) + body


def unsigned(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int, bool]:
    """Value, position behind it, and whether all its bits are ones (unknown size)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"variable-length integer cut off at byte {at}")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & (1 << 7 * width) - 1
    return raw if keep_marker else value, at + width, value == (1 << 7 * width) - 1


def _lace_sizes(sizes: list[int], lacing: int) -> bytes:
    """Lacing header behind the frame count; the last size follows from the block's, so a lone frame has none."""
    if len(sizes) < 2:
        return b""
    if lacing == 1:  # Xiph
        return b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if lacing == 3:  # EBML: the first size, then signed differences
        out = write_size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            d = b - a
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1))
            out += write_size(d + (1 << 7 * width - 1) - 1, width)
        return out
    return b""


def block(track: int, relative_ms: int, frames: list[bytes], lacing: int) -> bytes:
    """Body of a SimpleBlock; lacing 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    head = write_size(track) + struct.pack(">hB", relative_ms, 0x80 | lacing << 1)
    if lacing:
        head += bytes([len(frames) - 1]) + _lace_sizes([len(f) for f in frames], lacing)
    return head + b"".join(frames)


_HEADER = element(
    EBML, unsigned(0x4286, 1), unsigned(0x42F7, 1), unsigned(0x42F2, 4), unsigned(0x42F3, 8),
    element(0x4282, b"matroska"), unsigned(0x4287, 4), unsigned(0x4285, 2),
)
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY, unsigned(0xD7, 1), unsigned(0x73C5, 1), unsigned(0x83, 2), unsigned(0x9C, 1), element(0x86, b"A_PCM/INT/LIT"),
        element(AUDIO, element(0xB5, struct.pack(">d", RATE)), unsigned(0x9F, 1), unsigned(0x6264, 8)),
    ),
)


def pad(payload: bytes) -> bytes:
    return payload + b"\0" * (-len(payload) % UNIT or (0 if payload else UNIT))


def mux(payload: bytes) -> bytes:
    """A Matroska file whose only track's frames, joined, are ``payload`` (a multiple of 64 bytes)."""
    per_cluster, per_block = FRAME * LACED * BLOCKS, FRAME * LACED
    info = element(
        INFO, unsigned(TIMESTAMP_SCALE, 1_000_000), element(0x4489, struct.pack(">d", len(payload) * 1000 / RATE)),
        element(0x4D80, b"sieveline"), element(0x5741, b"sieveline"),
    )
    parts, position = [info, _TRACKS], len(info) + len(_TRACKS)
    cues = []
    for c in range(0, len(payload), per_cluster):
        blocks = []
        for b in range(c, min(c + per_cluster, len(payload)), per_block):
            cut = payload[b : b + per_block]
            frames = [cut[i : i + FRAME] for i in range(0, len(cut), FRAME)]
            lacing = 0 if len(frames) == 1 else 2 if len(frames[-1]) == FRAME else 3
            blocks.append(element(SIMPLE_BLOCK, block(1, (b - c) * 1000 // RATE, frames, lacing)))
        begin = c * 1000 // RATE
        cluster = element(CLUSTER, unsigned(CLUSTER_TIME, begin), *blocks)
        cues.append(element(CUE_POINT, unsigned(0xB3, begin), element(CUE_TRACK_POSITIONS, unsigned(0xF7, 1), unsigned(0xF1, position))))
        parts.append(cluster)
        position += len(cluster)
    return _HEADER + element(SEGMENT, *parts, element(CUES, *cues))


@dataclass
class Media:
    """Tables of one file: tracks by number, packets and cues in file order."""

    doc_type: str = ""
    scale_ns: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)  # track, time, offset, size, key frame
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, position in the segment


def elements(data: bytes, at: int, end: int, parent_level: int = -1) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of each element's body; of one of unknown size the end is found by its level."""
    while at < end:
        number, at, _ = read_vint(data, at, True)
        size, at, unknown = read_vint(data, at, False)
        if unknown:
            level, stop = LEVEL.get(number, 9), at
            while stop < end:
                inner, behind, _ = read_vint(data, stop, True)
                if LEVEL.get(inner, 9) <= level:
                    break
                n, behind, open_end = read_vint(data, behind, False)
                stop = end if open_end and LEVEL.get(inner, 9) > level and number != SEGMENT else behind + (0 if open_end else n)
            size = min(stop, end) - at
        if at + size > end:
            raise ValueError(f"element {number:x} reaches beyond its parent")
        yield number, at, at + size
        at += size


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative time, key frame and (offset, size) of each frame of a block."""
    track, at, _ = read_vint(data, at, False)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, relative, bool(flags & 0x80), [(at, end - at)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n += 255
                at += 1
            sizes.append(n + data[at])
            at += 1
    elif lacing == 3 and count > 1:
        n, at, _ = read_vint(data, at, False)
        sizes.append(n)
        for _ in range(count - 2):
            before = at
            d, at, _ = read_vint(data, at, False)
            n += d - (1 << 7 * (at - before) - 1) + 1
            sizes.append(n)
    elif lacing == 2:
        if (end - at) % count:
            raise ValueError("fixed lacing does not divide its block")
        sizes = [(end - at) // count] * (count - 1)
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    if at > end:
        raise ValueError("laced frames reach beyond their block")
    out.append((at, end - at))
    return track, relative, bool(flags & 0x80), out


def parse(data: bytes) -> Media:
    """Tables of a Matroska file; raises ``ValueError`` on anything else."""
    media = Media()
    number = lambda b, e: int.from_bytes(data[b:e], "big")
    real = lambda b, e: struct.unpack(">d" if e - b == 8 else ">f", data[b:e])[0] if e > b else 0.0

    def add(cluster_time: int, b: int, e: int, key: bool | None) -> None:
        track, relative, flag, frames = _frames(data, b, e)
        entry = media.tracks.get(track, {})
        time = cluster_time + relative
        for offset, size in frames:
            media.packets.append((track, time, offset, size, flag if key is None else key))
            if entry.get("bytes_per_s"):  # the later frames of a lace follow by their own length
                time += size * 1_000_000_000 // (entry["bytes_per_s"] * media.scale_ns)

    for top, b0, e0 in elements(data, 0, len(data)):
        if top == EBML:
            media.doc_type = next((data[b:e].decode("latin-1") for k, b, e in elements(data, b0, e0) if k == 0x4282), "")
        elif top == SEGMENT:
            for k1, b1, e1 in elements(data, b0, e0):
                if k1 == INFO:
                    for k, b, e in elements(data, b1, e1):
                        if k == TIMESTAMP_SCALE:
                            media.scale_ns = number(b, e)
                        elif k == 0x4489:
                            media.duration = real(b, e)
                elif k1 == TRACKS:
                    for _, b2, e2 in elements(data, b1, e1):
                        entry = {"codec": "", "type": 0, "rate": 8000.0, "channels": 1, "bits": 0}
                        own = 0
                        for k, b, e in elements(data, b2, e2):
                            if k == 0xD7:
                                own = number(b, e)
                            elif k == 0x86:
                                entry["codec"] = data[b:e].decode("latin-1")
                            elif k == 0x83:
                                entry["type"] = number(b, e)
                            elif k == AUDIO:
                                for k3, b3, e3 in elements(data, b, e):
                                    name = {0xB5: "rate", 0x9F: "channels", 0x6264: "bits"}.get(k3)
                                    if name:
                                        entry[name] = real(b3, e3) if name == "rate" else number(b3, e3)
                        entry["bytes_per_s"] = int(entry["rate"] * entry["channels"] * entry["bits"] / 8)
                        media.tracks[own] = entry
                elif k1 == CLUSTER:
                    time = 0
                    for k, b, e in elements(data, b1, e1):
                        if k == CLUSTER_TIME:
                            time = number(b, e)
                        elif k == SIMPLE_BLOCK:
                            add(time, b, e, None)
                        elif k == BLOCK_GROUP:
                            inner = list(elements(data, b, e))
                            for k3, b3, e3 in inner:
                                if k3 == BLOCK:
                                    add(time, b3, e3, all(x[0] != 0xFB for x in inner))
                elif k1 == CUES:
                    for _, b2, e2 in elements(data, b1, e1):
                        time = 0
                        for k, b, e in elements(data, b2, e2):
                            if k == 0xB3:
                                time = number(b, e)
                            elif k == CUE_TRACK_POSITIONS:
                                got = {k3: number(b3, e3) for k3, b3, e3 in elements(data, b, e) if k3 in (0xF7, 0xF1)}
                                media.cues.append((time, got.get(0xF7, 0), got.get(0xF1, 0)))
    if media.doc_type not in ("matroska", "webm"):
        raise ValueError("no Matroska file")
    return media


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[o : o + n] for t, _, o, n, _ in media.packets if t == track)


def feature(media: Media, samples: bytes) -> str:
    """What the packet table and the samples say, as text: the same for equal payloads."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero(x[1:] * x[:-1] < 0))
    squares = int((x.astype(np.int64) ** 2).sum())
    longest = max((n for *_, n, _ in media.packets), default=0)
    return (
        f"tracks={len(media.tracks)};packets={len(media.packets)};cues={len(media.cues)};longest={longest};"
        f"ms={len(x) * 1000 // RATE};sum={int(x.sum())};squares={squares};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"
    )


def mux_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary): each whole text as a Matroska file."""

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).to_pylist()
        for a, b in common.steps([len(x or "") for x in texts]):
            raw = [(x or "").encode() for x in texts[a:b]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(list(map(len, raw)), pa.int64()), pa.array([mux(pad(x)) for x in raw], pa.binary())],
                [id_col, "n_bytes", "media"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, media binary")


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a packet: (id, track, codec, timestamp_ms, byte_offset, byte_size, key_frame, error).

    A file that can't be parsed gives one row with ``error`` and nulls.
    """

    def run(batch: pa.RecordBatch):
        keys, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for key, x in zip(keys, data, strict=True):
            if x is None:
                continue
            try:
                m = parse(x)
                rows = [(key, t, m.tracks.get(t, {}).get("codec"), ms * m.scale_ns // 1_000_000, o, n, k, None) for t, ms, o, n, k in m.packets]
            except (ValueError, IndexError, struct.error) as e:
                rows = [(key, None, None, None, None, None, None, str(e))]
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [id_col, "track", "codec", "timestamp_ms", "byte_offset", "byte_size", "key_frame", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return common.map_batches(
        files.select(id_col, media_col), run,
        f"`{id_col}` {kind}, track long, codec string, timestamp_ms long, byte_offset long, byte_size long, key_frame boolean, error string",
    )


def read_back(files: DataFrame) -> DataFrame:
    """Parse stored files, join their frames and describe them: digests of payload and file, and features."""

    def run(batch: pa.RecordBatch):
        rows = []
        for data in batch.column(2).to_pylist():
            media = parse(data)
            samples = payload_of(data, media)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, samples)))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    return common.map_batches(
        files.select("doc_id", "n_bytes", "media"), run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
