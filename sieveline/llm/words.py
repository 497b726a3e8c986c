"""Vectorised words and shingles over UTF-8 bytes: no per-word Python."""

from __future__ import annotations

import hashlib

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words beyond this many bytes are hashed one by one.
LONG = 512


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of buf[start:end] of each slice, eight bytes at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), np.dtype("<u8"), padded.data, strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    long = size > LONG
    active = np.flatnonzero((size > 0) & ~long)
    offset = 0
    while len(active):
        rest = np.minimum(size[active] - offset, 8)
        h[active] = mix(h[active] * np.uint64(0x9E3779B97F4A7C15) + (lanes[start[active] + offset] & _MASK[rest]))
        offset += 8
        active = active[size[active] > offset]
    for i in np.flatnonzero(long):
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs without blanks, A-Z lowered: (bytes, start, end, text of each word, first word of each text + total)."""
    buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if lower:
        buf = _LOWER[buf]
    blank = _BLANK[buf]
    edge = np.empty(len(buf) + 1, bool)  # whether a word begins or ends at this byte
    if not len(buf):
        none = np.zeros(0, np.int64)
        return buf, none, none, none, np.zeros(len(texts) + 1, np.int64)
    edge[0] = not blank[0]
    edge[1:-1] = blank[1:] != blank[:-1]
    edge[-1] = not blank[-1]
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    bounds = np.searchsorted(start, text_at)
    return buf, start, end, np.repeat(np.arange(len(texts)), np.diff(bounds)), bounds


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Distinct hashes of ``width``-word shingles of each text, ascending; fewer words make one shingle, none no set."""
    buf, start, end, _, bounds = words(texts)
    h = hash_slices(buf, start, end)
    n = len(h)
    phi = np.uint64(0x9E3779B97F4A7C15)
    if n >= width:
        acc = h[: n - width + 1].copy()
        for j in range(1, width):
            acc = mix(acc * phi + h[j : n - width + 1 + j])
    else:
        acc = h[:0]
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(acc[a : b - width + 1]))
        elif b > a:
            x = h[a : a + 1].copy()
            for j in range(a + 1, b):
                x = mix(x * phi + h[j : j + 1])
            out.append(x)
        else:
            out.append(h[:0])
    return out
