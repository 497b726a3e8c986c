"""Operator 4: byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression on the text. Every code point becomes a symbol of a small alphabet
(letters, digits, other, blanks, apostrophes that begin a contraction), every symbol is a transition function
over eight states, and composition of those functions is associative: a blocked prefix scan over the (finite)
monoid they generate gives the state at every code point, and from state and symbol follows whether a token
begins there. Slices between boundaries are looked up in a cache of merged pieces; misses go through pair
merging once. Token ids decode through a table of their bytes, offsets locate each token in the UTF-8 text.

Defined results: null text is the empty text; an empty text has no tokens; texts of any length are whole. Rows that repeat
are each returned; an empty table gives an empty one; other columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Bound of the bytes that a worker's piece cache holds, with a guess of what an entry takes besides; beyond it the cache starts
#: anew, and longer pieces are not kept (results are the same).
CACHE_BYTES, CACHED_PIECE, ENTRY_BYTES = 128 << 20, 64, 250

# symbols
LETTER, DIGIT, OTHER, APO1, APO2, SPACE_TO, BLANK_TO, BLANK_ON = range(8)
# states
FRESH, IN_L, IN_N, IN_O, PREFIX, IN_W, CON2, CON1 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state and whether a token begins at this symbol."""
    if symbol == LETTER:
        if state == CON2:
            return CON1, False
        if state == CON1:
            return FRESH, False
        return IN_L, state not in (IN_L, PREFIX)
    if symbol == DIGIT:
        return IN_N, state not in (IN_N, PREFIX)
    if symbol == OTHER:
        return IN_O, state not in (IN_O, PREFIX)
    if symbol in (APO1, APO2):
        if state in (IN_O, PREFIX):
            return IN_O, False
        return (CON1 if symbol == APO1 else CON2), True
    if symbol == SPACE_TO:
        return PREFIX, True
    if symbol == BLANK_TO:
        return FRESH, True
    return IN_W, state != IN_W


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Closure of the 8 symbols and their 8 first-of-text versions under composition.

    Returns generator ids (16), composition table, application table (element, state) and begins (state, symbol).
    """
    gens = [tuple(_step(s, c)[0] for s in range(8)) for c in range(8)]
    gens += [(_step(FRESH, c)[0],) * 8 for c in range(8)]
    ids = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    while queue:
        f = queue.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                queue.append(h)
    table = np.zeros((len(ids), len(ids)), np.uint16)
    for f, i in ids.items():
        for g, k in ids.items():
            table[i, k] = ids[tuple(g[x] for x in f)]
    apply = np.array(list(ids), np.uint8)
    begins = np.array([[_step(s, c)[1] for c in range(8)] for s in range(8)])
    return np.array([ids[g] for g in gens], np.uint16), table, apply, begins


def _scan(elements: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive prefix composition of monoid elements, in blocks of ``width`` and recursively over block totals."""
    _, table, _, _ = _monoid()
    flat, m = table.ravel(), table.shape[0]
    n = len(elements)
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros((width, rows), np.uint16)  # identity is element 0
    padded = np.zeros(rows * width, np.uint16)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, width).T
    for j in range(1, width):
        grid[j] = flat[grid[j - 1].astype(np.int32) * m + grid[j]]
    totals = _scan(grid[-1].copy(), width)
    before = np.zeros(rows, np.int32)
    before[1:] = totals[:-1]
    grid = flat[before[None, :] * m + grid]
    return grid.T.reshape(-1)[:n]


@functools.cache
def code_point_classes() -> bytes:
    """LETTER, DIGIT, OTHER or 3 (blank) of each code point as the tokenizer's own regex engine sees it; compressed."""
    import tiktoken

    single = {bytes([i]): i for i in range(256)}
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF)
    lut = np.full(0x110000, OTHER, np.uint8)
    for value, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (3, r"\s")):
        enc = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(enc.encode_ordinary(every)).decode()
        lut[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    return zlib.compress(lut.tobytes())


@functools.lru_cache(2)
def _classes(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def boundaries(joined: str, lengths: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Code-point positions in ``joined`` (texts end to end, ``lengths`` each) at which a token begins."""
    n = len(joined)
    if not n:
        return np.zeros(0, np.int64)
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes[cp]
    first = np.zeros(n + 1, bool)
    first[np.concatenate(([0], np.cumsum(lengths)))] = True  # also one past the end
    blank = kind == 3
    next_blank = np.ones(n, bool)  # the end of a text counts as blank
    next_blank[:-1] = blank[1:]
    next_blank |= first[1:]
    symbol = kind.copy()
    symbol[blank] = BLANK_ON
    turn = blank & ~next_blank
    symbol[turn] = BLANK_TO
    symbol[turn & (cp == 32)] = SPACE_TO
    at = np.flatnonzero(cp == 39)
    if len(at):
        padded = np.zeros(n + 2, np.uint32)
        padded[:n] = cp
        inside1 = ~first[at + 1]
        inside2 = inside1 & ~first[np.minimum(at + 2, n)]
        c1, c2 = padded[at + 1], padded[at + 2]
        one = inside1 & np.isin(c1, [ord(x) for x in "stmd"])
        two = inside2 & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        symbol[at[one]] = APO1
        symbol[at[two]] = APO2
    gens, _, apply, begins = _monoid()
    first = first[:n]
    after = apply[_scan(gens[symbol + np.uint8(8) * first]), FRESH]
    state = np.empty(n, np.uint8)
    state[0] = FRESH
    state[1:] = after[:-1]
    state[first] = FRESH
    return np.flatnonzero(begins.ravel()[state * np.uint8(8) + symbol] | first)


class ByteBpe:
    """Encoder and decoder over a rank file's bytes; one per worker process and vocabulary."""

    def __init__(self, rank_file: bytes, classes: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        # the whole slice is one match: the library only merges pairs here, it does not split
        self._merge = tiktoken.Encoding("slices", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._classes = _classes(classes)
        top = max(ranks.values()) + 1
        tokens = [b""] * top
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._reset()

    def _reset(self) -> None:
        self._index: dict[str, int] = {}
        self._pieces: list[list[int]] = []
        self._bytes = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        start = boundaries(joined, lengths, self._classes)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self._bytes > CACHE_BYTES:
            self._reset()
        index, pieces = self._index, self._pieces
        cuts = start.tolist()
        slices = [joined[a:b] for a, b in zip(cuts, cuts[1:] + [len(joined)], strict=True)]
        which = list(map(index.get, slices))
        long: list[str] = []
        if None in which:
            for i, w in enumerate(which):
                if w is None:
                    piece = slices[i]
                    if (w := index.get(piece)) is None:
                        w = index[piece] = len(pieces)
                        pieces.append(self._merge(piece))
                        self._bytes += ENTRY_BYTES + len(piece) + 8 * len(pieces[w])
                        if len(piece) > CACHED_PIECE:
                            long.append(piece)
                    which[i] = w
        which = np.array(which, np.int64)
        used, inverse = np.unique(which, return_inverse=True)
        own = [pieces[i] for i in used]
        for piece in long:  # used in this step alone
            i = index.pop(piece)
            self._bytes -= len(piece) + 8 * len(pieces[i])  # its place stays taken
            pieces[i] = []
        size = np.fromiter(map(len, own), np.int64, len(own))
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        flat = np.fromiter((x for p in own for x in p), np.uint32, int(size.sum()))
        n = size[inverse]
        ids = flat[_spread(at[inverse], n)]
        bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
        total = np.concatenate(([0], np.cumsum(n)))
        return ids, np.diff(total[bounds])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids end to end, and the number of bytes of each id."""
        n = self.token_len[ids]
        return self.token_bytes[_spread(self.token_at[ids], n)], n


def _spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Indices at[i], at[i]+1, ... of n[i] entries each, end to end."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    return np.arange(total) + np.repeat(at - (ends - n), n)


@functools.lru_cache(2)
def _codec(rank_file: bytes, classes: bytes) -> ByteBpe:
    return ByteBpe(rank_file, classes)


def _ranks(spark, path: str):
    """The rank file as a broadcast; vocabularies of public tokenizers are a few MB, more is refused."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("rank files over 64 MB are not broadcast")
    return spark.sparkContext.broadcast((data, code_point_classes()))


def encode_table(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, ends array<int>): token ids of each text and the UTF-8 byte offset at which each ends."""
    vocabulary = _ranks(docs.sparkSession, ranks_path)

    def run(batch: pa.RecordBatch):
        codec = _codec(*vocabulary.value)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in common.steps([len(x) for x in texts]):
            ids, n = codec.encode(texts[a:b])
            cut = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            ends = np.cumsum(codec.token_len[ids])
            base = np.concatenate(([0], ends))[cut[:-1]]
            ends = ends - np.repeat(base, n)
            lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (ids, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], [id_col, "ids", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, ends array<int>")


def decode_table(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, bytes binary) from ``encode_table``'s ids."""
    vocabulary = _ranks(encoded.sparkSession, ranks_path)

    def run(batch: pa.RecordBatch):
        codec = _codec(*vocabulary.value)
        out = []
        for ids in batch.column(1).to_pylist():
            out.append(codec.decode(np.array(ids or [], np.int64))[0].tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return common.map_batches(encoded.select(id_col, "ids"), run, f"`{id_col}` {kind}, bytes binary")


def digest_round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Encode every text, decode the ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    vocabulary = _ranks(docs.sparkSession, ranks_path)

    def run(batch: pa.RecordBatch):
        codec = _codec(*vocabulary.value)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        counts, coded, back = [], [], []
        for a, b in common.steps([len(x) for x in texts]):
            ids, n = codec.encode(texts[a:b])
            raw, size = codec.decode(ids)
            ids = ids.astype("<u4")
            cut = np.concatenate(([0], np.cumsum(n)))
            cut_bytes = np.concatenate(([0], np.cumsum(size)))[cut].tolist()
            counts += n.tolist()
            cut = cut.tolist()
            coded += [hashlib.sha256(ids[x:y]).hexdigest() for x, y in zip(cut, cut[1:], strict=False)]
            back += [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(cut_bytes, cut_bytes[1:], strict=False)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return common.map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
