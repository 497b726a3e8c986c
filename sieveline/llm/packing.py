"""Operator 3: best-fit packing of token sequences by exact complements.

Texts are tokenised once; only (document, piece, start, length, checksum) rows are kept. A packing depends on
lengths alone, so it is planned on the histogram of lengths (at most ``capacity`` numbers, whatever the corpus):
a sequence opened with the longest piece has a gap; the index of available single lengths, pair sums and triple sums
is asked for that gap, a combination found is consumed as often as its counts allow, and where none fits exactly
the longest piece that fits is added (best fit) and the index asked again. The plan says, for each length, which
sequence and offset its r-th piece gets; ranks come from salted windows, so a length that a third of all pieces
have is dealt out.

Defined results: null text is the empty text, an empty text is the end token alone; repeated rows are packed each;
null ids pass through. Only documents over ``capacity`` are cut. Of equal lengths those with smaller ids and pieces get
the earlier places of their part; which of several equal rows gets which place is open. An empty table gives an empty
one. Other columns play no part, whatever their names.
"""

from __future__ import annotations

import array
import functools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from . import common

CAPACITY = 4096
END = 1
#: Bound of the bytes that a worker's cache of pieces holds; beyond it the cache starts anew. Longer pieces are not kept.
CACHE_BYTES, CACHED_PIECE, ENTRY_BYTES = 192 << 20, 64, 150

_LETTER = rb"[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: Pieces of a text that can be encoded alone: runs of ASCII and Latin-1 letters and runs of ASCII digits and signs, where neither meets a
#: character beyond these (it might combine or be of the same kind) and no apostrophe precedes a letter; else all up to the next blank.
PIECES = re.compile(rb"((?:" + _LETTER + rb")++)(?![\x80-\xff])|([!-&(-@\[-`{-~]++(?![\x00-\x08\x0e-\x1f\x7f-\xff'])|[^\t-\r ]++)")
_LETTERS = re.compile(rb"(?:" + _LETTER + rb")+")


class PieceEncoder(dict):
    """Ids of texts by a public tokenizer that never joins across blanks, nor letters with signs.

    Maps each chunk between blanks, and each piece of one, to its ids as little-endian bytes; a new chunk is put together
    from its pieces, and only a new piece is encoded. Words of plain letters go to the tokenizer's model directly, in the
    form its normaliser would give them. A text that holds the string of an added token (``<|endoftext|>``) is left to the
    library as a whole, which gives such a string its own id.
    """

    def __init__(self, tokenizer_json: bytes):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self._model = self._tokenizer.model
        added = self._tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens must be plain strings")
        self._added = [t.content.encode() for t in added]
        self._bytes = 0

    def _keep(self, piece: bytes, ids: bytes) -> bytes:
        if len(piece) <= CACHED_PIECE:
            self[piece] = ids
            self._bytes += ENTRY_BYTES + len(piece) + len(ids)
        return ids

    def _by_library(self, text: bytes) -> bytes:
        return np.array(self._tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        plain = word.isascii()
        low = word.lower() if plain else word.decode().lower().encode()
        if (ids := self.get(low)) is None:
            shown = low.decode() if plain else low.decode("latin-1").translate(_VISIBLE)
            ids = self._keep(low, array.array("I", [t.id for t in self._model.tokenize(shown)]).tobytes())
        return ids if low == word else self._keep(word, ids)

    def __missing__(self, chunk: bytes) -> bytes:
        out = []
        for letters, other in PIECES.findall(chunk):
            if (ids := self.get(letters or other)) is None:
                if letters or _LETTERS.fullmatch(other):
                    ids = self._word(letters or other)
                else:
                    ids = self._keep(other, self._by_library(other))
            out.append(ids)
        return out[0] if len(out) == 1 else self._keep(chunk, b"".join(out))

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, four bytes each."""
        if self._bytes > CACHE_BYTES:
            self.clear()
            self._bytes = 0
        if any(x in text for x in self._added):
            return self._by_library(text)
        return b"".join(map(self.__getitem__, text.split()))  # of bytes: at ASCII blanks


def _visible() -> dict[int, str]:
    """The byte-level alphabet: each byte as a printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_VISIBLE = _visible()
_END = np.array([END], "<u4").tobytes()


@functools.lru_cache(2)
def _encoder(tokenizer_json: bytes) -> PieceEncoder:
    return PieceEncoder(tokenizer_json)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's tokens and end token, cut only beyond ``capacity``."""
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("tokenizer files over 64 MB are not broadcast")
    vocabulary = docs.sparkSession.sparkContext.broadcast(data)

    def run(batch: pa.RecordBatch):
        encoder = _encoder(vocabulary.value)
        keys = batch.column(0)
        texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        for a, b in common.steps([len(x) for x in texts]):
            row, piece, start, length, crc, lists = [], [], [], [], [], []
            for i in range(a, b):
                own = memoryview(encoder.encode(texts[i]) + _END)
                for k, s in enumerate(range(0, len(own), 4 * capacity)):
                    x = own[s : s + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(x) // 4)
                    crc.append(zlib.crc32(x))
                    if with_ids:
                        lists.append(np.frombuffer(x, "<i4"))
            columns = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col), run, schema)


class Complements:
    """Available lengths with the index of their single, pair and triple sums.

    The index is a bit a sum. It may hold sums whose pieces are used up meanwhile (counts only fall), never lacks one; a
    sum found is therefore looked up among what is left, exhaustively.
    """

    def __init__(self, counts: np.ndarray):
        self.have = counts.astype(np.int64).copy()
        self.capacity = len(counts) - 1
        self._sums: tuple[int, int] | None = None

    def take(self, lengths: list[int], times: int) -> None:
        for x in lengths:
            self.have[x] -= times
            if not self.have[x]:  # it left the index
                self._sums = None

    def sums(self) -> tuple[int, int]:
        """Bits of the sums of two and of three available pieces."""
        if self._sums is None:
            there = np.flatnonzero(self.have > 0).tolist()
            room = (1 << self.capacity + 1) - 1
            singles = sum(1 << x for x in there)
            pairs = triples = 0
            for x in there:
                pairs |= singles << x & room
            for x in there:
                triples |= pairs << x & room
            self._sums = pairs, triples
        return self._sums

    def pair(self, gap: int, left: np.ndarray) -> tuple[int, int] | None:
        """The most even pair that sums to ``gap`` among the ``left`` counts; short pieces are kept for later gaps."""
        a = np.arange(gap // 2, 0, -1)
        ok = (left[a] > 0) & (left[gap - a] > 0)
        if gap % 2 == 0 and gap and left[gap // 2] < 2:
            ok[0] = False
        hit = np.flatnonzero(ok)
        return (int(a[hit[0]]), int(gap - a[hit[0]])) if len(hit) else None

    def triple(self, gap: int, left: np.ndarray) -> list[int] | None:
        """The longest piece beside which a pair of the ``left`` counts fills ``gap``, with the most even such pair."""
        bits = lambda n: int.from_bytes(np.packbits(left[: gap + 1] >= n, bitorder="little").tobytes(), "little")
        one, two = bits(1) & ~1, bits(2) & ~1
        mirrored = int.from_bytes(np.packbits((left[gap::-1] > 0), bitorder="little").tobytes(), "little")  # bit i: whether gap - i is there
        for x in np.flatnonzero(left[: gap - 1] > 0)[::-1].tolist():
            rest = gap - x  # of two pieces, a and rest - a
            if x == 0:
                break
            found = one & mirrored >> x & (1 << rest) - 1
            for own, fits in ((x, two >> x & 1 and (rest != 2 * x or left[x] > 2)), (rest - x, two >> x & 1 and (rest != 2 * x or left[x] > 2))):
                if 0 < own < rest and not fits:  # x itself is in the pair, and not there often enough
                    found &= ~(1 << own)
            if rest % 2 == 0 and not two >> rest // 2 & 1:
                found &= ~(1 << rest // 2)
            if found:
                more = left.copy()
                more[x] -= 1
                return [x, *self.pair(rest, more)]
        return None

    def exact(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three available pieces, beside the ``used`` ones, that fill ``gap`` exactly; none only if there are none."""
        left = self.have[: gap + 1].copy()
        for x, n in used.items():
            if x <= gap:
                left[x] -= n
        if left[gap] > 0:
            return [gap]
        pairs, triples = self.sums()
        if pairs >> gap & 1 and (found := self.pair(gap, left)):
            return list(found)
        return self.triple(gap, left) if triples >> gap & 1 else None

    def longest(self, gap: int, used: dict[int, int]) -> int:
        fits = np.flatnonzero(self.have[: gap + 1] > 0)
        for x in fits[::-1].tolist():
            if self.have[x] > used.get(x, 0):
                return x
        return 0


def plan(counts: np.ndarray, exact: bool = True) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, how many such sequences), for ``counts[length]`` pieces; without ``exact`` plain best fit."""
    index = Complements(counts)
    capacity, out = index.capacity, []
    while True:
        there = np.flatnonzero(index.have > 0)
        if not len(there):
            return out
        lengths = [int(there[-1])]
        used = {lengths[0]: 1}
        gap = capacity - lengths[0]
        while gap:
            found = index.exact(gap, used) if exact else None
            if not found:
                x = index.longest(gap, used)
                found = [x] if x else None
            if not found:
                break
            for x in found:
                lengths.append(x)
                used[x] = used.get(x, 0) + 1
            gap -= sum(found)
        times = min(int(index.have[x]) // n for x, n in used.items())
        index.take(lengths, times)
        out.append((lengths, times))


def best_plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """The plan with exact complements, or plain best fit where that needs fewer sequences."""
    plans = [plan(counts), plan(counts, exact=False)]
    return min(plans, key=lambda p: sum(n for _, n in p))


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a ``length`` column; read twice, so best a written table) plus ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before")
    )
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    keys, bases, offsets = [], [], []
    cursor = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, times in best_plan(counts):
        at = 0
        for x in lengths:
            keys.append(x << 44 | int(cursor[x]))
            bases.append(sequence)
            offsets.append(at)
            cursor[x] += times
            at += x
        sequence += times
    sort = np.argsort(np.array(keys, np.int64))
    slots = spark.sparkContext.broadcast(tuple(np.array(v, np.int64)[sort] for v in (keys, bases, offsets)))

    window = W.partitionBy("length", "_salt").orderBy(*order)
    ranked = (
        salted.withColumn("_rank", F.row_number().over(window) - 1)
        .join(before, ["length", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .select(*pieces.columns, "_rank")
    )
    at_length, at_rank = pieces.columns.index("length"), len(pieces.columns)

    def run(batch: pa.RecordBatch):
        starts, base, offset = slots.value
        length = batch.column(at_length).to_numpy(zero_copy_only=False)
        key = length.astype(np.int64) << 44 | batch.column(at_rank).to_numpy(zero_copy_only=False).astype(np.int64)
        slot = np.searchsorted(starts, key, side="right") - 1
        columns = [*batch.columns[:-1], pa.array(base[slot] + key - starts[slot]), pa.array(offset[slot])]
        return pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    out = StructType(list(pieces.schema.fields)).add("sequence_id", LongType()).add("offset", LongType())
    return common.map_batches(ranked, run, out)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(common.materialize(cut_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)
