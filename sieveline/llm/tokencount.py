"""Operator 6: token counts of a unigram tokenizer without the tokens.

An Aho-Corasick automaton enumerates the vocabulary's matches by their ends; dynamic programming keeps, for each
position, only the best score and the number of pieces on its path. Ties follow the tokenizers' rule: starts are taken
in ascending order and a later one must be strictly better, so of equal scores the longest last piece wins; a
character that is no piece of its own costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback).

Where no piece has a space mark behind another character and scores are whole numbers (so that sums are exact in any
order), the best path decomposes at spaces, and each distinct blank-led chunk is solved once per worker; otherwise
texts are solved as one. Both give the same counts.

Defined results: null and empty texts have no tokens and score 0; ``\\n`` and other characters beyond the vocabulary count
as bytes; special pieces never match text. Rows that repeat are each counted; an empty table gives an empty one; other
columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
#: Bound of the bytes that a worker's cache of chunks holds, with a guess of what an entry takes besides; longer chunks are not kept.
CACHE_BYTES, CACHED_CHUNK, ENTRY_BYTES = 128 << 20, 64, 250
UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts pieces of the best segmentation under (piece, score) of a SentencePiece model file with byte pieces."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        if sum(map(sp.is_byte, ids)) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        pieces = {sp.id_to_piece(i): float(sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.pieces = pieces
        self._unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        whole = all(s == int(s) for s in pieces.values())
        split = all(MARK not in p.lstrip(MARK) for p in pieces)
        self._chunks = None
        if whole and split:
            newline = not any("\n" in p for p in pieces)
            self._chunks = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if newline else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self._cache: dict[str, tuple[int, float]] = {}
        self._bytes = 0

    def solve(self, text: str) -> tuple[int, float]:
        """(pieces, score) of one normalised string."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        unknown, done = self._unknown, 0

        def lone(e: int) -> None:
            # no piece ends behind this character
            best[e] = best[e - 1] + unknown
            count[e] = count[e - 1] + len(text[e - 1].encode())

        single = reached = False
        for end, (size, score) in self._automaton.iter(text):
            e = end + 1
            if e != done:
                if done and not single and best[done - 1] + unknown > best[done]:
                    lone(done)
                for x in range(done + 1, e):
                    lone(x)
                done, single, reached = e, False, False
            value = best[e - size] + score
            if not reached or value > best[e]:  # longest first, so starts ascend
                best[e], count[e], reached = value, count[e - size] + 1, True
            single = single or size == 1
        if done and not single and best[done - 1] + unknown > best[done]:
            lone(done)
        for x in range(done + 1, n + 1):
            lone(x)
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a raw text: spaces become marks, one is put before the text."""
        if not text:
            return 0, 0.0
        text = MARK + text.replace(" ", MARK)
        if self._chunks is None:
            return self.solve(text)
        if self._bytes > CACHE_BYTES:
            self._cache.clear()
            self._bytes = 0
        cache = self._cache
        chunks = self._chunks.findall(text)
        found = list(map(cache.get, chunks))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    c = chunks[i]
                    if (x := cache.get(c)) is None:
                        x = self.solve(c)
                        if len(c) <= CACHED_CHUNK:
                            cache[c] = x
                            self._bytes += ENTRY_BYTES + len(c)
                    found[i] = x
        pieces, scores = zip(*found, strict=True)
        return sum(pieces), sum(scores)


@functools.lru_cache(2)
def _counter(model: bytes) -> UnigramCounter:
    return UnigramCounter(model)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score): pieces and summed score of each whole text's best segmentation."""
    with open(model_path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("vocabularies over 64 MB are not broadcast")
    model = docs.sparkSession.sparkContext.broadcast(data)

    def run(batch: pa.RecordBatch):
        counter = _counter(model.value)
        rows = [counter.count(x or "") for x in batch.column(1).to_pylist()]
        n, score = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(score)], [id_col, "n_tokens", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, score double")
