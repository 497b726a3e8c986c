"""Operator 7: substring deduplication by sliding sentence spans.

A text is a row of sentences: they end at ``.``, ``!`` or ``?`` before a blank and at line breaks, and long ones also at words
whose own hash says so (one in 8), which lie at the same places wherever a passage is quoted. From each sentence
the shortest run of at least two sentences and ``min_words`` words is a span; its key is 128 bits of hash over its
lower-cased words. Spans are joined globally: of equal spans the first (smallest id, then position) stays, and sentences
that another one covers are removed. A passage of over twice ``min_words`` words is found even if its ends run
into the text around it.

Only (hash, id) rows are shuffled to find repeated spans, pre-aggregated; a span that a third of all documents
hold is one row on the smaller side of the join that marks them, and its other side can be split.

Defined results: null and empty texts have no sentence and stay as they are; a null id sorts behind all others; rows
with equal ids count as one document between documents, but each text keeps its own marks (id and 64 bits of hash of
the text tell them apart), and a span that only rows of one id hold stays in each of them; blanks behind a removed
sentence go with it. An empty table gives an empty one. Other columns come along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common
from .words import hash_slices, mix, words

MIN_WORDS = 20
LONG_SENTENCE, CUT_ONE_IN = 12, 8  # sentences of more words are cut at words of which one in so many hashes to a cut
CHAINED = 1024  # words of a span that are hashed side by side with those of all others
LAST = 2**63 - 1

_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


class Sentences:
    """Sentences and spans of several texts: byte bounds, word counts, span keys."""

    def __init__(self, texts: list[bytes], min_words: int):
        buf, start, end, _, bounds = words(texts)
        n = len(start)
        self.bounds = np.zeros(len(texts) + 1, np.int64)  # first sentence of each text
        self.text_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if not n:
            self.first = self.last = self.units = self.h1 = self.h2 = np.zeros(0, np.int64)
            return
        h = hash_slices(buf, start, end)
        stop = _STOP[buf[end - 1]]
        breaks = np.concatenate(([0], np.cumsum(buf == 10)))
        stop[:-1] |= breaks[start[1:]] > breaks[end[:-1]]
        stop[bounds[1:][np.diff(bounds) > 0] - 1] = True
        size = np.diff(np.flatnonzero(np.concatenate(([True], stop))))
        long = np.repeat(size > LONG_SENTENCE, size)
        stop |= long & (mix(h + np.uint64(77)) % np.uint64(CUT_ONE_IN) == 0)
        last = np.flatnonzero(stop)  # last word of each sentence
        first = np.concatenate(([0], last[:-1] + 1))
        self.bounds = np.searchsorted(first, bounds)
        self.first, self.last = start[first], end[last]
        sentence_end = last + 1
        # the sentence in which the min_words-th word from each sentence's first word lies, two sentences at least
        target = np.searchsorted(sentence_end, first + min_words)
        target = np.maximum(target, np.arange(len(first)) + 1)
        text_last = np.repeat(self.bounds[1:], np.diff(self.bounds)) - 1
        whole = target <= text_last
        self.units = np.where(whole, target - np.arange(len(first)) + 1, 0)
        at = np.flatnonzero(whole)
        size = last[target[at]] - first[at] + 1
        self.h1, self.h2 = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for name, odd, salt in (("h1", np.uint64(0x9E3779B97F4A7C15), 1), ("h2", np.uint64(0xC2B2AE3D27D4EB4F), 2)):
            x = mix(h + np.uint64(salt))
            key = np.zeros(len(at), np.uint64)
            active, j = np.arange(len(at)), 0
            while len(active) and j < CHAINED:
                key[active] = key[active] * odd + x[first[at[active]] + j]
                j += 1
                active = active[size[active] > j]
            for i in active.tolist():  # words beyond these: in one go by value
                own = x[first[at[i]] + CHAINED : first[at[i]] + size[i]]
                key[i : i + 1] = key[i : i + 1] * odd + hash_slices(own.view(np.uint8), np.array([0]), np.array([8 * len(own)]))
            getattr(self, name)[at] = mix(key + size.astype(np.uint64)).view(np.int64)


def _local_first(s: Sentences, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentences of one text whose span is there for the first time in it, and those whose span is a repeat."""
    at = a + np.flatnonzero(s.units[a:b])
    if not len(at):
        return at, at
    both = np.stack([s.h1[at], s.h2[at]], axis=1)
    order = np.lexsort((at, both[:, 1], both[:, 0]))
    again = np.zeros(len(at), bool)
    again[order[1:]] = (both[order[1:]] == both[order[:-1]]).all(axis=1)
    return at[~again], at[again]


def span_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2, doc, version, at) of the distinct spans of each (doc, version, text): ``at`` is the first sentence."""

    def run(batch: pa.RecordBatch):
        keys, versions = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
        for a, b in common.steps([len(x) for x in texts]):
            s = Sentences(texts[a:b], min_words)
            firsts = [_local_first(s, x, y)[0] for x, y in zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True)]
            row = np.repeat(np.arange(len(firsts)), [len(x) for x in firsts])
            at = np.concatenate([*firsts, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.h1[at]), pa.array(s.h2[at]), pa.array(keys[a + row]), pa.array(versions[a + row]), pa.array((at - s.bounds[row]).astype(np.int32))],
                ["h1", "h2", "doc", "version", "at"],
            )

    return common.map_batches(docs.select("doc", "version", "text"), run, "h1 long, h2 long, doc long, version long, at int")


def _keyed(id_col: str, text_col: str) -> list[Column]:
    """(doc, version): the place of a row among documents, and which of the texts with its id it has."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), common.version(F.col(text_col)).alias("version")]


def _marks(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, version, marks): the first sentences of spans that a smaller id holds as well."""
    spans = span_table(docs, min_words)
    shared = spans.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    shared = common.materialize(shared, "span-shared")
    return spans.join(shared, ["h1", "h2"]).where("lo < doc").groupBy("doc", "version").agg(F.collect_set("at").alias("marks"))


def _cut(texts: list[bytes], marks: list[list[int] | None], min_words: int) -> tuple[list[int], list[int], list[bytes]]:
    """Sentences, removed sentences and remaining bytes of each text."""
    s = Sentences(texts, min_words)
    counts, removed, kept = [], [], []
    for i, (x, y) in enumerate(zip(s.bounds[:-1].tolist(), s.bounds[1:].tolist(), strict=True)):
        text, n = texts[i], y - x
        gone = np.zeros(n + 1, np.int64)
        # what another document holds first is marked once a document; repeats within it are found here
        _, again = _local_first(s, x, y)
        at = np.concatenate([again - x, np.array(marks[i] or [], np.int64)])
        np.add.at(gone, at, 1)
        np.add.at(gone, np.minimum(at + s.units[x + at], n), -1)
        gone = np.cumsum(gone)[:n] > 0
        counts.append(n)
        removed.append(int(gone.sum()))
        if removed[-1]:
            edge = np.append(s.first[x:y] - s.text_at[i], len(text))  # a sentence takes the blanks behind it along
            text = b"".join([text[: edge[0]]] + [text[edge[j] : edge[j + 1]] for j in np.flatnonzero(~gone)])
        kept.append(text)
    return counts, removed, kept


def dedup_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) of every row: ``text`` without sentences that a non-first repeated span covers."""
    docs = docs.select(*_keyed(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = docs.join(_marks(docs.select("doc", "version", "text"), min_words), ["doc", "version"], "left").select("doc_id", "text", "marks")

    def run(batch: pa.RecordBatch):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        marks = batch.column(2).to_pylist()
        for a, b in common.steps([len(x or b"") for x in texts]):
            counts, removed, kept = _cut([x or b"" for x in texts[a:b]], marks[a:b], min_words)
            out = [None if x is None else y.decode("utf-8", "replace") for x, y in zip(texts[a:b], kept, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string())],
                ["doc_id", "n_sentences", "n_removed", "text"],
            )

    return common.map_batches(joined, run, "doc_id long, n_sentences long, n_removed long, text string")


def with_spans_removed(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its columns, its ``text`` cut and ``n_chars`` (if there) following it."""
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keyed("doc_id", "text"))
    marks = _marks(keyed.select("doc", "version", F.col("row.text").alias("text")), min_words)
    # by position, so that no name of a column can clash
    names = docs.columns
    fields = [F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)]
    joined = keyed.join(marks, ["doc", "version"], "left").select("marks", *fields)
    at = names.index("text") + 1

    def run(batch: pa.RecordBatch):
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        marks = batch.column(0).to_pylist()
        for a, b in common.steps([len(x or b"") for x in texts]):
            _, _, kept = _cut([x or b"" for x in texts[a:b]], marks[a:b], min_words)
            out = [None if x is None else y.decode("utf-8", "replace") for x, y in zip(texts[a:b], kept, strict=True)]
            columns = batch.slice(a, b - a).columns[1:]
            columns[at - 1] = pa.array(out, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if x is None else len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return common.map_batches(joined, run, StructType([StructField(f.name, LongType()) if f.name == "n_chars" else f for f in docs.schema]))
