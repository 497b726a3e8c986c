"""Corpus preparation, in five stages: language identification, line, near-duplicate and substring deduplication, packing.

Every stage works on all rows its predecessor kept; all but the last return the columns of ``documents``, with
``n_chars`` following the text. ``run`` writes each stage as Parquet in the shared folder, so a lost executor never
costs more than the stage at hand; the tables of stages that are done are deleted.

Defined results: documents without text or letters go in the first stage, so later ones see neither; rows that share an
id, or have none, are judged each by its own text (of texts linked to one with a smaller id each goes, a null id never
does); of ties the smallest id stays. An empty table gives an empty one; further columns come along to the last stage,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import common, langid, lines, neardup, packing, spans

#: A document goes if no language is found or its words agree on one less than this.
MIN_LANGUAGE_SCORE = 0.4


def _columns(docs: DataFrame, text: DataFrame) -> DataFrame:
    """The columns of ``documents`` with the new text; other columns come along."""
    fields = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return text.select(*fields)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` as given (predictions are made from text alone)."""
    model = langid.train(docs)
    return langid.keep_identified(docs, model, MIN_LANGUAGE_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; documents stay, if without text."""
    return _columns(docs, lines.dedup_lines(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles the one with the smallest id stays."""
    return neardup.drop_copies(docs)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences covered by a span that an earlier document holds go."""
    return spans.with_spans_removed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the tokens of each kept document lie: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_spans),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the model nor the tokenizer: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.materialize(stage(spark, docs, sf_dir), name)
        common.drop_table(before)
    return STAGES[-1][1](spark, docs, sf_dir)
