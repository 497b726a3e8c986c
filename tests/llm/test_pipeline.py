"""The pipeline: every stage by itself against the plain versions, and the whole."""

from __future__ import annotations

import random

import corpus_pipeline as pipeline
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import common, langid, lines, spans

from . import test_lines, test_neardup, test_packing, test_spans
from .conftest import SCHEMA, awkward, make


@pytest.fixture(scope="module")
def labelled(spark):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    return [(r["doc_id"] + 1000, r["text"], r["lang"]) for r in sf] + [(r[0], r[1], None) for r in awkward()]


def text_of(df):  # noqa: ANN001, ANN201
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_columns_and_stages(spark, labelled):
    docs = make(spark, labelled)
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "substring_dedup", "best_fit_packing"]
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        docs = common.materialize(out, name)
        assert docs.where("n_chars <> length(text)").count() == 0, name
    assert set(pipeline.STAGES[-1][1](spark, docs, "").columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


def test_language_stage_keeps_clean_documents(spark, labelled):
    docs = make(spark, labelled)
    kept = {r["doc_id"] for r in pipeline.identify_language(spark, docs, "").collect()}
    prose = [r[0] for r in labelled if r[2] and r[1] and len(r[1].split()) >= 5 and sum(map(str.isalpha, r[1])) > len(r[1]) / 2]
    assert len(set(prose) - kept) <= len(prose) // 100
    assert not kept & {7, 8, 9, 11}


def test_line_stage_equals_brute_force(spark):
    got = text_of(pipeline.drop_repeated_lines(spark, make(spark, awkward()), ""))
    digests = sorted(((r[0], r[3]) for r in test_lines.brute(awkward()).elements()), key=repr)
    import hashlib

    assert sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in got), key=repr) == digests


def test_near_duplicate_stage_equals_brute_force(spark):
    rows = test_neardup.corpus(11, 30, 6) + [(None, "no id"), (9001, None), (9003, "")]
    got = text_of(pipeline.drop_near_duplicates(spark, make(spark, rows), ""))
    kept = {r[0] for r in test_neardup.brute(rows, 5) if r[3]}
    assert got == sorted(((r[0], r[1]) for r in rows if r[0] in kept), key=repr)


def test_substring_stage_equals_plain_version(spark):
    rows = test_spans.corpus(3)
    assert text_of(pipeline.drop_repeated_spans(spark, make(spark, rows), "")) == sorted(((r[0], r[3]) for r in test_spans.brute(rows)), key=repr)


def test_whole(spark, tmp_path, labelled):
    docs = make(spark, labelled)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()
    kept = {g["doc_id"] for g in got}
    assert 300 < sum(g["length"] for g in got) and kept <= {r[0] for r in labelled}
    texts = {r[0]: r[1] for r in labelled if r[0] is not None and r[0] >= 1000}
    assert len(kept & set(texts)) > len(texts) // 2


def test_ids_with_several_texts(spark):
    """Rows that share an id, or have none: each stage judges them by their own text; clashing columns come along."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    prose = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(9)) + "." for _ in range(n))
    a, passage, unique = prose(14), prose(13), prose(13)
    rows = [(1, passage), (30, passage), (30, unique), (None, passage + " " + prose(40)), (None, prose(30)), (20, a), (40, a + " end"), (40, prose(12)), (7, prose(3) + "\n" + passage)]
    names = ("n_dropped", "n_lines", "version", "kept", "marks", "_gone", "component_id")
    docs = make(spark, rows).withColumns({c: F.lit("v") for c in names})
    for name, stage in pipeline.STAGES[1:-1]:
        docs = common.materialize(stage(spark, docs, ""), name)
        got = docs.collect()
        assert {r[c] for r in got for c in names} == {"v"}, name
        texts = [r["text"] for r in got]
        assert unique in texts and rows[4][1] in texts and rows[7][1] in texts, name
    assert texts.count(passage) == 1 and a + " end" not in texts and a in texts and rows[8][1].split("\n")[0] in [t.strip() for t in texts]


def test_whole_equals_the_stages_one_by_one(spark, tmp_path):
    """``run`` against the plain versions of stages 2 to 4 and the library's tokens, for texts whose language is plain."""
    rows = [(r[0], r[1], "en") for r in test_spans.corpus(6)] + [(r[0] + 5000, r[1], "en") for r in test_neardup.corpus(13, 12, 5)] + [(9001, None, None), (9002, "123", None)]
    make(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    lettered = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    holders: dict = {}
    for i, text, _ in lettered:
        for x in text.split("\n"):
            holders.setdefault(test_lines.key(x), set()).add(i)
    kept = [(i, "\n".join(x for x in t.split("\n") if len(test_lines.key(x)) < 10 or min(holders[test_lines.key(x)]) >= i)) for i, t, _ in lettered]
    stay = {r[0] for r in test_neardup.brute(kept, 5) if r[3]}
    left = [(r[0], r[3]) for r in test_spans.brute([r for r in kept if r[0] in stay])]
    tokenizer = Tokenizer.from_file(test_packing.PATH)
    test_packing.check(left, pipeline.run(spark, str(tmp_path)).collect(), 4096, tokenizer)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_modules_are_the_ones_named():
    assert {langid.__name__, lines.__name__, spans.__name__} == {"sieveline.llm.langid", "sieveline.llm.lines", "sieveline.llm.spans"}
