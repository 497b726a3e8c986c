"""Line deduplication against brute force and SQL."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sieveline.llm import common, lines, queries
from tests import support

from .conftest import awkward, make

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(rows, min_chars: int = 10):  # noqa: ANN001
    order = lambda i: lines.LAST if i is None else i
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(order(r[0]))
    out = []
    for r in rows:
        own = (r[1] or "").split("\n")
        kept = [x for x in own if not (len(key(x)) >= min_chars and min(holders[key(x)]) < order(r[0]))]
        out.append((r[0], len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_equals_brute_force(docs, batches):
    got = Counter(map(tuple, lines.line_report(docs, batches=batches).collect()))
    assert got == brute(awkward())


def test_compaction_keeps_every_key(spark):
    rows = [(i, f"a line that all share\nline number {i % 50} of fifty\nline of {i} alone") for i in range(400)]
    got = Counter(map(tuple, lines.line_report(make(spark, rows), batches=16).collect()))
    assert got == brute(rows)


def test_columns_with_clashing_names_come_along(spark):
    rows = [(1, "the first line here", "x"), (2, "the first line here\nrest", "y")]
    df = make(spark, rows).withColumns({c: F.lit(c) for c in ("doc", "pos", "h1", "_doc", "first", "n_lines", "_gone", "a b")})
    out = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert out[2]["text"] == "rest" and out[1]["text"] == "the first line here"
    assert out[2]["lang"] == "y" and out[2]["_gone"] == "_gone" and out[2]["a b"] == "a b"
    assert out[2]["n_lines"] == "n_lines" and (out[2]["n_lines_"], out[2]["n_dropped"]) == (2, 1)


def test_ids_with_several_texts(spark):
    rows = [(5, "a line of number five\nanother line"), (5, "another line\nlast line here"), (3, "LAST line here"), (None, "another line"), (None, "only once here")]
    assert Counter(map(tuple, lines.line_report(make(spark, rows)).collect())) == brute(rows)


def test_runs_are_neither_shuffled_nor_sorted(spark):
    hashed = common.materialize(lines.line_hashes(make(spark, [(i, f"line number {i % 30} of thirty") for i in range(90)])), "line-hashes")
    keys = lambda low, high: hashed.where(F.col("doc").between(low, high)).groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    index = lines.LineRuns(spark, 5, fanout=4)
    for low in (0, 20, 40):
        index.add(keys(low, low + 19))
    with common.setting(spark, lines.SORTED_BUCKETS, "true"), common.setting(spark, "spark.sql.shuffle.partitions", "50"):
        plan = index.meet(keys(60, 89))._jdf.queryExecution().executedPlan().toString()
    joins = plan.count("SortMergeJoin")
    assert joins == 3 and plan.count("Bucketed: true") == 3
    assert plan.count("Exchange hashpartitioning(h1") == 2 and plan.count("Sort [h1") == 1  # of the batch alone: counted, dealt, sorted
    before = len(spark.catalog.listTables())
    index.drop()
    assert before - len(spark.catalog.listTables()) == 3


def test_empty_table(nothing):
    assert lines.line_report(nothing).collect() == []


def test_no_python_in_the_plan(docs):
    index = lines.LineRuns(docs.sparkSession, 4)
    keys = lines.line_hashes(docs).groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    index.add(keys)
    for df in (lines.line_report(docs), lines.line_hashes(docs), index.meet(keys)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    index.drop()


def test_query_equals_sql(spark, sf_dir):
    support.same(queries.op1_line_dedup(spark, sf_dir), support.database(sf_dir), queries.ORACLE["op1_line_dedup"])
