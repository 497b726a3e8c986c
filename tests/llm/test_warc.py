"""The content-addressed archive: SQL, exact records, files."""

from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from sieveline.llm import common, queries, warc
from tests import support

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "http://a", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b\r\nX: y", None), (4, "http://c", ""), (5, "http://d", "<p>ü 日本\r\n\r\nWARC/1.0\r\n</p>"),
    (6, "http://e", "x" * 3_000_000), (7, "http://f", "x" * 3_000_000), (8, "http://g", "<p>alone</p>"), (8, "http://g", "<p>alone</p>"), (None, "http://h", "<p>one</p>"), (None, "http://i", "no other"),
]


def brute(rows, min_bytes: int = 0):  # noqa: ANN001
    first: dict = {}
    for i, _, html in rows:
        first.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        head = min((x for x in first[html or ""] if x is not None), default=None)
        response = len(body) < min_bytes or i == head
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "response" if response else "revisit", None if response else head))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 5, 11])
def test_equals_brute_force(spark, min_bytes):
    got = warc.page_report(spark.createDataFrame(PAGES, SCHEMA), min_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == brute(PAGES, min_bytes)


def test_records_are_rebuilt_and_files_read_back(spark, tmp_path):
    pages = [p for p in PAGES if p[0] is not None][:8]
    headers, payloads = warc.archive(spark.createDataFrame(pages, SCHEMA))
    assert payloads.count() == len({p[2] or "" for p in pages})
    records = {r["page_id"]: bytes(r["record"]) for r in warc.reconstruct(headers, payloads).collect()}
    for page_id, _, html in pages:
        (fields, header, payload), = warc.parse_records(records[page_id])
        body = (html or "").encode()
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert payload == (body if fields["WARC-Type"] == "response" else b"")
        assert header + payload + b"\r\n\r\n" == records[page_id]
    path = str(tmp_path / "files")
    warc.write_files(headers, payloads, path, file_bytes=2_000_000)
    assert len(list((tmp_path / "files").glob("*.txt"))) > 1
    got = {r["page_id"]: (bytes(r["header"]) + bytes(r["payload"]) + b"\r\n\r\n") for r in warc.read_files(spark, path).collect()}
    assert got == records


def test_changed_payloads_are_refused(spark):
    headers, payloads = warc.archive(spark.createDataFrame(PAGES[:4], SCHEMA))
    changed = payloads.withColumn("payload", F.concat("payload", F.lit(b"!")))
    with pytest.raises(Exception, match="payload missing or changed"):
        warc.read_archive(headers, changed).collect()
    with pytest.raises(Exception, match="payload missing or changed"):
        warc.read_archive(headers, payloads.limit(0)).collect()
    record = warc.reconstruct(headers, payloads).where("page_id = 1")
    text = F.decode("record", "utf-8")
    for wrong in (F.replace(text, F.lit("Content-Length: 10"), F.lit("Content-Length: 11")), F.concat(text, F.lit(" ")), F.replace(text, F.lit("<p>one"), F.lit("<p>two"))):
        with pytest.raises(Exception, match="record does not hold"):
            warc.parse(record.select("page_id", wrong.cast("binary").alias("record"))).collect()
    revisit = headers.where("page_id = 2")
    with pytest.raises(Exception, match="refers to no such record"):
        warc.read_archive(revisit, payloads).collect()


def test_stored_payloads_are_not_shuffled_again(spark):
    with common.setting(spark, "spark.sql.shuffle.partitions", "50"), common.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        headers, payloads = warc.archive(spark.createDataFrame(PAGES, SCHEMA))
        plan = warc.reconstruct(headers, payloads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    files = [r["f"] for r in payloads.select(F.input_file_name().alias("f")).distinct().collect()]
    assert len(files) == len({f.rpartition("_")[2] for f in files})  # one file a bucket


def test_line_ends_in_urls_are_escaped(spark):
    headers, payloads = warc.archive(spark.createDataFrame([(1, "http://b\r\nX: y", "z")], SCHEMA))
    (fields, _, _), = warc.parse_records(bytes(warc.reconstruct(headers, payloads).first()["record"]))
    assert fields["WARC-Target-URI"] == "http://b%0D%0AX: y" and "X" not in fields


def test_ids_with_several_payloads(spark):
    rows = [(1, "u", "a"), (1, "u", "b"), (2, "u", "a"), (3, "u", "b"), (3, "u", "b")]
    assert sorted(map(tuple, warc.page_report(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame(PAGES[:2], SCHEMA).withColumns({c: F.lit(1) for c in ("address", "payload", "header", "n")})
    assert warc.page_report(df).count() == 2
    assert warc.page_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_sql(spark, sf_dir):
    support.same(queries.op5_warc(spark, sf_dir), support.database(sf_dir), queries.ORACLE["op5_warc"])
