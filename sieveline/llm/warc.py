"""Operator 5: a content-addressed web archive.

Payload bytes are stored once under their SHA-256, which is verified when they are read; the exact header bytes of
each WARC record are kept in a table of their own with that address. Joining the two gives back the original
records, and everything that is reported of a page is parsed from its rebuilt record: framing, both lengths and the
digest are checked, a revisit takes its payload's size and digest from the record it refers to. ``write_files`` and
``read_files`` exchange records as WARC/1.1 files of bounded size.

Of records with equal payloads the one with the smallest page id is the response and the others revisit it. Digests
are computed where the pages are read; only (id, digest) rows are shuffled to find that page, pre-aggregated, so a
payload that a third of all pages have is no hot spot; bytes are shuffled once, to the table of distinct payloads, which is
bucketed, so that rebuilding the responses moves headers alone. Revisits need no bytes, and a response that most revisits
refer to is dealt out.

Defined results: a null html is the empty payload; null urls are written as ``urn:sieveline:no-url``, line ends within urls as
``%0D`` and ``%0A``; repeated page ids with equal payloads are each responses, with different ones records of their own; a
null page id is a response only if no other record has its payload. An empty table gives an empty one; other columns play
no part, whatever their names. Ties cannot arise beyond repeated ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:sieveline:page:"
HEADER_END = "\r\n\r\n"
NO_ID = 2**63 - 1  # behind all page ids
FILE_BYTES = 256 << 20  # of a WARC file, which is read as one cell


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are 8 groups of 20 bits, 4 characters each."""
    digest = F.sha1(data)
    groups = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    alphabet = F.lit(ALPHABET)
    return F.concat(*[
        F.substr(alphabet, F.shiftright(g, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for j in range(4)
    ])


def _digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        "page_id", F.coalesce(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("urn:sieveline:no-url")).alias("url"), payload.alias("payload")
    ).select("page_id", "url", "payload", F.sha2("payload", 256).alias("address"))


def archive(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Write ``pages`` (page_id, url, html): the tables headers (page_id, address, page, header) and payloads (address, page, payload).

    ``page`` is the page whose payload was stored, so that (address, page) tells where the bytes are.
    """
    hashed = _digests(pages)
    index = common.materialize(
        hashed.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("sha1")),
        "warc-index",
    )
    firsts = index.groupBy("address").agg(F.min("page_id").alias("head"))
    placed = index.join(firsts, "address").withColumn("response", (F.col("n") < min_bytes) | F.col("page_id").eqNullSafe(F.col("head")))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(HEADER_END))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("response"), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), urn("page_id"),
        F.lit("WARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("sha1"), F.lit("\r\n"),
        F.when(F.col("response"), "").otherwise(
            F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn("head"))
        ),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(F.col("response"), F.col("n")).otherwise(0)).cast("string"), F.lit(HEADER_END), http,
    )
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias("page")
    headers = common.materialize(placed.select("page_id", "address", known("head"), header.cast("binary").alias("header")), "warc-headers")
    # the bytes are shuffled once: semi-join, distinct and buckets need the same partitioning, since an address has one head
    # no fewer than shuffle partitions: Spark would deal both sides of the join into that many, and every task write every bucket
    buckets = max(common.bucket_count(pages), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = hashed.select("address", known("page_id"), "payload").repartition(buckets, "address", "page")
    heads = firsts.select("address", known("head")).repartition(buckets, "address", "page")
    # an inner join, since a semi-join would be moved below the dealing and shuffle the bytes for itself; heads are distinct
    kept = dealt.join(heads, ["address", "page"]).dropDuplicates(["address", "page"])
    payloads = common.bucketed(kept, "warc-payloads", buckets, "address", "page")
    common.drop_table(index)
    return headers, payloads


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"\r\n{name}: <?(?:sha1:|{URN})?([^\r>]*)", 1)


def reconstruct(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record binary): the original WARC records; a revisit's block has no payload.

    A payload that is missing, or does not have the digest that is its address, fails the query.
    """
    revisit = F.decode("header", "utf-8").startswith("WARC/1.1\r\nWARC-Type: revisit\r\n")
    end = F.lit(HEADER_END).cast("binary")
    sound = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload missing or changed: "), F.col("address"))).cast("binary")
    )
    known = common.dealt_like(headers.where(~revisit), payloads, "address", "page")
    responses = known.join(payloads, ["address", "page"], "left").select("page_id", F.concat("header", sound, end).alias("record"))
    return responses.unionByName(headers.where(revisit).select("page_id", F.concat("header", end).alias("record")))


def parse(records: DataFrame) -> DataFrame:
    """What each record says: (page_id, record_type, refers_to, payload_digest, payload_bytes).

    A record whose framing, lengths or (for a response) digest do not hold fails the query. A revisit's digest and length are
    those it states.
    """
    whole = records.select(F.decode("record", "utf-8").alias("text"))
    cut = whole.withColumn("head", F.substring_index("text", HEADER_END, 1))
    cut = cut.withColumn("block", F.substr("text", F.char_length("head") + 5, F.char_length("text") - F.char_length("head") - 8))
    cut = cut.withColumn("http", F.substring_index("block", HEADER_END, 1)).withColumn("payload", F.substr("block", F.char_length("http") + 5))
    length = lambda c: F.regexp_extract(c, r"\r\nContent-Length: (\d+)(?:\r|$)", 1).cast("long")
    kind, digest = _field("WARC-Type"), base32_sha1(F.col("payload").cast("binary"))
    read = cut.select(
        F.nullif(_field("WARC-Record-ID"), F.lit("")).cast("long").alias("page_id"), kind.alias("record_type"),
        F.nullif(_field("WARC-Refers-To"), F.lit("")).cast("long").alias("refers_to"), _field("WARC-Payload-Digest").alias("stated"),
        length("http").alias("payload_bytes"), F.when(kind == "response", digest).alias("digest"),
        (F.col("text").endswith(HEADER_END) & (length("head") == F.octet_length("block"))).alias("framed"),
        F.octet_length("payload").cast("long").alias("there"),
    )
    right = F.col("framed") & F.when(F.col("record_type") == "response", (F.col("there") == F.col("payload_bytes")) & (F.col("stated") == F.col("digest"))).otherwise(F.col("there") == 0)
    checked = F.when(right, F.col("stated")).otherwise(F.raise_error(F.concat(F.lit("record does not hold: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("without id")))))
    return read.select("page_id", "record_type", "refers_to", checked.alias("payload_digest"), "payload_bytes")


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read from the rebuilt records."""
    read = common.materialize(parse(reconstruct(headers, payloads)), "warc-records")
    responses = read.where("record_type = 'response'")
    # what a revisit leaves out is in the record it refers to
    origin = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("_bytes")).distinct()
    revisits = common.join_hot(read.where("record_type = 'revisit'"), origin, ["refers_to", "payload_digest"], ["page_id"], "left")
    there = F.when(F.col("_bytes") == F.col("payload_bytes"), F.col("_bytes")).otherwise(F.raise_error(F.lit("a revisit refers to no such record")).cast("long"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).unionByName(revisits.withColumn("payload_bytes", there).select(columns))


def write_files(headers: DataFrame, payloads: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """WARC/1.1 files of whole records, of about ``file_bytes`` each (one larger record is a file of its own size)."""
    stated = F.regexp_extract(F.substring_index(F.decode("header", "utf-8"), HEADER_END, 1), r"\r\nContent-Length: (\d+)", 1).cast("long")
    size = headers.agg(F.coalesce(F.sum(F.octet_length("header") + stated), F.lit(0))).first()[0]
    record = F.decode("record", "utf-8")
    whole = reconstruct(headers, payloads).select(F.left(record, F.char_length(record) - 4).alias("value"))
    whole.repartition(max(1, -(-size // file_bytes)), F.xxhash64("value")).write.option("lineSep", HEADER_END).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(named fields, header bytes with the HTTP header, payload) of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:] if x)
        stop = end + int(fields["Content-Length"])
        body = data.index(b"\r\n\r\n", end, stop) + 4
        yield fields, data[at:body], data[body:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        at = stop + 4


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, refers_to, header, payload) of the WARC files in ``path``; each file is one bounded read."""

    def run(batch: pa.RecordBatch):
        number = lambda x: int(y) if (y := x.strip("<>").removeprefix(URN)) else None
        for data in batch.column(0).to_pylist():
            rows = [
                (number(f["WARC-Record-ID"]), f["WARC-Type"], number(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None, h, p)
                for f, h, p in parse_records(data)
            ]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "record_type", "refers_to", "header", "payload"])

    common.ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda it: (y for b in it for y in run(b)), "page_id long, record_type string, refers_to long, header binary, payload binary")


def page_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive all ``pages``, rebuild every record and report what it holds."""
    headers, payloads = archive(pages.select("page_id", "url", "html"), min_bytes)
    out = read_archive(headers, payloads)
    common.drop_table(headers)
    common.drop_table(payloads)
    return out
