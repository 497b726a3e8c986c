"""Operator 1: line deduplication with levelled sorted runs (DataFrame functions only).

Each text is split and its lines are hashed once; the rows (document, version, position, two 64-bit hashes) are written.
They are taken in batches of ascending ids. The index of lines seen so far is a set of runs: tables of (hashes, first
document) with disjoint keys, bucketed and sorted by the hashes, one file a bucket. A batch reduces its lines to distinct
keys, deals them into the same buckets and merge-joins each run, which is neither shuffled nor sorted again (a test looks
at the plan); what no run holds becomes a new run of level 0. When a level has ``fanout`` runs they are compacted into
one run of the next level, so a batch meets O(fanout * log batches) runs.

A key held by a third of all lines is no trouble: keys are pre-aggregated before their shuffle, and the join
that marks lines splits a hot key under adaptive skew handling, since its other side has one row a key.

Defined results: null or empty text is one empty line; rows with equal ids count as one document when a key's
documents are compared, and each row is returned; a null id sorts behind all others; keys are compared by 128
bits of hash, texts of one id by 64. Ties cannot arise: lines of the smallest id stay, however often it has them. An
empty table gives an empty one. Columns other than id and text are carried along untouched, whatever their names; where
one is called ``n_lines`` or ``n_dropped``, the count of that name gets an underscore behind it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST = 2**63 - 1
#: With it Spark trusts the order within buckets of one file each, and does not sort a run again.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """Stripped of blanks at both ends, A-Z lowered; other letters stay as they are."""
    key = F.btrim(line, F.lit(common.BLANKS))
    ascii_only = F.octet_length(key) == F.char_length(key)
    return F.when(ascii_only, F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, version, pos, h1, h2) of each line whose key is long enough."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    split = docs.select(_place(id_col).alias("doc"), F.xxhash64(text).alias("version"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = split.select("doc", "version", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _place(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))


class LineRuns:
    """The index: ``levels[i]`` lists the bucketed run tables of level i."""

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = 3):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = common.new_path(self.spark, name)
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).format("parquet").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def meet(self, keys: DataFrame) -> DataFrame:
        """A batch's (h1, h2, lo, hi), lowest and highest holder, with ``seen``: the first holder in earlier batches."""
        now = keys.repartition(self.buckets, "h1", "h2").withColumn("seen", F.lit(None).cast("long"))
        for name in self.runs():
            run = self.spark.table(name).where("fresh").select("h1", "h2", F.col("first").alias("_first")).hint("merge")
            now = now.join(run, ["h1", "h2"], "left").withColumn("seen", F.coalesce("seen", "_first")).drop("_first")
        return now

    def add(self, keys: DataFrame) -> DataFrame:
        """Take in a batch's keys; returns (h1, h2, first) of those in several documents."""
        with common.setting(self.spark, SORTED_BUCKETS, "true"):
            name = self._write(
                self.meet(keys).select(
                    "h1", "h2", F.coalesce("seen", "lo").alias("first"), F.col("seen").isNull().alias("fresh"),
                    (F.col("seen").isNotNull() | (F.col("lo") < F.col("hi"))).alias("shared"),
                )
            )
        self.levels[0].append(name)
        path = self.paths[name]
        self._compact()
        # read by path, not as a bucketed table: both sides of the join with lines are then dealt anew and a hot key can be split
        return self.spark.read.schema("h1 long, h2 long, first long, fresh boolean, shared boolean").parquet(path).where("shared").select("h1", "h2", "first")

    def drop(self) -> None:
        """Remove all runs, their files and their names."""
        for name, path in self.paths.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            common.delete(self.spark, path)

    def _compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            merged = None
            for name in level:
                part = self.spark.table(name).where("fresh")
                merged = part if merged is None else merged.unionByName(part)
            merged = merged.select("h1", "h2", "first", "fresh", F.lit(False).alias("shared")).repartition(self.buckets, "h1", "h2")
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(self._write(merged))
            level.clear()  # the files stay: marks of their batches are read from them


def mark_lines(lines: DataFrame, cuts: list[int], buckets: int) -> DataFrame:
    """(doc, version, gone): the positions of lines that a smaller id holds as well, as a written table.

    ``lines`` (a written table of ``line_hashes``) is taken in batches: ids up to the first cut, up to the second, and so on.
    """
    index, marks = LineRuns(lines.sparkSession, buckets), None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = lines
        if low is not None:
            part = part.where(F.col("doc") > low)
        if high is not None:
            part = part.where(F.col("doc") <= high)
        shared = index.add(part.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")))
        own = part.join(shared.hint("merge"), ["h1", "h2"]).where("first < doc").select("doc", "version", "pos")
        marks = own if marks is None else marks.unionByName(own)
    out = common.materialize(marks.groupBy("doc", "version").agg(F.collect_set("pos").alias("gone")), "line-marks")
    index.drop()
    return out


def _free(name: str, taken: Iterable[str]) -> str:
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4) -> DataFrame:
    """``docs`` with ``text_col`` reduced to its kept lines, plus ``n_lines`` (before) and ``n_dropped``.

    A line goes if its key has at least ``min_chars`` code points and a smaller id holds it as well.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    cuts = docs.select(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    lines = common.materialize(line_hashes(docs, min_chars, id_col, text_col), "line-hashes")
    marks = mark_lines(lines, sorted(set(cuts or [])), common.bucket_count(docs))
    common.drop_table(lines)
    marks = marks.select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("gone").alias("_gone"))
    out = docs.select(*_packed(id_col, text_col, others)).join(marks, ["_doc", "_version"], "left")
    # the lines are bound to a lambda variable, so that the text is split once a row
    kept = F.element_at(
        F.transform(
            F.array(F.split("_text", "\n")),
            lambda lines: F.struct(
                F.size(lines).cast("long").alias("n"),
                F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
                    F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda p: F.get(lines, p)), "\n")
                ).alias("text"),
            ),
        ),
        1,
    )
    out = out.select("_row", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_dropped"), kept.alias("_kept"))
    fields = [F.col("_row").getField(id_col).alias(id_col), F.col("_kept.text").alias(text_col)]
    fields += [F.col("_row").getField(c).alias(c) for c in others]
    return out.select(*fields, F.col("_kept.n").alias(_free("n_lines", docs.columns)), F.col("_dropped").alias(_free("n_dropped", docs.columns)))


def _packed(id_col: str, text_col: str, others: list[str]) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        _place(id_col).alias("_doc"), text.alias("_text"), F.xxhash64(text).alias("_version"),
        F.struct(F.col(id_col), *[F.col(f"`{c}`") for c in others]).alias("_row"),
    ]


def line_report(docs: DataFrame, min_chars: int = 10, batches: int = 4) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    out = dedup_lines(docs.select("doc_id", "text"), min_chars=min_chars, batches=batches)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
