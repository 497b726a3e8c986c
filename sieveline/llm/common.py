"""What the operators of this subpackage share: tables in the shared folder, bounded Arrow batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship_package

#: Characters that separate words and are stripped from lines: space and \t \n \v \f \r.
BLANKS = "\t\n\x0b\x0c\r "
#: Upper bound of text bytes that one vectorised step holds at a time; a single longer text is a step of its own.
STEP_BYTES = 4 << 20
#: Rows of an Arrow batch that a function gets at once, and bytes of a batch that Spark sends (its own bound is 64 MB).
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured, a local master gets one of its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share with the driver")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "sieveline-checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sieveline_path = path  # noqa: SLF001
    if _open:
        _open[-1].append(out)
    return out


_open: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialized inside are deleted in the end, but for those given to the function it yields: a later plan reads them."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.append(made)
    try:
        yield keep
    finally:
        _open.pop()
        for df in made:
            if not any(df is k for k in kept):
                drop_table(df)


#: Input bytes for which a bucketed table gets one bucket, and the most buckets.
BUCKET_BYTES, MAX_BUCKETS = 32 << 20, 50_000


def bucket_count(docs: DataFrame) -> int:
    """Buckets in proportion to the input, so that their files are neither many and small nor large; all cores have one."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # noqa: SLF001
    if size >= 1 << 60:  # unknown
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, min(-(-size // BUCKET_BYTES), MAX_BUCKETS))


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
    """``df``, dealt by ``keys`` into ``buckets`` partitions, as a written table of so many buckets: joins on the keys need not deal it again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(buckets, *keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._sieveline_path, out._sieveline_table, out._sieveline_buckets = path, table, buckets  # noqa: SLF001
    return out


def dealt_like(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """``df`` in the partitions of a ``bucketed`` table: left to itself, Spark deals both sides anew where buckets are few."""
    buckets = getattr(table, "_sieveline_buckets", None)
    return df.repartition(buckets, *keys) if buckets else df


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a ``materialize``d or ``bucketed`` table that no later plan reads."""
    if table := getattr(df, "_sieveline_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path := getattr(df, "_sieveline_path", None):
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` set for the jobs inside, and as before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, without copying: no setting of the session is touched."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def release_memory() -> None:
    """Give what a task has freed back to the system: workers outlive tasks, and stages in the JVM need the room."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(text: str) -> int:
    """``64m``, ``67108864b`` or ``67108864`` as a number."""
    unit = {"b": 0, "k": 10, "m": 20, "g": 30}
    low = text.lower().removesuffix("b") or "0"
    return int(low[:-1]) << unit[low[-1]] if low[-1] in unit else int(low)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with one bounded Arrow batch in and one or several out.

    Spark's bound of bytes a batch is lowered where it is larger: two tasks an executor would hold several times 64 MB outside the
    heap. Rows a batch stay as they are, so functions over short rows get as many as ever.
    """
    ship_package(df.sparkSession)
    if _bytes(df.sparkSession.conf.get(ARROW_BYTES)) > BATCH_BYTES:
        df.sparkSession.conf.set(ARROW_BYTES, str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches):
                out = fn(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
        finally:
            release_memory()

    return df.mapInArrow(run, schema)


def steps(sizes: list[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most ``limit`` (or one row)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def version(text: Column) -> Column:
    """64 bits that tell texts with the same id apart; null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


#: A key with more than one in HOT_SHARE of all rows is dealt over HOT_PARTS tasks; fewer than HOT_SHARE keys can be so frequent.
HOT_SHARE, HOT_PARTS = 256, 64


def join_hot(rows: DataFrame, single: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to ``single``, which has one row a key, where one key may hold any share of ``rows``.

    Frequent keys are counted first (pre-aggregated, fewer than ``HOT_SHARE`` of them can exist, so broadcasting them is
    bounded); their rows are dealt by ``spread`` over ``HOT_PARTS`` tasks, and their single row is repeated as often.
    ``rows`` is read twice: best a written table.
    """
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    counts = rows.groupBy(*named).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))  # one row
    marks = [f"_k{i}" for i in range(len(keys))]
    hot = counts.join(F.broadcast(total)).where(F.col("_n") * HOT_SHARE > F.col("_all")).select(*marks, F.lit(True).alias("_hot"))
    hot = F.broadcast(materialize(hot, "hot-keys"))  # fewer than HOT_SHARE rows
    tell = lambda df: df.join(hot, [df[k].eqNullSafe(hot[m]) for k, m in zip(keys, marks, strict=True)], "left").drop(*marks)
    left = tell(rows).withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(HOT_PARTS)).cast("int")).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))
    right = tell(single).withColumn("_part", F.explode(parts)).drop("_hot")
    return left.join(right, [*keys, "_part"], how).drop("_part")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every vertex in ``edges``: (id, component).

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round is one shuffle of the
    edges, converges in O(log n) rounds, and every round is a written table. A vertex of any degree is fine:
    minima are pre-aggregated and the join back on a hub splits under adaptive skew handling.
    """
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc-edges"
    )

    def checksum(df: DataFrame) -> tuple:
        # numeric(38): the sum of 64-bit hashes does not overflow
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = checksum(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = materialize(small, "cc-edges")
        state = checksum(after)
        drop_table(now)
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
