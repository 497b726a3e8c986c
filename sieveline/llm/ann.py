"""Operator 9: approximate nearest neighbours by additive quantisation.

Codebooks of full dimension are trained one on the residuals of the other over a bounded sample (``sample`` vectors
with the smallest hashed ids); every vector is then encoded by beam search, which keeps the ``beam`` best partial
sums, and stored with its code and the norm of its reconstruction. A query scores codes by one table lookup a
codebook; in every ``chunk`` of the index the ``rerank`` best are ranked again by the exact cosine of the original
vectors, so the share of exact work is the same at every size. Queries are taken in blocks of bounded size; where there
are several, each block's result is a written table before the next one begins.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, neither do those
with another number of components than most; equal scores go to the smaller id. Rows that repeat an id are candidates
each, but never of a query with that id; as a query the id is asked once, with the smallest of its vectors. A table
without a usable vector gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

BOOKS, ENTRIES, BEAM = 8, 256, 4
SAMPLE = 8192
CHUNK, RERANK = 4096, 96
QUERIES = 16384  # a block of queries that is sent to every task: 16,384 x 64 x 8 bytes = 8 MB


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """(id, vec) of the vectors that take part, their number of components, and how many they are."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null and vec is not null")
    v = v.where(F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vec, x -> x <> 0)"))
    top = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (v.where(F.size("vec") == top["d"]), top["d"], top["count"]) if top else (v, 0, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        n = np.bincount(nearest, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
    return centres


def train(sample: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, rounds: int = 8) -> np.ndarray:
    """(books, entries, d) codebooks by residual k-means."""
    rng = np.random.default_rng(7)
    rest, out = sample.copy(), []
    for _ in range(books):
        c = _kmeans(rest, min(entries, len(rest)), rounds, rng)
        nearest = np.argmax(rest @ c.T - 0.5 * (c**2).sum(1), axis=1)
        rest = rest - c[nearest]
        if len(c) < entries:
            c = np.concatenate([c, np.zeros((entries - len(c), c.shape[1]), np.float32)])
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(n, books) codes by beam search and the norms of their reconstructions."""
    m, k, d = books.shape
    codes, norms = np.zeros((len(x), m), np.uint8), np.zeros(len(x), np.float32)
    for a in range(0, len(x), 512):
        rest = x[a : a + 512, None, :]  # (n, beam, d)
        n = len(rest)
        path = np.zeros((n, 1, 0), np.uint8)
        for i in range(m):
            c = books[i]
            width = rest.shape[1]
            error = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ c.T).reshape(n, width, k) + (c**2).sum(1)
            flat = error.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            from_beam, code = best // k, best % k
            rows = np.arange(n)[:, None]
            rest = rest[rows, from_beam] - c[code]
            path = np.concatenate([path[rows, from_beam], code[:, :, None].astype(np.uint8)], axis=2)
        top = (rest**2).sum(2).argmin(1)
        codes[a : a + 512] = path[np.arange(n), top]
        norms[a : a + 512] = np.sqrt(((x[a : a + 512] - rest[np.arange(n), top]) ** 2).sum(1))
    return codes, norms


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def build_index(vectors: DataFrame, d: int, n: int, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray]:
    """The written index (id, vec, code, norm) of every one of the ``n`` rows of (id, vec), and the codebooks."""
    key = F.shiftrightunsigned(F.xxhash64("id"), 11)
    # hashes are uniform: twice the share that is wanted holds the smallest, so tasks need not hand over ``sample`` rows each
    few = vectors.where(key <= int(min(1.0, 2 * sample / max(n, 1)) * (1 << 53)))
    drawn = few.orderBy(key, "id").limit(sample).collect()
    books = train(_unit(np.array([r["vec"] for r in drawn], np.float64).reshape(-1, d))) if drawn else np.zeros((BOOKS, ENTRIES, max(d, 1)), np.float32)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batch: pa.RecordBatch):
        codes, norms = encode(_unit(_vectors(batch.column(1), d)), sent.value)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], ["id", "vec", "code", "norm"]
        )

    return common.materialize(common.map_batches(vectors, run, "id long, vec array<double>, code binary, norm float"), "ann-index"), books


@functools.lru_cache(2)
def _tables(key: str, build) -> tuple:  # noqa: ANN001
    return build()


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)

    def merge(self, score: np.ndarray, ids: np.ndarray, rows: slice) -> None:
        score = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, 1)
        self.id[rows] = np.take_along_axis(ids, order, 1)


def _search_chunk(best: Best, q_id: np.ndarray, q: np.ndarray, q_length: np.ndarray, tables: np.ndarray, ids: np.ndarray, vec: np.ndarray, code: np.ndarray, norm: np.ndarray, rerank: int) -> None:
    order = np.argsort(ids, kind="stable")  # equal scores: the smaller id first
    ids, vec, code, norm = ids[order], vec[order], code[order], norm[order]
    scaled = vec / np.abs(vec).max(axis=1, keepdims=True)
    length = np.sqrt((scaled * scaled).sum(axis=1))
    books = code.shape[1]
    prefer = np.arange(len(ids)) * 1e-13
    inverse = 1 / np.maximum(norm, 1e-12)
    for a in range(0, len(q_id), 128):
        rows = slice(a, min(a + 128, len(q_id)))
        approx = tables[rows, 0][:, code[:, 0]]
        for i in range(1, books):
            approx = approx + tables[rows, i][:, code[:, i]]
        key = approx * inverse - prefer
        key[ids[None, :] == q_id[rows, None]] = -np.inf
        keep = min(rerank, len(ids))
        pick = np.argpartition(-key, keep - 1, axis=1)[:, :keep]
        exact = (scaled[pick] * q[rows, None, :]).sum(axis=2) / (length[pick] * q_length[rows, None])
        own = ids[pick] == q_id[rows, None]
        best.merge(np.where(own, -np.inf, exact), np.where(own, np.iinfo(np.int64).max, ids[pick]), rows)


def search(index: DataFrame, books: np.ndarray, d: int, every: int, k: int = 5, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of the index to each of its rows whose id is divisible by ``every``."""
    spark = index.sparkSession
    asked = index.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    total = asked.count()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    blocks = max(1, -(-total // QUERIES))
    found = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)) == block) if blocks > 1 else asked
        rows = part.toPandas()
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, rows["id"].to_numpy(np.int64), np.stack(rows["vec"]) if len(rows) else np.zeros((0, d)), books))

        def run(batches, sent=sent):
            name, q_id, vec, books = sent.value
            if not len(q_id):
                return

            def build():
                q = vec / np.abs(vec).max(axis=1, keepdims=True)
                return q, np.sqrt((q * q).sum(axis=1)), np.einsum("qd,mkd->qmk", _unit(vec), books, optimize=True).astype(np.float32)

            q, q_length, tables = _tables(name, build)
            best, held = Best(len(q_id), k), []

            def flush():
                table = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint8).reshape(len(table), -1)
                _search_chunk(
                    best, q_id, q, q_length, tables, table["id"].to_numpy(), _vectors(table["vec"].combine_chunks(), d), code, table["norm"].to_numpy(), rerank
                )

            for batch in common.slices(batches, 1024):
                held.append(batch)
                if sum(map(len, held)) >= CHUNK:
                    flush()
            if held:
                flush()
            there = best.score > -np.inf
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(q_id[:, None], there.shape)[there]), pa.array(best.id[there]), pa.array(best.score[there])], ["query_id", "vec_id", "score"]
            )

        common.ship_package(spark)
        one = index.select("id", "vec", "code", "norm").mapInArrow(run, "query_id long, vec_id long, score double")
        best = one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            best = common.materialize(best, "ann-block")
            sent.destroy()
        found = best if found is None else found.unionByName(best)
    return found


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    use, d, n = usable(vectors, id_col, vec_col)
    index, books = build_index(use, d, n)
    return search(index, books, d, every, k)
