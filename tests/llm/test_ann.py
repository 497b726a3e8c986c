"""Nearest neighbours: recall against brute force, exact scores, defined results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import ann

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids: np.ndarray, x: np.ndarray, every: int, k: int = 5) -> dict[int, list[tuple[int, float]]]:
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(1))
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i] / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def recall(got, wanted) -> float:  # noqa: ANN001
    found = {}
    for r in got:
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r
    hits = sum(j in found.get(q, {}) for q, own in wanted.items() for j, _ in own)
    for q, own in wanted.items():
        for j, score in own:
            if j in found.get(q, {}):
                assert abs(found[q][j]["score"] - score) < 1e-12
        ranked = sorted(found.get(q, {}).values(), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(own) + 1))
        assert ranked == sorted(ranked, key=lambda r: (-r["score"], r["vec_id"]))
    return hits / sum(map(len, wanted.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    wanted = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), 50)
    assert recall(ann.nearest(df).collect(), wanted) >= 0.95


def test_recall_where_chunks_are_full(spark, monkeypatch):
    """Independent vectors have no structure to learn: the hardest case."""
    rng = np.random.default_rng(2)
    ids, x = np.arange(12_000), rng.normal(size=(12_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], SCHEMA).coalesce(2)
    assert recall(ann.nearest(df, every=200).collect(), brute(ids, x, 200)) >= 0.9


def test_query_blocks_find_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    one = sorted(map(tuple, ann.nearest(df, every=5).collect()))
    monkeypatch.setattr(ann, "QUERIES", 30)
    assert sorted(map(tuple, ann.nearest(df, every=5).collect())) == one


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [2.0, 0.0]), (2, [5.0, 0.0]), (4, [0.0, -1.0]), (100, None), (150, [0.0, 0.0]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [None, 1.0]),
        (350, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (0, [1.0, 0.0]), (-50, [1e-30, 1e-30]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(0) for c in ("id", "vec", "code", "norm")})
    got = ann.nearest(df).collect()
    own = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        own.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 6)))
    assert set(own) == {0, 50, -50}
    assert own[0][:2] == [(2, 1.0), (3, 1.0)] and 0 not in [v for v, _ in own[0]]
    assert own[50][0] == (-50, 1.0) and own[-50][0] == (50, 1.0)


def test_empty_tables(spark):
    assert ann.nearest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann.nearest(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    assert ann.nearest(spark.createDataFrame([(50, [1.0, 2.0])], SCHEMA)).collect() == []


def test_beam_search_is_no_worse_than_greedy():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 16)).astype(np.float32)
    books = ann.train(x, books=4, entries=32)

    def error(beam: int) -> float:
        codes, norms = ann.encode(x, books, beam)
        made = sum(books[i][codes[:, i]] for i in range(4))
        assert np.allclose(np.sqrt((made**2).sum(1)), norms, atol=1e-4)
        return float(((x - made) ** 2).sum())

    assert error(4) <= error(1)
