"""Near-duplicates against brute force over all pairs, and SQL."""

from __future__ import annotations

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from sieveline.llm import common, neardup, queries
from tests import support

from .conftest import awkward, make

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, width: int) -> frozenset:
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute(rows, width: int, percent: int = 80) -> list[tuple]:  # noqa: ANN001
    sets = [shingles(r[1], width) for r in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i][0], rows[j][0]
        if a is None or b is None or not sets[i] or not sets[j]:
            continue
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    out = [(r[0], len(s), None if r[0] is None else root(r[0]), r[0] is None or root(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True)]
    return sorted(out, key=repr)


def run(df, width: int, **more) -> list[tuple]:  # noqa: ANN001, ANN003
    return sorted(map(tuple, neardup.near_duplicates(df, width=width, **more).drop("version").collect()), key=repr)


def corpus(seed: int, groups: int, copies: int) -> list[tuple]:
    """Groups of near copies about the threshold, with a passage that all documents share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common_part = [rng.choice(words) for _ in range(30)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(5, 220))]
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 12))):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(own + common_part * (rng.random() < 0.3))))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_awkward_documents(docs, width):
    assert run(docs, width) == brute(awkward(), width)  # number 30 is there with two texts


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 2), (3, 5)])
def test_equals_brute_force(spark, seed, width):
    rows = corpus(seed, 40, 9)
    assert run(make(spark, rows), width) == brute(rows, width)


def test_long_lists_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 3)
    monkeypatch.setattr(neardup, "ROWS", 5)
    monkeypatch.setattr(neardup, "COLUMNS", 7)
    rows = corpus(5, 25, 12)
    assert run(make(spark, rows), 2) == brute(rows, 2)


def test_long_sets_of_a_large_group_are_compared_in_blocks(spark, monkeypatch):
    """Sets beyond the sketches: exact links, and no row for each pair of an outsider and a member of its group."""
    for name, value in (("SMALL", 3), ("ROWS", 64), ("COLUMNS", 128), ("WIDE", 64), ("VALUES", 400)):
        monkeypatch.setattr(neardup, name, value, raising=False)
    rng = random.Random(31)
    word = lambda: f"x{rng.randrange(10**6)}"
    base = [word() for _ in range(150)]
    variant = base[:118] + [word() for _ in range(32)]  # too far from the base, but within the sketches' doubt
    rows = []
    for text in (base, variant):
        for _ in range(40):
            own = list(text)
            for _ in range(rng.randrange(12)):
                own[rng.randrange(len(own))] = word()
            rows.append((0, " ".join(own)))
    rows += corpus(6, 10, 8)
    rows = [(i, r[1]) for i, r in enumerate(rows, 1)]
    rng.shuffle(rows)
    made = {}

    def counted(df, name, *more):  # noqa: ANN001, ANN002, ANN202
        out = written(df, name, *more)
        made[name] = out.count()
        return out

    written = common.materialize
    monkeypatch.setattr(common, "materialize", counted)
    assert run(make(spark, rows), 2) == brute(rows, 2)
    assert max(made.get("near-blocks", 0), made.get("near-unsure", 0)) < 300, sorted(made.items())
    assert made.get("near-diffs", 0) > 40  # there was doubt


def test_exactly_at_the_threshold(spark):
    # 9 words: 8 shingles; 10 words with 2 changed at the end: 8 of 10 in common is 80 %
    base = "a b c d e f g h i".split()
    rows = [(5, " ".join(base)), (3, " ".join([*base, "x", "y"])), (9, " ".join([*base, "x", "y", "z"]))]
    got = {r[0]: r[2] for r in run(make(spark, rows), 2)}
    assert got == {r[0]: r[2] for r in brute(rows, 2)} and got[5] == 3


def test_repeated_ids_link_their_texts(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"v{rng.randrange(900)}" for _ in range(60))
    a, b, c = text(), text(), text()
    rows = [(30, a), (30, b), (40, b + " x"), (20, a + " y"), (50, c), (50, c), (None, a), (60, c + " z"), (60, text())]
    for order in (rows, rows[::-1], rows[4:] + rows[:4]):
        got = run(make(spark, order), 2)
        assert got == brute(order, 2)
        assert {r[2] for r in got if r[0] in (20, 30, 40)} == {20}


def test_rows_are_dropped_by_their_own_text(spark):
    rng = random.Random(9)
    a, b = (" ".join(f"v{rng.randrange(900)}" for _ in range(60)) for _ in range(2))
    rows = [(20, a + " y"), (30, a), (30, b), (30, None), (None, a), (40, b)]
    df = make(spark, rows).withColumns({c: F.lit(c) for c in ("version", "kept", "class", "n", "row", "_near_id")})
    out = neardup.drop_copies(df)
    assert out.columns == df.columns and {r["version"] for r in out.collect()} == {"version"}
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([rows[0], *rows[2:5]], key=repr)


def test_whole_sets_find_every_link(spark):
    rows = corpus(21, 25, 8) + [(9000, " ".join(f"q{i}" for i in range(700))), (9001, " ".join(f"q{i}" for i in range(20, 760)))]
    assert run(make(spark, rows), 2, k=neardup.EXACT) == brute(rows, 2)


def test_a_class_may_hold_most_rows(spark):
    rows = [(i, "one and the same text of a few words") for i in range(900)] + corpus(3, 10, 4)[1:]
    assert run(make(spark, rows), 2) == brute(rows, 2)


def test_empty_table(nothing):
    assert run(nothing, 2) == []


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1100)] + [(5000, 4000)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 201)} == {1} and {got[i] for i in range(1000, 1100)} == {1000} and got[5000] == 4000
    assert len(got) == 200 + 100 + 2


def test_query_equals_sql(spark, sf_dir):
    support.same(queries.op2_near_duplicates(spark, sf_dir), support.database(sf_dir), queries.ORACLE["op2_near_duplicates"])


def test_sql_holds_for_awkward_documents(spark, docs):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [list(r[:2]) for r in awkward()])
    support.same(neardup.near_duplicates(docs, width=2).drop("version"), db, queries.ORACLE["op2_near_duplicates"])
