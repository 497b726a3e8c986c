"""Documents that every operator must cope with."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):  # noqa: ANN001
    """(doc_id, text[, lang]) rows as a documents table."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(12) + "." for _ in range(6)]
    rows: list[tuple] = [(None, "text without an id. It has two sentences."), (None, None), (7, None), (8, ""), (9, " \t\r\n\n"), (10, "one"), (11, "!?. ... 123")]
    for i in range(20, 60):
        parts = [line(rng.randint(3, 15)) + rng.choice([".", "!", "", " ?"]) for _ in range(rng.randint(1, 8))]
        parts[rng.randrange(len(parts)) :] = [rng.choice(shared), " \t" + rng.choice(shared).upper() + "\r"]
        rows.append((i, "\n".join(parts)))
    rows += [(70, rows[-1][1]), (71, rows[-1][1]), (72, rows[-2][1]), rows[-1], (30, "another text of number thirty.\nIt is short.")]
    rows.append((80, "\n".join(line(9) for _ in range(3000)) + "\n" + shared[0]))
    rows.append((81, "ÄÖÜ äöü İıſ   x 日本語のテキスト é 👩‍👩‍👧 it's I'll we've 12½ 3,14 ende " + shared[1]))
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return make(spark, awkward()).cache()


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(spark):
    return make(spark, [])
