"""Substring deduplication against a plain version."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sieveline.llm import spans
from sieveline.llm.words import hash_slices, mix

from .conftest import awkward, make

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _cut_word(word: str) -> bool:
    import numpy as np

    data = np.frombuffer(word.encode(), np.uint8)
    return bool(mix(hash_slices(data, np.array([0]), np.array([len(data)])) + np.uint64(77))[0] % np.uint64(spans.CUT_ONE_IN) == 0)


def sentences(text: str) -> list[list[re.Match]]:
    """Words of each sentence."""
    out: list[list[re.Match]] = []
    found = list(re.finditer("[^\x20\x09-\x0d]+", text))
    own: list[re.Match] = []
    for i, m in enumerate(found):
        own.append(m)
        gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        if m.group()[-1] in ".!?" or "\n" in gap:
            out.append(own)
            own = []
    cut: list[list[re.Match]] = []
    for s in out:
        own = []
        for m in s:
            own.append(m)
            if len(s) > spans.LONG_SENTENCE and _cut_word(m.group().translate(LOWER)):
                cut.append(own)
                own = []
        if own:
            cut.append(own)
    return cut


def brute(rows, min_words: int = spans.MIN_WORDS):  # noqa: ANN001
    order = lambda i: spans.LAST if i is None else i
    first: dict = {}
    own = []
    for doc_id, text, *_ in rows:
        s = sentences(text or "")
        keys = {}
        for i in range(len(s)):
            j, n = i, len(s[i])
            while (n < min_words or j == i) and j + 1 < len(s):
                j += 1
                n += len(s[j])
            if n >= min_words and j > i:
                keys[i] = (tuple(m.group().translate(LOWER) for x in s[i : j + 1] for m in x), j)
        own.append((s, keys))
        for key, _ in keys.values():
            first[key] = min(first.get(key, spans.LAST), order(doc_id))
    out = []
    for (doc_id, text, *_), (s, keys) in zip(rows, own, strict=True):
        gone, seen = set(), set()
        for i, (key, j) in keys.items():
            if first[key] < order(doc_id) or key in seen:
                gone |= set(range(i, j + 1))
            seen.add(key)
        kept = text
        if gone:
            edge = [x[0].start() for x in s] + [len(text)]
            kept = text[: edge[0]] + "".join(text[edge[i] : edge[i + 1]] for i in range(len(s)) if i not in gone)
        out.append((doc_id, len(s), len(gone), kept))
    return sorted(out, key=repr)


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n)) + rng.choice([".", "!", "?", "\n", ",", ""])
    passages = [" ".join(sentence(rng.randint(4, 40)) for _ in range(rng.randint(2, 6))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [sentence(rng.randint(1, 30)) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, " ".join(parts)))
    return rows


def test_equals_plain_version(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = sorted(map(tuple, spans.dedup_spans(make(spark, rows)).collect()), key=repr)
        assert got == brute(rows)


def test_awkward_documents(docs):
    got = sorted(map(tuple, spans.dedup_spans(docs).collect()), key=repr)
    wanted = [(a, b, c, None if (a == 7 or (a is None and d is None)) else d) for a, b, c, d in brute([(r[0], r[1]) for r in awkward()])]
    assert got == sorted(wanted, key=repr)


def test_long_passages_go_wherever_they_are_quoted(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = [word() for _ in range(90)]  # one sentence without an end
    rows = [(i, " ".join([word() for _ in range(25)] + passage + [word() for _ in range(25)])) for i in range(4)]
    got = {r["doc_id"]: r for r in spans.dedup_spans(make(spark, rows)).collect()}
    assert got[0]["text"] == rows[0][1]
    for i in (1, 2, 3):
        left = set(got[i]["text"].split())
        assert len(left & set(passage)) < 45
        assert got[i]["text"].split()[:5] == rows[i][1].split()[:5]


def test_columns_stay(docs):
    wider = docs.withColumns({c: F.lit(c) for c in ("marks", "row", "doc", "_text", "h1", "at")})
    out = spans.with_spans_removed(wider)
    assert out.columns == wider.columns and out.count() == wider.count()
    assert {r["marks"] for r in out.collect()} == {"marks"}
    assert out.where("n_chars <> length(text)").count() == 0


def test_empty_table(nothing):
    assert spans.dedup_spans(nothing).collect() == []


def test_each_text_of_an_id_has_its_own_marks(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    prose = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(8)) + "." for _ in range(n))
    passage, unique = prose(13), prose(13)
    for other in (30, None):
        rows = [(1, passage), (other, passage), (other, unique), (other, prose(2) + " " + passage), (other, prose(40)), (other, ""), (other, None), (other, unique)]
        for order in (rows, rows[::-1]):
            got = sorted(map(tuple, spans.dedup_spans(make(spark, order)).collect()), key=repr)
            wanted = [(i, n, k, None if (i, n, t) == (other, 0, None) else t) for i, n, k, t in brute(order)]
            assert got == sorted(wanted, key=repr)
            kept = [r["text"] for r in spans.with_spans_removed(make(spark, order)).collect()]
            assert kept.count(unique) == 2 and kept.count(passage) == 1
