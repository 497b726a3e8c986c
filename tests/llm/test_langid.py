"""Language identification: inference by definition, held-out accuracy, defined results."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import langid
from sieveline.llm.words import hash_slices, mix

from .conftest import make


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(4)
    k, t = 3, 5
    emission = rng.normal(size=(2, t, k)).astype(np.float32)
    transitions = rng.normal(size=(k, k)).astype(np.float32)
    mask = np.array([[True] * t, [True] * 3 + [False] * 2])
    gamma, expected = langid.marginals(emission, mask, transitions, pairs=True)
    total = np.zeros((k, k))
    for s, n in ((0, 5), (1, 3)):
        weight, single = 0.0, np.zeros((n, k))
        pairs = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            w = np.exp(sum(emission[s, i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:], strict=False)))
            weight += w
            for i, y in enumerate(path):
                single[i, y] += w
            for a, b in zip(path, path[1:], strict=False):
                pairs[a, b] += w
        assert np.allclose(gamma[s, :n], single / weight, atol=1e-4)
        total += pairs / weight
    assert np.allclose(expected, total, atol=1e-3)


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(big):
    return langid.train(big)


def test_held_out_accuracy(big, model):
    out = langid.predict(big, model).join(big.select("doc_id", "lang", "n_chars"), "doc_id").where(langid.held_out(F.col("doc_id")))
    rows = out.where("lang is not null and n_chars >= 20 and lang_pred <> 'und'").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert len(rows) > 100 and right / len(rows) >= 0.95, right / len(rows)


def test_words_of_mixed_texts(big, model):
    """Spans of two languages in one text: most words get their own span's label."""
    own = {}
    for r in big.where("lang is not null and n_chars > 600").where(langid.held_out(F.col("doc_id"))).select("lang", "text").collect():
        own.setdefault(r["lang"], " ".join(r["text"].split()[:40]))
    assert len(own) >= 2
    right = total = 0
    for a, b in itertools.permutations(sorted(own), 2):
        *_, gamma, letters = langid.label_words(model, [f"{own[a]} {own[b]}".encode()])
        said = [model.labels[i] for i in gamma.argmax(1)]
        right += sum(x == (a if i < 40 else b) for i, x in enumerate(said))
        total += len(said)
    assert right / total >= 0.85, right / total


def test_contract(big):
    out = langid.identify(big)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    for r in out.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1


def test_defined_results(spark, model):
    rows = [(1, None), (2, ""), (3, " 123 .,!\n"), (4, "½ ①"), (5, "the same text in two rows"), (6, "the same text in two rows"), (None, "the same text in two rows"), (7, "日本語"), (8, "word " * 200_000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(make(spark, rows), model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 4))
    assert got[5] == got[6] == got[None] and got[5][0] in model.labels and got[8][0] in model.labels


def _plain(model, text: str) -> tuple[str, float]:  # noqa: ANN001
    """Prediction of a short text by definition: features one by one, marginals by enumeration of all label paths."""
    table = {65 + i: 97 + i for i in range(26)}
    found = [w.translate(table).encode() for w in re.findall("[^\x20\x09-\x0d]+", text)]
    number = lambda b: int.from_bytes(b, "little")
    bucket = lambda x: int(mix(np.array([x % (1 << 64)], np.uint64))[0]) % langid.BUCKETS
    emission, k = [], len(model.labels)
    for w in found:
        h = hash_slices(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        at = np.flatnonzero(model.lexicon == h)
        x = [bucket(3 * (1 << 40) + (int(model.lexicon_label[at[0]]) + 1 if len(at) else 0))]
        for n in (1, 2, 3):
            x += [bucket(number(w[:n]) * 8 + n), bucket(number(w[-n:]) * 8 + n + (1 << 40))]
        x += [bucket(number(w[i : i + 3]) + 2 * (1 << 40)) for i in range(len(w) - 2)]
        emission.append(sum(model.weights[b].astype(float) for b in x))
    total, single = 0.0, np.zeros((len(found), k))
    for path in itertools.product(range(k), repeat=len(found)):
        score = sum(emission[i][y] for i, y in enumerate(path)) + sum(float(model.transitions[a, b]) for a, b in zip(path, path[1:], strict=False))
        total += np.exp(score)
        for i, y in enumerate(path):
            single[i, y] += np.exp(score)
    counts = [i for i, w in enumerate(found) if any(c > 127 or chr(c).isalpha() for c in w)]
    if not any(map(str.isalpha, text)):
        return "und", 0.0
    mean = (single / total)[counts].mean(axis=0)
    return model.labels[int(mean.argmax())], float(mean.max())


def test_predictions_equal_the_definition(big, model):
    texts = ["THE cat", "der Hund 12 läuft", "la casa", "un peu de", "x", "12 ...", "Straße über-ab", "donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichen" * 3 + " Ende"]
    for r in big.where("n_chars > 100").limit(25).collect():
        w = r["text"].split()
        texts += [" ".join(w[:4]), " ".join(w[5:7])]
    langs, scores = langid.predict_texts(model, texts)
    for text, lang, score in zip(texts, langs, scores, strict=True):
        wanted, certain = _plain(model, text)
        assert abs(score - certain) < 2e-3, text
        assert lang == wanted or certain < 0.51


def test_sample_is_bounded(spark):
    rows = [(i % 7, f"word{i % 40} other text", "l" + str(i % 3)) for i in range(4000)]
    labels, windows = langid._sample_windows(make(spark, rows).select("doc_id", "text", "lang"), 5)
    assert {x: labels.count(x) for x in set(labels)} == {"l0": 5, "l1": 5, "l2": 5} and len(windows) == 15
    labels, _ = langid._sample_windows(make(spark, rows).select("doc_id", "text", "lang"), 5, total=6)
    assert sorted(labels) == ["l0", "l0", "l1", "l1", "l2", "l2"]
    with pytest.raises(ValueError, match="more than 2 labels"):
        langid._sample_windows(make(spark, rows).select("doc_id", "text", "lang"), 5, total=2)


def test_empty_table_with_a_model(nothing, model):
    assert langid.predict(nothing, model).collect() == []


def test_without_training_rows(spark, nothing):
    assert langid.identify(nothing).collect() == []
    rows = langid.identify(make(spark, [(1, "some text"), (2, None)])).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
    kept = langid.keep_identified(make(spark, [(1, "some text"), (2, None), (3, "12")]), None, 0.4)
    assert [r["doc_id"] for r in kept.collect()] == [1]


def test_rejection_keeps_rows_whole(docs, model):
    wider = docs.withColumns({c: F.lit(c) for c in ("lang_pred", "score", "key")})
    out = langid.keep_identified(wider, model, 0.0)
    assert out.columns == wider.columns
    assert {r["doc_id"] for r in wider.collect()} - {r["doc_id"] for r in out.collect()} == {7, 8, 9, 11}


def test_lexicon_and_labels_are_never_features(spark, big, model):
    """Predictions depend on text alone: other columns may say anything."""
    some = big.limit(50)
    changed = some.withColumns({"lang": F.lit("xx"), "source": F.lit("?"), "doc_id": F.col("doc_id") + 10_000})
    a = {r["doc_id"]: r["lang_pred"] for r in langid.predict(some, model).collect()}
    b = {r["doc_id"] - 10_000: r["lang_pred"] for r in langid.predict(changed, model).collect()}
    assert a == b


def test_sampled_windows_are_one_object_each(spark):
    """The driver holds a window as its words with spaces between, not as an object for each word."""
    text = "\t ".join(f"word{i}" for i in range(150))
    labels, windows = langid._sample_windows(make(spark, [(0, text, "en"), (1, "zwei Worte", "de")]).select("doc_id", "text", "lang"), 5)
    wanted = [b" ".join(f"word{i}".encode() for i in range(a, a + 64)) for a in (0, 64)]
    assert {*zip(labels, windows, strict=True)} <= {("de", b"zwei Worte"), *(("en", w) for w in wanted)} and windows
