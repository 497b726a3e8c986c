"""Operator 8: language identification by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes of up to three bytes, its byte trigrams and its membership in lexicons of
the training words; weights of hashed features give each label a score, a learned transition matrix joins neighbours.
Forward-backward over windows of ``WINDOW`` words labels every word of every text, code-switched ones included; a
document's language is the one with the largest mean marginal over its words that hold letters, and that mean is
the score.

The model is fitted to at most ``per_label`` training documents of each label (those with the smallest hash of id and
text), ``SAMPLE`` in all, and ``PER_DOC`` windows of each. Training sequences join spans of different languages, so that
transitions are learned from switches, not only from monolingual text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without training rows every text is;
equal texts get equal predictions, rows that repeat are each returned; of labels with equal marginals the first in order of
their names is taken; label, source and id are never features. An empty table gives an empty one; other columns play no
part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .words import _MASK, hash_slices, mix, words

BUCKETS = 1 << 16
WINDOW = 64
PER_LABEL, PER_DOC = 800, 4
SAMPLE = 32_768  # texts in all, whatever the number of labels
UNDETERMINED = "und"

_HAS_LETTER = np.zeros(256, bool)  # bytes of words that count: ASCII letters and anything beyond ASCII
_HAS_LETTER[65:91] = _HAS_LETTER[97:123] = _HAS_LETTER[128:] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Weights of hashed features (bucket, label), transitions, start scores and the lexicon."""

    def __init__(self, labels: list[str], lexicon: np.ndarray, lexicon_label: np.ndarray):
        k = len(labels)
        self.labels = labels
        self.lexicon, self.lexicon_label = lexicon, lexicon_label
        self.weights = np.zeros((BUCKETS, k), np.float32)
        self.transitions = np.zeros((k, k), np.float32)

    def features(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all features of the words, end to end, and the number of each word's."""
        padded = np.zeros(len(buf) + 16, np.uint8)
        padded[8 : len(buf) + 8] = buf
        lanes = np.ndarray((len(buf) + 9,), np.dtype("<u8"), padded.data, strides=(1,))
        size = end - start
        columns = []
        for n in (1, 2, 3):
            use = np.minimum(size, n)
            head = lanes[start + 8] & _MASK[use]
            tail = lanes[end + 8 - use] & _MASK[use]
            columns += [mix(head * np.uint64(8) + np.uint64(n)), mix(tail * np.uint64(8) + np.uint64(n) + np.uint64(1 << 40))]
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            known = np.where(self.lexicon[at] == h, self.lexicon_label[at] + 1, 0)
        else:
            known = np.zeros(len(h), np.int64)
        columns.append(mix(known.astype(np.uint64) + np.uint64(3 << 40)))
        fixed = (np.stack(columns, axis=1) % np.uint64(BUCKETS)).astype(np.int64)
        grams = np.maximum(size - 2, 0)
        total = grams + fixed.shape[1]
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        first = ends - total
        for i in range(fixed.shape[1]):
            out[first + i] = fixed[:, i]
        within = np.cumsum(grams)
        steps = np.arange(int(within[-1]) if len(within) else 0) - np.repeat(within - grams, grams)
        gram = lanes[np.repeat(start + 8, grams) + steps] & _MASK[3]
        out[np.repeat(first + fixed.shape[1], grams) + steps] = (mix(gram + np.uint64(2 << 40)) % np.uint64(BUCKETS)).astype(np.int64)
        return out, total

    def emissions(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(words, labels) summed weights."""
        if not len(counts):
            return np.zeros((0, len(self.labels)), np.float32)
        return np.add.reduceat(self.weights[buckets], np.cumsum(counts) - counts, axis=0)


def marginals(emission: np.ndarray, mask: np.ndarray, transitions: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward over (sequences, time, labels) with scaling; masked tail steps are uniform and carry nothing."""
    s, t, k = emission.shape
    psi = np.exp(emission - emission.max(axis=2, keepdims=True))
    psi[~mask] = 1
    a = np.exp(transitions - transitions.max())
    alpha = np.empty((t, s, k), np.float32)
    beta = np.empty((t, s, k), np.float32)
    psi = np.ascontiguousarray(psi.transpose(1, 0, 2))
    alpha[0] = psi[0] / psi[0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (alpha[i - 1] @ a) * psi[i]
        alpha[i] = x / x.sum(1, keepdims=True)
    beta[t - 1] = 1
    for i in range(t - 1, 0, -1):
        keep = mask[:, i, None]
        x = np.where(keep, (beta[i] * psi[i]) @ a.T, 1)
        beta[i - 1] = x / x.sum(1, keepdims=True) * k
    gamma = alpha * beta
    gamma /= gamma.sum(2, keepdims=True)
    expected = None
    if pairs:
        expected = np.zeros((k, k))
        for i in range(1, t):
            x = alpha[i - 1][:, :, None] * a * (beta[i] * psi[i])[:, None, :]
            x /= x.sum((1, 2), keepdims=True)
            expected += (x * mask[:, i, None, None]).sum(0)
    return gamma.transpose(1, 0, 2), expected


def _sample_windows(docs: DataFrame, per_label: int, total: int = SAMPLE) -> tuple[list[str], list[bytes]]:
    """Labels and windows of the bounded training sample: at most ``per_label`` texts of a label, ``total`` in all.

    A window is its words with spaces between: on the driver, an object for each word takes some 20 times their bytes.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # 53 bits of hash of id and text: rows that repeat both count once
    rows = rows.select("lang", "text", F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(8)), 11).alias("key"))
    many = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).limit(total + 1).collect()}
    if len(many) > total:
        raise ValueError(f"more than {total} labels: the sample cannot hold a text of each")
    if not many:
        return [], []
    # hashes are uniform: twice the share that is wanted holds the smallest ones of each label, whatever the number of rows
    each = min(per_label, total // len(many))
    bounds = docs.sparkSession.createDataFrame([(lang, int(min(1.0, 2 * each / n) * (1 << 53))) for lang, n in many.items()], "lang string, bound long")
    few = rows.join(F.broadcast(bounds), "lang").where("key <= bound").dropDuplicates(["lang", "key"])  # bounds: at most ``total`` rows
    drawn = few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("key"))).where(F.col("r") <= each)

    def run(batch: pa.RecordBatch):
        langs, keys, out = [], [], []
        for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = text.encode().split()
            n = max(1, len(w) // WINDOW)
            for i in sorted({n * j // PER_DOC for j in range(PER_DOC)}):
                if own := w[i * WINDOW : (i + 1) * WINDOW]:
                    langs.append(lang)
                    keys.append(key)
                    out.append(b" ".join(own))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["lang", "key", "w"])

    got = common.map_batches(drawn.select("lang", "key", "text"), run, "lang string, key long, w binary").collect()  # PER_DOC windows of each
    got = sorted((r["lang"], r["key"], bytes(r["w"])) for r in got)
    return [g[0] for g in got], [g[2] for g in got]


def fit(label_of: list[str], texts: list[bytes], rounds: int = 120, batch: int = 192) -> Model:
    """Adagrad on the conditional likelihood of label sequences made of spans of one or several languages."""
    labels = sorted(set(label_of))
    y = np.array([labels.index(x) for x in label_of])
    buf, start, end, _, bounds = words(texts)
    h = hash_slices(buf, start, end)
    uniq, first, word = np.unique(h, return_index=True, return_inverse=True)
    word_label = np.repeat(y, np.diff(bounds))
    seen = np.zeros((len(uniq), len(labels)))
    np.add.at(seen, (word, word_label), 1)
    pure = (seen.sum(1) >= 3) & (seen.max(1) >= 0.8 * seen.sum(1))
    model = Model(labels, uniq[pure], seen.argmax(1)[pure])
    buckets, counts = model.features(buf, start[first], end[first], uniq)
    at = np.concatenate(([0], np.cumsum(counts)))
    rng = np.random.default_rng(8)
    g_w, g_t = np.full_like(model.weights, 1e-2), np.full_like(model.transitions, 1e-2)
    k = len(labels)
    by_label = [np.flatnonzero(y == i) for i in range(k)]
    for _ in range(rounds):
        ids, gold = np.zeros((batch, WINDOW), np.int64), np.zeros((batch, WINDOW), np.int64)
        mask = np.zeros((batch, WINDOW), bool)
        for s in range(batch):
            n, mixed = 0, rng.random() < 0.5
            lang = rng.integers(k)
            while n < WINDOW:
                w = rng.choice(by_label[lang])
                a, b = bounds[w], bounds[w + 1]
                if mixed:
                    a = rng.integers(a, b)
                    b = min(b, a + rng.integers(4, 24))
                own = word[a : min(b, a + WINDOW - n)]
                ids[s, n : n + len(own)] = own
                gold[s, n : n + len(own)] = lang
                mask[s, n : n + len(own)] = True
                n += len(own)
                if not mixed:
                    break
                lang = rng.integers(k)
        used, inverse = np.unique(ids, return_inverse=True)
        pick = np.concatenate([np.arange(at[u], at[u + 1]) for u in used])
        own_buckets, own_counts = buckets[pick], counts[used]
        emission = model.emissions(own_buckets, own_counts)[inverse.reshape(ids.shape)]
        gamma, expected = marginals(emission, mask, model.transitions, pairs=True)
        error = gamma.copy()
        error[np.arange(batch)[:, None], np.arange(WINDOW)[None, :], gold] -= 1
        error[~mask] = 0
        per_word = np.zeros((len(used), k))
        np.add.at(per_word, inverse.ravel(), error.reshape(-1, k))
        grad = np.zeros_like(model.weights)
        np.add.at(grad, own_buckets, np.repeat(per_word, own_counts, axis=0).astype(np.float32))
        grad = grad / batch + 1e-5 * model.weights
        g_w += grad**2
        model.weights -= 0.3 * grad / np.sqrt(g_w)
        inner = mask[:, 1:] & mask[:, :-1]
        observed = np.zeros((k, k))
        np.add.at(observed, (gold[:, :-1][inner], gold[:, 1:][inner]), 1)
        grad_t = ((expected - observed) / batch + 1e-3 * model.transitions).astype(np.float32)
        g_t += grad_t**2
        model.transitions -= 0.2 * grad_t / np.sqrt(g_t)
    return model


def label_words(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, bounds, marginals, letters) of all words: letters says whether a word holds any."""
    buf, start, end, text, bounds = words(texts)
    k = len(model.labels)
    if not len(start):
        return buf, start, end, bounds, np.zeros((0, k), np.float32), np.zeros(0, bool)
    uniq, first, word = np.unique(hash_slices(buf, start, end), return_index=True, return_inverse=True)
    emission = model.emissions(*model.features(buf, start[first], end[first], uniq))
    letter_bytes = np.concatenate(([0], np.cumsum(_HAS_LETTER[buf])))
    letters = letter_bytes[end] > letter_bytes[start]
    position = np.arange(len(start)) - np.repeat(bounds[:-1], np.diff(bounds))
    windows_of = -(-np.diff(bounds) // WINDOW)
    row = np.repeat(np.cumsum(windows_of) - windows_of, np.diff(bounds)) + position // WINDOW
    grid = np.zeros((int(windows_of.sum()), WINDOW), np.int64)
    mask = np.zeros(grid.shape, bool)
    grid[row, position % WINDOW] = word
    mask[row, position % WINDOW] = True
    gamma, _ = marginals(emission[grid], mask, model.transitions)
    return buf, start, end, bounds, gamma[row, position % WINDOW], letters


def predict_texts(model: Model | None, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if model is None:
        return langs, scores
    *_, bounds, gamma, letters = label_words(model, [x.encode() for x in texts])
    total = np.concatenate((np.zeros((1, gamma.shape[1])), np.cumsum(gamma * letters[:, None], axis=0, dtype=np.float64)))
    sums = total[bounds[1:]] - total[bounds[:-1]]
    for i, x in enumerate(texts):
        weight = sums[i].sum()
        # a word beyond ASCII need not hold a letter
        if weight > 0.5 and any(map(str.isalpha, x)):
            best = int(sums[i].argmax())
            langs[i] = model.labels[best]
            scores[i] = min(1.0, max(0.0, round(float(sums[i][best] / weight), 5)))
    return langs, scores


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        texts = [x or "" for x in batch.column(1).to_pylist()]
        for a, b in common.steps([len(x) for x in texts], 2 << 20):
            langs, scores = predict_texts(sent.value, texts[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(langs, pa.string()), pa.array(scores)], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double")


def train(docs: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """The model of ``docs`` (doc_id, text, lang): its rows that are not held out, as far as the bound allows."""
    label_of, windows = _sample_windows(docs.select("doc_id", "text", "lang"), per_label)
    model = fit(label_of, windows) if label_of else None
    del label_of, windows
    common.release_memory()  # the driver's Python, too, goes on beside the JVM
    return model


def identify(docs: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, held_out, lang_pred, score)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    out = predict(docs, train(docs, per_label))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model | None, min_score: float) -> DataFrame:
    """Rows of ``docs`` with a predicted language and at least ``min_score``; columns and order of columns unchanged.

    The rows pass through whole, so nothing is joined back. Without a model nothing is rejected but texts without letters.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch):
        texts = [x or "" for x in batch.column(at).to_pylist()]
        for a, b in common.steps([len(x) for x in texts], 2 << 20):
            langs, scores = predict_texts(sent.value, texts[a:b])
            keep = [
                lang != UNDETERMINED and score >= min_score if sent.value is not None else any(map(str.isalpha, x))
                for lang, score, x in zip(langs, scores, texts[a:b], strict=True)
            ]
            yield batch.slice(a, b - a).filter(pa.array(keep, pa.bool_()))

    return common.map_batches(docs, run, docs.schema)
