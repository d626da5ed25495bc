"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

Words give character n-grams of 3 to 6 signs, with a space at both ends, hashed to 2^20 buckets. A document is cut into
windows of about 200 words, so that length neither drowns a few words nor fills the buckets; a window counts the n-grams of its
distinct words. Each bucket is scaled by the log ratio of its smoothed counts in toxic and other windows, and logistic
regression fits the weights. A document scores as its most toxic window.

Fitting takes a bounded sample: at most ``MOST_TOXIC`` and ``MOST_CLEAN`` labelled documents, by a hash of their id, and of each at
most ``MOST_WINDOWS`` windows of at most ``LONGEST_WORD`` bytes a word, evenly spaced over the whole text. So the one task that fits
reads at most (4,000 + 8,000) x 12 x 200 words. Scoring reads every text whole, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, LOWER, mixed, slices, text_bytes, words

ORDERS, BITS, WINDOW = (3, 4, 5, 6), 20, 200
MOST_TOXIC, MOST_CLEAN = 4000, 8000
MOST_WINDOWS, LONGEST_WORD = 12, 64
SMOOTH, L2, ROUNDS = 1.0, 1.0, 60

_PLACES = mixed(np.arange(7001, 7001 + max(ORDERS), dtype=np.uint64)) | np.uint64(1)


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of the n-grams in code points of words that are joined by, and begin and end with, a space."""
    space = codes == 32
    word = np.cumsum(space) - 1
    inside = np.concatenate(([0], np.cumsum(space)))
    values = mixed(codes.astype(np.uint64) + np.uint64(1))
    buckets, of = [], []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            at = np.flatnonzero(inside[n - 1 : n - 1 + m] - inside[1 : 1 + m] == 0)  # no space but at the ends
            total = np.full(len(at), n, np.uint64)
            for j in range(n):
                total += values[at + j] * _PLACES[j]
            buckets.append((mixed(total) >> np.uint64(64 - BITS)).astype(np.int32))
            of.append(word[at])
    return (np.concatenate(buckets), np.concatenate(of)) if buckets else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class Windows:
    """The windows of some texts: distinct words, their n-grams, and the distinct words of each window."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        h, begin, end, first = words(data, offsets, ALNUM)
        n = np.diff(first)
        _, example, word = np.unique(h, return_index=True, return_inverse=True)
        size = end[example] - begin[example]
        at = np.repeat(begin[example] - np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(example) else begin[example], size + 1) + np.arange(int((size + 1).sum()))
        joined = LOWER[data[np.minimum(at, max(len(data) - 1, 0))]] if len(at) else np.zeros(0, np.uint8)
        joined[np.cumsum(size + 1) - 1] = 32
        text = " " + joined.tobytes().decode("utf-8", "replace")
        self.bucket, self.gram_of = grams(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        self.n_words = len(example)
        per = np.maximum(np.rint(n / WINDOW).astype(np.int64), 1)
        self.first = np.concatenate(([0], np.cumsum(per)))  # windows of each text
        doc = np.repeat(np.arange(len(n)), n)
        inside = np.arange(len(h)) - first[doc]
        window = self.first[doc] + inside * per[doc] // np.maximum(n[doc], 1)
        pair = np.unique(window * max(self.n_words, 1) + word)
        self.window, self.word = pair // max(self.n_words, 1), pair % max(self.n_words, 1)

    def margins(self, weights: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.gram_of, weights=weights[self.bucket], minlength=self.n_words)
        return np.bincount(self.window, weights=by_word[self.word], minlength=int(self.first[-1]))

    def counts(self, by_window: np.ndarray) -> np.ndarray:
        """Sum over windows of by_window times the window's n-gram counts, for each bucket."""
        by_word = np.bincount(self.word, weights=by_window[self.window], minlength=self.n_words)
        return np.bincount(self.bucket, weights=by_word[self.gram_of], minlength=1 << BITS)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias). Without rows of both classes the weights are 0 and the bias tells the smoothed share."""
    share = (toxic.sum() + 1) / (len(toxic) + 2)
    bias = float(np.log(share / (1 - share)))
    if not 0 < toxic.sum() < len(toxic):
        return np.zeros(1 << BITS), bias
    x = Windows(*text_bytes(texts))
    y = np.repeat(toxic.astype(float), np.diff(x.first))
    p, q = SMOOTH + x.counts(y), SMOOTH + x.counts(1 - y)
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(p == SMOOTH) & (q == SMOOTH)] = 0

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.margins(w[:-1] * ratio) + w[-1]
        miss = _sigmoid(z) - y
        value = float(np.logaddexp(0, np.where(y > 0, -z, z)).sum() + L2 / 2 * (w[:-1] ** 2).sum())
        return value, np.append(x.counts(miss) * ratio + L2 * w[:-1], miss.sum())

    w = descend(loss, np.append(np.zeros(1 << BITS), bias), ROUNDS)
    return w[:-1] * ratio, float(w[-1])


def descend(loss, w: np.ndarray, rounds: int, memory: int = 7) -> np.ndarray:
    """Minimises a smooth convex function by L-BFGS with halved steps."""
    value, slope = loss(w)
    steps: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    for _ in range(rounds):
        d, kept = -slope, []
        for s, t in zip(reversed(steps), reversed(turns), strict=True):
            a = (s @ d) / (s @ t)
            d = d - a * t
            kept.append(a)
        if steps:
            d = d * ((steps[-1] @ turns[-1]) / (turns[-1] @ turns[-1]))
        else:
            d = d / max(1.0, float(np.abs(slope).sum()))
        for s, t, a in zip(steps, turns, reversed(kept), strict=True):
            d = d + (a - (t @ d) / (s @ t)) * s
        size, down = 1.0, float(slope @ d)
        while size > 1e-8:
            new, new_slope = loss(w + size * d)
            if new <= value + 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        step, turn = size * d, new_slope - slope
        if step @ turn > 1e-12:
            steps, turns = [*steps, step][-memory:], [*turns, turn][-memory:]
        done = value - new < 1e-5 * abs(value)
        w, value, slope = w + step, new, new_slope
        if done:
            break
    return w


def _bounded(batches: Iterator[pa.RecordBatch], most_windows: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, toxic) with what fitting takes of each text: all of it up to ``most_windows`` windows, else so many
    windows, evenly spaced. Words beyond LONGEST_WORD bytes lose what is beyond."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        texts = []
        for lo, hi in slices(offsets):
            _, begin, end, first = words(data, offsets[lo : hi + 1], ALNUM)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                at = np.arange(a, b)
                n = max(round((b - a) / WINDOW), 1)
                if n > most_windows:
                    window = (at - a) * n // (b - a)
                    at = at[np.isin(window, np.linspace(0, n - 1, most_windows).astype(np.int64))]
                texts.append(b" ".join(data[x : min(y, x + LONGEST_WORD)].tobytes() for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)).decode("utf-8", "ignore"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2)], names=["doc_id", "text", "toxic"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    weights, bias = fit(table["text"], table["toxic"].to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, most_windows: int = MOST_WINDOWS) -> tuple[np.ndarray, float]:
    """Fits on documents whose id ``usable`` allows (a condition on doc_id).

    ``labels``: doc_id, toxic (0 or 1; null: none). Rows of one id: toxic if one says so. An id without a document, or a
    document without words, adds nothing but its share.
    """
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    order = [F.xxhash64(F.col("doc_id"), F.lit("fit")), F.col("doc_id")]
    sample = known.filter("toxic > 0").orderBy(*order).limit(most_toxic).unionByName(known.filter("toxic <= 0").orderBy(*order).limit(most_clean))
    # At most most_toxic + most_clean rows of two numbers are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "__id")), F.col("doc_id") == F.col("__id"))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("toxic") > 0, 1).otherwise(0).cast("long").alias("toxic"))
    rows = rows.mapInArrow(lambda batches: _bounded(batches, most_windows), rows.schema)
    model = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("text", "toxic").mapInArrow(_fitted, T.StructType([T.StructField("weights", T.BinaryType()), T.StructField("bias", T.DoubleType())])).collect()
    if not model:
        return np.zeros(1 << BITS), 0.0
    return np.frombuffer(model[0][0], "<f4"), float(model[0][1])


def score(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, 0 to 1, higher if more likely toxic. A text without words, or null, scores by the bias alone."""
    docs = docs.drop(out_col)
    at, names = docs.columns.index(text_col), [*docs.columns, out_col]
    used = np.flatnonzero(weights)
    kept = weights[used].astype(np.float32)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << BITS)
        full[used] = kept
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            scores = np.empty(batch.num_rows)
            for lo, hi in slices(offsets):
                x = Windows(data, offsets[lo : hi + 1])
                scores[lo:hi] = _sigmoid(np.maximum.reduceat(x.margins(full), x.first[:-1]) + bias)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=names)

    return docs.mapInArrow(of, T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))
