"""Toxicity: linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are n-grams of characters (3 to 5 code points, A-Z lowered; known by a 64-bit hash) that a text
holds at all; a text's length does not thin them out. Each is scaled by the log ratio of its smoothed frequencies in toxic and
clean texts, and a logistic regression is fitted on the scaled features. The classifier is fitted
on a bounded sample of labelled rows (``per_class`` of each class, by hash order of their ids);
n-grams are counted in Spark. Scoring is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.llm import words as W
from citeharbor.llm.runs import give_back
from citeharbor.sources.stages import cut

ORDERS = (3, 4, 5)
PER_CLASS = 4_000  # labelled rows of each class that the fit reads at most
FEATURES = 20_000  # n-grams of the classifier at most
MIN_TEXTS = 4  # sampled texts that hold an n-gram, for it to be a feature
TABLE_BITS = 22
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A mixed number for each code point of UTF-8 ``data``, and ``offsets`` counted in code points."""
    points = np.frombuffer(LOWER[data].tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return W.mix(points + np.uint64(1)), before[offsets]


def grams(marks: np.ndarray) -> dict[int, np.ndarray]:
    """By order, the hash of that many code points from each place; each order continues the one before."""
    found, hashes = {}, marks
    for order in range(2, ORDERS[-1] + 1):
        hashes = hashes[:len(marks) - order + 1] * W.BASE + marks[order - 1:] if len(marks) >= order else marks[:0]
        if order in ORDERS:
            found[order] = hashes
    return found


def key(gram: str) -> int:
    """The hash that stands for an n-gram."""
    data = np.frombuffer(gram.encode(), dtype=np.uint8)
    return int(grams(characters(data, np.array([0, len(data)]))[0])[len(gram)][0])


def _slot(packed: np.ndarray) -> np.ndarray:
    return ((packed * SPREAD) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Model:
    """N-grams in ascending order, their weights (regression times log ratio), and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self._marked = None

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and feature number of every feature that a text of the chunk holds, once each."""
        if self._marked is None:
            self._marked = np.zeros(1 << TABLE_BITS, dtype=bool)
            self._marked[_slot(self.keys)] = True
        hits = []
        marks, offsets = characters(data, offsets)
        for order, packed in grams(marks).items():
            at = np.flatnonzero(self._marked[_slot(packed)])
            row = np.searchsorted(offsets, at, side="right") - 1
            whole = at + order <= offsets[row + 1]  # not over the end of a text
            at, row, values = at[whole], row[whole], packed[at[whole]]
            place = np.minimum(np.searchsorted(self.keys, values), len(self.keys) - 1)
            same = self.keys[place] == values
            hits.append(row[same] * len(self.keys) + place[same])
        unique = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
        return unique // len(self.keys), unique % len(self.keys)

    def scores(self, texts: pa.Array) -> np.ndarray:
        sums = np.full(len(texts), self.bias)
        if len(self.keys):
            for first, rows, data, offsets in W.spans(texts):
                row, feature = self.found(data, offsets)
                sums[first:first + rows] += np.bincount(row, self.weights[feature], minlength=rows)
        return 1.0 / (1.0 + np.exp(-np.clip(sums, -30, 30)))


def _text_grams(batches):
    """Distinct n-grams of the sampled texts, with the number of texts of each class."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for first, rows, data, offsets in W.spans(batch.column(1)):
            marks, places = characters(data, offsets)
            parts = {0: [], 1: []}
            for row in range(rows):
                piece = marks[places[row]:places[row + 1]]
                parts[int(toxic[first + row])].append(np.unique(np.concatenate(list(grams(piece).values()))))
            for label, found in parts.items():
                if found:
                    keys, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(n if label else n * 0, pa.int64()),
                         pa.array(n * 0 if label else n, pa.int64())], ["gram", "toxic", "clean"])


def _features(model: Model):
    def run(batches):
        for batch in batches:
            toxic = batch.column(0)
            for first, rows, data, offsets in W.spans(batch.column(1)):
                row, feature = model.found(data, offsets)
                cuts = np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [toxic.slice(first, rows),
                     pa.ListArray.from_arrays(pa.array(cuts), pa.array(feature.astype(np.int32)))],
                    ["toxic", "features"])
    return run


def fit_logistic(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, ratios: np.ndarray,
                 penalty: float = 1e-4, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of L2-penalised logistic regression on present features times ratios.

    Accelerated gradient steps on sparse rows; both classes weigh the same.
    """
    n, width = len(labels), len(ratios)
    per_class = np.bincount(labels, minlength=2).clip(1)
    share = (0.5 / per_class)[labels]
    squares = np.bincount(rows, ratios[features] ** 2, minlength=n) + 1
    step = 4.0 / (squares * share).sum() if n else 1.0
    w = np.zeros(width)
    bias, w_ahead, bias_ahead, momentum = 0.0, w.copy(), 0.0, 1.0
    for _ in range(steps):
        z = np.bincount(rows, (w_ahead * ratios)[features], minlength=n) + bias_ahead
        error = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        slope = np.bincount(features, error[rows], minlength=width) * ratios + penalty * w_ahead
        w_new, bias_new = w_ahead - step * slope, bias_ahead - step * error.sum()
        grown = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        pull = (momentum - 1) / grown
        w_ahead, bias_ahead = w_new + pull * (w_new - w), bias_new + pull * (bias_new - bias)
        w, bias, momentum = w_new, bias_new, grown
    return w, bias


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may read: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(labels: DataFrame, per_class: int) -> DataFrame:
    """``doc_id, toxic`` of at most ``per_class`` labelled ids of each class, none held out.

    Ids with labels of both kinds are left out; NULL ids and labels too.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high"))
    rows = rows.filter("toxic = high").select("doc_id", "toxic")
    order = F.xxhash64("doc_id")
    return rows.filter("toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(
        rows.filter("toxic = 0").orderBy(order, "doc_id").limit(per_class))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """A classifier from labelled rows that are not held out. Without both classes in the labels it
    has no features and scores 0.5 or, with clean rows only or no labels at all, just below."""
    chosen = cut(sample(labels, per_class))  # at most 2 * per_class rows of two numbers
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    texts = cut(narrow.join(F.broadcast(chosen), "doc_id").select("toxic", "text").repartition(
        max(1, 2 * docs.sparkSession.sparkContext.defaultParallelism)))
    n = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        empty = np.zeros(0)
        return Model(empty.astype(np.uint64), empty, 0.0 if n.get(1) else -1.0)
    counts = texts.mapInArrow(_text_grams, "gram long, toxic long, clean long").groupBy("gram").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 1) / (n[1] + 2)) - F.log((F.col("clean") + 1) / (n[0] + 2))
    worth = F.abs(ratio) * F.sqrt(F.col("toxic") + F.col("clean"))
    best = (counts.filter(F.col("toxic") + F.col("clean") >= MIN_TEXTS)
            .select("gram", ratio.alias("ratio"), worth.alias("worth"))
            .orderBy(F.desc("worth"), "gram").limit(features).select("gram", "ratio").toArrow())
    keys = best["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, ratios = keys[order], best["ratio"].to_numpy()[order]
    probe = Model(keys, ratios, 0.0)
    if not len(keys):
        return Model(keys, ratios, -1.0)
    found = texts.mapInArrow(_features(probe), "toxic int, features array<int>").toArrow()
    lists = found["features"].combine_chunks()
    rows = np.repeat(np.arange(len(found)), np.diff(lists.offsets.to_numpy()))
    weights, bias = fit_logistic(rows, lists.values.to_numpy(), found["toxic"].to_numpy(), ratios)
    return Model(keys, weights * ratios, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity``, 0 to 1; a NULL or empty text scores as a text without features.

    A column ``toxicity`` of ``docs`` is replaced. Rows are scored one by one, repeated ones alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES n-grams

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        scores = pa.array(shared.value.scores(texts))
        give_back()
        return scores

    return docs.withColumn("toxicity", scored(F.coalesce(F.col("text"), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
             features: int = FEATURES) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Scores depend on the text alone. A NULL doc_id is never labelled and not held out. Extra columns
    of either table are ignored.
    """
    model = fit(docs, labels, per_class, features)
    rows = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
                       (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
