"""Repeated passages: rolling hashes of every window of words, counted in Spark.

A window is ``window`` consecutive words of one document. Each word covered by a window whose word
sequence also starts in a document with a smaller doc_id is removed. All windows are hashed
(Rabin-Karp, rolling); which of them have to be counted is found first with anchors: among the
``window - gram + 1`` grams of a window the one with the smallest hash is its anchor. Equal windows
have equal anchors at equal offsets, so a window whose anchor occurs in one text alone cannot
repeat and needs no count. This leaves nothing out and moves one row for about thirteen windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.llm import words as W
from citeharbor.sources.stages import cut

WINDOW, GRAM = 50, 25
WINDOW_BASE = 0xD1B54A32D192ED03
TEXT_KEY = ["k1", "k2"]


class Windows:
    """Windows of a chunk that lie within one text: row, start, hash, anchor's place and hash."""

    def __init__(self, chunk: W.Chunk, window: int, gram: int):
        words = chunk.hashes()
        n = len(words) - window + 1
        self.row = np.repeat(np.arange(chunk.rows), chunk.counts())
        if n < 1:
            empty = np.zeros(0, dtype=np.int64)
            self.at, self.place, self.hash, self.anchor = empty, empty, empty, empty
            return
        grams_at = np.arange(len(words) - gram + 1)
        grams = W.mix(W.rolling(words, grams_at, grams_at + gram, WINDOW_BASE))
        self.at = np.flatnonzero(self.row[:n] == self.row[window - 1:])
        hashes = W.mix(W.rolling(words, self.at, self.at + window, WINDOW_BASE))
        place = sliding_window_view(grams, window - gram + 1).argmin(axis=1)[self.at] + self.at
        self.place, self.hash = place, hashes.view(np.int64)
        self.anchor = grams[place].view(np.int64)
        self.row = self.row[self.at]


def _lists(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list of ``values`` for each of ``n`` rows; ``rows`` is sorted."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _anchors(window: int, gram: int):
    """Distinct anchors of each text that has a window: their hashes and places."""
    def run(batches):
        for batch in batches:
            for chunk in W.chunks(batch.column(2)):
                found = Windows(chunk, window, gram)
                if not len(found.at):
                    continue
                new = np.append(True, found.place[1:] != found.place[:-1])
                rows = found.row[new]
                have, rows = np.unique(rows, return_inverse=True)
                keys = pa.array(have + chunk.first_row)
                local = found.place[new] - chunk.bounds[have[rows]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(keys), batch.column(1).take(keys),
                     _lists(found.anchor[new], rows, len(have), pa.int64()),
                     _lists(local.astype(np.int32), rows, len(have), pa.int32())],
                    ["k1", "k2", "anchors", "places"])
    return run


def _counted(window: int, gram: int):
    """Hashes of the windows that belong to the listed anchors: a row for each text and anchor.

    Windows with one anchor follow each other, so a row holds the first start and the hashes.
    """
    def run(batches):
        for batch in batches:
            first, k1, k2, texts, places = batch.columns
            for chunk in W.chunks(texts):
                found = Windows(chunk, window, gram)
                if not len(found.at):
                    continue
                listed = np.concatenate([
                    places[chunk.first_row + r].values.to_numpy().astype(np.int64) + chunk.bounds[r]
                    for r in range(chunk.rows)])
                keep = np.flatnonzero(np.isin(found.place, listed))
                if not len(keep):
                    continue
                place = found.place[keep]
                begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                rows = found.row[keep[begin]]
                at = pa.array(rows + chunk.first_row)
                group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keep))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.anchor[keep[begin]]), first.take(at), k1.take(at), k2.take(at),
                     pa.array((found.at[keep[begin]] - chunk.bounds[rows]).astype(np.int32)),
                     _lists(found.hash[keep], group, len(begin), pa.int64())],
                    ["anchor", "first", "k1", "k2", "at", "hashes"])
    return run


def intervals(starts: np.ndarray, window: int) -> list[dict]:
    """Maximal runs of words covered by windows at ``starts``; ends are exclusive."""
    if not len(starts):
        return []
    starts = np.sort(starts)
    opens = np.append(True, starts[1:] > starts[:-1] + window)
    begin = starts[opens]
    end = starts[np.append(np.flatnonzero(opens)[1:] - 1, len(starts) - 1)] + window
    return [{"start": int(a), "end": int(b)} for a, b in zip(begin, end)]


def _removed(window: int):
    def run(batches):
        for batch in batches:
            out = {"n_words": [], "n_removed": [], "kept_text": [], "removed": []}
            for text, copy, starts in zip(batch.column("text"), batch.column("copy"), batch.column("starts")):
                pieces = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if copy.as_py() and len(pieces) >= window:
                    spans = [{"start": 0, "end": len(pieces)}]
                elif starts.is_valid:
                    spans = intervals(starts.values.to_numpy().astype(np.int64), window)
                else:
                    spans = []
                kept, at = [], 0
                for span in spans:
                    kept += pieces[at:span["start"]]
                    at = span["end"]
                kept += pieces[at:]
                out["n_words"].append(len(pieces))
                out["n_removed"].append(len(pieces) - len(kept))
                out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                out["removed"].append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()),
                 pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_text"], pa.string()),
                 pa.array(out["removed"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "n_words", "n_removed", "kept_text", "removed"])
    return run


def _text_key() -> list[Column]:
    return [F.xxhash64("text").alias("k1"), F.hash("text").alias("k2")]


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed`` for each row of ``docs``.

    ``removed`` lists the maximal word intervals taken out, ``kept_text`` the words left, joined by
    one space. Windows are judged on the input. A NULL text has no words. Rows with the same text
    are one text of its smallest doc_id: only the others lose its words, all of them (if there is a
    whole window). Rows that repeat a doc_id are not earlier than each other. A row with a NULL
    doc_id neither removes nor loses words. Extra columns are ignored.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = narrow.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", *_text_key(), "text")
    texts = cut(keyed.groupBy(*TEXT_KEY).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))

    anchors = cut(keyed.select(*TEXT_KEY, "text").mapInArrow(
        _anchors(window, gram), "k1 long, k2 int, anchors array<long>, places array<int>"))
    anchors = anchors.select(*TEXT_KEY, F.explode(F.arrays_zip("anchors", "places")).alias("x")).select(
        *TEXT_KEY, F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place"))
    shared = cut(
        anchors.groupBy("anchor").agg(F.min("k1").alias("low"), F.max("k1").alias("high"),
                                      F.min("k2").alias("low2"), F.max("k2").alias("high2"))
        .filter("low < high OR low2 < high2").select("anchor"))
    places = (
        anchors.join(shared, "anchor").groupBy(*TEXT_KEY).agg(F.collect_set("place").alias("places"))
        .join(texts, TEXT_KEY).select("first", *TEXT_KEY, "places"))
    places = cut(places)
    windows = cut(
        keyed.join(places, TEXT_KEY).filter(F.col("doc_id") == F.col("first"))
        .select("first", *TEXT_KEY, "text", "places")
        .mapInArrow(_counted(window, gram),
                    "anchor long, first long, k1 long, k2 int, at int, hashes array<long>"))
    windows = windows.select("*", F.posexplode("hashes").alias("step", "hash")).select(
        "anchor", "hash", "first", *TEXT_KEY, (F.col("at") + F.col("step")).alias("at"))
    earliest = cut(
        windows.groupBy("anchor", "hash").agg(F.min("first").alias("low"), F.max("first").alias("high"))
        .filter("low < high").select("anchor", "hash", "low"))
    starts = (
        windows.join(earliest, ["anchor", "hash"]).filter(F.col("first") > F.col("low"))
        .groupBy(*TEXT_KEY).agg(F.collect_set("at").alias("starts")))
    marked = cut(
        texts.join(starts, TEXT_KEY, "left")
        .filter("starts IS NOT NULL OR first < last").select(*TEXT_KEY, "first", "starts"))
    judged = (
        narrow.select("doc_id", "text", *_text_key()).join(marked, TEXT_KEY, "left")
        .select("doc_id", "text",
                F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy"),
                F.when(F.col("doc_id").isNotNull(), F.col("starts")).alias("starts")))
    return judged.mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, "
                             "kept_text string, removed array<struct<start:int,end:int>>")
