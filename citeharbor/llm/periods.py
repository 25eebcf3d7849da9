"""Runs of repeated word sequences in texts, found online with one match length for each active lag.

A run of period q is a maximal stretch of words in which words q apart are identical, at least
``LEAST`` words and ``TIMES`` periods long, with no smaller period. Seen on the diagonal of lag q it
is a chain of matches: word i equals word i - q. The words of a text are read in order:

* Every active lag whose word matches again gets one longer; a lag that does not match ends, and if
  its chain is long enough, its run is emitted at once.
* The earlier occurrences of the word make new lags active. An occurrence counts as one in context:
  the window of 8, 16, 32, ... words that ends there equals the one that ends here. For each window
  length only the nearest occurrence, and only a lag between half the window and the window, can be
  the period of a run: a run of period q is at least 3q long, so some window of q to 2q words lies in
  it twice, and nothing of that length lies in it at a smaller distance. The chain of a new lag is
  followed back to its first match before it is carried on.

So a position has few active lags, also in a text of one word. Texts in which no window of
``LONGEST_SEED`` words occurs twice have no run (a chain has max(24 - q, 2q) >= 16 matches); hashes of
all windows of many texts tell these apart first. Rows are handled on their own, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeharbor.llm.words import Chunk, chunks, mix, rolling

LEAST = 24
TIMES = 3
SEED = 8  # least window, and greatest period of its scale
LONGEST_SEED = 16
BASE = 0xD6E8FEB86659FD93
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def needed(lag: int) -> int:
    """Matches on the diagonal of a lag that make a run."""
    return max(LEAST - lag, (TIMES - 1) * lag)


def _suspects(chunk: Chunk) -> np.ndarray:
    """For each row of the chunk, whether some window of ``LONGEST_SEED`` words occurs twice in it."""
    out = np.zeros(chunk.rows, dtype=bool)
    counts = chunk.counts()
    windows = np.maximum(counts - LONGEST_SEED + 1, 0)
    windows[counts < LEAST] = 0
    if not windows.any():
        return out
    row = np.repeat(np.arange(chunk.rows), windows)
    starts = np.repeat(chunk.bounds[:-1] - np.append(0, np.cumsum(windows))[:-1], windows) + np.arange(len(row))
    keys = mix(rolling(chunk.hashes(), starts, starts + LONGEST_SEED, BASE)
               + row.astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out[row[order[1:][same]]] = True
    return out


def _openings(words: np.ndarray) -> list[tuple[int, int]]:
    """(position, lag) in ascending order: where a lag becomes the nearest occurrence of a window."""
    n, size, found = len(words), SEED, []
    values = mix(words.astype(np.uint64) + np.uint64(1))
    while size < n and TIMES * (size // 2 + 1 if size > SEED else 1) <= n:
        starts = np.arange(n - size + 1)
        keys = rolling(values, starts, starts + size, BASE)
        order = np.lexsort((starts, keys))
        same = keys[order[1:]] == keys[order[:-1]]
        if not same.any():
            break
        lags = np.zeros(len(starts), dtype=np.int64)
        lags[order[1:][same]] = (order[1:] - order[:-1])[same]
        lags[(lags > size) | ((lags <= size // 2) & (size > SEED))] = 0
        new = np.flatnonzero((lags > 0) & (lags != np.append(0, lags[:-1])))
        found += zip((new + size - 1).tolist(), lags[new].tolist())
        size *= 2
    return sorted(found)


def find_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of word numbers, by start, then period."""
    openings = _openings(np.array(words, dtype=np.int64))
    active: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}

    def close(lag: int, matches: int, end: int) -> None:
        if matches >= needed(lag):
            place = end - matches - lag, end
            found[place] = min(lag, found.get(place, lag))

    n, at, i = len(words), 0, 0
    while at < len(openings) or active:
        if not active:
            i = openings[at][0]
        elif i == n:
            for lag, matches in active.items():
                close(lag, matches, n)
            break
        word = words[i]
        for lag in list(active):
            if words[i - lag] == word:
                active[lag] += 1
            else:
                close(lag, active.pop(lag), i)
        while at < len(openings) and openings[at][0] == i:
            lag = openings[at][1]
            if lag not in active:
                first = i
                while first >= lag and words[first] == words[first - lag]:
                    first -= 1
                if first < i:
                    active[lag] = i - first
            at += 1
        i += 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length by period; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]


def _row(raw: bytes, suspect: bool):
    words = raw.split()  # the white space of bytes: space and 0x09-0x0D
    if not suspect:
        return len(words), [], None, b" ".join(words)
    numbers: dict[bytes, int] = {}
    runs = find_runs([numbers.setdefault(w, len(numbers)) for w in words])
    return len(words), runs, strongest(runs), b" ".join(collapse(words, runs) if runs else words)


def _found(batches):
    names = ["start", "length", "period"]
    kind = pa.struct([(x, pa.int64()) for x in names])
    for batch in batches:
        row = 0
        for chunk in chunks(batch.column(1)):
            suspects = _suspects(chunk)
            out = [_row(raw, s) for raw, s in zip(chunk.texts(), suspects.tolist())]
            count, runs, best, texts = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, chunk.rows), pa.array(count, pa.int64()),
                 pa.array([[dict(zip(names, r)) for r in x] for x in runs], pa.list_(kind)),
                 pa.array([b and dict(zip(names, b)) for b in best], kind), pa.array(texts, pa.string())],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"])
            row += chunk.rows


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, strongest, collapsed`` for each row of ``docs`` (doc_id, text).

    ``runs`` lists start (word number from 0), length and period by start, then period; ``strongest``
    is the run with the most repetitions, NULL without any; ``collapsed`` holds the words, joined by
    one space, without those in a run after its first period. NULL and blank texts have no words and
    no runs; repeated rows and NULL ids are rows of their own; other columns are ignored.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(
        _found, f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")


# --- the registered query --------------------------------------------------------------

def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of the query's contract: in a tenth of the documents, by the checksum of the id, the words
    from some place on repeat a passage of the text. Built-in functions only."""
    rewritten = r"""
      transform(array(filter(split(text, '[ \\x09-\\x0D]+'), x -> x <> '')), w -> if(size(w) = 0, '',
        array_join(transform(sequence(0, size(w) - 1), i -> w[cast(
          if(i < g % size(w), i, g % size(w) + (i - g % size(w)) % (1 + (size(w) - g % size(w)) div (3 + g % 8)))
          as int)]), ' ')))[0]"""
    marked = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h")).withColumn(
        "g", F.expr("h div 10"))
    return marked.select("doc_id", F.when(F.col("h") % 10 == 0, F.expr(rewritten)).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row of numbers and checksums for each document of :func:`periodic_runs`."""
    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        sha(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"))
