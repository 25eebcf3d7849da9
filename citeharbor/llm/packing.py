"""Token sequences of fixed capacity without padding: minimum bin slack over remaining lengths.

A document's ids fill whole sequences of their own as far as they reach; what remains, fewer ids
than a sequence holds, is its rest. Only the lengths of rests matter for packing, so the plan is
made from their histogram, which has ``capacity`` - 1 cells whatever the number of documents:

* A sequence begins with the longest length left. A subset-sum search over the other lengths, each
  as often as it is left, runs on a bitset of reachable sums; the best sum is traced back to counts.
  The choice is used as often as the counts allow, then the search goes on with what is left.
* Where no choice fills a sequence, the one with the least slack is taken and the slack is filled
  with the beginning of another rest, whose end goes back into the histogram as a shorter length.
* The last ids, fewer than ``capacity``, go to sequences of powers of two, which need no padding.

Rests of one length are interchangeable. Each gets a rank among its equals, by task and place in the
task, and looks its places up in the plan: one join on (task, length), so no key holds more rows than
one task of the scan does.
"""

from __future__ import annotations

import functools
import json
import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeharbor.llm.words import SPACE, spans
from citeharbor.sources.stages import cut

CAPACITY = 1024
END_ID = 0
SPAN_BYTES = 1 << 22  # texts cut into segments at once
KEPT = 400_000  # segments remembered between batches
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
PIECES_AT_ONCE = 2_000
#: Sequences that one document fills are numbered by task in the bits from here on.
TASK_BITS = 40

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
LATIN = np.zeros(256, dtype=bool)  # second byte of a letter from U+00C0 to U+00FF
LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
SPACE_MARK = "\u0120"  # how byte-level vocabularies write a space
MARK = np.zeros(256, dtype=bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --- tokens -------------------------------------------------------------------------

class Segments:
    """The tokenizer's ids of whole texts, each distinct segment encoded once.

    A byte-level tokenizer without normaliser never lets a token reach over the beginning of white
    space after something else, or over an ASCII mark after an ASCII letter. Texts are cut there.
    Texts with ``<|`` or with white space outside ASCII, and all texts if the tokenizer is of another
    kind, are encoded whole.
    """

    WHOLE = (r"<\||[\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}"
             r"\x{205f}-\x{2064}\x{3000}\x{feff}]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        self.cuts = (made["normalizer"] is None and before.get("type") == "ByteLevel"
                     and before.get("use_regex") is True and not before.get("add_prefix_space"))
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith(SPACE_MARK)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 5000):
            found = self.tokenizer.encode_batch_fast(texts[at:at + 5000], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        return out

    def _learn(self, segments: list[str]) -> None:
        """Remember the ids of new segments. Words that begin with a space go many to a text, since
        a token that begins with a space begins a word."""
        words = [w for w in segments if w[0] == " " and w[1:].isalpha()]
        for at in range(0, len(words), 5000):
            groups = [words[k:k + 50] for k in range(at, min(at + 5000, len(words)), 50)]
            for group, raw in zip(groups, self.encode(["".join(g) for g in groups])):
                firsts = 4 * np.flatnonzero(self.begins[np.frombuffer(raw, "<u4")])
                if len(firsts) == len(group):
                    firsts = [*firsts.tolist(), len(raw)]
                    self.known.update(zip(group, [raw[a:b] for a, b in zip(firsts, firsts[1:])]))
        rest = [w for w in segments if w not in self.known]
        self.known.update(zip(rest, self.encode(rest)))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a NULL text has none."""
        texts = texts.cast(pa.large_string()).fill_null("")
        whole = np.ones(len(texts), dtype=bool)
        if self.cuts and len(texts):
            whole = pc.match_substring_regex(texts, self.WHOLE).to_numpy(zero_copy_only=False)
        out = []
        for _, _, data, offsets in spans(pc.if_else(pa.array(whole), "", texts), SPAN_BYTES):
            out += self._cut(data, offsets)
        for at in np.flatnonzero(whole).tolist():
            out[at] = np.frombuffer(self.encode([texts[at].as_py()])[0], "<u4")
        return out

    def _cut(self, data: np.ndarray, offsets: np.ndarray):
        edge = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            space = SPACE[data]
            letter = LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & LATIN[data[1:]]
            edge[1:-1] = ((space[1:] & ~space[:-1]) | (letter[:-1] & MARK[data[1:]])
                          | ((data[:-1] == 10) & ~space[1:] & ~np.append(True, space[:-2])))
        edge[offsets] = True
        edge[-1] = False
        starts = np.flatnonzero(edge)
        ends = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(
            len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        if len(self.known) > KEPT:
            self.known = {w: self.known[w] for w in names if w in self.known}
        self._learn([w for w in names if w not in self.known])
        found = [self.known[w] for w in names]
        sizes = np.array([len(b) // 4 for b in found], dtype=np.int64)
        begins = np.append(0, np.cumsum(sizes))
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        index = pieces.indices.to_numpy().astype(np.int64)
        counts = sizes[index]
        upto = np.append(0, np.cumsum(counts))
        ids = flat[np.arange(upto[-1]) - np.repeat(upto[:-1] - begins[index], counts)]
        bounds = upto[np.searchsorted(starts, offsets)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield ids[a:b]


@functools.cache
def _loaded(path: str) -> Segments:
    """One tokenizer for each worker process."""
    return Segments(path)


def _packed(ids: np.ndarray) -> bytes:
    """Zstandard of the two low and the two high bytes of the ids, kept apart."""
    return pa.compress(ids.astype("<u4").view("<u2").reshape(-1, 2).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype="<u2").reshape(2, -1).T).view("<u4").ravel()


def _tokens(path: str, capacity: int, end_id: int):
    """Per document: ids of whole sequences and of the rest, with its place among the task's documents."""
    def run(batches):
        task = TaskContext.get().partitionId()
        coder, wholes, ranks = _loaded(path), 0, np.zeros(capacity, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, rest, rank, before, main, tail = [], [], [], [], [], []
                for ids in coder.batch(part.column(1)):
                    ids = np.append(ids, np.uint32(end_id))
                    left = len(ids) % capacity
                    edge = len(ids) - left
                    n.append(len(ids))
                    rest.append(left)
                    rank.append(int(ranks[left]))
                    before.append(wholes)
                    main.append(_packed(ids[:edge]) if edge else None)
                    tail.append(_packed(ids[edge:]) if left else None)
                    ranks[left] += 1
                    wholes += edge // capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(n), pa.int32()), part.column(0), pa.array(n, pa.int64()),
                     pa.array(rest, pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64()),
                     pa.array(main, pa.binary()), pa.array(tail, pa.binary())],
                    ["task", "doc_id", "n", "rest", "rank", "before", "main", "tail"])
    return run


# --- plan ---------------------------------------------------------------------------

def subset(lengths: dict[int, int], target: int) -> tuple[int, dict[int, int]]:
    """The greatest sum up to ``target`` of lengths used at most so often, and the counts that give it.

    Bit s of the set tells that the lengths seen so far reach s. A count is split into 1, 2, 4, ...
    copies, one shift each; the search stops as soon as the target is reached.
    """
    reach, mask, history = 1, (1 << (target + 1)) - 1, []
    for length in sorted((x for x in lengths if x <= target and lengths[x] > 0), reverse=True):
        left, copies = min(lengths[length], target // length), 1
        while left and not reach >> target & 1:
            copies = min(copies, left)
            history.append((length, copies, reach))
            reach = (reach | reach << copies * length) & mask
            left, copies = left - copies, copies * 2
    best = total = reach.bit_length() - 1
    counts: dict[int, int] = defaultdict(int)
    for length, copies, before in reversed(history):
        if not before >> total & 1:
            counts[length] += copies
            total -= copies * length
    return best, dict(counts)


class Plan:
    """Where the rests of each length go, by rank: intervals of ranks, in ascending order.

    An interval of length l holds (first rank, first sequence, rests for each sequence, offset of the
    first one, ids taken, rank of what is left among the rests of the shorter length).
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.left = {x: n for x, n in histogram.items() if n}
        self.next = dict.fromkeys(self.left, 0)  # first rank not yet placed
        self.ranks = dict(self.left)             # ranks given out so far
        self.intervals: dict[int, list[tuple]] = defaultdict(list)
        total = sum(x * n for x, n in self.left.items())
        while total >= capacity:
            total -= capacity * self._fill()
        self._last(total)
        self.firsts = {x: np.array([row[0] for row in rows]) for x, rows in self.intervals.items()}

    def _take(self, length: int, count: int, sequence: int, each: int, offset: int, taken: int) -> None:
        rest, rank = length - taken, 0
        if rest:
            rank = self.ranks.get(rest, 0)
            self.ranks[rest] = rank + count
            self.next.setdefault(rest, 0)
            self.left[rest] = self.left.get(rest, 0) + count
        self.intervals[length].append((self.next[length], sequence, each, offset, taken, rank))
        self.next[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _fill(self) -> int:
        """Fill as many sequences as one choice of lengths can; their number."""
        longest = max(self.left)
        others = dict(self.left)
        others[longest] -= 1
        best, counts = subset(others, self.capacity - longest)
        counts[longest] = counts.get(longest, 0) + 1
        slack = self.capacity - longest - best
        source = None
        if slack:  # every rest that is left over is longer than the slack, else it would have been chosen
            source = max((x for x in self.left if self.left[x] > counts.get(x, 0)),
                         key=lambda x: (self.left[x] - counts.get(x, 0), x))
        times = min(self.left[x] // (n + (x == source)) for x, n in [*counts.items(), (source, counts.get(source, 0))] if x)
        offset = 0
        for length in sorted(counts, reverse=True):
            self._take(length, counts[length] * times, self.sequences, counts[length], offset, length)
            offset += length * counts[length]
        if slack:
            self._take(source, times, self.sequences, 1, offset, slack)
        self.sequences += times
        return times

    def _last(self, total: int) -> None:
        """Fewer ids than a sequence holds: sequences of powers of two, rests cut where those end."""
        for bit in reversed(range(total.bit_length())):
            if not total >> bit & 1:
                continue
            offset, size = 0, 1 << bit
            while offset < size:
                length = max(self.left)
                taken = min(length, size - offset)
                self._take(length, 1, self.sequences, 1, offset, taken)
                offset += taken
            self.sequences += 1

    def places(self, length: int, rank: int):
        """(start, length, sequence, offset) of each piece of a rest, in the order of its ids."""
        start = 0
        while length:
            at = int(np.searchsorted(self.firsts[length], rank, side="right")) - 1
            first, sequence, each, offset, taken, base = self.intervals[length][at]
            number = rank - first
            yield start, taken, sequence + number // each, offset + number % each * taken
            start, length, rank = start + taken, length - taken, base + number


# --- pieces -------------------------------------------------------------------------

def _batches(rows):
    """Arrow batches of a bounded number of pieces."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in PIECE.split(", ")]
    held = []
    for row in rows:
        held.append(row)
        if len(held) == PIECES_AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held), kinds)], names)


def _whole(capacity: int):
    """Sequences that one document fills."""
    def rows(batches):
        for batch in batches:
            for task, doc_id, n, before, packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _unpacked(packed, n - n % capacity)
                for k in range(n // capacity):
                    at = k * capacity
                    yield (doc_id, at, capacity, ids[at:at + capacity].tobytes(), n,
                           ((task + 1) << TASK_BITS) + before + k, 0)

    return lambda batches: _batches(rows(batches))


def _rests(plan, capacity: int):
    """Pieces of rests at the places of the plan."""
    def rows(batches):
        known = plan.value
        for batch in batches:
            for doc_id, n, rest, rank, packed in zip(*(c.to_pylist() for c in batch.columns)):
                ids = _unpacked(packed, rest)
                for start, length, sequence, offset in known.places(rest, rank):
                    yield (doc_id, n - rest + start, length, ids[start:start + length].tobytes(), n,
                           sequence, offset)

    return lambda batches: _batches(rows(batches))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """Pieces of the token ids of ``docs`` (doc_id, text), laid out in sequences of ``capacity`` ids.

    Returns ``doc_id, start, length, ids`` (little-endian 32-bit), ``doc_tokens, sequence_id, offset``
    for each piece. A document's ids end with ``end_id``; each lies in one piece. Every sequence is
    full, but for at most log2(capacity) ones whose sizes are different powers of two. NULL texts are
    empty and hold the end id only; rows with a NULL or repeated doc_id are documents of their own;
    other columns are ignored; an empty table gives no piece. Which rest of several equally long ones
    goes where depends on the partitions of the scan.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = cut(narrow.mapInArrow(
        _tokens(tokenizer or default_tokenizer(), capacity, end_id),
        "task int, doc_id long, n long, rest int, rank long, before long, main binary, tail binary"))
    rests = rows.filter("rest > 0")
    counts = cut(rests.groupBy("task", "rest").agg(F.count(F.lit(1)).alias("n")))
    histogram = counts.groupBy("rest").agg(F.sum("n").alias("n")).collect()  # fewer rows than capacity
    plan = docs.sparkSession.sparkContext.broadcast(Plan({r["rest"]: r["n"] for r in histogram}, capacity))
    earlier = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("task", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    ranked = rests.select("task", "rest", "doc_id", "n", "rank", "tail").join(shift, ["task", "rest"])
    whole = rows.filter(f"n >= {int(capacity)}").select("task", "doc_id", "n", "before", "main")
    return whole.mapInArrow(_whole(capacity), PIECE).unionByName(
        ranked.select("doc_id", "n", "rest", (F.col("rank") + F.col("shift")).alias("rank"), "tail")
        .mapInArrow(_rests(plan, capacity), PIECE))
