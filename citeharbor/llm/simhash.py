"""Near duplicates by SimHash: byte-position inverted index, shared-byte counts, verification.

Fingerprints of 64 bits link at ``max_bits`` or fewer differing bits. Bits that differ spoil at
most ``max_bits`` of the eight bytes, so linked fingerprints agree on at least ``8 - max_bits``
byte positions. The index holds, for every choice of one position less, the list of fingerprints
with the same bytes there. Within a list the shared positional bytes of each pair are counted: pairs
that share no byte beyond those of the list fall below the guaranteed number and are dropped, the
rest verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.llm.runs import bounds, whole_groups
from citeharbor.operators.components import components
from citeharbor.sources.stages import cut

SEED = 42
LIST_ROWS = 1024  # longer posting lists are compared block against block
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 values of all word shingles, in order; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED)
                     for a, b in zip(starts, ends[shingle - 1:].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes, as a signed number; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for low in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[low:low + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Majority bits of the XXH64 values of all word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit) for each row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def _masks(max_bits: int) -> list[int]:
    guaranteed = 8 - max_bits
    masks = []
    for positions in combinations(range(8), max(guaranteed - 1, min(guaranteed, 1))):
        mask = sum(0xFF << 8 * p for p in positions)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def tally(differing: np.ndarray) -> np.ndarray:
    """Byte positions that each pair shares, given the exclusive or of its fingerprints."""
    return (np.ascontiguousarray(differing).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _forest(values: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links that join what is linked within one list: each member found, to where it was found."""
    left, right = [], []
    rest = np.unique(values)
    while len(rest) > 1:
        root, frontier, rest = rest[0], [rest[0]], rest[1:]
        while frontier and len(rest):
            differing = rest ^ frontier.pop()
            near = tally(differing) >= 8 - max_bits
            near[near] = np.bitwise_count(differing[near]) <= max_bits
            found = rest[near]
            rest = rest[~near]
            left.extend([root] * len(found))
            right.extend(found.tolist())
            frontier.extend(found)
    return left, right


LIST_KEY = ["mask", "key", "low", "high"]


def _links(max_bits: int):
    def run(batches):
        for table in whole_groups(batches, LIST_KEY):
            cuts = bounds(table, LIST_KEY)
            values = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
            sizes = np.diff(cuts)
            first = cuts[:-1][sizes == 2]
            differing = values[first] ^ values[first + 1]
            likely = tally(differing) >= 8 - max_bits
            pairs = first[likely][np.bitwise_count(differing[likely]) <= max_bits]
            left, right = [values[pairs]], [values[pairs + 1]]
            for at in np.flatnonzero(sizes > 2):
                a, b = _forest(values[cuts[at]:cuts[at + 1]], max_bits)
                left.append(np.array(a, dtype=np.uint64))
                right.append(np.array(b, dtype=np.uint64))
            a, b = (np.concatenate(x).view(np.int64) for x in (left, right))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
    return run


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """Edges ``a, b`` among distinct fingerprints ``fp`` that keep every near pair connected.

    A list that n fingerprints share yields at most n - 1 edges, never its pairs. Lists longer
    than ``LIST_ROWS`` are dealt out as pairs of blocks over many tasks: no list is cut short.
    """
    masks = F.explode(F.array(*[F.lit(m).cast("long") for m in _masks(max_bits)]))
    index = distinct.select("fp", masks.alias("mask")).select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared = cut(index.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    lists = index.join(shared, ["mask", "key"])
    blocks = F.ceil(F.col("n") / LIST_ROWS).cast("int")
    dealt = (
        lists.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("mask", "key", F.least("block", "other").alias("low"),
                F.greatest("block", "other").alias("high"), "fp"))
    return (dealt.repartition(*LIST_KEY).sortWithinPartitions(*LIST_KEY)
            .mapInArrow(_links(max_bits), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs`` (columns doc_id, text).

    ``component_id`` is the smallest doc_id that links reach, the row's own included. Texts that
    are NULL or hold no word have fingerprint zero and link like any other. Rows that repeat a
    doc_id stay rows of their own; a NULL doc_id is linked but never named (a component of NULL
    ids has a NULL component_id). Extra columns are ignored.
    """
    prints = cut(fingerprints(docs, shingle))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), max_bits)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    smallest = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(rooted.join(smallest, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component, columns unchanged.

    A component of NULL ids keeps its rows, since none of them can be named. Rows that repeat the
    kept doc_id with the same text all stay.
    """
    found = near_duplicates(docs, shingle, max_bits)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(
        F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
