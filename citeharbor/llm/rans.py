"""Token ids in a compact file format: static range asymmetric numeral systems (rANS).

A folder holds two Parquet tables, so writes are committed by Spark and any file system serves.

``table``: ``id, frequency``. One frequency table for the whole folder; frequencies add up to
2^``SCALE_BITS``.

``blocks``: one row for each block of whole documents, in ascending doc_id order: ``part`` (range
partition), ``first`` (ids of the part before the block), ``doc_ids`` and ``lengths`` of its
documents, ``n`` ids, ``words`` (the coded 32-bit words, little endian), ``states`` and ``offsets``
(the checkpoints), ``checksum`` (CRC-32 of the ids as little-endian unsigned 32-bit integers).
Id i of a block belongs to lane i modulo ``LANES``; each lane is a coder of its own, all lanes share
the words. Every ``STEPS`` steps a checkpoint holds the lanes' states and the place in the words:
decoding can begin at any of them, and all of them are decoded side by side.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeharbor.sources.stages import cut, shared_folder

SCALE_BITS = 20
LANES = 16
STEPS = 512
BLOCK_IDS = 65_536  # a block is closed when it holds so many; documents are not divided
GROUP_BLOCKS = 64  # blocks coded side by side
PART_IDS = 1 << 23  # ids of a range partition, about
LOWEST = np.uint64(1 << 31)
HALF = np.uint64(32)
BLOCK = ("part int, first long, doc_ids array<long>, lengths array<long>, n long, words binary, "
         "states binary, offsets array<int>, checksum long")


# --- tokens -------------------------------------------------------------------------

def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: What a tokenizer must be made of for its words to be encoded one by one (fixed values).
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@functools.cache
def marked_when_normalized() -> str:
    """Characters that hold a combining mark once they are normalised and lower-cased."""
    return "".join(c for c in map(chr, range(0x80, 0x110000)) if any(
        unicodedata.category(x)[0] == "M" for x in unicodedata.normalize("NFC", c).lower()))


class Tokens:
    """The tokenizer's ids of whole texts, each distinct word encoded once.

    White space ends every word of this kind of tokenizer, a letter before an ASCII punctuation
    mark does too, and capitals do not count. Texts with ``<|`` or with characters that have
    combining marks after normalisation, where this need not hold, are encoded whole. So are all
    texts if the tokenizer is not of this kind.
    """

    BORDER = r"(\pL)([!-/:-@\[-`{-~])"
    KEPT = 500_000  # words remembered between batches

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.by_words = self._by_words()
        self.whole = r"<\||[\pM" + "".join(f"\\x{{{ord(c):x}}}" for c in marked_when_normalized()
                                         if unicodedata.category(c)[0] != "M") + "]"

    def _by_words(self) -> bool:
        made = json.loads(self.tokenizer.to_str())
        steps = [(made["normalizer"] or {}).get("normalizers") or [], (made["pre_tokenizer"] or {}).get("pretokenizers") or []]
        return (made["model"].get("end_of_word_suffix") == "</w>"
                and [x["type"] for x in steps[0]] == WORD_NORMALIZERS
                and [x["type"] for x in steps[1]] == ["Split", "ByteLevel"]
                and steps[1][0]["pattern"].get("Regex") == WORD_PATTERN)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 5000):
            found = self.tokenizer.encode_batch_fast(texts[at:at + 5000], add_special_tokens=False)
            out += [np.array(e.ids, dtype="<u4").tobytes() for e in found]
        return out

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words. Words of letters go many to a text: each ends with its own mark."""
        letters = [w for w in words if w.isalpha()]
        known = {}
        groups = [letters[at:at + 100] for at in range(0, len(letters), 100)]
        for at in range(0, len(groups), 100):
            part = groups[at:at + 100]
            for group, raw in zip(part, self._encode([" ".join(g) for g in part])):
                ends = 4 * (np.flatnonzero(self.ends_word[np.frombuffer(raw, "<u4")]) + 1)
                if len(ends) == len(group):  # else a letter stands for several characters
                    ends = ends.tolist()
                    known.update(zip(group, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        rest = [w for w in words if w not in known]
        known.update(zip(rest, self._encode(rest)))
        return known

    def batch(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        if not self.by_words:
            return self._encode(texts.to_pylist())
        out: list[bytes] = [b""] * len(texts)
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~whole)
        for at, ids in zip(np.flatnonzero(whole), self._encode(texts.take(pa.array(np.flatnonzero(whole))).to_pylist())):
            out[at] = ids
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(
            pc.ascii_lower(texts.take(pa.array(rest))), self.BORDER, r"\1 \2"))
        offsets = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        names = words.dictionary.to_pylist()
        if len(self.known) > self.KEPT:
            self.known = {w: self.known[w] for w in names if w in self.known}
        self.known.update(self._words([w for w in names if w not in self.known]))
        found = [self.known[w] for w in names]
        sizes = np.array([len(b) // 4 for b in found], dtype=np.int64)
        starts = np.append(0, np.cumsum(sizes))
        flat = np.frombuffer(b"".join(found), dtype="<u4")
        index = words.indices.to_numpy().astype(np.int64)
        counts = sizes[index]
        ends = np.append(0, np.cumsum(counts))
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - starts[index], counts)
        ids = flat[place]
        base = offsets[0] if len(offsets) else 0
        for k, at in enumerate(rest):
            out[at] = ids[ends[offsets[k] - base]:ends[offsets[k + 1] - base]].tobytes()
        return out


@functools.cache
def _loaded(path: str) -> Tokens:
    """One tokenizer for each worker process."""
    return Tokens(path)


def tokens(docs: DataFrame, end_id: int, path: str | None = None) -> DataFrame:
    """``doc_id, n, ids`` (Zstandard of 32-bit ids, ``end_id`` last) for each row; no shuffle."""
    path = path or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                coder = _loaded(path)
                found = [ids + end for ids in coder.batch(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) // 4 for x in found], pa.int64()),
                     pa.array([_packed(x) for x in found], pa.binary())], ["doc_id", "n", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n long, ids binary")


def _packed(ids: bytes) -> bytes:
    """Zstandard of the two low and the two high bytes of the ids, kept apart."""
    halves = np.frombuffer(ids, dtype="<u2").reshape(-1, 2)
    return pa.compress(halves.T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype="<u2").reshape(2, -1).T).view("<u4").ravel()


# --- frequencies ---------------------------------------------------------------------

def frequencies(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Counts scaled to add up to 2^``bits``; a symbol that occurs keeps at least 1."""
    counts = np.asarray(counts, dtype=np.float64)
    total, goal = counts.sum(), 1 << bits
    if (counts > 0).sum() > goal:
        raise ValueError("more symbols than the table has places")
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    scaled = np.where(counts > 0, np.maximum(1, np.floor(counts * goal / total)), 0).astype(np.int64)
    rest = goal - int(scaled.sum())
    for at in np.argsort(-counts, kind="stable"):  # the commonest symbols take up the rounding
        change = rest if rest > 0 else max(rest, 1 - int(scaled[at]))
        scaled[at] += change
        rest -= change
        if not rest:
            break
    return scaled


class Coder:
    """Codes symbols 0 to n - 1 with one static frequency table."""

    def __init__(self, scaled: np.ndarray, bits: int = SCALE_BITS):
        self.bits = np.uint64(bits)
        self.freq = scaled.astype(np.uint64)
        self.cum = (np.cumsum(scaled) - scaled).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(scaled)), scaled).astype(np.uint32)
        self.limit = self.freq << np.uint64(63 - bits)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Words, checkpoint states and checkpoint offsets of each block, all coded side by side."""
        sizes = np.array([len(b) for b in blocks])
        steps = int(-(-sizes.max(initial=0) // LANES))
        symbols = np.zeros((len(blocks), steps * LANES), dtype=np.int64)
        for k, block in enumerate(blocks):
            symbols[k, :len(block)] = block
        symbols = np.ascontiguousarray(symbols.reshape(len(blocks), steps, LANES).transpose(1, 0, 2))
        lane = np.arange(LANES)
        state = np.full((len(blocks), LANES), LOWEST)
        words = np.zeros((steps, len(blocks), LANES), dtype=np.uint32)
        sent = np.zeros((steps, len(blocks), LANES), dtype=bool)
        points = []
        for step in range(steps - 1, -1, -1):
            live = step * LANES + lane[None, :] < sizes[:, None]
            s = symbols[step]
            f = np.where(live, self.freq[s], np.uint64(1))
            full = live & (state >= self.limit[s])
            words[step] = state & np.uint64(0xFFFFFFFF)
            sent[step] = full
            state = np.where(full, state >> HALF, state)
            quotient = state // f
            coded = (quotient << self.bits) + (state - quotient * f) + self.cum[s]
            state = np.where(live, coded, state)
            if step % STEPS == 0:
                points.append(state)
        points = points[::-1]
        out = []
        for k, size in enumerate(sizes):
            used = -(-int(size) // (LANES * STEPS))
            flags = sent[:, k, :]
            per_step = np.append(0, np.cumsum(flags.sum(axis=1)))
            offsets = per_step[np.arange(used) * STEPS].astype(np.int32)
            states = np.array([p[k] for p in points[:used]], dtype="<u8").reshape(used, LANES)
            out.append((words[:, k, :][flags].astype("<u4"), states, offsets))
        return out

    def decode(self, blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Symbols of blocks given as (n, words, states, offsets); all checkpoints side by side."""
        per_point = LANES * STEPS
        stream = np.concatenate([w for _, w, _, _ in blocks] + [np.zeros(LANES, dtype="<u4")]).astype(np.uint64)
        base = np.cumsum([0] + [len(w) for _, w, _, _ in blocks])
        at = np.concatenate([o + b for (_, _, _, o), b in zip(blocks, base)]).astype(np.int64)
        state = np.concatenate([s for _, _, s, _ in blocks]).astype(np.uint64).reshape(-1, LANES)
        sizes = np.concatenate([np.minimum(n - np.arange(len(o)) * per_point, per_point) for n, _, _, o in blocks])
        steps = int(-(-sizes.max(initial=0) // LANES))
        out = np.zeros((len(sizes), steps, LANES), dtype=np.uint32)
        lane = np.arange(LANES)
        mask = np.uint64((1 << int(self.bits)) - 1)
        for step in range(steps):
            live = step * LANES + lane[None, :] < sizes[:, None]
            slot = state & mask
            s = self.symbol[slot]
            out[:, step] = s
            coded = self.freq[s] * (state >> self.bits) + slot - self.cum[s]
            state = np.where(live, coded, state)
            empty = live & (state < LOWEST)
            place = at[:, None] + np.cumsum(empty, axis=1) - 1
            word = stream[np.where(empty, place, 0)]
            state = np.where(empty, (state << HALF) | word, state)
            at = at + empty.sum(axis=1)
        flat = out.reshape(len(sizes), -1)
        parts = [flat[k, :n] for k, n in enumerate(sizes)]
        ends = np.cumsum([len(o) for _, _, _, o in blocks])
        return [np.concatenate(parts[e - len(b[3]):e]) if len(b[3]) else np.zeros(0, np.uint32)
                for e, b in zip(ends, blocks)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


# --- files ---------------------------------------------------------------------------

def _grouped(batches):
    """Blocks of whole documents of a sorted partition, a bounded number at a time.

    A block that one long document makes large is coded on its own.
    """
    group, ids, doc_ids, size, part = [], [], [], 0, 0
    for batch in batches:
        for p, doc_id, n, packed in zip(*(c.to_pylist() for c in batch.columns)):
            part = p
            ids.append(_unpacked(packed, n))
            doc_ids.append(doc_id)
            size += n
            if size >= BLOCK_IDS:
                if group and size > 2 * BLOCK_IDS:
                    yield part, group
                    group = []
                group.append((doc_ids, ids))
                if len(group) == GROUP_BLOCKS or size > 2 * BLOCK_IDS:
                    yield part, group
                    group = []
                ids, doc_ids, size = [], [], 0
    if ids:
        group.append((doc_ids, ids))
    if group:
        yield part, group


def _write(places, coder):
    def run(batches):
        first = 0
        for part, group in _grouped(batches):
            joined = [np.concatenate(ids) for _, ids in group]
            symbols = [np.searchsorted(places.value, x) for x in joined]
            columns = {c.split()[0]: [] for c in BLOCK.split(", ")}
            for (doc_ids, ids), raw, (words, states, offsets) in zip(group, joined, coder.value.encode(symbols)):
                for name, value in (("part", part), ("first", first), ("doc_ids", doc_ids),
                                    ("lengths", [len(x) for x in ids]), ("n", len(raw)), ("words", words.tobytes()),
                                    ("states", states.tobytes()), ("offsets", offsets.tolist()),
                                    ("checksum", checksum(raw))):
                    columns[name].append(value)
                first += len(raw)
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(),
                     pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(columns.values(), kinds)], list(columns))
    return run


def _counts(batches):
    totals = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for n, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            more = np.bincount(_unpacked(packed, n))
            if len(more) > len(totals):
                totals = np.append(totals, np.zeros(len(more) - len(totals), dtype=np.int64))
            totals[:len(more)] += more
    used = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(totals[used])], ["id", "n"])


def write(encoded: DataFrame, folder: str) -> None:
    """Write token rows (``doc_id, n, ids`` as of :func:`tokens`) to a new folder.

    Range partitions hold ascending doc_ids (NULL first); rows that repeat a doc_id follow each
    other in the order of their ids' hash. Counts cover all rows. An empty table gives empty tables.
    """
    spark = encoded.sparkSession
    rows = cut(encoded)
    counts = rows.select("n", "ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(
        F.sum("n").alias("n")).orderBy("id").toArrow()  # as many rows as the vocabulary has ids
    ids, seen = counts["id"].to_numpy(), counts["n"].to_numpy()
    scaled = frequencies(seen)
    spark.createDataFrame(
        pa.table({"id": pa.array(ids, pa.int64()), "frequency": pa.array(scaled, pa.int64())})
    ).coalesce(1).write.parquet(f"{folder}/table")
    context = spark.sparkContext
    places, coder = context.broadcast(ids.astype(np.uint32)), context.broadcast(Coder(scaled))
    parts = max(context.defaultParallelism, int(seen.sum()) // PART_IDS + 1)
    ordered = (
        rows.select("doc_id", "n", "ids").repartitionByRange(parts, "doc_id", F.xxhash64("ids"))
        .sortWithinPartitions("doc_id", F.xxhash64("ids"))
        .select(F.spark_partition_id().alias("part"), "doc_id", "n", "ids"))
    ordered.mapInArrow(_write(places, coder), BLOCK).write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of each document in a folder; blocks are decoded wherever they lie.

    A block whose ids do not give its checksum raises an error.
    """
    table = spark.read.parquet(f"{folder}/table").orderBy("id").toArrow()
    ids = spark.sparkContext.broadcast(table["id"].to_numpy().astype(np.uint32))
    coder = spark.sparkContext.broadcast(Coder(table["frequency"].to_numpy()))
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_BLOCKS):
                yield from _documents(batch.slice(at, GROUP_BLOCKS).to_pylist(), ids.value, coder.value)

    found = blocks.mapInArrow(run, "part int, doc_id long, start long, ids binary")
    ends = blocks.groupBy("part").agg(F.max(F.col("first") + F.col("n")).alias("size"))
    # One row for each range partition, of about PART_IDS ids.
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = cut(ends.select("part", F.coalesce(before, F.lit(0)).alias("before")))
    return found.join(F.broadcast(shift), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "ids")


def _documents(rows, ids, coder):
    packed = [(r["n"], np.frombuffer(r["words"], "<u4"), np.frombuffer(r["states"], "<u8"),
               np.array(r["offsets"], dtype=np.int64)) for r in rows]
    for row, symbols in zip(rows, coder.decode(packed)):
        values = ids[symbols].astype("<u4")
        if checksum(values) != row["checksum"]:
            raise ValueError(f"block at {row['first']} of part {row['part']} is damaged")
        ends = np.cumsum(row["lengths"])
        starts = ends - row["lengths"]
        raw = [values[a:b].tobytes() for a, b in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["part"]] * len(ends), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
             pa.array(starts + row["first"], pa.int64()), pa.array(raw, pa.binary())],
            ["part", "doc_id", "start", "ids"])


def write_texts(docs: DataFrame, end_id: int = 1, tokenizer: str | None = None, folder: str | None = None) -> str:
    """Encode the texts of ``docs`` (doc_id, text; NULL: empty) and write them; the folder's path.

    Each document ends with ``end_id``. Without a folder, a new one in the shared folder is used.
    Extra columns are ignored.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(tokens(docs, end_id, tokenizer), folder)
    return folder
