"""Line deduplication: an exact set-similarity join of lines by their words.

A line (split at \\n) with a word is removed if an earlier line, by doc_id and then line number, has
the same set of words or one with Jaccard similarity of ``THRESHOLD`` or more. Equal sets are found
by grouping. The others are joined: the words of a line are ordered by rarity, and lines meet at the
words of their prefixes, which similar lines must share. Length, positional and bitmap bounds drop
pairs that cannot be similar; what is left is verified on the words.

Every line needs one witness, so each keeps its earliest few candidates of a list. The lists of lines
that have more and found no witness are compared once more as a whole, with the words of their lines
at hand, and give each line once: no line is lost and no pairs are written out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.llm import words as W
from citeharbor.llm.runs import whole_groups
from citeharbor.sources.stages import cut

THRESHOLD = (4, 5)  # 0.8
RARITY_BITS = 18
WITNESSES = 4  # candidates of a line that one list gives in the first round
LIST_ROWS = 4096  # longer lists are compared block against block
SHORT_LIST = 64  # lists up to this length are compared many at a time
LONG_LINE = 96  # words from which a line has a bitmap of 256 parities instead of 64
FILTER_BITS = 24  # of the bitmaps of documents and words that are still wanted, 2 MB each
SPAN_BYTES = 1 << 18  # text taken at a time: arrays of 8 bytes for each byte stay below 4 MB, where new pages cost most


@dataclass
class Lines:
    """Lines with words of a run of texts: row, number in the text, key of the word set, its size;
    and the distinct words of all lines, line after line, with the start of each line's words."""

    row: np.ndarray
    number: np.ndarray
    key: np.ndarray
    size: np.ndarray
    words: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, first, rows, data, offsets) -> Lines:
        chunk = W.Chunk(first, rows, data, offsets)
        hashes = chunk.hashes()
        if not len(hashes):
            empty = np.zeros(0, dtype=np.int64)
            return cls(empty, empty, empty, empty, empty.view(np.uint64), empty)
        breaks = np.flatnonzero(data == 10)
        row = np.repeat(np.arange(rows), chunk.counts())
        before = np.cumsum(np.bincount(np.searchsorted(chunk.starts, breaks), minlength=len(hashes)))[:len(hashes)]
        number = before - np.searchsorted(breaks, offsets[:-1])[row]
        new = np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1]))
        line = np.cumsum(new) - 1
        order = _sorted(line, hashes)
        line, words = line[order], hashes[order]
        fresh = np.append(True, (line[1:] != line[:-1]) | (words[1:] != words[:-1]))
        line, words = line[fresh], words[fresh]
        starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        size = np.diff(np.append(starts, len(words)))
        key = W.mix(np.add.reduceat(W.mix(words), starts) + size.astype(np.uint64)).view(np.int64)
        at = np.flatnonzero(new)
        return cls(row[at] + first, number[at], key, size, words, starts)

    def only(self, keep: np.ndarray) -> Lines:
        """Some of the lines."""
        size = self.size[keep]
        return Lines(self.row[keep], self.number[keep], self.key[keep], size,
                     self.words[np.repeat(keep, self.size)], np.cumsum(size) - size)


def _sorted(line: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Order by line, then hash; one sort of line number and leading hash bits where they fit."""
    bits = max(int(line[-1]).bit_length(), 1)
    if bits > 24:
        return np.lexsort((hashes, line))
    return np.argsort((line.astype(np.uint64) << np.uint64(64 - bits)) | (hashes >> np.uint64(bits)))


def _by_rarity(line: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order by line, then rank, then as given (by hash)."""
    key = (line.astype(np.uint64) << np.uint64(40)) | (rank.astype(np.uint64) << np.uint64(32))
    if int(line[-1]) >= 1 << 24 or len(line) >= 1 << 32:
        return np.lexsort((rank, line))
    return (np.sort(key | np.arange(len(line), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _scan(batches):
    """Keys and sizes of the lines of each text; at the end of a task its word counts by bucket."""
    counts = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    names = ["doc_id", "lines", "keys", "counts"]
    for batch in batches:
        for run in W.spans(batch.column(1), SPAN_BYTES):
            found = Lines.of(*run)
            counts += np.bincount(_bucket(found.words), minlength=len(counts))
            cuts = pa.array(np.searchsorted(found.row, run[0] + np.arange(run[1] + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(run[0], run[1]),
                 pa.ListArray.from_arrays(cuts, pa.array(found.number.astype(np.int32))),
                 pa.ListArray.from_arrays(cuts, pa.array(found.key)),
                 pa.nulls(run[1], pa.list_(pa.int64()))], names)
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int64())),
         pa.array([counts], pa.list_(pa.int64()))], names)


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Words of a set of which a similar set must hold at least one, if all are in one order."""
    up, down = THRESHOLD
    return size - -(-size * up // down) + 1


def bitmaps(words: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Parities of each set: two sets differ in at least as many words as in parities.

    Four columns of 64 parities; short lines have them folded into the first.
    """
    spread = W.mix(words)
    bit = np.uint64(1) << (spread >> np.uint64(58))
    column = (spread >> np.uint64(56)) & np.uint64(3)
    out = np.stack([np.bitwise_xor.reduceat(np.where(column == k, bit, np.uint64(0)), starts) for k in range(4)])
    short = size < LONG_LINE
    out[0, short] = np.bitwise_xor.reduce(out[:, short], axis=0)
    out[1:, short] = 0
    return out.view(np.int64)


#: list: word (32 bits) and part, in one number, which sorts faster than two; lines: line and key (32 bits each);
#: sizes: words of the line and place in its order; wide: the other 192 parities of a line that has them.
PREFIX = "list long, doc_id long, lines long, sizes long, b0 long, wide binary"
PREFIX_NAMES = [c.split()[0] for c in PREFIX.split(", ")]
LIST = ["list"]
WIDE_BYTES = 24


def _wide(bits: np.ndarray, long: np.ndarray) -> pa.Array:
    """The parities of the long lines as bytes; NULL for the others."""
    ends = np.append(0, np.cumsum(long) * WIDE_BYTES).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(long), [
        pa.py_buffer(np.packbits(long, bitorder="little")), pa.py_buffer(ends),
        pa.py_buffer(np.ascontiguousarray(bits[:, long].T))])


def _unpacked(table: pa.Table) -> pa.Table:
    """Rows of :data:`PREFIX` with the columns that :class:`_List` takes."""
    lists, lines = (table[c].to_numpy() for c in ("list", "lines"))
    wide = table["wide"].combine_chunks()
    bits = np.zeros((4, len(table)), dtype=np.int64)
    bits[0] = table["b0"].to_numpy()
    if wide.null_count < len(wide):
        long, kept = wide.is_valid().to_numpy(zero_copy_only=False), wide.drop_null().cast(pa.binary(WIDE_BYTES))
        raw = np.frombuffer(kept.buffers()[1], dtype=np.int64)[kept.offset * 3:(kept.offset + len(kept)) * 3]
        bits[1:, long] = raw.reshape(-1, 3).T
    columns = {"ids": lists >> 32 << 32 | lines & 0xFFFFFFFF, "part": (lists & 0xFFFFFFFF).astype(np.int32),
               "doc_id": table["doc_id"], "line": (lines >> 32).astype(np.int32), "sizes": table["sizes"],
               **{f"b{k}": b for k, b in enumerate(bits)}}
    return pa.table({**columns, **{c: table[c] for c in table.column_names if c == "words"}})


def _prefixes(rarity, wanted=None):
    """A row for each word of each line's prefix; long lists are dealt out as pairs of blocks.

    With a bitmap of words only those it has, and then each row holds the words of its line.
    """
    def may(words):
        slot = (words >> np.uint64(32)).astype(np.int64) & ((1 << FILTER_BITS) - 1)
        return (wanted.value[slot >> 3] >> (slot & 7)) & 1 > 0

    def run(batches):
        order_of = rarity.value  # log-scaled counts, one byte for each bucket
        for batch in batches:
            ids = batch.column(0)
            for span in W.spans(batch.column(1), SPAN_BYTES):
                found = Lines.of(*span)
                if wanted is not None and len(found.key):
                    found = found.only(np.logical_or.reduceat(may(found.words), found.starts))
                if not len(found.key):
                    continue
                line = np.repeat(np.arange(len(found.key)), found.size)
                rank = order_of[_bucket(found.words)]
                order = _by_rarity(line, rank)
                place = np.arange(len(order)) - found.starts[line]
                # Of equal lines of this run the earliest stands for all.
                doc = ids.slice(span[0], span[1]).to_numpy(zero_copy_only=False)[found.row - span[0]]
                early = np.lexsort((found.number, doc, found.key))
                leads = np.zeros(len(found.key), dtype=bool)
                leads[early[np.append(True, found.key[early][1:] != found.key[early][:-1])]] = True
                # Sets of fewer than four words are similar to equal sets only.
                keep = (place < prefix_length(found.size)[line]) & (leads & (found.size >= 4))[line]
                keep &= rank[order] > 0  # alone in its bucket: no other line has the word
                if wanted is not None:
                    keep &= may(found.words[order])
                order, line, place = order[keep], line[keep], place[keep]
                words, rank = found.words[order], rank[order]
                expected = 2.0 ** (rank / 8.0 + 0.125)
                blocks = np.where(expected < LIST_ROWS, 1, expected // LIST_ROWS + 1).astype(np.int64)
                own = (found.key[line].view(np.uint64) % blocks.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(line)), blocks)
                other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                low, high = np.minimum(own[again], other), np.maximum(own[again], other)
                line, n = line[again], blocks[again]
                lists = (words[again] >> np.uint64(32) << np.uint64(32)).view(np.int64) | (low * n + high)
                lines = found.number << 32 | found.key & 0xFFFFFFFF
                bits = bitmaps(found.words, found.starts, found.size)
                columns = [*[pa.array(x) for x in (
                    lists, doc[line], lines[line], found.size[line] << 32 | place[again], bits[0, line])],
                    _wide(bits[1:, line], found.size[line] >= LONG_LINE)]
                if wanted is None:
                    yield pa.RecordBatch.from_arrays(columns, PREFIX_NAMES)
                    continue
                ends = np.append(found.starts, len(found.words)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.words.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*columns, sets.take(pa.array(line))], [*PREFIX_NAMES, "words"])
    return run


FOUND = "doc_id long, line int, key int, doc_id2 long, line2 int, key2 int, more boolean, word int"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


class _List:
    """Rows of sorted posting lists, in each list by document and line, equal sets once."""

    def __init__(self, table: pa.Table):
        ids = table["ids"].to_numpy().view(np.uint64)
        part, doc, line = (table[c].to_numpy() for c in ("part", "doc_id", "line"))
        word, key = ids >> np.uint64(32), (ids & np.uint64(0xFFFFFFFF))
        group = np.cumsum(np.append(0, (word[1:] != word[:-1]) | (part[1:] != part[:-1])))
        halves = group.astype(np.uint64) << np.uint64(32) | key
        order = np.argsort(halves)
        again = halves[order][1:] == halves[order][:-1]
        twins = order[np.append(again, False) | np.append(False, again)]
        keep = np.ones(len(group), dtype=bool)
        if len(twins):
            # Half a key does not tell sets apart: their sizes and bitmaps must be equal as well.
            same = [table[c].to_numpy()[twins] for c in ("sizes", "b0", "b1", "b2", "b3")] + [halves[twins]]
            order = np.lexsort((line[twins], doc[twins], *same))
            first = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in same], axis=0))
            keep[twins[order[~first]]] = False
        order = np.flatnonzero(keep)
        order = order[np.lexsort((line[order], doc[order], group[order]))]
        self.order = order
        self.group, self.word, self.key = group[order], word[order], key[order]
        self.doc, self.line = doc[order], line[order]
        sizes = table["sizes"].to_numpy()[order]
        self.size, self.place = sizes >> 32, sizes & 0xFFFFFFFF
        self.bits = np.stack([table[f"b{k}"].to_numpy()[order].view(np.uint64) for k in range(4)])
        self.folded = np.bitwise_xor.reduce(self.bits, axis=0)
        self.starts = np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1]))
        self.lengths = np.diff(np.append(self.starts, len(order)))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows no bound rules out; the cheap bounds first."""
        up, down = THRESHOLD
        both = self.size[a] + self.size[b]
        need = -(-both * up // (up + down))  # common words that similarity asks for
        may = np.flatnonzero(np.bitwise_count(self.folded[a] ^ self.folded[b]) <= both - 2 * need)
        a, b, both, need = a[may], b[may], both[may], need[may]
        ok = np.minimum(self.size[a] - self.place[a], self.size[b] - self.place[b]) >= need
        ok &= np.minimum(self.size[a], self.size[b]) * down >= np.maximum(self.size[a], self.size[b]) * up
        ok &= (self.doc[b] < self.doc[a]) | (self.line[b] < self.line[a])
        long = np.flatnonzero(ok & (self.size[a] >= LONG_LINE) & (self.size[b] >= LONG_LINE))
        apart = np.bitwise_count(self.bits[:, a[long]] ^ self.bits[:, b[long]]).sum(axis=0)
        ok[long] = apart <= (both - 2 * need)[long]
        return may[ok]

    def pairs(self, steps: int = 500_000):
        """(row, earlier row of the same list) that may be similar, in order of row."""
        position = np.arange(len(self.group)) - np.repeat(self.starts, self.lengths)
        short = np.repeat(self.lengths <= SHORT_LIST, self.lengths)
        rows = np.flatnonzero(short & (position > 0))
        ends = np.cumsum(position[rows])
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + steps, side="right")))
            mine = rows[at:stop]
            a = np.repeat(mine, position[mine])
            b = np.arange(len(a)) - np.repeat(np.cumsum(position[mine]) - position[mine], position[mine]) + np.repeat(
                mine - position[mine], position[mine])
            found = self.near(a, b)
            yield a[found], b[found]
            at = stop
        for start, n in zip(self.starts[self.lengths > SHORT_LIST], self.lengths[self.lengths > SHORT_LIST]):
            up, down = THRESHOLD
            for low in range(0, n, 256):
                mine = np.arange(start + low, start + min(low + 256, n))
                upto = np.arange(start, mine[-1])
                both = self.size[mine][:, None] + self.size[upto][None, :]
                far = both - 2 * -(-both * up // (up + down))
                may = np.bitwise_count(self.folded[mine][:, None] ^ self.folded[upto][None, :]) <= far
                i, j = np.nonzero(may & (upto[None, :] < mine[:, None]))
                found = self.near(mine[i], upto[j])
                yield mine[i[found]], upto[j[found]]


def _candidates(witnesses: int):
    """Earlier lines of the same list that may be similar: the earliest few of each line."""
    def run(batches):
        for table in whole_groups(batches, LIST):
            rows = _List(_unpacked(table))
            for a, b in rows.pairs():
                if not len(a):
                    continue
                first = np.append(True, a[1:] != a[:-1])
                group = np.cumsum(first) - 1
                nth = np.arange(len(a)) - np.flatnonzero(first)[group]
                more = (np.bincount(group) > witnesses)[group]
                keep = nth < witnesses
                a, b, more = a[keep], b[keep], more[keep]
                half = lambda x: x.astype(np.uint32).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    rows.doc[a], rows.line[a], half(rows.key[a]), rows.doc[b], rows.line[b], half(rows.key[b]),
                    more, half(rows.word[a]))], FOUND_NAMES)
    return run


def _witnessed(batches):
    """Lines that have an earlier similar line in one of their lists, by their words; once each."""
    up, down = THRESHOLD
    for table in whole_groups(batches, LIST):
        rows = _List(_unpacked(table))
        sets = table["words"].combine_chunks().take(pa.array(rows.order))
        for start, n in zip(rows.starts[rows.lengths > 1], rows.lengths[rows.lengths > 1]):
            size = rows.size[start:start + n]
            words, number = np.unique(sets.slice(start, n).flatten().to_numpy(), return_inverse=True)
            row = np.repeat(np.arange(n), size)
            found = np.zeros(n, dtype=bool)
            for low in range(0, n, 256):
                mine = np.arange(low, min(low + 256, n))
                common = np.zeros((len(mine), mine[-1] + 1), dtype=np.float32)
                for part in range(0, len(words), 4096):
                    here = (number >= part) & (number < part + 4096) & (row <= mine[-1])
                    held = np.zeros((mine[-1] + 1, min(4096, len(words) - part)), dtype=np.float32)
                    held[row[here], number[here] - part] = 1
                    common += held[mine] @ held.T
                alike = common * (up + down) >= up * (size[mine][:, None] + size[None, :mine[-1] + 1])
                b = np.arange(mine[-1] + 1)[None, :]
                doc, line = rows.doc[start:start + n], rows.line[start:start + n]
                alike &= (b < mine[:, None]) & ((doc[b] < doc[mine][:, None]) | (line[b] < line[mine][:, None]))
                found[mine] = alike.any(axis=1)
            at = start + np.flatnonzero(found)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.doc[at]), pa.array(rows.line[at]),
                     pa.array(rows.key[at].astype(np.uint32).view(np.int32))], SIDE)


def _half(key: np.ndarray) -> np.ndarray:
    """The low half of the keys, which tells lines with one number apart."""
    return (key & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def _sets(batches):
    """Distinct words of the listed lines of each text."""
    for batch in batches:
        ids, packed, sizes, wanted = batch.columns
        raw = b"".join(pa.decompress(p.as_buffer(), decompressed_size=n, codec="zstd", asbytes=True)
                       for p, n in zip(packed, sizes.to_pylist()))
        offsets = np.append(0, np.cumsum(sizes.to_numpy(), dtype=np.int64))
        texts = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(offsets), pa.py_buffer(raw))
        listed = pc.list_parent_indices(wanted).to_numpy() << 32 | pc.list_flatten(wanted).to_numpy()
        for span in W.spans(texts, SPAN_BYTES):
            found = Lines.of(*span)
            at = np.flatnonzero(np.isin(found.row << 32 | found.number, listed))
            if not len(at):
                continue
            ends = pa.array(np.append(found.starts, len(found.words)).astype(np.int32))
            sets = pa.ListArray.from_arrays(ends, pa.array(found.words.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(found.row[at])), pa.array(found.number[at].astype(np.int32)), pa.array(_half(found.key[at])),
                 sets.take(pa.array(at))],
                ["doc_id", "line", "key", "words"])


def _compressed(text: str):
    """The column ``text`` as Zstandard, to shuffle less; and its size in bytes."""
    @F.arrow_udf("struct<packed:binary,size:int>")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(
            [pa.array([pa.compress(t.as_buffer(), codec="zstd", asbytes=True) for t in texts], pa.binary()),
             pc.binary_length(texts).cast(pa.int32())], ["packed", "size"])

    return packed(text)


SIDE = ["doc_id", "line", "key"]


def _bitmap(slots: DataFrame):
    """Broadcast bitmap of the slots (column ``slot``, from 0) that occur: of fixed size, whatever occurs.

    It only spares rows that a later join would drop; where very many are wanted, it lets all pass.
    """
    place = F.col("slot") + 1
    parts = slots.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    table = np.zeros((1 << FILTER_BITS) >> 3, dtype=np.uint8)
    for r in parts:
        at = (r["bucket"] - 1) * len(r["bits"])
        table[at:at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return slots.sparkSession.sparkContext.broadcast(table)


def _documents_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts whose doc_id may be in ``wanted``; most others are spared the shuffle."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("slot")
    shared = _bitmap(wanted.select(slot))

    @F.arrow_udf("boolean")
    def listed(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (at & 7)) & 1 > 0)

    return texts.filter(listed(slot))


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose lines are similar; each text that holds one of their lines is read once more."""
    second = {f"{c}2": c for c in SIDE}
    ends = pairs.select(*SIDE).unionByName(pairs.select(*[F.col(k).alias(v) for k, v in second.items()]))
    wanted = cut(ends.groupBy("doc_id").agg(F.collect_set("line").alias("wanted")))
    packed = _documents_of(texts.filter("doc_id IS NOT NULL"), wanted).select(
        "doc_id", _compressed("text").alias("t")).select("doc_id", "t.packed", "t.size")
    sets = cut(packed.join(wanted, "doc_id").mapInArrow(_sets, "doc_id long, line int, key int, words array<long>"))
    sets = sets.dropDuplicates(SIDE)
    both = pairs.join(sets.withColumnRenamed("words", "w1"), SIDE).join(
        sets.withColumnRenamed("words", "w2").withColumnsRenamed({v: k for k, v in second.items()}), list(second))
    common = F.size(F.array_intersect("w1", "w2"))
    up, down = THRESHOLD
    return both.filter(common * (up + down) >= up * (F.size("w1") + F.size("w2")))


def _low(key):
    """:func:`_half` as a column."""
    low = F.pmod(key, F.lit(1 << 32))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


class LineDedup:
    """Lines to remove. ``lines`` has one row for each text, ``removed`` one for each line to go."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        scanned = cut(self.texts.mapInArrow(
            _scan, "doc_id long, lines array<int>, keys array<long>, counts array<long>"))
        self.lines = scanned.filter("counts IS NULL").select("doc_id", "lines", "keys")
        each = self.lines.filter("doc_id IS NOT NULL").select(
            "doc_id", F.explode(F.arrays_zip("lines", "keys")).alias("x")).select(
            "doc_id", F.col("x.lines").alias("line"), F.col("x.keys").alias("key"))
        first = cut(each.groupBy("key").agg(
            F.min(F.struct("doc_id", "line")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
        copies = each.join(first, "key").filter(F.struct("doc_id", "line") > F.col("first")).select(
            "doc_id", "line", _low(F.col("key")).alias("key"))

        counts = scanned.filter("counts IS NOT NULL").select(F.posexplode("counts").alias("bucket", "n")).groupBy(
            "bucket").agg(F.sum("n").alias("n")).toArrow()  # 2^RARITY_BITS rows
        rarity = np.zeros(1 << RARITY_BITS, dtype=np.uint8)
        seen = counts["n"].to_numpy().astype(np.float64)
        rarity[counts["bucket"].to_numpy()] = np.minimum(np.log2(seen.clip(1)) * 8, 255)
        self.rarity = spark.sparkContext.broadcast(rarity)
        self.removed = copies.unionByName(self._similar()).distinct()

    def _pairs(self, witnesses: int) -> DataFrame:
        rows = self.texts.filter("doc_id IS NOT NULL").mapInArrow(_prefixes(self.rarity), PREFIX)
        return rows.repartition(*LIST).sortWithinPartitions(*LIST).mapInArrow(_candidates(witnesses), FOUND)

    def _whole_lists(self, lists: DataFrame) -> DataFrame:
        """Lines with a witness in the lists of the given words; at most one row for each line of a list."""
        wanted = _bitmap(lists.select(F.pmod("word", F.lit(1 << FILTER_BITS)).cast("long").alias("slot")))
        rows = self.texts.filter("doc_id IS NOT NULL").mapInArrow(
            _prefixes(self.rarity, wanted), f"{PREFIX}, words array<long>")
        rows = rows.withColumn("word", F.shiftright("list", 32).cast("int")).join(lists, "word").drop("word")
        return rows.repartition(*LIST).sortWithinPartitions(*LIST).mapInArrow(
            _witnessed, "doc_id long, line int, key int")

    def _similar(self) -> DataFrame:
        found = cut(self._pairs(WITNESSES))
        ends = [*SIDE, *[f"{c}2" for c in SIDE]]
        similar = cut(_verified(self.texts, found.select(*ends).distinct()).select(*SIDE).distinct())
        # Lines that have further candidates and no witness so far.
        open_ = cut(found.filter("more").select(*SIDE, "word").join(similar, SIDE, "left_anti"))
        if open_.isEmpty():
            return similar
        return similar.unionByName(self._whole_lists(cut(open_.select("word").distinct())))

    def by_document(self) -> DataFrame:
        gone = self.removed.groupBy("doc_id").agg(F.collect_set(F.struct("line", "key")).alias("gone"))
        return cut(gone)


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` for each row of ``docs``: lines with words, how many of
    them go, and their numbers (from 0, all lines counted).

    A NULL or empty text has no lines. Lines of rows with a NULL doc_id are kept and remove nothing.
    Rows that repeat a doc_id count as one document: of two lines with the same number neither is
    earlier. Lines without a word are never removed. Extra columns are ignored.
    """
    work = LineDedup(docs)
    joined = work.lines.join(work.by_document(), "doc_id", "left")
    every = F.arrays_zip(F.col("lines").alias("line"), F.transform("keys", _low).alias("key"))
    gone = F.coalesce(F.transform(F.array_intersect(every, F.col("gone")), lambda x: x["line"]),
                      F.array().cast("array<int>"))
    return joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"),
                         F.size(gone).cast("long").alias("n_removed"), F.array_sort(gone).alias("removed"))


def _without(raw: bytes, gone: list[dict]) -> bytes:
    found = Lines.of(0, 1, np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]))
    pairs = {(g["line"], g["key"]) for g in gone}
    drop = {n for n, k in zip(found.number.tolist(), _half(found.key).tolist()) if (n, k) in pairs}
    return b"\n".join(x for i, x in enumerate(raw.split(b"\n")) if i not in drop)


def _kept(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts without some of their lines; NULL stays NULL. One text at a time is taken out of Arrow."""
    out = [_without(text.as_buffer().to_pybytes(), lines.as_py()) if text.is_valid else None
           for text, lines in zip(texts, gone)]
    return pa.array(out, pa.binary()).cast(pa.string())


def remove_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the repeated lines taken out of ``text``; a column n_chars follows.

    Only texts that lose a line go through Python; all other rows and columns stay as they are.
    """
    gone = LineDedup(docs).by_document().withColumnRenamed("doc_id", "__id")
    without = F.arrow_udf(_kept, "string")
    text = F.col("text").cast("string")
    row = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), text.alias("__text"))
    marked = row.join(gone, "__id", "left")
    hit = F.col("gone").isNotNull() & F.col("__text").isNotNull()
    done = marked.select("__row", "__text", hit.alias("__hit"), without(F.when(hit, F.col("__text")), F.col("gone")).alias("__cut"))
    kept = F.when(F.col("__hit"), F.col("__cut")).otherwise(F.col("__text"))

    def column(name: str):
        value = F.col("__row").getField(name)
        if name == "text":
            value = kept
        elif name == "n_chars":
            value = F.when(value.isNotNull(), F.length(kept).cast(docs.schema[name].dataType))
        return value.alias(name)

    return done.select(*[column(c) for c in docs.columns])
