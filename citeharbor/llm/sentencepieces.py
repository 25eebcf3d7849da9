"""SentencePiece encoding and decoding with a given BPE model, by suffix-array matching.

Each batch of texts is cut wherever no piece can reach over (so before most words and marks), the
distinct segments are joined into one text and a suffix array is built over it. Every piece of the vocabulary is looked up by
binary search, which gives the range of its occurrences; these are the edges of a lattice. Sorted by
position, the edges are relaxed from left to right. An edge may follow the piece that ends where it
begins only if BPE would leave these two pieces side by side; then each place has one piece that
reaches it, and the path to the end is the BPE encoding itself, the library's ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeharbor.llm.runs import give_back

SPACE = "▁"
INDEX_CHARS = 500_000  # characters of distinct segments that one suffix array covers
CACHE_BITS = 20
NEVER = np.iinfo(np.int64).max


@dataclass
class Vocabulary:
    """Pieces as numbers: keys for the search, merge ranks, canonical halves, pairs that merge."""

    ids: np.ndarray  # id of each piece that a text can hold, and -1 for a character without one
    codes: np.ndarray  # character numbers of each piece, padded with zeros
    lengths: np.ndarray
    rank: np.ndarray  # when BPE builds the piece; -1 for single characters
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    alone: np.ndarray  # BPE builds this piece from its own characters
    byte_ids: np.ndarray
    texts: list[bytes]  # by id; b"" for control pieces
    letters: np.ndarray  # number of each code point, 0 if no piece has it
    joins: np.ndarray  # whether some piece has these two characters side by side

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("the model is not a BPE model")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not (
                spec.add_dummy_prefix and spec.escape_whitespaces):
            raise ValueError("the model rewrites its input; only the plain normaliser is supported")
        kinds = proto.ModelProto.SentencePiece
        normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        byte_ids = np.full(256, next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN))
        texts = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                byte_ids[int(p.piece[1:-1], 16)] = i
                texts.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                texts.append(p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"")
        return cls.build(normal, byte_ids, texts)

    @classmethod
    def build(cls, normal, byte_ids, texts) -> Vocabulary:
        names = [p for _, p, _ in normal]
        number = {p: k for k, p in enumerate(names)}
        order = sorted(range(len(names)), key=lambda k: -normal[k][2])
        rank = np.full(len(names) + 1, -1, dtype=np.int64)
        for at, k in enumerate(order):
            rank[k] = at if len(names[k]) > 1 else -1
        pairs = {}
        for k, name in enumerate(names):
            for cut in range(1, len(name)):
                a, b = number.get(name[:cut]), number.get(name[cut:])
                if a is not None and b is not None:
                    pairs[(a, b)] = int(rank[k])
        left, right = (np.arange(len(names) + 1) for _ in range(2))
        alone = np.zeros(len(names) + 1, dtype=bool)
        alone[-1] = True
        for k, name in enumerate(names):
            built, halves = cls._merge([number.get(c) for c in name], pairs, order)
            alone[k] = built == [k]
            if alone[k] and halves:
                left[k], right[k] = halves
        keyed = np.array([a * (len(names) + 1) + b for a, b in pairs], dtype=np.int64)
        by_key = np.argsort(keyed)
        lengths = np.array([len(n) for n in names])
        width = -(-int(lengths.max(initial=1)) // 8) * 8
        # Characters of longer pieces come first, so that the table of neighbours is small.
        inner = sorted({c for n in names if len(n) > 1 for c in n})
        single = sorted({n for n in names if len(n) == 1} - set(inner))
        letters = np.zeros(0x110000, dtype=np.uint16)
        letters[[ord(c) for c in inner + single]] = np.arange(1, len(inner) + len(single) + 1)
        joins = np.zeros((len(inner) + 1, len(inner) + 1), dtype=bool)
        codes = np.zeros((len(names), width), dtype=np.uint64)
        for k, name in enumerate(names):
            own = letters[[ord(c) for c in name]]
            codes[k, :len(name)] = own
            joins[own[:-1], own[1:]] = True
        return cls(
            np.array([i for i, _, _ in normal] + [-1]), codes, lengths, rank, left, right,
            keyed[by_key], np.array(list(pairs.values()), dtype=np.int64)[by_key], alone,
            byte_ids, texts, letters, joins)

    @staticmethod
    def _merge(symbols, pairs, order):
        """Merge a piece's characters by rank, leftmost first; the result and the last two halves."""
        halves = None
        while len(symbols) > 1:
            ranks = [pairs.get((a, b), NEVER) for a, b in zip(symbols, symbols[1:])]
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            halves = (symbols[at], symbols[at + 1])
            symbols = symbols[:at] + [order[best]] + symbols[at + 2:]
        return symbols, halves

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves pieces ``a`` and ``b`` side by side, for arrays of piece numbers.

        The merges that built the two are undone from the last to the first. At each step the two
        symbols at the border must not merge before the next merge that really took place.
        """
        good = np.ones(len(a), dtype=bool)
        open_ = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER)
        size = len(self.rank)
        while len(open_):
            key = a * size + b
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merges = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit)
            good[open_[merges]] = False
            ra, rb = self.rank[a], self.rank[b]
            going = ~merges & ((ra >= 0) | (rb >= 0))
            undo_a = ra > rb  # built later; of two equal pieces the left one is built first
            limit = np.where(undo_a, ra, rb + 1)[going]
            a, b = np.where(undo_a, self.right[a], a)[going], np.where(undo_a, b, self.left[b])[going]
            open_ = open_[going]
        return good


def _packed(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of character numbers as rows of keys, as many of ``bits`` bits in each as fit."""
    pack = 64 // bits
    keys = np.zeros((len(codes), codes.shape[1] // pack), dtype=np.uint64)
    for k in range(pack):
        keys = (keys << np.uint64(bits)) | codes[:, k::pack]
    return keys


def suffix_array(text: np.ndarray, longest: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of all suffixes by their first ``longest`` characters at least, and the sorted keys."""
    pack = 64 // bits
    width = -(-longest // pack)
    padded = np.zeros(len(text) + pack * width, dtype=np.uint64)
    padded[:len(text)] = text
    key = np.zeros(len(text) + pack * (width - 1), dtype=np.uint64)
    for k in range(pack):
        key = (key << np.uint64(bits)) | padded[k:k + len(key)]
    keys = [key[pack * w:pack * w + len(text)] for w in range(width)]
    order = np.lexsort(keys[::-1]) if width > 1 else np.argsort(keys[0])
    return order, [k[order] for k in keys]


def occurrences(keys: list[np.ndarray], pieces: np.ndarray, lengths: np.ndarray, bits: int):
    """First place and end in the suffix array of each piece, by binary search of all at once."""
    pack = 64 // bits
    last = pieces.copy()
    for w in range(pieces.shape[1]):
        free = np.clip(pack * (w + 1) - lengths, 0, pack)
        ones = np.array([(1 << (int(f) * bits)) - 1 for f in range(pack + 1)], dtype=np.uint64)
        last[:, w] |= ones[free]

    def first_above(bound, or_equal):
        low, high = np.zeros(len(bound), dtype=np.int64), np.full(len(bound), len(keys[0]))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            less, equal = np.zeros(len(open_), dtype=bool), np.ones(len(open_), dtype=bool)
            for w, key in enumerate(keys):
                here, want = key[middle], bound[open_, w]
                less |= equal & (here < want)
                equal &= here == want
            goes_up = less | equal if or_equal else less
            low[open_[goes_up]] = middle[goes_up] + 1
            high[open_[~goes_up]] = middle[~goes_up]
        return low

    return first_above(pieces, False), first_above(last, True)


class Encoder:
    """Encodes batches of texts; remembers which pairs of pieces may stand side by side."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache_keys = np.full(1 << CACHE_BITS, -1, dtype=np.int64)
        self.cache_good = np.zeros(1 << CACHE_BITS, dtype=bool)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * len(self.v.rank) + b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        new = np.flatnonzero(self.cache_keys[slot] != key)
        good = self.cache_good[slot]
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            size = len(self.v.rank)
            found = self.v.stay_apart(fresh // size, fresh % size)
            good[new] = found[back]
            at = slot[new]
            self.cache_keys[at] = key[new]
            self.cache_good[at] = self._owner(at, key[new], found[back])
        return good

    def _owner(self, slots, keys, values):
        """Values that belong to the keys which the slots kept (the last one written)."""
        kept = self.cache_keys[slots]
        own = dict(zip(keys[kept == keys].tolist(), values[kept == keys].tolist()))
        return np.array([own[k] for k in kept.tolist()], dtype=bool)

    def segments(self, names: list[str]) -> pa.ListArray:
        """Ids of each segment."""
        parts, at = [], 0
        while at < len(names):
            end, size = at, 0
            while end < len(names) and (size == 0 or size + len(names[end]) < INDEX_CHARS):
                size += len(names[end]) + 1
                end += 1
            parts.append(self._block(names[at:end]))
            at = end
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def _block(self, names: list[str]) -> pa.ListArray:
        v = self.v
        text = np.frombuffer(("\0".join(names) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.array([len(n) for n in names])
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        letters = v.letters[text]
        here = np.unique(letters)
        # Few different characters, as in most batches, need eight bits each; the pieces that have
        # others cannot occur.
        bits = 8 if len(here) < 256 else 16
        number = np.zeros(int(v.codes.max(initial=0)) + 1, dtype=np.uint64)
        number[here[here > 0]] = np.arange(1, (here > 0).sum() + 1) if bits == 8 else here[here > 0]
        known = np.flatnonzero(((v.codes == 0) | (number[v.codes] > 0)).all(axis=1) & v.alone[:-1])
        longest = int(v.lengths[known].max(initial=1))
        order, keys = suffix_array(number[letters], longest, bits)
        width = len(keys) * (64 // bits)
        coded = np.zeros((len(known), width), dtype=np.uint64)
        shown = min(width, v.codes.shape[1])
        coded[:, :shown] = number[v.codes[known][:, :shown]]
        low, high = occurrences(keys, _packed(coded, bits), v.lengths[known], bits)
        counts = high - low
        # Small numbers in 32 bits: there are several edges for each character.
        piece = np.repeat(known.astype(np.int32), counts)
        shift = (low - np.append(0, np.cumsum(counts)[:-1])).astype(np.int32)
        place = order.astype(np.int32)[np.repeat(shift, counts) + np.arange(len(piece), dtype=np.int32)]
        # A character without a piece is an edge of its own, later spelled in bytes.
        single = np.zeros(len(text), dtype=bool)
        single[place[v.lengths[piece] == 1]] = True
        segment = np.repeat(np.arange(len(names), dtype=np.int32), lengths + 1)
        inner = np.ones(len(text), dtype=bool)
        inner[ends] = False
        bare = np.flatnonzero(~single & inner).astype(np.int32)
        place = np.concatenate([place, bare])
        piece = np.concatenate([piece, np.full(len(bare), len(v.rank) - 1, dtype=np.int32)])
        span = np.append(v.lengths, 1).astype(np.int32)[piece]
        offset = place - starts.astype(np.int32)[segment[place]]
        by_place = np.argsort(offset, kind="stable")
        place, piece, span = place[by_place], piece[by_place], span[by_place]
        steps = np.searchsorted(offset[by_place], np.arange(lengths.max(initial=0) + 1))
        last = np.full(len(text) + 1, -1, dtype=np.int64)  # the piece that ends before each place
        for step, (a, b) in enumerate(zip(steps[:-1], steps[1:])):
            at, p, n = place[a:b], piece[a:b], span[a:b]
            if step:
                before = last[at]
                good = before >= 0
                good[good] = self.may_follow(before[good], p[good])
                at, p, n = at[good], p[good], n[good]
            last[at + n] = p
        return self._paths(text, starts, ends, last)

    def _paths(self, text, starts, ends, last) -> pa.ListArray:
        """Follow the pieces back from the end of each segment; spell bare characters in bytes."""
        v = self.v
        spans = np.append(v.lengths, 1)
        at, owner = ends.copy(), np.arange(len(ends))
        owners, pieces, places = [], [], []
        while len(owner):
            live = at > starts[owner]
            owner, at = owner[live], at[live]
            p = last[at]
            at = at - spans[p]
            owners.append(owner)
            pieces.append(p)
            places.append(at)
        owners, pieces, places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, pieces, places))
        forward = np.argsort(places, kind="stable")
        owners, pieces, places = owners[forward], pieces[forward], places[forward]
        bare = pieces == len(v.rank) - 1
        code = np.where(bare, text[places], 0)
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        row = np.repeat(np.arange(len(pieces)), n_bytes)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n_bytes) - n_bytes, n_bytes)
        ids = v.ids[pieces][row]
        spelled = bare[row]
        c, n, s = code[row][spelled], n_bytes[row][spelled], step[spelled]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        rest = (c >> (6 * (n - 1 - s))) & np.where(n == 1, 0x7F, 0x3F)
        ids[spelled] = v.byte_ids[np.where(s == 0, lead | rest, 0x80 | rest)]
        offsets = np.searchsorted(owners[row], np.arange(len(ends) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))

    def cuts(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Byte offsets at which the segments of UTF-8 bytes begin; texts begin at ``starts``."""
        lead = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32 if len(raw) < 1 << 31 else np.int64)
        code = self.v.letters[np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode(
            "utf-32-le", "surrogatepass"), dtype=np.uint32)]
        code[code >= len(self.v.joins)] = 0
        new = np.ones(len(lead), dtype=bool)
        for at in range(1, len(code), 1 << 19):  # in steps, since indexing widens its operands
            before, here = code[at - 1:at - 1 + (1 << 19)], code[at:at + (1 << 19)]
            new[at:at + len(here)] = ~self.v.joins[before[:len(here)], here]
        new[np.searchsorted(lead, starts)] = True
        return lead[new]

    def texts(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; a null or empty text has none."""
        spaced = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), " ", SPACE)
        full = pc.if_else(pc.equal(spaced, ""), "", pc.binary_join_element_wise(
            pa.scalar("", pa.large_string()), spaced, pa.scalar(SPACE, pa.large_string())))
        bounds = np.frombuffer(full.buffers()[1], dtype=np.int64)[full.offset:full.offset + len(full) + 1]
        if not len(full) or bounds[-1] == bounds[0]:
            return pa.array([[]] * len(full), pa.list_(pa.int32()))
        raw = np.frombuffer(full.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        begin = self.cuts(raw, bounds[:-1][np.diff(bounds) > 0])
        offsets = np.append(begin, len(raw)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(
            len(begin), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes()))
        coded = pieces.dictionary_encode()
        known = self.segments(coded.dictionary.to_pylist())
        lists = known.take(coded.indices)
        ends = lists.offsets.to_numpy()[np.searchsorted(begin, bounds)]
        return pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), lists.flatten())


def decoded(vocabulary: Vocabulary, ids) -> str:
    """Text of a list of ids: pieces joined, the leading space dropped, broken UTF-8 replaced."""
    text = b"".join(map(vocabulary.texts.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


BATCH = 2000  # rows of a batch inside a task


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array<int>); a NULL or empty text has none. No shuffle.

    A column ``ids`` of ``docs`` is replaced. U+2581 counts as a space, as in the library.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))
    held: dict[str, Encoder] = {}

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        if "encoder" not in held:
            held["encoder"] = Encoder(shared.value)
        encoder = held["encoder"]
        parts = [encoder.texts(texts.slice(at, BATCH)) for at in range(0, len(texts), BATCH)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return docs.withColumn("ids", ids(F.coalesce(F.col("text"), F.lit(""))))


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` as of :func:`encode` and ``decoded`` as of :func:`decode`, by one function.

    Two functions in a row would be merged into one call of each and one of both: texts would be encoded
    twice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))
    held: dict[str, Encoder] = {}

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        if "encoder" not in held:
            held["encoder"] = Encoder(shared.value)
        parts = []
        for at in range(0, len(texts), BATCH):
            ids = held["encoder"].texts(texts.slice(at, BATCH))
            back = pa.array([decoded(shared.value, x.values.tolist()) for x in ids], pa.string())
            parts.append(pa.StructArray.from_arrays([ids, back], ["ids", "decoded"]))
        give_back()
        return pa.concat_arrays(parts) if parts else pa.array(
            [], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    coded = docs.withColumn("__coded", both(F.coalesce(F.col("text"), F.lit(""))))
    return coded.withColumns({"ids": F.col("__coded.ids"), "decoded": F.col("__coded.decoded")}).drop("__coded")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its column ``ids`` (NULL: empty).

    A column ``decoded`` is replaced. Ids outside the vocabulary raise an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model or default_model()))

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return pa.array([decoded(shared.value, x.values.tolist() if x.is_valid else ()) for x in lists], pa.string())

    return encoded.withColumn("decoded", text(F.col("ids")))
