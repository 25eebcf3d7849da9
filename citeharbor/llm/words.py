"""Words of many texts at once, as numpy arrays: positions and 64-bit hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D. UTF-8 never uses those bytes
inside a longer character, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1 modulo 2^64; kept, so that batches share them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, CHUNK_BYTES + 2)
        grown = np.full(size, base, dtype=np.uint64)
        grown[0] = 1
        known = np.cumprod(grown, dtype=np.uint64)
        if size == CHUNK_BYTES + 2:
            _POWERS[base] = known
    return known[:n]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits (the splitmix64 finaliser)."""
    v = values ^ (values >> np.uint64(30))
    v = v * np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v = v * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of ``values[start:end]`` for each pair of bounds."""
    forward = powers(base, len(values))
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.multiply(values, forward, out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return (sums[ends] - sums[starts]) * powers(_inverse(base), len(values) + 1)[starts]


class Chunk:
    """Words of consecutive rows: ``row`` gives the row of each word, ``bounds`` each row's words."""

    def __init__(self, first_row: int, rows: int, data: np.ndarray, offsets: np.ndarray):
        self.first_row, self.rows, self.data = first_row, rows, data
        space = (data == 32) | (data - np.uint8(9) < 5)  # as SPACE; below 9 the difference wraps
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[0] = edge[-1] = True
        edge[offsets] = True  # words never reach over the end of a text
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = ~space
        here, before = inside[1:], inside[:-1]
        self.starts = np.flatnonzero(here & (~before | edge))
        self.ends = np.flatnonzero(before & (~here | edge))
        self.bounds = np.searchsorted(self.starts, offsets)
        self.offsets = offsets

    def texts(self) -> list[bytes]:
        """The bytes of each row."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word; equal words have equal hashes."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        values = self.data.astype(np.uint64)
        values += np.uint64(1)
        raw = rolling(values, self.starts, self.ends, int(BASE))
        return mix(raw + (self.ends - self.starts).astype(np.uint64))


def spans(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Cut an Arrow string column into runs of whole texts of about ``size`` bytes.

    Yields first row, number of rows, bytes, and the offset of each text and of the end. A null
    text is empty. A text longer than ``size`` is a run of its own.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[
        texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        low, high = offsets[row], offsets[stop]
        yield row, stop - row, data[low:high], offsets[row:stop + 1] - low
        row = stop


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of each run of :func:`spans`."""
    for run in spans(texts, size):
        yield Chunk(*run)
