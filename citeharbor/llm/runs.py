"""Rows of sorted groups, streamed to numpy without ever holding more than one batch and one group."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by ``keys`` so that no group is cut.

    The last group of a batch waits for the next one. Groups must be bounded by the caller.
    """
    waiting: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(len(table), dtype=bool)
        for values in columns:
            new[1:] |= values[1:] != values[:-1]
        starts = np.flatnonzero(new)
        begins_new = last is not None and any(v[0] != x for v, x in zip(columns, last))
        last = [v[-1] for v in columns]
        if begins_new and waiting:
            yield pa.concat_tables(waiting).combine_chunks()
            waiting = []
        if len(starts):
            cut = int(starts[-1])
            yield pa.concat_tables([*waiting, table.slice(0, cut)]).combine_chunks()
            waiting = [table.slice(cut)]
        else:
            waiting.append(table)
    if waiting:
        yield pa.concat_tables(waiting).combine_chunks()


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Start of every group in a sorted table, and the end of the last one."""
    new = np.zeros(len(table), dtype=bool)
    new[:1] = True
    for key in keys:
        values = table[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(table))


def give_back() -> None:
    """Return freed memory to the system. Workers live on between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU systems only
    if trim is not None:
        trim(0)


def by_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]):
    """A ``mapInArrow`` function that handles each batch on its own."""
    def run(batches):
        for batch in batches:
            yield make(batch)
    return run
