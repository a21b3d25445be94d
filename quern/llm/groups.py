"""Whole groups from partitions that are sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never split a group of equal keys; each is about a batch, or one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and cut == 0 and held[-1].column(key)[-1].as_py() == keys[-1]:
            held.append(batch)
            continue
        done = [*held, batch.slice(0, cut)]
        if any(b.num_rows for b in done):
            yield pa.Table.from_batches(done)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of equal values."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    return np.concatenate([[0], edges]).astype(int), np.concatenate([edges, [len(keys)]]).astype(int)
