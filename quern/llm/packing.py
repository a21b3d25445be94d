"""Packing documents into windows by non-negative least squares over length combinations.

A document longer than the window fills whole windows with its beginning; what remains has
a length below the window. For a block of documents the histogram of those lengths is
matched by shallow combinations (two or three lengths that fill a window exactly): their
repeat counts are the non-negative least squares solution, rounded and checked against what
is there. Documents left over are packed greedily, cut where a window is full; the rest of
the block becomes windows at powers of two, which need no padding.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import encoder, ship
from quern.llm.workers import lean
from quern.storage import materialize

#: Tokens of a block; a longer document is a block of its own. Bounds a worker's memory.
BLOCK_TOKENS = 2_000_000
MOST_TRIPLES = 4_096
END_ID = 0


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: unused) that sum to the window and occur in the histogram.

    All pairs, and triples led by the most frequent lengths."""
    there = np.flatnonzero(histogram)
    pairs = there[(2 * there <= window) & (histogram[window - there] > 0)]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)]
    common = there[np.argsort(-histogram[there], kind="stable")][: max(8, MOST_TRIPLES // max(1, len(there)))]
    for a in common.tolist():
        b = there[(there >= 1) & (2 * there <= window - a)]
        b = b[histogram[window - a - b] > 0]
        out.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    found = np.sort(np.concatenate(out), axis=1)
    return np.unique(found, axis=0)


def least_squares(parts: np.ndarray, histogram: np.ndarray, rounds: int = 150) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A counting each length in each combination.

    Accelerated projected gradient; A is never written out."""
    n, width = len(parts), len(histogram)
    if not n:
        return np.zeros(0)
    flat, used = parts.ravel(), (parts > 0).ravel().astype(float)

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(flat, np.repeat(x, 3) * used, width)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[flat] * used).reshape(n, 3).sum(axis=1)

    # Column sums are at most 3, so |A|^2 is at most 3 times the largest row sum.
    step = 1.0 / (3.0 * max(1.0, times(np.ones(n))[1:].max()))
    x = y = np.zeros(n)
    t = 1.0
    h = histogram.astype(float)
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(times(y) - h))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def pack_lengths(lengths: list[int], window: int = 1024) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of a block, and its sequence count.

    Every token is in exactly one piece; sequences are gapless and either full or, for the
    block's last tokens, at a power of two."""
    pieces: list[tuple[int, int, int, int, int]] = []
    seq = 0
    waiting: list[list[int]] = [[] for _ in range(window)]
    for k, n in enumerate(lengths):
        for start in range(0, n - n % window, window):
            pieces.append((k, start, window, seq, 0))
            seq += 1
        waiting[n % window].append(k)
    waiting[0] = []
    histogram = np.array([len(w) for w in waiting])
    parts = combinations(histogram, window) if histogram.any() else np.zeros((0, 3), int)
    repeats = np.rint(least_squares(parts, histogram)).astype(int)

    def place(k: int, start: int, length: int, offset: int) -> None:
        pieces.append((k, start, length, seq, offset))

    for j in np.argsort(-repeats, kind="stable").tolist():
        if repeats[j] <= 0:
            break
        combo = [x for x in parts[j].tolist() if x]
        for _ in range(min(int(repeats[j]), *(len(waiting[x]) // combo.count(x) for x in combo))):
            offset = 0
            for x in combo:
                k = waiting[x].pop()
                place(k, lengths[k] - x, x, offset)
                offset += x
            seq += 1

    rest = sorted((x, k) for x in range(window) for k in waiting[x])
    left = sum(x for x, _ in rest)
    room, offset = (window if left >= window else 0), 0
    while left >= window or (room and offset):
        fits = bisect.bisect_right(rest, (room, len(lengths))) - 1
        if fits >= 0:
            x, k = rest.pop(fits)
            place(k, lengths[k] - x, x, offset)
        else:  # the shortest is cut, and what remains of it waits again
            whole, k = rest.pop(0)
            x = room
            place(k, lengths[k] - whole, x, offset)
            bisect.insort(rest, (whole - x, k))
        offset, room, left = offset + x, room - x, left - x
        if not room:
            seq, offset, room = seq + 1, 0, window
            if left < window:
                break
    # Fewer tokens than a window: sequences at the powers of two that add up to their number.
    while left:
        room, offset = 1 << (left.bit_length() - 1), 0
        while room:
            whole, k = rest.pop()
            x = min(whole, room)
            place(k, lengths[k] - whole, x, offset)
            if whole > x:
                rest.append((whole - x, k))
            offset, room, left = offset + x, room - x, left - x
        seq += 1
    return pieces, seq


PIECES = "doc_id long, start long, length long, doc_tokens long, part int, doc_key long, local_sequence long, offset long, ids binary"


def pack(docs: DataFrame, vocabulary: str, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit bytes).

    A document is the ids of its whole text (null: empty) and an end id 0. Null ids stay
    null; repeated rows are packed each on its own and differ in (part, doc_key); an empty
    table gives no pieces. Only the two named columns are read. Each input partition packs
    its own documents; ``number`` turns (part, local_sequence) into sequence ids.
    """
    name, end = ship(docs.sparkSession, vocabulary), np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode = TaskContext.get().partitionId(), encoder(name).encode
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = base = first = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, base, first
            lengths = [len(x) // 4 for x in ids]
            pieces, count = pack_lengths(lengths, window)
            for at in range(0, len(pieces), 20_000):
                rows = pieces[at : at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[k] for k, *_ in rows], pa.int64()),
                        pa.array([s for _, s, *_ in rows], pa.int64()),
                        pa.array([n for _, _, n, *_ in rows], pa.int64()),
                        pa.array([lengths[k] for k, *_ in rows], pa.int64()),
                        pa.array([part] * len(rows), pa.int32()),
                        pa.array([first + k for k, *_ in rows], pa.int64()),
                        pa.array([base + q for *_, q, _ in rows], pa.int64()),
                        pa.array([o for *_, o in rows], pa.int64()),
                        pa.array([ids[k][4 * s : 4 * (s + n)] for k, s, n, *_ in rows], pa.binary()),
                    ],
                    names=[c.split()[0] for c in PIECES.split(", ")],
                )
            held, base, first = 0, base + count, first + len(ids)
            ids.clear(), keys.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                ids.append(encode(text) + end)
                held += len(ids[-1]) // 4
                if held >= BLOCK_TOKENS:
                    yield from close()
        if ids:
            yield from close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(rows.mapInArrow(lean(run), PIECES), "packed")


def number(pieces: DataFrame) -> DataFrame:
    """``pieces`` with sequence_id: local numbers plus the prefix sum of earlier partitions.

    The one-task window has a row per input partition, not per document."""
    totals = pieces.groupBy("part").agg((F.max("local_sequence") + 1).alias("count"))
    bases = totals.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    return pieces.join(bases, "part").withColumn("sequence_id", F.col("base") + F.col("local_sequence")).drop("base")
