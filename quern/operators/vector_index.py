"""A vector index: unit vectors in cells around centroids, searched cell by cell and re-ranked exactly.

Centroids are fitted on a bounded sample; every vector is stored in the cell of its nearest
centroid, in a folder of its own. A query asks its nearest cells (``nearest``, as many as gave
the wanted recall on the sample) or all that can hold an answer (``within``: a cell's widest
angle bounds what is in it, so that no pair is lost)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.versions import Versions

#: Sampled vectors at most, and their bytes as 64-bit floats.
MOST_SAMPLE, MOST_BYTES = 16_384, 64 << 20
MOST_CELLS = 4_096
#: Vectors of a cell in one file, and so in one task.
FILE_VECTORS = 100_000
#: Bytes of a block of queries, which every task gets.
BLOCK_BYTES = 32 << 20
#: Cosines held at once, by the driver or by a task.
MOST_COSINES = 1 << 20


def _unit_rows(rows: list, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows that have a direction, and their places."""
    good, at = [], []
    for k, row in enumerate(rows):
        if row and None not in row and (dim is None or len(row) == dim):
            v = np.array(row, np.float64)
            top = np.abs(v).max()
            if np.isfinite(top) and top > 0:
                v = v / top
                good.append(v / np.sqrt(v @ v))
                at.append(k)
    return np.array(good) if good else np.zeros((0, dim or 1)), np.array(at, int)


def _slices(rows: int, others: int) -> Iterator[slice]:
    """Rows in runs whose cosines with all others may be held at once."""
    step = max(1, MOST_COSINES // max(1, others))
    return (slice(a, a + step) for a in range(0, rows, step))


def _homes(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each vector."""
    return np.concatenate([(unit[some] @ centres.T).argmax(axis=1) for some in _slices(len(unit), len(centres))] or [np.zeros(0, int)])


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = sample[np.sort(rng.choice(len(sample), cells, replace=False))]
    for _ in range(rounds):
        own = _homes(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Cells to ask so that, on the sample, this share of the k nearest is found."""
    own, some = _homes(sample, centres), sample[:: max(1, len(sample) // 256)]
    near = np.argsort(-(some @ sample.T), axis=1)[:, 1 : k + 1]
    order = np.argsort(np.argsort(-(some @ centres.T), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(order, own[near], 1).reshape(-1))
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1 if len(ranks) else 1


class VectorIndex:
    """Vectors (id, embedding) by cell in a folder. Null, empty, zero and non-finite vectors, and
    those of another width than most of the sample, have no place in it and are never found;
    repeated rows and ids are vectors of their own, ids may be null."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    def build(self, vectors: DataFrame, cells: int | None = None, k: int = 10, recall: float = 0.97) -> VectorIndex:
        """Fits centroids on the vectors of the least hashes, as many as ``MOST_SAMPLE`` and
        ``MOST_BYTES`` allow (``cells``: the root of the number of vectors, 4,096 at most), sets
        the number of cells to ask by the recall of ``k`` on the sample, and stores all vectors."""
        rows = vectors.select("id", "embedding")
        n, longest = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
        most = max(1, min(MOST_SAMPLE, MOST_BYTES // (8 * max(1, longest or 1))))
        taken = rows.where("embedding is not null").orderBy(F.xxhash64("embedding")).limit(most).select("embedding").collect()
        widths = [len(r[0]) for r in taken]
        dim = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
        sample, _ = _unit_rows([r[0] for r in taken], dim)
        cells = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, len(sample)))
        centres = _centroids(sample, cells) if len(sample) else np.zeros((1, max(1, dim)))
        shared = self.spark.sparkContext.broadcast(centres)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in (whole.slice(a, 1024) for whole in batches for a in range(0, whole.num_rows, 1024)):
                unit, at = _unit_rows(batch.column(1).to_pylist(), centres.shape[1])
                if len(at):
                    cell = _homes(unit, centres)
                    cosine = np.einsum("ij,ij->i", unit, centres[cell])
                    stored = pa.array([v.tobytes() for v in unit], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(at)), pa.array(cosine), stored], names=["cell", "id", "cosine", "vector"])

        folder, kind = self.versions.new("vectors"), rows.schema["id"].dataType.simpleString()
        table = rows.mapInArrow(placed, f"cell int, id {kind}, cosine double, vector binary")
        # A cell of very many vectors is cut into files, whose number is known before.
        part = F.pmod(F.xxhash64("vector", "id"), F.lit(max(1, -(-n // FILE_VECTORS))))
        table.repartition("cell", part).write.partitionBy("cell").parquet(f"{self.versions.folder}/{folder}")
        widest = [1.0] * cells
        for r in self._table(folder, kind).groupBy("cell").agg(F.min("cosine").alias("c")).collect():  # a row a cell
            widest[r["cell"]] = r["c"]
        state = {"folder": folder, "id": kind, "centres": centres.tolist(), "widest": widest, "probes": _probes(sample, centres, k, recall)}
        self.versions.change(lambda _: state)
        return self

    def _table(self, folder: str, kind: str) -> DataFrame:
        return self.spark.read.schema(f"id {kind}, cosine double, vector binary, cell int").parquet(f"{self.versions.folder}/{folder}")

    def _asked(self, queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
        """Blocks of (ids, unit vectors) of bounded bytes; queries stream through the driver."""
        dim = len(self.versions.newest()[1]["centres"][0])
        most, ids, rows = max(1, BLOCK_BYTES // (8 * dim)), [], []
        for r in queries.select("query_id", "embedding").toLocalIterator():
            ids.append(r[0])
            rows.append(r[1])
            if len(rows) == most:
                unit, at = _unit_rows(rows, dim)
                yield [ids[k] for k in at], unit
                ids, rows = [], []
        unit, at = _unit_rows(rows, dim)
        yield [ids[k] for k in at], unit

    def _found(self, queries: DataFrame, limits, k: int | None, least: float) -> DataFrame:
        """``limits(state, unit)``: the least cosine with a centre at which a query asks its cell, by
        query and cell, either axis 1 long. Tasks find a cell's queries when they come to it: lists
        of the cells of all queries would grow with the number of cells."""
        state = self.versions.newest()[1]
        kind, asked_by = state["id"], queries.schema["query_id"].dataType.simpleString()
        schema, out = f"query_id {asked_by}, id {kind}, similarity double", []
        table, centres = self._table(state["folder"], kind), np.array(state["centres"])
        for ids, unit in self._asked(queries):
            bound = limits(state, unit)
            limit = np.broadcast_to(bound, (len(unit), len(centres)))  # a view
            asked = np.zeros(len(centres), bool)
            for some in _slices(len(unit), len(centres)):
                asked |= (unit[some] @ centres.T >= limit[some] - 1e-9).any(axis=0)
            wanted = np.flatnonzero(asked).tolist()
            shared = self.spark.sparkContext.broadcast((np.array(ids, object), unit, bound, centres))

            def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                ids, unit, limit, centres = shared.value
                limit = np.broadcast_to(limit, (len(unit), len(centres)))
                for batch in batches:
                    cells = batch.column("cell").to_numpy()
                    for cell in np.unique(cells):
                        at, asking = np.flatnonzero(cells == cell), np.flatnonzero(unit @ centres[cell] >= limit[:, cell] - 1e-9)
                        stored = batch.column("vector").take(pa.array(at)).to_pylist()
                        v = np.frombuffer(b"".join(stored), np.float64).reshape(len(stored), -1)
                        for run in _slices(len(asking), max(v.shape)):
                            some = asking[run]
                            exact = unit[some] @ v.T
                            sims = np.clip(exact, 0, 1).round(6)
                            if k and sims.shape[1] > k:
                                least_kept = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]  # all ties of the last stay
                                q, x = np.nonzero((sims >= least_kept) & (sims >= least))
                            else:
                                q, x = np.nonzero((exact if k is None else sims) >= least)
                            if len(q):
                                found = batch.column("id").take(pa.array(at[x]))
                                yield pa.RecordBatch.from_arrays([pa.array(ids[some[q]].tolist()), found, pa.array(sims[q, x])], names=["query_id", "id", "similarity"])

            if wanted:
                rows = table.where(F.col("cell").isin(wanted)) if len(wanted) < len(centres) else table
                out.append(rows.mapInArrow(best, schema))
        found = self.spark.createDataFrame([], schema)
        for part in out:
            found = found.unionAll(part)
        return found

    def nearest(self, queries: DataFrame, k: int = 10, probes: int | None = None, least: float = 0.0) -> DataFrame:
        """(query_id, id, similarity, rank): the k nearest of each query (query_id, embedding) in
        its ``probes`` nearest cells, by cosine from 0 to 1, exact to six digits, ties by id."""
        def limits(state: dict, unit: np.ndarray) -> np.ndarray:
            centres = np.array(state["centres"])
            n = min(len(centres), probes or state["probes"])
            kth = [-np.partition(-(unit[some] @ centres.T), n - 1, axis=1)[:, n - 1 : n] for some in _slices(len(unit), len(centres))]
            return np.concatenate(kth or [np.zeros((0, 1))])

        place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
        return self._found(queries, limits, k, least).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    def within(self, queries: DataFrame, least: float) -> DataFrame:
        """(query_id, id, similarity): all vectors of a cosine of ``least`` or more. A cell is left
        out only if the angle to its centre, less the widest in it, is too wide."""
        def limits(state: dict, unit: np.ndarray) -> np.ndarray:
            reach = np.arccos(np.clip(np.array(state["widest"]), -1, 1)) + math.acos(max(-1.0, least - 1e-6)) + 1e-6
            return np.where(reach < np.pi, np.cos(np.minimum(reach, np.pi)), -2.0)[None, :]

        return self._found(queries, limits, None, least - 1e-12)
