"""Embedding near-duplicates: cross-polytope hashing, multiprobe buckets, verified pairs.

A vector is rotated by sign flips and fast Hadamard transforms, three rounds, and its hash
is the nearest signed axis; two such hashes name a bucket of a table. Each vector lives in
its home bucket of every table and also visits the buckets of its second-nearest axes.

Buckets get ids and short codes, a few bits a coordinate, whose angle to the vector is known:
by the triangle inequality of angles a code tells pairs that cannot reach the cosine. Only
rows that keep a partner bring their vectors, and those pairs are verified by their cosine in
double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.components import Forest, components
from quern.llm.groups import runs, whole_groups
from quern.storage import materialize

SEED = 20_240_229
#: Rows of a bucket that one task compares; a larger bucket is split into blocks, and a
#: task takes each pair of blocks.
BLOCK = 4_096
_BLOCKS = 1 << 10
#: Rows that are compared with a block's at once.
ROWS = 256
#: Groups up to this size are compared many at once.
SMALL = 64
#: Step of the codes' quantiser by bits, in standard deviations of a rotated coordinate.
STEPS = {2: 0.996, 3: 0.586}
#: Split buckets (16 bytes each) that are broadcast; beyond, the join is a shuffle.
MOST_BROADCAST = 100_000


def padded_width(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def tables_for(dim: int) -> int:
    """Tables by width: the chance that a pair at cosine 0.9 meets in one falls with every
    doubling of the width, so wider vectors get more (6 up to 64 dimensions, 10 at 1,024)."""
    return max(6, padded_width(dim).bit_length() - 1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the Hadamard matrix, in n log n steps; the width is a power of two."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        v = x.reshape(len(x), -1, 2, h)
        x = np.stack([v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]], axis=2).reshape(len(x), -1)
        h *= 2
    return x


def bucket_keys(vectors: np.ndarray, tables: int | None = None, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 3) bucket keys: home, then the second axis of either hash."""
    n, dim = vectors.shape
    tables, width = tables or tables_for(dim), padded_width(dim)
    padded = np.zeros((n, width))
    padded[:, :dim] = vectors
    signs = np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, 2, 3, width))
    out = np.empty((n, tables, 3), np.int64)
    axes = 2 * width
    for t in range(tables):
        best = []
        for k in range(2):
            x = padded
            for flip in signs[t, k]:
                x = hadamard(x * flip)
            top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            high = np.take_along_axis(x, top, 1)
            swap = np.abs(high[:, 0]) < np.abs(high[:, 1])
            top[swap], high[swap] = top[swap, ::-1], high[swap, ::-1]
            best.append(2 * top + (high < 0))
        a, b = best
        first = ((t + 1) * axes + a) * axes
        out[:, t, 0] = first[:, 0] + b[:, 0]
        out[:, t, 1] = first[:, 1] + b[:, 0]
        out[:, t, 2] = first[:, 0] + b[:, 1]
    return out


def _rows(column: pa.Array) -> list[np.ndarray]:
    """Vectors of a column of lists; empty where the list is null or holds a null."""
    values = column.values.to_numpy(zero_copy_only=False)  # nulls become NaN, which links with nothing either
    begin = column.offsets.to_numpy()
    empty = column.is_null().to_numpy(zero_copy_only=False)
    return [values[0:0] if none else values[a:b] for a, b, none in zip(begin[:-1].tolist(), begin[1:].tolist(), empty.tolist())]


def _meet(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least key of the buckets in which two rows of keys are candidates."""
    most = np.iinfo(np.int64).max
    one = np.where(x[:, :, :1] == y, y, most).min(axis=(1, 2))
    two = np.where(y[:, :, :1] == x, x, most).min(axis=(1, 2))
    return np.minimum(one, two)


VECTORS = "vec_id long, key binary, dim int, vector binary"


def _units(vectors: list[bytes], dtype: str, dim: int) -> np.ndarray:
    """Stored vectors of one width as unit rows in double precision."""
    v = np.frombuffer(b"".join(vectors), dtype).reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _prepared(vectors: DataFrame, id_col: str, vec_col: str, dtype: str) -> DataFrame:
    """(vec_id, key, dim, vector): a digest of the direction, and the components in the
    precision that the table has; null for vectors that link with nothing."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows(batch.column(1))
            key, vector, dim = [None] * len(rows), [None] * len(rows), [None] * len(rows)
            for k, row in enumerate(rows):
                top = np.abs(row).max() if len(row) else 0.0
                if np.isfinite(top) and top > 0:
                    v = row / top
                    v = v / np.sqrt(v @ v)
                    vector[k], dim[k] = row.astype(dtype).tobytes(), len(v)
                    key[k] = hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(key, pa.binary()), pa.array(dim, pa.int32()), pa.array(vector, pa.binary())], names=["vec_id", "key", "dim", "vector"]
            )

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(run, VECTORS)


def _bits(width: int) -> int:
    """Bits a coordinate: cosines of unlike vectors spread less the wider they are, so coarser codes tell them."""
    return 3 if width <= 256 else 2


def codes(units: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Codes of unit rows, 2 or 3 bits a coordinate after a rotation, and their angles to the rows."""
    n, dim = units.shape
    width = padded_width(dim)
    padded = np.zeros((n, width))
    padded[:, :dim] = units
    signs = np.random.default_rng([seed, width, 2]).choice([-1.0, 1.0], width)
    turned = hadamard(padded * signs)  # coordinates times the root of the width: about normal, of deviation 1
    half = 1 << (_bits(width) - 1)
    level = (np.clip(np.floor(turned / STEPS[_bits(width)]), -half, half - 1) + half).astype(np.uint8)
    bits = np.packbits(np.concatenate([level >> k & 1 for k in range(_bits(width))], axis=1), axis=1)
    cosine = np.einsum("ij,ij->i", turned, decoded(bits, width)) / np.sqrt(width)
    return bits, np.arccos(np.clip(cosine, -1, 1))


def decoded(bits: np.ndarray, width: int) -> np.ndarray:
    """Unit rows that codes stand for, in the rotated coordinates."""
    planes = np.unpackbits(bits, axis=1, count=_bits(width) * width).reshape(len(bits), _bits(width), width)
    q = np.tensordot(planes, 2.0 ** np.arange(_bits(width)), (1, 0)) - ((1 << _bits(width)) - 1) / 2
    return q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]


HASHED = "node long, least long, n long, key binary, dim int, vector binary, buckets array<long>, code binary"


def _hashed(reps: DataFrame, tables: int | None, dtype: str) -> DataFrame:
    """``reps`` with the buckets of each vector (of every table the home, then two visited) and
    its code, which ends with its angle to the vector and the vector's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                for k in range(0, part.num_rows, 1024):
                    rows = part.slice(k, 1024)
                    units = _units(rows.column("vector").to_pylist(), dtype, dim)
                    keys = bucket_keys(units, tables).reshape(len(units), -1)
                    bits, angle = codes(units)
                    ends = np.stack([angle.astype(np.float32).view(np.int32), np.full(len(angle), dim, np.int32)], axis=1)
                    whole = np.concatenate([bits, ends.view(np.uint8)], axis=1)
                    offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*(rows.column(c) for c in ("node", "least", "n", "key", "dim", "vector")), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1))), pa.array([r.tobytes() for r in whole], pa.binary())],
                        names=["node", "least", "n", "key", "dim", "vector", "buckets", "code"],
                    )

    return reps.mapInArrow(run, HASHED)


def _above(left: np.ndarray, right: np.ndarray, begin: np.ndarray, end: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places x < y of one group (rows begin to end) whose product left[x] right[y] is at least
    ``floor``, in blocks of bounded size."""
    sizes, most = end - begin, max(1, (1 << 20) // left.shape[1])
    for size in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        i, j = np.triu_indices(size, 1)
        starts, step = begin[sizes == size], max(1, most // len(i))
        for k in range(0, len(starts), step):
            x, y = (starts[k : k + step, None] + i).ravel(), (starts[k : k + step, None] + j).ravel()
            keep = np.einsum("ij,ij->i", left[x], right[y]) >= floor
            yield x[keep], y[keep]
    for a, b in zip(begin[sizes > SMALL], end[sizes > SMALL]):
        for k in range(a, b, ROWS):
            x, y = np.nonzero(left[k : min(k + ROWS, b)] @ right[k:b].T >= floor)
            yield x[x < y] + k, y[x < y] + k


def _alike(pairs: Iterator[tuple[np.ndarray, np.ndarray]], task: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of ``pairs`` that this task has to judge: one of the two is at home in the bucket,
    and where the task is of two blocks, each is of another."""
    home, block, cross = place % 2 == 1, place // 2, (task // _BLOCKS) % _BLOCKS != task % _BLOCKS
    for x, y in pairs:
        keep = (home[x] | home[y]) & (~cross[x] | (block[x] != block[y]))
        if keep.any():
            yield x[keep], y[keep]


def _by_width(table: pa.Table, width: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows of one width by task, their tasks, and begin and end of each task's rows."""
    for w in np.unique(width):
        part = table.filter(pa.array(width == w)) if (width != w).any() else table
        task = part["task"].to_numpy()
        yield part, task, *runs(task), int(w)


def _kept(least: float):
    """Rows of each task that have a partner there which their codes don't rule out."""
    names, limit = ["task", "node", "place"], float(np.arccos(np.clip(least, -1, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            width = np.array([int.from_bytes(c[-4:], "little") for c in table["code"].to_pylist()])
            for part, task, begin, end, dim in _by_width(table, width):
                place, size = part["place"].to_numpy(), padded_width(dim)
                whole = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(len(task), -1)
                q = decoded(whole[:, :-8], size).astype(np.float32)
                angle = np.ascontiguousarray(whole[:, -8:-4]).view(np.float32)[:, 0].astype(np.float64)
                # The angle of two vectors is at least that of their codes less both codes' own; a pair
                # stays if cos(codes) >= cos(limit + one + other), one product by the sum of angles.
                one = np.stack([-np.cos(limit + angle), np.sin(limit + angle)], axis=1)
                other = np.stack([np.cos(angle), np.sin(angle)], axis=1)
                left, right = np.concatenate([q, one], axis=1, dtype=np.float32), np.concatenate([q, other], axis=1, dtype=np.float32)
                wide = angle > (np.pi - limit) / 2 - 0.001  # sums of angles may pass a half turn: such rows rule nothing out
                left[wide], right[wide] = 0, 0
                some = np.zeros(len(task), bool)
                for x, y in _alike(_above(left, right, begin, end, -1e-4), task, place):
                    some[x] = some[y] = True
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(task[some]), part["node"].to_numpy()[some], pa.array(place[some])], names=names)

    return run


def _found(least: float, dtype: str):
    """Links of each row that its task counts, and the least row that it reaches there."""
    names = ["node", "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            for part, task, begin, end, dim in _by_width(table, table["dim"].to_numpy()):
                v = _units(part["vector"].to_pylist(), dtype, dim)
                keys = part["buckets"].combine_chunks().flatten().to_numpy().reshape(len(task), -1, 3)
                node, n, bucket = part["node"].to_numpy(), part["n"].to_numpy(), task // (_BLOCKS * _BLOCKS)
                links, forest = np.zeros(len(v)), Forest(len(v))
                for x, y in _alike(_above(v, v, begin, end, least), task, part["place"].to_numpy()):
                    first = np.concatenate([_meet(keys[x[c : c + 16_384]], keys[y[c : c + 16_384]]) for c in range(0, len(x), 16_384)]) == bucket[x]
                    x, y = x[first], y[first]
                    links += np.bincount(x, n[y], len(v)) + np.bincount(y, n[x], len(v))
                    forest.join(x, y)
                some = links > 0
                if some.any():
                    yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(node[forest.root[some]])], names=names)

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.9, tables: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``.

    Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, and so do vectors of different length. Equal vectors (same direction) are one
    node of the search: n_links counts all other rows linked directly, copies included.
    Nodes are numbered, whatever their ids: rows that repeat an id are vectors of their own,
    and rows without one link and join others like any row. component_id is the smallest id
    reached, null (and kept false) where no row reached has one. Empty tables give no rows;
    other columns are not read. ``tables`` is chosen from the width unless it is given.

    A pair that meets in several buckets counts in the one with the least key only, so
    counts need no distinct. A task returns counts and a spanning forest, not pairs. Codes
    rule out only pairs whose cosine is below ``least``, so they lose no link.
    """
    dtype = "<f4" if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"
    rows = materialize(_prepared(vectors, id_col, vec_col, dtype), "vectors")
    reps = rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("dim").alias("dim"), F.first("vector").alias("vector")
    )
    reps = materialize(_hashed(reps.withColumn("node", F.monotonically_increasing_id()), tables, dtype), "representatives")  # numbered once, as written
    entries = reps.select(F.posexplode("buckets").alias("at", "bucket"), "node", "code")
    large = entries.groupBy("bucket").count().where(F.col("count") > BLOCK)
    large = large.select("bucket", F.ceil(F.col("count") / F.greatest(F.lit(BLOCK), F.ceil(F.col("count") / (_BLOCKS - 1)))).cast("int").alias("blocks"))
    large = materialize(large, "large")
    few = large.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    entries = entries.join(F.broadcast(large) if few else large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    entries = entries.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.least("block", "other") * _BLOCKS + F.greatest("block", "other")
    place = F.col("block") * 2 + (F.col("at") % 3 == 0).cast("int")
    tasks = entries.select((F.col("bucket") * (_BLOCKS * _BLOCKS) + pair).alias("task"), "node", place.alias("place"), "code")
    kept = tasks.repartition("task").sortWithinPartitions("task").mapInArrow(_kept(least), "task long, node long, place int")
    kept = materialize(kept, "candidates").join(reps.select("node", "n", "dim", "vector", "buckets"), "node")
    found = kept.repartition("task").sortWithinPartitions("task").mapInArrow(_found(least, dtype), "node long, links long, root long")
    found = materialize(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select("node", "root")).withColumnRenamed("component", "root")
    placed = reps.select("key", "node", "least", "n").join(reached, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    per_key = placed.join(ids, "root").join(counts, "node", "left")
    per_key = per_key.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(per_key, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
