"""Vector codes: product quantisation in integers, nearest entries found by a VA-file filter.

Components become integers and vectors are cut into parts, each with a codebook of 16 entries.
To find a part's nearest entry, the coordinates of the entries are quantised to a few bits:
each falls into one of ``CELLS`` cells between the least and greatest at its position. For a
query, a table per position gives the least and the greatest squared distance to each cell;
their sums bound the distance to each entry from below and above. Only entries whose lower
bound is not above the least upper bound are compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.workers import lean
from quern.storage import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
CELLS = 8
#: Components below this, in size, are taken as 64-bit numbers; above, as Python's integers.
NARROW = 1 << 26
#: Rows that are compared at once.
ROWS = 2_048
#: Labels whose sums are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 100_000


def integers(vectors: list[np.ndarray]) -> np.ndarray:
    """floor(SCALE * x) of vectors of one width, padded with zeros to a multiple of ``PARTS``."""
    x = np.stack(vectors).astype(np.float64)
    # Scaling by a power of two is exact unless it overflows.
    if x.size and np.abs(x).max() < NARROW / SCALE:
        out = np.floor(x * SCALE).astype(np.int64)
    else:
        out = np.array([[_floor(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return np.pad(out, ((0, 0), (0, -x.shape[1] % PARTS)))


def _floor(x: float) -> int:
    above, below = x.as_integer_ratio()
    return above * SCALE // below


class Codebook:
    """The entries of one part (entries x width) and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        low, high = entries.min(axis=0), entries.max(axis=0)
        step = (high - low) // CELLS + 1
        self.cells = ((entries - low) // step).astype(np.int64)
        # Cells hold the integers first..last.
        self.first = low[:, None] + step[:, None] * np.arange(CELLS).astype(entries.dtype)
        self.last = self.first + (step - 1)[:, None]

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows x entries) of squared distances, summed from tables."""
        below, above = self.first - x[:, :, None], x[:, :, None] - self.last
        zero = np.zeros_like(below)
        near = np.maximum(np.maximum(below, above), zero) ** 2
        far = np.maximum(np.abs(below), np.abs(above)) ** 2
        at = np.arange(x.shape[1])
        lower, upper = (np.stack([t[:, at, c].sum(axis=1) for c in self.cells], axis=1) for t in (near, far))
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry of each row, ties to the lower index, its squared distance, and how
        many exact distances it took."""
        if not x.shape[1]:
            return np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype), 0
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        exact = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
        # Rows in order, then distance, then index: the first of each row is its nearest.
        order = np.lexsort((entry, exact, row)) if exact.dtype != object else np.array(sorted(range(len(row)), key=lambda k: (row[k], exact[k], entry[k])), int)
        first = order[np.searchsorted(row[order], np.arange(len(x)))]
        return entry[first], exact[first], len(row)


def _wide(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit numbers where no distance can exceed them, else both as Python's integers."""
    if all(a.dtype != object and (not a.size or np.abs(a).max() < NARROW) for a in (x, entries)) and x.shape[1] < 512:
        return x, entries
    return x.astype(object), entries.astype(object)


def assign(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x parts) nearest entries and squared distances."""
    codes, errors = [], []
    for part, entries in zip(np.split(x, PARTS, axis=1), books):
        part, entries = _wide(part, entries)
        book, out = Codebook(entries), []
        for k in range(0, len(part), ROWS):
            out.append(book.nearest(part[k : k + ROWS])[:2])
        codes.append(np.concatenate([c for c, _ in out]))
        errors.append(np.concatenate([e for _, e in out]))
    return np.stack(codes, axis=1), np.stack(errors, axis=1)


def _good(rows: list[list[float] | None]) -> Iterator[tuple[int, np.ndarray]]:
    for k, row in enumerate(rows):
        if row is not None and None not in row:
            v = np.array(row, np.float64)
            if np.isfinite(v).all():
                yield k, v


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vector is whole, its width, and its components as 64-bit floats."""
    for batch in batches:
        good = list(_good(batch.column("v").to_pylist()))
        kept = batch.take(pa.array([k for k, _ in good], pa.int64())).select(["vec_id", "label"])
        columns = [*kept.columns, pa.array([len(v) for _, v in good], pa.int32()), pa.array([v.tobytes() for _, v in good], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "width", "vector"])


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    widths = batch.column("width").to_numpy()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        stored = batch.column("vector").take(pa.array(at)).to_pylist()
        yield int(width), at, integers([np.frombuffer(b, np.float64) for b in stored])


def _sums(books):
    """(width, part, entry, position, total, n): sums of the parts that each entry is nearest to;
    totals in decimal digits, as they may need more than 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in _by_width(batch):
                own = books.value[width]
                code, _ = assign(x, own)
                total = totals.setdefault(width, np.zeros((PARTS, ENTRIES, x.shape[1] // PARTS), object))
                count = counts.setdefault(width, np.zeros((PARTS, ENTRIES), np.int64))
                for p, part in enumerate(np.split(x, PARTS, axis=1)):
                    count[p] += np.bincount(code[:, p], minlength=ENTRIES)
                    for e in np.unique(code[:, p]):
                        total[p, e] += part[code[:, p] == e].sum(axis=0)
        rows = [(w, p, e, k, str(t), int(counts[w][p, e])) for w, a in totals.items() for (p, e, k), t in np.ndenumerate(a) if counts[w][p, e]]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["width", "part", "entry", "position", "total", "n"])

    return run


def _encoded(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = {w: digest(b) for w, b in books.value.items()}
        for batch in batches:
            code, error, digest_ = [None] * batch.num_rows, [None] * batch.num_rows, [None] * batch.num_rows
            for width, at, x in _by_width(batch):
                codes, errors = assign(x, books.value[width])
                for k, c, e in zip(at.tolist(), codes.astype(np.uint8), errors.sum(axis=1).tolist()):
                    code[k], error[k], digest_[k] = c.tobytes().hex(), int(e) if e < 1 << 63 else None, digests[width]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array(digest_, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def fit(kept: DataFrame, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """Codebooks by width from rows of ``vectors_of``: they begin as the vectors of the least ids
    (of equal ids, the least vectors; null ids last) and are replaced in each round by the floor
    of the mean of what is nearest. The driver holds 16 vectors for each width."""
    books: dict[int, list[np.ndarray]] = {}
    for (width,) in kept.select("width").distinct().orderBy("width").collect():
        least = kept.where(F.col("width") == width).orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()
        x = integers([np.frombuffer(bytes(r["vector"]), np.float64) for r in least])
        books[width] = np.split(x, PARTS, axis=1)
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(books)
        sums = kept.select("width", "vector").mapInArrow(lean(_sums(shared)), "width int, part int, entry int, position int, total string, n long")
        sums = sums.groupBy("width", "part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = {w: [b.copy() for b in own] for w, own in books.items()}
        for r in sums.collect():  # a number per component of the codebooks
            mean = int(r["total"]) // r["n"]
            own = books[r["width"]]
            if own[r["part"]].dtype != object and abs(mean) >= NARROW:
                own[r["part"]] = own[r["part"]].astype(object)
            own[r["part"]][r["entry"], r["position"]] = mean
    return books


def vectors_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, width, vector): the rows that get a code, written once."""
    kind = vectors.schema[label_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    return materialize(rows.mapInArrow(lean(_kept), f"vec_id long, label {kind}, width int, vector binary"), "vectors")


def encode(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each vector that is whole.

    Rows whose vector is null or holds a null or non-finite component are dropped. A component x
    becomes floor(4096 x). Vectors are cut into 8 equal parts, padded with zeros where their
    width is no multiple of 8; each width has codebooks of its own, of fewer than 16 entries
    where fewer vectors have it. Repeated rows and ids are vectors of their own. error is the
    squared distance, summed over the parts, null beyond 64 bits; label_error its sum over
    equal labels, nulls together. Components up to 2^80 are exact; sums of larger ones may
    exceed 38 digits. An empty table gives no rows; other columns are not read."""
    spark = vectors.sparkSession
    kept = vectors_of(vectors, id_col, vec_col, label_col)
    kind = kept.schema["label"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(fit(kept, rounds))
    schema = f"vec_id long, label {kind}, code string, error long, codebooks_sha256 string"
    coded = materialize(kept.mapInArrow(lean(_encoded(shared)), schema), "codes")
    totals = materialize(coded.groupBy("label").agg(F.expr("try_sum(error)").alias("label_error")), "label_errors")
    few = totals.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    totals = totals.withColumnRenamed("label", "of")
    joined = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
