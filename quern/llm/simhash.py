"""SimHash near-duplicates: fingerprints linked by an exact search in a vantage-point tree.

The tree is fitted on a bounded sample of the fingerprints. A node takes one fingerprint of
its own as vantage point and splits by the distance to it, at the median, quartiles and so on
of what its sample holds: a child is an interval of distances. A level measures distance on a
block of bits of its own. For a query at distance d, a child of the interval [low, high] holds
matches within radius r only if d + r >= low and d - r <= high (triangle bound); as the blocks
of levels are disjoint, what a query spends on one bound is gone from its radius, so that a
query descends with what is left of it. Below the fitted nodes, whose sample is used up, every
distance is a child. Leaves are the shards: each fingerprint lives in its home leaf and visits
the leaves that its radius overlaps. Every pair within the radius meets in the larger of their
two home leaves, so none is lost, whatever the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import Forest, components
from quern.llm.groups import runs, whole_groups
from quern.llm.workers import lean
from quern.storage import materialize

#: Fingerprints that the tree is fitted on at most (8 bytes each); all are searched.
MOST_SAMPLE = 1 << 16
#: A node with fewer sampled fingerprints isn't fitted. At 1,000 bytes a node, the tree that is
#: sent to executors stays below 10 MB.
LEAST_SAMPLE = 32
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17
#: Homes of a leaf that one task takes; a larger leaf is split into several.
LEAF_HOMES = 50_000
#: Cells of one comparison matrix.
CELLS = 1 << 20


def fingerprint(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text over hashed word shingles, repeats included.

    A-Z are lower-cased and words are runs of anything but ASCII white space. A text with
    fewer words than a shingle is one shingle; one without words (null, empty) gives 0.
    A bit is set if more than half of the shingles' XXH64 (seed 42) have it.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    ends: list[int] = []
    where: list[int] = []

    def ones_of(starts: list[int]) -> np.ndarray:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)

    def packed(ones: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8")[:, 0]

    def close() -> None:
        if where:
            out[where] = packed(ones_of([0, *ends[:-1]]), np.diff([0, *ends]))
        hashes.clear(), ends.clear(), where.clear()

    for k, text in enumerate(texts):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        count = max(1, len(words) - shingle + 1)
        if count > CHUNK:  # counted by parts, so that only a part's hashes are held
            close()
            ones = np.zeros((1, 64), np.int64)
            for at in range(0, count, CHUNK):
                part = words[at : at + CHUNK + shingle - 1]
                hashes += [digest(run, 42) for run in map(b" ".join, zip(*(part[i:] for i in range(shingle))))]
                ones += ones_of([0])
                hashes.clear()
            out[k] = packed(ones, np.array([count]))[0]
            continue
        if len(words) <= shingle:
            hashes.append(digest(b" ".join(words), 42))
        else:
            hashes += [digest(run, 42) for run in map(b" ".join, zip(*(words[i:] for i in range(shingle))))]
        ends.append(len(hashes))
        where.append(k)
        if len(hashes) > CHUNK:
            close()
    close()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprint(batch.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, fp long")


def _blocks(levels: int) -> list[int]:
    """Disjoint masks of about equal width that cover 64 bits."""
    edges = [64 * k // levels for k in range(levels + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def levels_for(n: int) -> int:
    """Depth of the tree for ``n`` fingerprints: any depth gives the same pairs.

    Of random fingerprints, about 1.4 % share a leaf at 4 levels, and each further level
    divides that by 2.5, while a fingerprint is in 21 leaves at 4 levels, 43 at 6, 73 at 8
    and 145 at 12. So the candidates of a fingerprint stay at about ten thousand."""
    return max(4, min(16, math.ceil(4 + (math.log10(max(1, n)) - 5.85) / 0.4)))


@dataclass
class Tree:
    """Fitted nodes as arrays: vantage point, and for each child its interval of distances and
    its node (-1: not fitted). Node 0 is the root."""

    masks: np.ndarray
    vantage: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.vantage, self.low, self.high, self.child))

    def _reached(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf): the leaves that the radius of each fingerprint reaches, once each."""
        n, slots = len(fps), self.low.shape[1]
        at, leaf, left = np.arange(n), np.zeros(n, np.int64), np.full(n, radius, np.int16)
        node, vantage = np.zeros(n, np.int32), np.zeros(n, np.uint64)
        for mask in self.masks:
            fitted = node >= 0
            vantage = np.where(fitted, self.vantage[node], vantage)  # below the fitted nodes, the last one's
            d = np.bitwise_count((fps[at] ^ vantage) & mask).astype(np.int16)
            parts = []
            for c in range(slots):
                low, high = np.where(fitted, self.low[node, c], c), np.where(fitted, self.high[node, c], c)
                cost = np.maximum(np.maximum(low - d, d - high), 0)
                some = np.flatnonzero((cost <= left) & (low <= high))
                parts.append((some, np.full(len(some), c), cost[some]))
            pick, slot, cost = (np.concatenate([p[k] for p in parts]) for k in range(3))
            node = np.where(node[pick] >= 0, self.child[node[pick], slot], -1).astype(np.int32)
            at, vantage, left, leaf = at[pick], vantage[pick], left[pick] - cost, leaf[pick] * slots + slot
        return at, leaf

    def descend(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, leaf, home): the leaves from its home leaf on that each fingerprint reaches."""
        own = np.empty(len(fps), np.int64)
        at, leaf = self._reached(fps, 0)
        own[at] = leaf
        at, leaf = self._reached(fps, radius)
        keep = leaf >= own[at]
        return at[keep], leaf[keep], (leaf == own[at])[keep]


def fit_tree(sample: np.ndarray, levels: int, least: int | None = None) -> Tree:
    """A tree over sampled fingerprints, breadth first; the root is fitted on any sample. A node's vantage point is its sample's
    first fingerprint in a hashed order, and its children are cut where the sample's distances
    pass equal shares, so that a child holds a fair part of them or a single distance."""
    least = LEAST_SAMPLE if least is None else least
    masks = np.array(_blocks(levels), np.uint64)
    slots = -(-64 // levels) + 1
    sample = sample if len(sample) else np.zeros(1, np.uint64)
    queue = [(sample[np.argsort(sample * np.uint64(0x9E3779B97F4A7C15), kind="stable")], 0)]
    vantage, lows, highs, children = [], [], [], []
    done = 0
    while done < len(queue):
        mine, level = queue[done]
        queue[done] = (mine[:0], level)
        done += 1
        v, width = mine[0], int(masks[level]).bit_count()
        d = np.bitwise_count((mine ^ v) & masks[level]).astype(int)
        share = np.bincount(d, minlength=width + 1)
        low, high, child = np.full(slots, 99, np.int16), np.full(slots, -1, np.int16), np.full(slots, -1, np.int32)
        begin = held = slot = 0
        for x in range(width + 1):
            held += share[x]
            if x == width or held * 2 * (width + 1) >= len(mine):
                low[slot], high[slot] = begin, x
                inside = mine[(d >= begin) & (d <= x)]
                if level + 1 < levels and len(inside) >= least:
                    child[slot] = len(queue)
                    queue.append((inside, level + 1))
                begin, held, slot = x + 1, 0, slot + 1
        vantage.append(v)
        lows.append(low)
        highs.append(high)
        children.append(child)
    return Tree(masks, np.array(vantage, np.uint64), np.array(lows), np.array(highs), np.array(children))


def sampled(fps: DataFrame, n: int) -> np.ndarray:
    """An eighth of ``n`` fingerprints, ``MOST_SAMPLE`` at most, chosen by their hashes."""
    part = 1 << 30
    share = min(1 / 8, 0.95 * MOST_SAMPLE / max(1, n))
    rows = fps.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(part)) < int(part * share)).limit(MOST_SAMPLE)
    return np.sort(np.array([r[0] for r in rows.collect()], np.int64)).view(np.uint64)


def descend(fps: DataFrame, radius: int, tree: Tree) -> DataFrame:
    """(fp, rep, leaf, home): each fingerprint in its home leaf and in the later leaves
    that its radius reaches."""
    shared = fps.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                rows = batch.slice(k, 8192)
                at, leaf, home = shared.value.descend(rows.column(0).to_numpy().view(np.uint64), radius)
                spread = rows.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([spread.column(0), spread.column(1), pa.array(leaf), pa.array(home)], names=["fp", "rep", "leaf", "home"])

    return fps.select("fp", "rep").mapInArrow(lean(run), "fp long, rep long, leaf long, home boolean")


def near(homes: np.ndarray, visitors: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (visitor, home) within the radius, in blocks of bounded size."""
    step = max(1, CELLS // max(1, len(homes)))
    for k in range(0, len(visitors), step):
        v, h = np.nonzero(np.bitwise_count(visitors[k : k + step, None] ^ homes[None, :]) <= radius)
        yield v + k, h


def links(fps: DataFrame, radius: int = 2, levels: int | None = None) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct fingerprints at
    Hamming distance <= ``radius``. ``fps`` has one row (fp, rep) per fingerprint.

    A task returns a spanning forest of the pairs that it finds, not the pairs.
    """
    fps = materialize(fps.select("fp", "rep"), "fingerprints")
    n = fps.count()
    tree = fit_tree(sampled(fps, n), levels or levels_for(n))
    walk = materialize(descend(fps, radius, tree), "walk")
    # Only leaves with very many homes: at most one per LEAF_HOMES fingerprints.
    sizes = walk.where("home").groupBy("leaf").count().where(F.col("count") > LEAF_HOMES)
    sizes = sizes.select("leaf", F.ceil(F.col("count") / LEAF_HOMES).cast("int").alias("parts"))
    walk = walk.join(sizes, "leaf", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("home"), F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).otherwise(F.lit(0))
    walk = walk.withColumn("own", part)
    walk = walk.select("fp", "rep", "leaf", "home", "own", F.explode(F.sequence(F.col("own"), F.col("parts") - 1)).alias("part"))
    walk = walk.withColumn("home", F.col("home") & (F.col("own") == F.col("part")))

    names = ["a", "b"]

    def leaf_edges(fp: np.ndarray, rep: np.ndarray, home: np.ndarray) -> list[np.ndarray]:
        at, forest = np.flatnonzero(home), Forest(len(fp))
        for v, h in near(fp[at], fp, radius):
            forest.join(v, at[h])
        child = np.flatnonzero(forest.root != np.arange(len(fp)))
        return [rep[child], rep[forest.root[child]]]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            task, home = table["task"].to_numpy(), table["home"].to_numpy()
            fp, rep = table["fp"].to_numpy().view(np.uint64), table["rep"].to_numpy()
            begin, end = runs(task)
            some = (end - begin > 1) & np.logical_or.reduceat(home, begin)
            found = [leaf_edges(fp[a:b], rep[a:b], home[a:b]) for a, b in zip(begin[some].tolist(), end[some].tolist())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=names)

    parts = 1 << 16
    tasks = walk.select((F.col("leaf") * parts + F.col("part")).alias("task"), "home", "fp", "rep")
    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(lean(pairs), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3, levels: int | None = None
) -> DataFrame:
    """(id, fp, component): one row per row of ``docs``.

    component is the smallest id that links of at most ``radius`` bits reach. Equal
    fingerprints (exact copies, and all texts without words) are one node of the search,
    so copies are never paired with each other. Rows without an id link, and join others,
    like any row; component is null where no row that is reached has an id; repeated rows
    are returned repeated; an empty table gives no rows; further columns of ``docs`` are
    not read.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    fps = marks.groupBy("fp").agg(F.min("id").alias("least"))
    found = components(links(fps.select("fp", F.col("fp").alias("rep")), radius, levels))
    placed = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component"))
    reached = placed.join(groups, "root").select("fp", "component")
    return marks.join(reached, "fp").select("id", "fp", "component")
