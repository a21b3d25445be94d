"""Near-duplicates by Jaccard similarity of word shingles: MinHash bands, then exact sets.

Texts that share a band of MinHash values are candidates; components of candidates are
clusters, and inside a cluster the shingle sets themselves are compared, so that no pair
below the threshold is linked. A pair at similarity s shares a band with probability
1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8 and over 0.99999 at 0.86.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.components import components
from quern.llm.groups import runs, whole_groups
from quern.llm.workers import lean
from quern.storage import materialize

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 24, 6
#: Texts of a block; all pairs of a cluster's blocks are compared, each in one group.
BLOCK = 512
#: Shingles whose MinHash values are computed at once.
CHUNK = 1 << 15

_rng = np.random.default_rng(20)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words as SimHash takes them: A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _node(words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(b" ".join(words), 7)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the runs of five words, repeats included; a shorter text is one shingle."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = np.fromiter(map(digest, words), np.uint64, len(words))
    if len(w) < SHINGLE:
        return np.array([_node(words)], np.uint64) if len(w) else w
    n = len(w) - SHINGLE + 1
    return _mixed(sum(w[k : k + n] * _PLACE[k] for k in range(SHINGLE)))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys (BANDS a row) of non-empty shingle arrays."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.stack([np.minimum.reduceat((flat ^ m) * a, starts) for m, a in zip(_MASK, _ODD)], axis=1)
    return _mixed((_mixed(least.reshape(-1, BANDS, ROWS)) * _BAND).sum(axis=2, dtype=np.uint64))


#: Columns that tell a row's text: two hashes of it, 96 bits.
TEXT_KEY = ("text_hash", "text_hash2")


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(TEXT_KEY[0]), F.hash(text).alias(TEXT_KEY[1])]


def marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, text_hash2, node, fp, bands) per row: fp is op9's SimHash; texts without words have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys: list = [None] * len(texts)
            node = np.zeros(len(texts), np.uint64)
            held: list[np.ndarray] = []
            at: list[int] = []

            def close() -> None:
                if held:
                    for k, row in zip(at, bands(held).view(np.int64)):
                        keys[k] = row
                    held.clear(), at.clear()

            size = 0
            for k, text in enumerate(texts):
                words = words_of(text)
                node[k] = _node(words)
                if words:
                    held.append(shingles(words))
                    at.append(k)
                    size += len(held[-1])
                if size > CHUNK:
                    close()
                    size = 0
            close()
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(node.view(np.int64)), pa.array(simhash.fingerprint(texts).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *TEXT_KEY, "node", "fp", "bands"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *text_key(text), text.alias("text"))
    return rows.mapInArrow(lean(run), "id long, text_hash long, text_hash2 int, node long, fp long, bands array<long>")


def alike(sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """Edges whose components are those of all pairs of similarity >= ``least``.

    A search from each text in turn over the texts not yet reached. A match holds at least
    ``least`` of the text's shingles, so it holds one of any len - ceil(least * len) + 1 of
    them: only the texts that hold one of the rarest so many are compared."""
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    holders, count = owner[order], np.bincount(flat)
    ends = np.cumsum(count)
    mine = np.split(flat, np.cumsum(sizes)[:-1])
    left = np.ones(len(sets), bool)
    inside = np.zeros(len(count), bool)
    found: list[tuple[int, int]] = []
    for seed in range(len(sets)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            s = mine[x]
            few = s[np.argsort(count[s], kind="stable")[: len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1]]
            near = np.unique(np.concatenate([holders[ends[f] - count[f] : ends[f]] for f in few]))
            inside[s] = True
            for y in near[left[near]].tolist():
                both = int(inside[mine[y]].sum())
                if both >= least * (len(s) + len(mine[y]) - both) - 1e-9:
                    left[y] = False
                    queue.append(y)
                    found.append((x, y))
            inside[s] = False
    return found


def links(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b): edges between nodes of Jaccard similarity >= LEAST. ``found`` are marks of ``docs``."""
    keyed = found.where("bands is not null").select("node", F.explode("bands").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    stars = keyed.join(shared.select("key", "least"), "key").where("node <> least").select("node", "least")
    clusters = materialize(components(stars).withColumnRenamed("component", "cluster"), "clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    placed = clusters.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tasks = placed.withColumn("other", other).select("node", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"))

    # One text stands for each node; rows are found by the hashes of their text, in the JVM.
    chosen = found.join(clusters.select("node"), "node", "left_semi").groupBy("node").agg(F.min(F.struct(*TEXT_KEY)).alias("k")).select("node", "k.*")
    text = F.col(text_col).cast("string")
    texts = docs.select(*text_key(text), text.alias("text")).join(chosen, list(TEXT_KEY)).groupBy("node").agg(F.first("text").alias("text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task"):
            node, texts = table["node"].to_numpy(), table["text"]
            left, right = [], []
            for a, b in zip(*(x.tolist() for x in runs(table["task"].to_numpy()))):
                if b - a < 2:
                    continue
                sets = [np.unique(shingles(words_of(t))) for t in texts.slice(a, b - a).to_pylist()]
                for x, y in alike(sets):
                    left.append(node[a + x])
                    right.append(node[a + y])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    dealt = texts.join(tasks, "node").select("task", "node", "text")
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(lean(compare), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, text_hash2, grp): one row per row of ``docs``; rows of a group are near-duplicates.

    Linked are texts of equal words, of Jaccard similarity >= 0.8 on runs of five words, or
    within op9's 2 bits of SimHash, whatever the rows' ids: rows without an id link like the
    others, and different texts that repeat an id are rows of their own. Texts without words,
    null ones among them, are one group; an empty table gives no rows."""
    found = materialize(marks(docs, id_col, text_col), "jaccard")
    fps = found.groupBy("fp").agg(F.min("node").alias("rep"))
    same = found.select("fp", "node").distinct().join(fps, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    edges = links(docs, found, text_col).unionAll(simhash.links(fps)).unionAll(same)
    groups = components(edges)
    return found.select("id", *TEXT_KEY, "node").join(groups, "node", "left").select("id", *TEXT_KEY, F.coalesce("component", "node").alias("grp"))


def kept_rows(groups: DataFrame) -> DataFrame:
    """(no_id, id, text_hash, text_hash2, n): the row that stays of each group, that of the
    smallest id (rows without one last) and hash; ``n`` rows of it are equal in id and text."""
    rows = groups.groupBy("grp", "id", *TEXT_KEY).agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), *TEXT_KEY, "n")).alias("best")
    return rows.groupBy("grp").agg(best).select("best.*")
