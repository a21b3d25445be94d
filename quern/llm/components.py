"""Connected components of an edge table, without bringing edges to the driver.

Alternating large-star and small-star rounds (Kiveris et al., 2014): every round hangs
neighbours on smaller ones until each component is a star around its smallest node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import delete, new_folder

MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(least.select("u", "m")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two columns of longs), the component
    being its smallest node. Loops and repeated edges change nothing; no edges, no rows;
    edges with a null end are left out.

    A node with very many neighbours is a long run of one join key, which adaptive
    execution splits; the rounds grow with the logarithm of the node count.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    root = new_folder(spark, "components")
    now = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    now = now.where("a is not null and b is not null and a <> b").distinct()
    seen, last = None, None
    for k in range(MOST_ROUNDS):
        path = f"{root}/{k}"
        step = now if k == 0 else _small_star(_large_star(now))
        step.write.parquet(path)
        now = spark.read.schema(step.schema).parquet(path)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last:
            delete(spark, last)
        if not mark[0] or (k > 1 and mark == seen):
            break
        seen, last = mark, path
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())


def spanning(n: int, left, right):
    """Least-index roots of ``n`` items after joining each left[i] with right[i]."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(left, right):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


class Forest:
    """Components of ``n`` items under pairs that come in blocks, in memory for the items alone.

    ``root`` holds the least item of each one's component at any time."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins x[i] with y[i]; pairs that are joined already cost a comparison."""
        a, b = self.root[x], self.root[y]
        apart = a != b
        if not apart.any():
            return
        a, b, n = a[apart], b[apart], len(self.root)
        low, high = np.divmod(np.unique(np.minimum(a, b) * n + np.maximum(a, b)), n)
        used = np.unique(np.concatenate([low, high]))
        new = np.arange(n)
        new[used] = used[spanning(len(used), np.searchsorted(used, low).tolist(), np.searchsorted(used, high).tolist())]
        self.root = new[self.root]
