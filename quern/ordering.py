"""Numbering rows in a total order without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import materialize


def with_place(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """``rows`` with their place from 1 in the given order (ties in any, but one, order).

    Rows are dealt by ranges of the order, sorted and written; a partition's places begin
    behind the counts of those before it, one row per partition."""
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"__part": F.spark_partition_id(), "__index": index}), "places")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    bases = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("base"))
    placed = ranged.join(F.broadcast(bases), "__part")  # a row per partition
    return placed.withColumn(name, (F.col("base") + F.col("__index") + 1).cast("long")).drop("__part", "__index", "base")
