"""A keyed table as sorted runs in levels: batches of rows and removals, merged in the background.

A batch becomes a run of level 0: files sorted by key, whose least and greatest keys stand in
the table's state, so that a read of some keys opens only files that may hold them. A newer
run's row, or removal, hides older ones of its key. Once a level has ``fanout`` runs they are
merged with the next level into one run there; removals are dropped on the last level. Every
change is one new state (``Versions``); folders that no state needs stay until ``vacuum``, so
whoever reads during a compaction goes on with what it has."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.sources.versions import Versions

REMOVED = "__removed"
#: Rows of a run to a file.
FILE_ROWS = 1_000_000


def _schema(text: str | None) -> StructType:
    return StructType.fromJson(json.loads(text)) if text else StructType([])


class SortedRuns:
    """Rows by ``key``, a string or integer column. Null keys, and a key that repeats within one
    batch, raise. Columns may be added by later batches; older rows have null there."""

    def __init__(self, spark: SparkSession, folder: str, key: str, fanout: int = 4):
        self.spark, self.versions, self.key, self.fanout = spark, Versions(spark, folder), key, fanout

    def _state(self) -> dict:
        return self.versions.newest()[1] or {"runs": [], "next": 1, "schema": None}

    def write(self, rows: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Puts ``rows`` and removes the keys of ``removed`` (column of the key), as one batch. A
        key in both is put. Removing what is not there changes nothing that is read."""
        parts = [rows.withColumn(REMOVED, F.lit(False))] if rows is not None else []
        if removed is not None:
            keys = removed.select(self.key).distinct()
            keys = keys.join(rows.select(self.key), self.key, "left_anti") if rows is not None else keys
            parts.append(keys.withColumn(REMOVED, F.lit(True)))
        batch = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        n, keys = batch.agg(F.count("*"), F.countDistinct(self.key)).first()
        if n != keys:
            raise ValueError("keys of a batch are unique and not null")
        if n:
            schema = rows.schema if rows is not None else None
            made = self._written(batch, n)
            self.versions.change(lambda state: self._with(state or self._state(), made, schema))
        while self.compact():
            pass
        return self.versions.newest()[0]

    def _written(self, rows: DataFrame, n: int) -> dict:
        """A run of rows sorted by key, and the range of each of its files."""
        folder = self.versions.new("run")
        path = f"{self.versions.folder}/{folder}"
        rows.repartitionByRange(max(1, -(-n // FILE_ROWS)), self.key).sortWithinPartitions(self.key).write.parquet(path)
        stored = self.spark.read.schema(rows.schema).parquet(path)
        found = stored.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name")).agg(F.min(self.key).alias("low"), F.max(self.key).alias("high"), F.count("*").alias("rows"))
        return {"folder": folder, "schema": rows.schema.json(), "files": sorted((r.asDict() for r in found.collect()), key=lambda f: f["low"])}

    def _with(self, state: dict, made: dict, schema: StructType | None) -> dict:
        known = _schema(state["schema"])
        added = [f for f in schema or [] if f.name not in known.names]
        whole = StructType([*known, *added]).json() if known or added else None
        return state | {"runs": [*state["runs"], made | {"level": 0, "at": state["next"]}], "next": state["next"] + 1, "schema": whole}

    def _rows(self, runs: list[dict], low=None, high=None) -> DataFrame | None:
        """Rows of the files whose range meets low..high, with the age of their run."""
        out = []
        for run in runs:
            files = [f["name"] for f in run["files"] if (high is None or f["low"] <= high) and (low is None or f["high"] >= low)]
            if files:
                out.append(self.spark.read.schema(_schema(run["schema"])).parquet(*[f"{self.versions.folder}/{run['folder']}/{f}" for f in files]).withColumn("__at", F.lit(run["at"])))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out) if out else None

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in (self.key, "__at")]
        found = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "__at").alias("r"))
        return found.select(self.key, "r.*")

    def read(self, low=None, high=None) -> DataFrame:
        """Rows whose key lies in low..high (both within; None: no bound)."""
        state = self._state()
        if not state["schema"]:
            return self.spark.createDataFrame([], self.key + " string")
        schema = _schema(state["schema"])
        rows = self._rows(state["runs"], low, high)
        if rows is None:
            return self.spark.createDataFrame([], schema)
        rows = rows.where(F.lit(True) if low is None else F.col(self.key) >= low).where(F.lit(True) if high is None else F.col(self.key) <= high)
        rows = self._newest(rows).where(~F.col(REMOVED))
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def compact(self) -> bool:
        """Merges the lowest level that has ``fanout`` runs with the next one; False if none has,
        or another compaction was first."""
        state = self._state()
        level = next((n for n in sorted({r["level"] for r in state["runs"]}) if sum(r["level"] == n for r in state["runs"]) >= self.fanout), None)
        if level is None:
            return False
        old = [r for r in state["runs"] if r["level"] in (level, level + 1)]
        rows = self._newest(self._rows(old))
        if all(r["level"] <= level + 1 for r in state["runs"]):
            rows = rows.where(~F.col(REMOVED))  # nothing older is left to hide
        n = rows.count()
        made = [self._written(rows, n) | {"level": level + 1, "at": max(r["at"] for r in old)}] if n else []
        gone = {r["folder"] for r in old}

        def step(now: dict) -> dict | None:
            if not gone <= {r["folder"] for r in now["runs"]}:
                return None
            return now | {"runs": [*made, *(r for r in now["runs"] if r["folder"] not in gone)]}

        return self.versions.at(self.versions.change(step))["runs"][: len(made)] == made

    def vacuum(self) -> int:
        """Removes folders that the newest state doesn't name; only while nobody reads or writes."""
        named = {r["folder"].split("/")[1] for r in self._state()["runs"]}
        gone = [n for n in self.versions.listed("data") if n not in named]
        self.versions.remove(*[f"data/{n}" for n in gone])
        return len(gone)
