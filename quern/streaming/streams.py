"""Streams: windows with watermarks, change capture, time-limited tags, ordered folds.

Event times are TIMESTAMP columns named ``ts``; a zone-less one is cast first, as
watermarks need it."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quern.operators.state import latest
from quern.sources.versions import Versions
from quern.storage import materialize


def folder_source(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, by: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Tumbling (or, with ``slide``, sliding) windows: (start, end, by, n, total)."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def session_counts(events: DataFrame, by: str = "user_id", gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of activity: (by, start, end, n)."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), by).agg(F.count("*").alias("n"))
    return grouped.select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "30 minutes") -> DataFrame:
    """Each event once within the watermark: an idempotent receiver."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


BUCKET, GONE, COMMIT = "bucket_no", "__deleted", "__commit"


def keyed_sink(path: str, keys: list[str], order: list[str], deleted: str | None = None, buckets: int = 16, writer: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a keyed table: a key's row is the one of the highest
    ``order`` over all batches, so an older row that comes late changes nothing; of equal ones
    the one that was committed later. Rows flagged ``deleted`` hide their key until a newer row comes.

    Several writers may keep one table: batches are known by writer and number. The writer is
    the streaming query (its id stays over restarts from one checkpoint; a new checkpoint is a
    new writer), or the name given. A batch that is delivered again writes nothing.

    Keys are hashed to buckets, and a batch writes only those that it touches, into a folder of
    its own, which counts once a new state names it (``Versions``); a writer that loses a race
    merges anew with the winner's rows. Readers use ``keyed_table``; folders that the last two
    states don't name, but an earlier one did, are removed."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = writer or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        versions = Versions(spark, path)
        if batch_id <= ((versions.newest()[1] or {}).get("done", {})).get(name, -1):
            return
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        rows = batch.drop(deleted) if deleted else batch
        marked = rows.withColumn(GONE, gone) if not deleted else batch.withColumn(GONE, gone).drop(deleted)
        marked = materialize(latest(marked, keys, order), "keyed")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        touched = [r[0] for r in marked.select(bucket).distinct().collect()]  # at most ``buckets``
        lost = []

        def step(state: dict | None) -> dict | None:
            versions.remove(*lost)
            state = state or {"places": {}, "done": {}, "commit": 0}
            if batch_id <= state["done"].get(name, -1):
                return None
            commit, places = state["commit"] + 1, state["places"]
            merged = marked.withColumn(COMMIT, F.lit(commit).cast("long"))
            stored = [f"{path}/{places[str(k)]}" for k in touched if str(k) in places]
            if stored:
                before = spark.read.option("mergeSchema", "true").parquet(*stored)
                merged = latest(before.unionByName(merged, allowMissingColumns=True), keys, [*order, COMMIT])
            folder = versions.new("keyed")
            if touched:
                merged.withColumn(BUCKET, bucket).repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
            lost[:] = [folder]
            places = places | {str(k): f"{folder}/{BUCKET}={k}" for k in touched}
            return {"places": places, "schema": rows.schema.json(), "done": state["done"] | {name: batch_id}, "commit": commit}

        versions.change(step)
        _sweep(versions)

    return write


def _folders(state: dict) -> set[str]:
    return {"/".join(p.split("/")[:2]) for p in state["places"].values()}


def _sweep(versions: Versions) -> None:
    """Removes states before the last two, and what only those name. A folder that a writer is
    about to name is in none of them, and stays."""
    *old, before, last = [-1, -1, *versions.numbers()]
    kept = set().union(*(_folders(versions.at(n)) for n in (before, last) if n > 0))
    for n in old:
        if n > 0:
            versions.remove(*(_folders(versions.at(n)) - kept), f"states/{n:012d}")


def keyed_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows that ``keyed_sink`` keeps, as of the last commit, or None."""
    state = Versions(spark, path).newest()[1]
    if state is None:
        return None
    schema = StructType.fromJson(json.loads(state["schema"]))
    if not state["places"]:
        return spark.createDataFrame([], schema)
    rows = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/{p}" for p in state["places"].values()])
    return rows.where(~F.col(GONE)).select(*[c for c in rows.columns if c in schema.names])


def tag_stream(tags: DataFrame, ttl_seconds: int = 1800, late: str = "30 minutes") -> DataFrame:
    """(symbol, tagged, expired_at): per symbol, how often it was tagged until its time ran out.

    The state of a symbol is two numbers; event-time timeouts end it."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            count, last = state.get
            state.remove()
            yield pd.DataFrame({"symbol": [key[0]], "tagged": [count], "expired_at": [pd.Timestamp(last + ttl_seconds * 1000, unit="ms")]})
            return
        count, last = state.get if state.exists else (0, 0)
        for pdf in batches:
            count += len(pdf)
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((count, last))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = tags.withWatermark("ts", late).groupBy("symbol")
    return rows.applyInPandasWithState(step, "symbol string, tagged long, expired_at timestamp", "count long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def synapse_stream(pairs: DataFrame) -> DataFrame:
    """(src, dst, weight, sample_count) after each micro-batch: the synapse fold with its weight
    kept between batches; a batch's updates are applied in time order."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, count = state.get if state.exists else (-1.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for dt in rows["dt"]:
            delta = math.exp(-dt / 600) if dt > 0 else -0.5 * math.exp(dt / 300)
            first = weight < 0
            weight = min(1.0, max(0.05 if first else 0.01, (0.5 if first else weight) + 0.2 * delta))
            count += 1
        state.update((weight, count))
        yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "weight": [weight], "sample_count": [count]})

    out = "src string, dst string, weight double, sample_count long"
    return pairs.groupBy("src", "dst").applyInPandasWithState(step, out, "weight double, count long", "update", GroupStateTimeout.NoTimeout)


DRAINED = "id long, settled boolean, retry_count int, status string, error_message string, due timestamp"


def drain(queue: DataFrame, handler: Callable[[pd.DataFrame], list[str | None]], path: str, most: int = 5, now: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for an event queue: the handler gets batches of events on the
    executors and returns an error or None for each; outcomes and events are kept by event id.
    Outcomes are kept once; the handler itself sees a batch of events again if a task dies after
    it ran, and must bear that.

    An event counts as PROCESSED only on success and is not handled again. One that fails is
    PENDING and is tried again, in the first batch after a back-off of 2^retries seconds, until
    it has failed ``most`` times: then it is FAILED. ``queue`` gives the events' schema."""
    columns = [c for c in queue.columns if c != "id"]
    schema = ", ".join([DRAINED, *(f"{c} {queue.schema[c].dataType.simpleString()}" for c in columns)])
    sink = keyed_sink(path, ["id"], ["retry_count", "settled"])

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, moment = batch.sparkSession, float(now())
        events = batch.select("id", *columns).dropDuplicates(["id"]).withColumn("retry_count", F.lit(0))
        kept = keyed_table(spark, path)
        if kept is not None:
            again = kept.where((F.col("status") == "PENDING") & (F.col("due") <= F.timestamp_seconds(F.lit(moment)))).select("id", *columns, "retry_count")
            events = events.join(kept.select("id"), "id", "left_anti").unionByName(again)

        def handled(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                errors = handler(pdf.drop(columns="retry_count"))
                failed = [e is not None for e in errors]
                tries = pdf["retry_count"] + failed
                out = pd.DataFrame({"id": pdf["id"], "retry_count": tries, "status": ["PROCESSED" if not f else "FAILED" if t >= most else "PENDING" for f, t in zip(failed, tries)], "error_message": errors})
                out["settled"] = out["status"] != "PENDING"
                out["due"] = pd.to_datetime([moment + 2.0 ** min(t, 30) for t in tries], unit="s")
                yield out.join(pdf[columns])

        sink(events.mapInPandas(handled, schema), batch_id)

    return run


def delta_stream(files: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for a stream of file states (path, at, sha256, text; a null
    sha256 is a deletion): keeps the index by path, whatever order states come in."""
    sink = keyed_sink(path, ["path"], ["at"], deleted="__gone")

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(batch.select(*files.columns).withColumn("__gone", F.col("sha256").isNull()), batch_id)

    return run
