from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.operators import history as H
from quern.streaming import streams as S

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value")
    for k in range(3):
        e.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_windows_equal_batch(spark, folder):
    stream = S.windowed_counts(S.folder_source(spark, folder, EVENTS), late="60 days")
    got = {tuple(r) for r in run(stream, "complete", "windows").collect()}
    want = {tuple(r) for r in S.windowed_counts(spark.read.schema(EVENTS).parquet(folder)).collect()}
    assert got == want and got


def test_sessions_equal_batch(spark, folder):
    got = {tuple(r) for r in run(S.session_counts(S.folder_source(spark, folder, EVENTS), late="60 days"), "complete", "sessions").collect()}
    assert got == {tuple(r) for r in S.session_counts(spark.read.schema(EVENTS).parquet(folder)).collect()}


def test_repeats_are_dropped_once(spark, folder):
    twice = S.folder_source(spark, folder, EVENTS, 1)
    twice = twice.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    assert run(S.once(twice, ["event_id"], "60 days"), "append", "once").count() == spark.read.parquet(folder).count()


def test_synapses_in_one_batch_equal_the_fold(spark, folder, tmp_path):
    pairs = H.spike_pairs(spark.read.schema(EVENTS).parquet(folder), "user_id", "event_type", horizon=86400)
    pairs.coalesce(1).write.parquet(f"{tmp_path}/pairs")
    stream = S.synapse_stream(S.folder_source(spark, f"{tmp_path}/pairs", pairs.schema))
    got = {(r.src, r.dst): round(r.weight, 6) for r in run(stream, "update", "synapses").collect()}
    assert got == {(r.src, r.dst): round(r.weight, 6) for r in H.synapses(pairs).collect()}


def test_tags_expire(spark, tmp_path):
    schema = "symbol string, ts timestamp"
    for name, data in (("1", [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00")]), ("2", [("b", "2024-01-01 06:00:00")]), ("3", [("c", "2024-01-02 06:00:00")])):
        spark.createDataFrame([(s, datetime.fromisoformat(t)) for s, t in data], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/tags")
    got = {(r.symbol, r.tagged) for r in run(S.tag_stream(S.folder_source(spark, f"{tmp_path}/tags", schema, 1)), "append", "tags").collect()}
    assert ("a", 2) in got and not any(s == "c" for s, _ in got)


def test_keyed_sink_is_idempotent(spark, rows, tmp_path):
    path = f"{tmp_path}/table"
    write = S.keyed_sink(path, ["id"], ["at"], "gone")
    schema = "id int, at int, v string, gone boolean"
    write(rows(schema, (1, 1, "a", False), (1, 2, "b", False), (2, 1, "x", False)), 0)
    write(rows(schema, (2, 3, None, True), (3, 1, "n", False)), 1)
    write(rows(schema, (9, 9, "ignored", False)), 1)
    assert {(r.id, r.v) for r in S.keyed_table(spark, path).collect()} == {(1, "b"), (3, "n")}


def test_keyed_sink_keeps_the_newest_whatever_comes_last(spark, rows, tmp_path):
    path = f"{tmp_path}/table"
    write = S.keyed_sink(path, ["id"], ["at"], "gone", 2)
    schema = "id int, at int, v string, gone boolean"
    write(rows(schema, (1, 10, "new", False), (2, 10, "x", False), (4, 1, "y", False)), 0)
    write(rows(schema, (1, 5, "old", False), (2, 20, None, True)), 1)
    write(rows(schema, (2, 15, "late", False), (3, 1, "z", False), (4, 1, "same time", False)), 2)
    assert {(r.id, r.v) for r in S.keyed_table(spark, path).collect()} == {(1, "new"), (3, "z"), (4, "same time")}
    write(rows(schema, (2, 30, "back", False)), 3)
    write(rows(schema), 4)
    assert {(r.id, r.v) for r in S.keyed_table(spark, path).collect()} == {(1, "new"), (2, "back"), (3, "z"), (4, "same time")}
    folders = {p.name.split("-")[0] for p in (tmp_path / "table" / "data").iterdir()}
    assert "k0" not in folders and S.keyed_table(spark, f"{tmp_path}/none") is None


def test_drain_retries_after_a_while_and_fails_at_last(spark, rows, tmp_path):
    def handler(pdf):
        return ["bad" if p == "x" else None for p in pdf["payload"]]

    path, clock = f"{tmp_path}/q", [1000.0]
    schema = "id long, payload string"
    none = rows(schema)
    run_batch = S.drain(none, handler, path, most=3, now=lambda: clock[0])

    def state():
        return {r.id: (r.status, r.retry_count) for r in S.keyed_table(spark, path).collect()}

    run_batch(rows(schema, (1, "ok"), (2, "x"), (2, "x")), 0)
    assert state() == {1: ("PROCESSED", 0), 2: ("PENDING", 1)}
    run_batch(rows(schema, (2, "ok"), (3, "ok")), 1)  # delivered again, and not due yet
    assert state() == {1: ("PROCESSED", 0), 2: ("PENDING", 1), 3: ("PROCESSED", 0)}
    clock[0] += 2.5
    run_batch(none, 2)
    assert state()[2] == ("PENDING", 2)
    clock[0] += 4.5
    run_batch(none, 3)
    assert state()[2] == ("FAILED", 3)
    clock[0] += 100
    run_batch(none, 4)
    assert state() == {1: ("PROCESSED", 0), 2: ("FAILED", 3), 3: ("PROCESSED", 0)}


def test_delta_stream_keeps_the_index(spark, rows, tmp_path):
    schema = "path string, at long, sha256 string, text string"
    index = S.delta_stream(rows(schema), f"{tmp_path}/index")
    index(rows(schema, ("a", 1, "1", "x"), ("b", 1, "2", "y")), 0)
    index(rows(schema, ("a", 3, None, None), ("b", 2, "3", "z"), ("a", 2, "9", "late")), 1)
    assert [(r.path, r.text) for r in S.keyed_table(spark, f"{tmp_path}/index").collect()] == [("b", "z")]
