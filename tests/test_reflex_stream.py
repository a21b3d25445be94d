"""The stream of reflexes against the batch fold."""

from datetime import datetime

from pyspark.sql import functions as F

from quern.operators import state as St
from quern.streaming import streams as S
from quern.streaming.reflexes import reflex_stream

SCHEMA = "key string, at timestamp, id long, threat double"


def test_reflexes_with_late_rows_and_a_restart(spark, sf_dir, rows, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type in ('error', 'view')")
    threat = F.when(F.col("event_type") == "error", (F.floor("value") % 10) / 10)
    e = e.select((F.col("user_id") % 5).cast("string").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), threat.alias("threat"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for k in range(2):  # each file holds events of all times: half of them are late
        e.where(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = reflex_stream(S.folder_source(spark, f"{tmp_path}/in", SCHEMA, 1), "60 days")
        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
        query.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out")).start().awaitTermination()

    try:
        run()
        rows(SCHEMA, ("end", datetime(2030, 1, 1), 1, None)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()  # goes on from the checkpoint; the watermark passes all events
        rows(SCHEMA, ("end", datetime(2031, 1, 1), 2, None), ("0", datetime(2024, 1, 1), 3, 1.0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()  # an event that is too late changes nothing
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(f"{tmp_path}/out")
    newest = out.groupBy("key").agg(F.max_by(F.struct("threat", "occurrences", "clean_runs"), "folded").alias("r")).select("key", "r.*").where("key <> 'end'")
    want = {(r.key, round(r.threat, 6), r.occurrences, r.clean_runs) for r in St.reflexes(e).collect()}
    assert {(r.key, round(r.threat, 6), r.occurrences, r.clean_runs) for r in newest.collect()} == want and len(want) == 5
