"""Queries over indexes and keyed tables that have changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.index import TextIndex
from quern.operators.runs import SortedRuns
from quern.plans.indexes import FIELDS
from quern.plans.registry import query
from quern.plans.roles import texts
from quern.plans.text_queries import QUERY, bm25_sql
from quern.session import load
from quern.storage import new_folder
from quern.streaming.outbox import Outbox

CHANGED = """changed AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 7 = 0 THEN coalesce(text, '') || ' the of' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0)"""


def _changed(spark, d: str, merged: bool) -> TextIndex:
    """A third of the documents at a time, then every fifth deleted, then every seventh written anew, the deleted ones too."""
    index, docs = TextIndex(spark, new_folder(spark, "text-index"), list(FIELDS), ["source"], 8), texts(spark, d)
    for k in range(3):
        index.add(docs.where(F.col("id") % 3 == k))
    index.delete(docs.where(F.col("id") % 5 == 0).select("id"))
    if merged:
        index.merge()
    index.update(docs.where(F.col("id") % 7 == 0).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" the of"))))
    if merged:
        index.merge()
    return index


@query(f"WITH {CHANGED}, {bm25_sql('changed')} SELECT id, score FROM scored")
def indexed_search_after_changes(spark, d):
    return _changed(spark, d, False).bm25(QUERY, FIELDS, n=None)


@query(f"WITH {CHANGED}, {bm25_sql('changed')} SELECT id, score FROM scored")
def indexed_search_after_merge(spark, d):
    return _changed(spark, d, True).bm25(QUERY, FIELDS, n=None)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'late' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price
FROM orders WHERE o_orderkey % 5 <> 1 AND o_orderkey BETWEEN 100 AND (SELECT max(o_orderkey) // 2 FROM orders)""")
def orders_after_batches(spark, d):
    """Orders put in two batches, a third of them put anew, a fifth removed, another removed and put again; compacted as batches come."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    runs = SortedRuns(spark, new_folder(spark, "runs"), "id", 3)
    runs.write(o.where("id % 2 = 0"))
    runs.write(o.where("id % 2 = 1"), o.where("id % 5 = 2").select("id"))
    anew = o.where("id % 3 = 0").select("id", F.lit("late").alias("status"), (F.col("price") + 1).alias("price"))
    runs.write(anew, o.where("id % 5 = 1").select("id"))
    runs.write(removed=o.where("id % 5 in (1, 3)").select("id"))
    runs.write(o.where("id % 5 in (2, 3) and id % 3 <> 0").unionAll(anew.where("id % 5 in (2, 3)")))
    last = o.agg(F.max("id")).first()[0]
    return runs.read(100, last // 2)


@query("""SELECT event_id AS id, event_type, CASE WHEN event_type = 'error' AND value >= 50 THEN 'FAILED' ELSE 'PROCESSED' END AS status,
  CASE WHEN event_type <> 'error' THEN 0 WHEN value >= 50 THEN 2 WHEN value >= 20 THEN 1 ELSE 0 END AS retry_count FROM events""")
def outbox_of_two_consumers(spark, d):
    """All events through a queue of two consumers: errors of 20 and more fail at first, those of 50 and more always.
    One consumer dies with half of the parts claimed; the other gets them when the lease has ended."""
    clock = [0.0]
    e = load(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    queue = Outbox(spark, new_folder(spark, "outbox"), e.schema, 8, 60, 2, lambda: clock[0])
    queue.put(e.where("id % 3 <> 0"), "w", 0)

    def handler(pdf):
        floor = pdf["retry_count"].map(lambda n: 50 if n else 20)
        return ["too large" if large else None for large in (pdf["event_type"] == "error") & (pdf["value"] >= floor)]

    lost = queue.claim("dies", 4)
    folder = queue.handle(lost, "dies", lambda pdf: ["never counts"] * len(pdf))
    queue.consume("lives", handler)
    clock[0] = 61.0  # the dead one's lease has ended, and retries are due
    queue.put(e.where("id % 3 = 0"), "w", 1)
    claims = queue.claim("lives")
    queue.settle(lost, folder)  # refused: claimed anew
    queue.settle(claims, queue.handle(claims, "lives", handler))
    clock[0] = 70.0
    queue.consume("lives", handler)
    return queue.events().select("id", "event_type", "status", "retry_count")
