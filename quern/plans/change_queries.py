"""Queries over change history and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import payloads
from quern.operators import history as H
from quern.plans.registry import query
from quern.plans.roles import HISTORY, edits, history, part_edits
from quern.session import load, small_tasks

CHURN = f"""WITH {HISTORY}, c AS (
  SELECT file, sum(insertions + deletions) AS churn_score, sum(insertions) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions,
         count(DISTINCT commit) AS commit_count, count(DISTINCT author) AS authors_count, CAST(sum(CAST(is_fix AS INT)) AS BIGINT) AS fix_commits, max(ts) AS last_modified
  FROM history GROUP BY file),
s AS (SELECT *, churn_score * commit_count * (1 + 0.5 * fix_commits) AS hotspot_score FROM c),
churn AS (SELECT *, CASE WHEN hotspot_score > 1000 OR fix_commits >= 5 THEN 'CRITICAL' WHEN hotspot_score > 250 OR fix_commits >= 2 THEN 'HIGH'
          WHEN hotspot_score > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s)"""


@query(f"{CHURN} SELECT * FROM churn")
def file_churn(spark, d):
    small_tasks(spark)
    return H.file_churn(history(spark, d))


@query(f"{CHURN} SELECT * FROM churn ORDER BY hotspot_score DESC, file LIMIT 15")
def hotspots(spark, d):
    small_tasks(spark)
    return H.top_hotspots(H.file_churn(history(spark, d)))


@query(f"""WITH {HISTORY} SELECT commit, author, max(ts) AS ts, count(DISTINCT file) AS files FROM history
WHERE ts <= TIMESTAMP '1998-01-01' AND ts >= TIMESTAMP '1998-01-01' - INTERVAL 720 HOUR GROUP BY commit, author""")
def recent_commits(spark, d):
    return H.recent_changes(history(spark, d), F.lit("1998-01-01").cast("timestamp"), 720)


def failures(spark, d):
    e = load(spark, d, "events").where("event_type = 'error'")
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("id"), F.col("props").alias("message"))


@query("""WITH f AS (SELECT user_id AS file, event_id AS id, props AS message FROM events WHERE event_type = 'error'),
m AS (SELECT file, message, row_number() OVER (PARTITION BY file ORDER BY min(id)) AS place FROM f GROUP BY file, message),
t AS (SELECT file, string_agg(message, ' | ' ORDER BY place) AS messages FROM m WHERE place <= 3 GROUP BY file)
SELECT file, count(*) AS incidents, least(1.0, round(0.40 + 0.15 * count(*), 2))::DOUBLE AS threat_score, any_value(messages) AS messages
FROM f JOIN t USING (file) GROUP BY file""")
def threat_scars(spark, d):
    return H.threat_scars(failures(spark, d))


@query("""SELECT user_id AS file, count(*) AS incidents, least(1.0, round(0.40 + 0.15 * count(*), 2))::DOUBLE AS error_gradient FROM events
WHERE event_type = 'error' GROUP BY user_id HAVING least(1.0, round(0.40 + 0.15 * count(*), 2)) >= 0.5 ORDER BY error_gradient DESC, incidents DESC, file LIMIT 10""")
def error_ripples(spark, d):
    return H.error_ripples(failures(spark, d))


EDITS = """raw AS (SELECT DISTINCT l_orderkey AS commit, l_partkey % 40 AS file FROM lineitem),
edits AS (SELECT * FROM raw WHERE commit IN (SELECT commit FROM raw GROUP BY commit HAVING count(*) >= 2))"""
RULES = f"""WITH {EDITS}, pairs AS (
  SELECT a.file AS trigger, b.file AS consequent, count(*) AS together FROM edits a JOIN edits b ON a.commit = b.commit AND a.file <> b.file GROUP BY ALL),
r AS (SELECT trigger, consequent, together, n AS occurrences, together / n AS c FROM pairs JOIN (SELECT file, count(*) AS n FROM edits GROUP BY file) ON trigger = file
      WHERE together >= 2 AND together / n >= 0.08),
rules AS (SELECT trigger, consequent, together, occurrences, round(c, 6) AS confidence, row_number() OVER (PARTITION BY trigger ORDER BY c DESC, together DESC, consequent) AS place
          FROM r QUALIFY place <= 5)"""


@query(f"""WITH {EDITS} SELECT a.file AS file_a, b.file AS file_b, count(*) AS together FROM edits a JOIN edits b ON a.commit = b.commit AND a.file < b.file GROUP BY ALL""")
def co_changes(spark, d):
    small_tasks(spark)
    return H.co_changes(H.sessions(edits(spark, d)))


@query(f"{RULES} SELECT * FROM rules")
def habits(spark, d):
    small_tasks(spark)
    return H.habits(H.sessions(edits(spark, d)), 0.08)


@query(f"{RULES} SELECT trigger, string_agg(consequent::VARCHAR, ',' ORDER BY place) AS choreography, max(confidence) AS confidence, max(occurrences) AS occurrences FROM rules GROUP BY trigger")
def choreographies(spark, d):
    small_tasks(spark)
    return H.choreographies(H.habits(H.sessions(edits(spark, d)), 0.08))


PART_EDITS = """raw AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS file FROM lineitem),
edits AS (SELECT * FROM raw WHERE commit IN (SELECT commit FROM raw GROUP BY commit HAVING count(*) >= 2))"""
PART_RULES = f"""WITH {PART_EDITS}, pairs AS (
  SELECT a.file AS trigger, b.file AS consequent, count(*) AS together FROM edits a JOIN edits b ON a.commit = b.commit AND a.file <> b.file GROUP BY ALL),
r AS (SELECT trigger, consequent, together, n AS occurrences, together / n AS c FROM pairs JOIN (SELECT file, count(*) AS n FROM edits GROUP BY file) ON trigger = file
      WHERE together >= 2 AND together / n >= 0.08),
rules AS (SELECT trigger, consequent, together, occurrences, round(c, 6) AS confidence, row_number() OVER (PARTITION BY trigger ORDER BY c DESC, together DESC, consequent) AS place
          FROM r QUALIFY place <= 5)"""


@query(f"""WITH {PART_EDITS} SELECT a.file AS file_a, b.file AS file_b, count(*) AS together FROM edits a JOIN edits b ON a.commit = b.commit AND a.file < b.file GROUP BY ALL""")
def part_co_changes(spark, d):
    small_tasks(spark)
    return H.co_changes(H.sessions(part_edits(spark, d)))


@query(f"{PART_RULES} SELECT * FROM rules")
def part_habits(spark, d):
    small_tasks(spark)
    return H.habits(H.sessions(part_edits(spark, d)), 0.08)  # no pair of these tables reaches the default 0.5


@query(f"{PART_RULES} SELECT trigger, string_agg(consequent::VARCHAR, ',' ORDER BY place) AS choreography, max(confidence) AS confidence, max(occurrences) AS occurrences FROM rules GROUP BY trigger")
def part_choreographies(spark, d):
    small_tasks(spark)
    return H.choreographies(H.habits(H.sessions(part_edits(spark, d)), 0.08))


SPIKES = """WITH t AS (
  SELECT event_type AS src, lead(event_type) OVER w AS dst, ts, lead(ts) OVER w AS next_ts, lead(event_id) OVER w AS id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT src, dst, epoch_us(next_ts) / 1e6 - epoch_us(ts) / 1e6 AS dt, next_ts AS ts, id FROM t WHERE src <> dst),
pairs AS (SELECT * FROM p WHERE abs(dt) <= 86400)"""
FOLDED = f"""{SPIKES}, l AS (SELECT src, dst, list(dt ORDER BY ts, id) AS u FROM pairs GROUP BY src, dst),
f AS (SELECT src, dst, list_reduce(u, lambda w, dt: least(1.0, greatest(CASE WHEN w < 0 THEN 0.05 ELSE 0.01 END, CASE WHEN w < 0 THEN 0.5 ELSE w END
      + 0.2 * CASE WHEN dt > 0 THEN exp(-dt / 600.0) ELSE -0.5 * exp(dt / 300.0) END)), -1.0::DOUBLE) AS w, len(u)::INT AS sample_count FROM l)"""


def spikes(spark, d):
    return H.spike_pairs(load(spark, d, "events"), "user_id", "event_type", horizon=86400)


@query(f"{SPIKES} SELECT src, dst, round(dt, 6) AS dt, ts, id FROM pairs")
def spike_pairs(spark, d):
    return spikes(spark, d).withColumn("dt", F.round("dt", 6))


@query(f"{FOLDED} SELECT src, dst, round(w, 6) AS weight, sample_count FROM f")
def synapses(spark, d):
    return H.synapses(spikes(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"{FOLDED} SELECT src, dst, round(w, 6) AS weight, sample_count FROM f WHERE round(w, 6) >= 0.5 ORDER BY weight DESC, sample_count DESC, src, dst LIMIT 20")
def strongest_synapses(spark, d):
    return H.strongest(H.synapses(spikes(spark, d)).withColumn("weight", F.round("weight", 6)))


@query(name="thompson_synapses")
def thompson_synapses(spark, d):
    return H.thompson(H.synapses(spikes(spark, d)))


@query("""WITH p AS (SELECT r_name AS subsystem, count(*) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1),
q AS (SELECT r_name AS subsystem, count(*) AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_nationkey < 12 GROUP BY 1),
j AS (SELECT coalesce(p.m / (SELECT sum(m) FROM p), 0) AS p, coalesce(q.m / (SELECT sum(m) FROM q), 0) AS q FROM p FULL JOIN q USING (subsystem))
SELECT round(sum(CASE WHEN q > 0 THEN q * ln(q / greatest(p, 1e-5)) ELSE 0 END), 6) AS kl, CAST(sum(CAST(q > 0 AS INT)) AS BIGINT) AS subsystems FROM j""")
def subsystem_divergence(spark, d):
    place = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("subsystem"), F.lit(1).alias("mass"))
    expected = load(spark, d, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    proposed = load(spark, d, "supplier").where("s_nationkey < 12").join(place, F.col("s_nationkey") == F.col("n_nationkey"))
    return H.subsystem_divergence(expected, proposed).withColumn("kl", F.round("kl", 6))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders)
SELECT 'invariant-' || lower(o_orderstatus) AS id, o_orderkey AS dst, 'applies_to' AS edge_type, 1.0::DOUBLE AS weight FROM n WHERE k <= 1 AND o_orderstatus <> 'O'""")
def postmortem_edges(spark, d):
    from pyspark.sql import Window

    o = load(spark, d, "orders")
    newest = o.withColumn("k", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_orderdate"), "o_orderkey"))).where("k <= 1")
    commits = newest.select(F.col("o_orderkey").alias("commit"), F.concat(F.lit("fix "), "o_orderstatus").alias("subject"), F.col("o_orderdate").alias("ts"), F.array("o_orderkey").alias("files"))
    _, edges = H.postmortems(commits, spark.createDataFrame([("invariant-fix-o",)], "id string"))
    return edges.select(F.replace("src", F.lit("fix-"), F.lit("")).alias("id"), "dst", "edge_type", "weight")


@query("""WITH p AS (SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN props[:length(props) - 1] || ',}' WHEN event_id % 11 = 0 THEN 'free text' ELSE props END AS payload,
  event_type = 'error' AS failed, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT id, CASE WHEN id % 7 = 0 THEN payload WHEN id % 11 = 0 THEN '{"raw_action":"free text","failed":' || failed || ',"validation_tag":"none"}'
  ELSE '{"failed":' || failed || ',"k":' || k || ',"validation_tag":"none"}' END AS stamped, CASE WHEN id % 7 > 0 AND id % 11 > 0 THEN k END AS k FROM p""")
def stamped_payloads(spark, d):
    """Payloads of events, some of them broken or no objects, with what a receipt says."""
    e = load(spark, d, "events")
    broken = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(",}"))
    payload = F.when(F.col("event_id") % 7 == 0, broken).when(F.col("event_id") % 11 == 0, "free text").otherwise(F.col("props"))
    rows = e.select(F.col("event_id").alias("id"), payload.alias("payload"), (F.col("event_type") == "error").alias("failed"))
    stamps = {"failed": F.col("failed"), "validation_tag": F.lit("none")}
    return rows.select("id", payloads.stamped(F.col("payload"), "raw_action", **stamps).alias("stamped"), payloads.extracted(F.col("payload"), "$.k", "long").alias("k"))
