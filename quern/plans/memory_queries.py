"""Queries over stored memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import lexical as L
from quern.operators import memory as M
from quern.operators import vector as V
from quern.plans.indexes import FIELDS, text_index
from quern.plans.registry import query
from quern.plans.roles import EDGES, FILES, edges, files, texts
from quern.plans.text_queries import BM25
from quern.session import load, small_tasks

TURNS = """t AS (SELECT conv_id * 1000 + turn AS id, role AS title, coalesce(text, '') AS content, 'k' || (conv_id % 7) AS topic_key, conv_id % 5 AS project, CASE WHEN turn % 5 = 4 THEN 'now' END AS deleted_at FROM conversations)"""


def turns(spark, d):
    t = load(spark, d, "conversations")
    return t.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("title"), F.coalesce("text", F.lit("")).alias("content"),
        F.concat(F.lit("k"), (F.col("conv_id") % 7).cast("string")).alias("topic_key"), (F.col("conv_id") % 5).alias("project"), F.when(F.col("turn") % 5 == 4, "now").alias("deleted_at"),
    )


@query(f"WITH {TURNS} SELECT id, title FROM t WHERE title = 'user' ORDER BY id DESC LIMIT 15")
def recent_observations(spark, d):
    return M.newest(turns(spark, d), 15, F.col("title") == "user").select("id", "title")


@query(f"WITH {TURNS} SELECT id, title FROM t WHERE deleted_at IS NULL AND title = 'user' AND (contains(lower(title), 'tion') OR contains(lower(content), 'tion') OR contains(topic_key, 'tion')) ORDER BY id DESC LIMIT 20")
def observation_search(spark, d):
    return M.search_observations(turns(spark, d), "tion", title="user").select("id", "title")


@query(f"""WITH {TURNS} SELECT id, project FROM (SELECT id, project, row_number() OVER (PARTITION BY project ORDER BY id DESC) AS k FROM t WHERE contains(lower(content), 'there')) WHERE k <= 5 ORDER BY id DESC, project LIMIT 20""")
def cross_project_search(spark, d):
    return M.cross_project_search(turns(spark, d), "there").select("id", "project")


@query(f"WITH {FILES} SELECT node AS id, path FROM files WHERE path = 'part78.py' OR ends_with(path, '/part78.py') ORDER BY id DESC")
def file_lessons(spark, d):
    f = files(spark, d).select(F.col("node").alias("id"), F.col("path").alias("file_path"), F.col("language").alias("symbol_name"))
    return M.lessons_of(f, "part78.py").select("id", F.col("file_path").alias("path"))


GOTCHAS = """g AS (SELECT p_partkey AS id, ['critical', 'high', 'medium', 'low'][CAST(p_size % 4 + 1 AS INT)] AS severity, p_name AS title, p_type AS content, p_brand AS tags, p_retailprice AS created_at, p_size % 2 = 0 AS resolved FROM part)"""


def gotchas(spark, d):
    s = F.col("p_size")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (s % 4 + 1).cast("int"))
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), severity.alias("severity"), F.col("p_name").alias("title"), F.col("p_type").alias("content"), F.col("p_brand").alias("tags"), F.col("p_retailprice").alias("created_at"), (s % 2 == 0).alias("resolved"))


@query(f"WITH {GOTCHAS} SELECT id, severity FROM g WHERE severity IN ('high', 'critical') ORDER BY created_at DESC, id LIMIT 10")
def active_threats(spark, d):
    return M.active_threats(gotchas(spark, d)).select("id", "severity")


@query(f"WITH {GOTCHAS} SELECT id FROM g WHERE contains(lower(title || ' ' || content || ' ' || tags), 'steel') OR contains(lower(title || ' ' || content || ' ' || tags), 'ring') ORDER BY created_at DESC, id LIMIT 10")
def gotcha_search(spark, d):
    return M.search_gotchas(gotchas(spark, d), "ring of steel").select("id")


@query(f"WITH {GOTCHAS} SELECT id FROM g WHERE NOT resolved")
def drift_alerts(spark, d):
    return M.drift_alerts(gotchas(spark, d)).select("id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'stale' WHEN f.mtime IS NULL THEN 'file_missing' WHEN f.mtime > o_orderdate + INTERVAL 1 SECOND THEN 'file_changed' END AS warning
FROM orders LEFT JOIN (SELECT l_partkey AS k, max(l_shipdate) AS mtime FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1) f ON f.k = o_custkey""")
def memory_freshness(spark, d):
    f = load(spark, d, "lineitem").where("l_partkey % 3 <> 0").groupBy(F.col("l_partkey").alias("path")).agg(F.max("l_shipdate").cast("timestamp").alias("mtime"))
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_path"), (F.col("o_orderkey") % 11 == 0).alias("stale"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return M.freshness(o, f)


@query(f"WITH {EDGES} SELECT src, dst, weight, 'out' AS direction FROM edges WHERE src = 8 UNION ALL SELECT src, dst, weight, 'in' FROM edges WHERE dst = 8 AND src <> 8")
def edges_of_node(spark, d):
    return M.edges_of(edges(spark, d).withColumn("created_at", F.col("src")), 8).drop("created_at")


@query(f"""WITH {FILES} SELECT * FROM (SELECT 'code' AS kind, node AS id, 1.0::DOUBLE AS score FROM files WHERE contains(language, '13') UNION ALL SELECT 'lesson', node, 0.9 FROM files WHERE contains(path, '13')) ORDER BY score DESC, id LIMIT 150""")
def unified_search(spark, d):
    f = files(spark, d).select(F.col("node").alias("id"), F.col("language").alias("name"), F.col("path").alias("content"))
    return M.unified_search(f, f, "13", n=150)


@query(f"WITH {FILES} SELECT node AS id, language, path FROM files WHERE contains(language, 'brand#1') AND starts_with(path, 'crates/m2') ORDER BY language, path LIMIT 100")
def symbol_lookup(spark, d):
    f = files(spark, d)
    return M.find_symbol(f.select(F.col("node").alias("id"), F.col("language").alias("name"), "path"), f, "Brand#1", "crates/m2").select("id", "language", "path")


SYMBOLS = "s AS (SELECT l_partkey AS path, l_orderkey || '-' || l_linenumber AS name, CAST(l_quantity AS BIGINT) AS start_line, CAST(l_quantity AS BIGINT) + l_linenumber AS end_line FROM lineitem)"


def symbols(spark, d):
    start = F.col("l_quantity").cast("long")
    return load(spark, d, "lineitem").select(F.col("l_partkey").alias("path"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"), start.alias("start_line"), (start + F.col("l_linenumber")).alias("end_line"))


@query(f"WITH {SYMBOLS} SELECT path, min(start_line) AS first_line, max(end_line) AS last_line FROM s GROUP BY path")
def symbol_ranges(spark, d):
    return M.symbol_ranges(symbols(spark, d))


@query(f"WITH {SYMBOLS} SELECT path, name, greatest(1, start_line - 10) AS from_line, end_line + 10 AS to_line FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY start_line, name) <= 3")
def localised_windows(spark, d):
    s = symbols(spark, d)
    return M.localise(s, s)


@query(f"""WITH {TURNS}, c AS (SELECT id, CASE title WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS priority, greatest(length(content) // 4, 1) AS c FROM t),
r AS (SELECT *, sum(c) OVER (ORDER BY priority, id ROWS UNBOUNDED PRECEDING) AS s FROM c) SELECT priority, id FROM r WHERE s <= 1200""")
def task_context(spark, d):
    t = turns(spark, d)
    priority = F.when(F.col("title") == "system", 1).when(F.col("title") == "user", 2).otherwise(3)
    return M.task_context(t.select(priority.alias("priority"), "id", F.col("content").alias("body"))).select("priority", "id")


@query("""WITH a AS (SELECT user_id AS key, floor(value) % 5 * CASE WHEN event_type = 'error' THEN 5.0 ELSE 0.5 END AS x FROM events), s AS (SELECT key, round(sum(x), 2)::DOUBLE AS load FROM a GROUP BY key)
SELECT key, load, round(load / 100, 4) AS pressure, load >= 100 AS rest FROM s""")
def load_pressure(spark, d):
    return M.pressure(load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"), (F.floor("value") % 5).alias("weight")))


MODULATED = """e AS (SELECT user_id AS key, list({'d': CASE WHEN event_type = 'error' THEN CAST(round(-200 * ((floor(value) % 10) / 10)) AS BIGINT) ELSE CAST(round(300 * round((floor(value) % 10) / 10 - 0.5, 3)) AS BIGINT) END,
  'a': CASE WHEN event_type = 'error' THEN CAST(round(250 * ((floor(value) % 10) / 10)) AS BIGINT) ELSE -150 END, 'l': CASE WHEN event_type = 'error' THEN 50::BIGINT ELSE 10 END} ORDER BY ts, event_id) AS u FROM events GROUP BY user_id),
f AS (SELECT key, list_reduce(list_prepend({'d': 500::BIGINT, 'a': 200::BIGINT, 'l': 0::BIGINT}, u), lambda s, x: {'d': least(1000, greatest(x.l, s.d + x.d)), 'a': least(1000, greatest(50, s.a + x.a)), 'l': 0::BIGINT}) AS s FROM e)"""


@query(f"WITH {MODULATED} SELECT key, s.d / 1000 AS drive, s.a / 1000 AS alert, greatest(0.25, round(0.80 - 0.45 * (s.a / 1000), 2))::DOUBLE AS threat_threshold FROM f")
def modulator_state(spark, d):
    kind = F.when(F.col("event_type") == "error", "pain").otherwise("reward")
    return M.modulators(load(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), kind.alias("kind"), ((F.floor("value") % 10) / 10).alias("amount")))


@query("""SELECT event_id AS id, CASE WHEN event_type IN ('error', 'view') THEN 'MISSING_IMPORT' ELSE 'GENERAL_DIAGNOSTIC' END AS kind, CASE WHEN event_type = 'click' THEN 'ARITY_PARITY' WHEN event_type = 'view' THEN 'INVERT_DEPENDENCY' ELSE 'ISOLATE_SANDBOX' END AS operator FROM events""")
def diagnostic_rules(spark, d):
    e = load(spark, d, "events")
    message = F.when(F.col("event_type") == "error", "name 'x' is not defined").when(F.col("event_type") == "view", "cannot import name y").when(F.col("event_type") == "click", "wrong arity").otherwise("slow")
    text = F.when(F.col("event_type") == "error", "plain failure").otherwise(message)
    return e.select(F.col("event_id").alias("id"), M.diagnostic_kind(message, F.lit("")).alias("kind"), M.replay_rule(text).alias("operator"))


@query("""SELECT o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS project, count(*) FILTER (o_orderstatus = 'F') > 0 AS ended FROM orders GROUP BY o_custkey""")
def session_states(spark, d):
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.lit("start").alias("event"), F.col("o_orderpriority").alias("project"), "o_orderstatus")
    log = o.drop("o_orderstatus").unionAll(o.where("o_orderstatus = 'F'").withColumn("event", F.lit("end")).drop("o_orderstatus"))
    return M.sessions_state(log).select("id", "project", (F.col("status") == "ended").alias("ended"))


@query("""SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0""")
def stale_projects(spark, d):
    c = load(spark, d, "customer")
    status = F.when(F.col("c_mktsegment") == "BUILDING", "SLEEPING").otherwise("ACTIVE")
    opened = F.when(F.col("c_acctbal") > 0, F.lit("2023-01-01").cast("date")).otherwise(F.lit("2024-01-20").cast("date"))
    return M.stale_projects(c.select(F.col("c_custkey").alias("id"), status.alias("status"), opened.alias("last_opened")), F.lit("2024-01-31").cast("date")).select("id")


POINTS = """pts AS (SELECT p_partkey AS k, p_name || p_partkey AS path, [p_size / 80, (p_partkey % 7) / 20, -(p_partkey % 5) / 20] AS q FROM part),
duo AS (SELECT a.path AS a, b.path AS b, a.q AS u, b.q AS v FROM pts a JOIN pts b ON b.k = a.k + 1),
dist AS (SELECT a, b, acosh(greatest(1.0, 1 + 2 * list_sum([(u[i] - v[i]) * (u[i] - v[i]) for i in [1, 2, 3]]) / ((1 - list_sum([x * x for x in u])) * (1 - list_sum([x * x for x in v]))))) AS h FROM duo)"""


@query(f"WITH {POINTS} SELECT a, b, round(exp(-h / 0.8), 6) AS coupling FROM dist")
def hyperbolic_coupling(spark, d):
    """Coupling of given points; ``path_points`` gives those of paths."""
    small_tasks(spark)
    p, k = load(spark, d, "part"), F.col("p_partkey")
    pts = p.select(k.alias("k"), F.concat("p_name", k).alias("path"), F.array(F.col("p_size") / 80, (k % 7) / 20, -(k % 5) / 20).alias("point"))
    pairs = pts.select(F.col("path").alias("a"), (F.col("k") + 1).alias("k")).join(pts.select("k", F.col("path").alias("b")).hint("merge"), "k").select("a", "b")
    return M.hyperbolic_coupling(pts, pairs, 0.8).withColumn("coupling", F.round("coupling", 6))


@query()
def path_coupling(spark, d):
    small_tasks(spark)
    f = files(spark, d)
    pairs = f.select(F.col("path").alias("a"), (F.col("node") + 1).alias("k")).join(f.select(F.col("node").alias("k"), F.col("path").alias("b")).hint("merge"), "k").select("a", "b")
    return M.hyperbolic_coupling(V.path_points(f), pairs)


SKETCH = r"""t AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents UNION ALL SELECT -1, unnest(['the', 'of', 'that'])), h AS (SELECT id, token, sha256(token) AS h FROM t),
c AS (SELECT id, CAST(('0x' || h[15:16] || h[13:14] || h[11:12] || h[9:10] || h[7:8] || h[5:6] || h[3:4] || h[1:2])::UBIGINT % 384 AS INT) AS place, CASE WHEN ('0x' || h[6:6])::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM h),
v AS (SELECT id, place, sum(s) AS v FROM c GROUP BY ALL), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM v GROUP BY id), e AS (SELECT id, place, CAST(v / n AS FLOAT)::DOUBLE AS x FROM v JOIN n USING (id) WHERE n > 0),
z AS (SELECT id, sqrt(sum(x * x)) AS z FROM e GROUP BY id), near AS (SELECT d.id, round(greatest(0, least(1, sum(d.x * q.x) / (any_value(zd.z) * any_value(zq.z)))), 6) AS sim FROM e d JOIN e q ON q.id = -1 AND q.place = d.place JOIN z zd ON zd.id = d.id JOIN z zq ON zq.id = -1 WHERE d.id >= 0 GROUP BY d.id),
dense AS (SELECT id, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (SELECT * FROM near ORDER BY sim DESC, id LIMIT 15))"""


@query(f"""{BM25}, lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 15)), {SKETCH},
fused AS (SELECT id, round(sum(1.0 / (60 + rank)), 6) AS s FROM (SELECT * FROM lex UNION ALL SELECT * FROM dense) GROUP BY id ORDER BY s DESC, id LIMIT 10),
w AS (SELECT doc_id AS id, list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda t: len(t) >= 2)) AS t, lower(coalesce(text, '')) AS x FROM documents WHERE doc_id IN (SELECT id FROM fused))
SELECT id, round(least(1.0, 0.75 * len(list_intersect(['the', 'of', 'that'], t)) / 3 + CASE WHEN contains(x, 'the of that') THEN 0.25 ELSE 0 END), 6)::DOUBLE AS score FROM w ORDER BY score DESC, id LIMIT 5""".replace("\\\\", "\\"))
def deep_search(spark, d):
    docs = texts(spark, d)
    words = L.ranked(text_index(spark, d).bm25("the of that", FIELDS, n=15), F.desc("score"), "id")
    sketch = V.hashed_embedding(docs.select("id", "text"))
    probe = V.hashed_embedding(spark.createDataFrame([(0, "the of that")], "id int, text string")).first()["embedding"]
    return M.deep_search(L.ranked(V.nearest(sketch, probe, 15), F.desc("similarity"), "id"), words, docs, "the of that")
