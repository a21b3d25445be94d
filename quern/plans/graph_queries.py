"""Queries over dependency graphs and search trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scores
from quern.operators import graph as G
from quern.operators import policy as P
from quern.operators import summaries as S
from quern.plans.registry import query
from quern.plans.roles import EDGES, FILES, NODES, edges, files, nodes
from quern.session import load


def seeds(spark, *ids: int):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def many_seeds(spark, d):
    """A part in twenty, from 8 on."""
    return load(spark, d, "part").where("p_partkey % 20 = 8").select(F.col("p_partkey").alias("node"))


MANY = "p_partkey AS node, 0 AS depth FROM part WHERE p_partkey % 20 = 8"


def _reach(start: str, depth: int, frm: str = "src", to: str = "dst", table: str = "edges") -> str:
    begin = start if " " in start else f"{start} AS node, 0 AS depth"
    return f"""walk AS (
  SELECT {begin} UNION SELECT e.{to}, w.depth + 1 FROM walk w JOIN {table} e ON e.{frm} = w.node WHERE w.depth < {depth}),
reached AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""


@query(f"""WITH {EDGES} SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out, CAST(sum(i + o) AS BIGINT) AS score FROM (
  SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY node ORDER BY score DESC, node LIMIT 20""")
def coupling_hotspots(spark, d):
    return G.coupling(edges(spark, d))


@query(f"""WITH RECURSIVE {EDGES}, {FILES}, {_reach('1', 6)}
SELECT r.node, r.depth, CASE WHEN regexp_matches(lower(path), 'schema|model|dto|entity|interface|type') THEN 'breaking'
  WHEN lessons > 0 OR functions > 15 OR depth <= 1 THEN 'warning' ELSE 'info' END AS severity FROM reached r JOIN files f ON f.node = r.node WHERE depth > 0""")
def impact_analysis(spark, d):
    return G.impact(edges(spark, d), seeds(spark, 1), files(spark, d), 6)


@query(f"WITH RECURSIVE {EDGES}, {_reach(MANY, 5, 'dst', 'src')} SELECT node, depth FROM reached WHERE depth > 0")
def incoming_dependencies(spark, d):
    return G.incoming(edges(spark, d), many_seeds(spark, d), 5)


@query(f"WITH {EDGES} SELECT dst AS node, 'out' AS direction FROM edges WHERE src = 8 UNION SELECT src, 'in' FROM edges WHERE dst = 8")
def neighbors(spark, d):
    return G.neighbors(edges(spark, d), 8)


@query(f"WITH RECURSIVE {EDGES}, {_reach(MANY, 4, 'dst', 'src')} SELECT DISTINCT src, dst, depth + 1 AS depth FROM edges JOIN reached ON dst = node")
def reverse_blast_radius(spark, d):
    return G.blast_edges(edges(spark, d), many_seeds(spark, d), 5)


@query(f"""WITH RECURSIVE {EDGES}, p AS (SELECT [CAST(1 AS BIGINT)] AS path, CAST(1 AS BIGINT) AS node, 0 AS hops
  UNION ALL SELECT list_append(path, dst), dst, hops + 1 FROM p JOIN edges ON src = node WHERE hops < 8 AND node <> 309 AND NOT list_contains(path, dst))
SELECT path, hops FROM p WHERE node = 309 AND hops > 0""")
def graph_paths(spark, d):
    return G.simple_paths(edges(spark, d), 1, 309, 8, None)


UNDIRECTED = "both_ways AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"


@query(f"""WITH RECURSIVE {EDGES}, {UNDIRECTED}, {_reach('8', 3, table='both_ways')}
SELECT r.node, r.depth, round(max(b.weight) * power(0.6, r.depth - 1), 6) AS weight FROM reached r JOIN both_ways b ON b.dst = r.node
JOIN reached q ON q.node = b.src AND q.depth = r.depth - 1 WHERE r.depth > 0 GROUP BY r.node, r.depth""")
def memory_neighborhood(spark, d):
    return G.neighborhood(edges(spark, d), seeds(spark, 8), 3)


TYPED = "typed AS (SELECT src, dst, CASE WHEN (src + dst) % 2 = 0 THEN 'supersedes' ELSE 'applies_to' END AS edge_type FROM edges)"


@query(f"""WITH RECURSIVE {EDGES}, {TYPED}, m AS (SELECT p_partkey AS id, p_size / 50 AS confidence FROM part),
near AS (SELECT dst AS node FROM typed WHERE src = 8 UNION SELECT src FROM typed WHERE dst = 8),
walk AS (SELECT node, 0 AS depth FROM near UNION SELECT e.dst, depth + 1 FROM walk JOIN typed e ON e.src = node AND edge_type = 'supersedes' WHERE depth < 60),
r AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)
SELECT id, depth, confidence AS old_confidence, greatest(0.1, confidence / 2) AS confidence, true AS stale, 'invalidated by 8: changed' AS stale_reason FROM m JOIN r ON r.node = m.id""")
def stale_cascade(spark, d):
    e = edges(spark, d).withColumn("edge_type", F.when((F.col("src") + F.col("dst")) % 2 == 0, "supersedes").otherwise("applies_to"))
    memories = load(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("confidence"))
    return G.stale_cascade(e, memories, 8, "changed")


DAG = "dag AS (SELECT src, dst FROM edges WHERE src > dst)"


@query(f"""WITH RECURSIVE {EDGES}, {DAG}, n AS (SELECT p_partkey AS node FROM part),
w AS (SELECT node, 0 AS level FROM n UNION SELECT d.src, level + 1 FROM w JOIN dag d ON d.dst = w.node),
l AS (SELECT node, max(level) AS level FROM w GROUP BY node)
SELECT node, level, row_number() OVER (ORDER BY level, node) AS place FROM l""")
def topological_order(spark, d):
    e = edges(spark, d).where("src > dst")
    return G.topological_order(load(spark, d, "part").select(F.col("p_partkey").alias("node")), e)


@query(f"""WITH RECURSIVE {EDGES}, w AS (SELECT src AS a, dst AS b FROM edges UNION SELECT w.a, e.dst FROM w JOIN edges e ON e.src = w.b)
SELECT x.a AS node, min(x.b) AS cycle FROM w x JOIN w y ON y.a = x.b AND y.b = x.a GROUP BY x.a""")
def import_cycles(spark, d):
    return G.cycles(edges(spark, d))


@query(f"""WITH {EDGES}, {FILES}, t AS (
  SELECT node, coalesce(fan_in, 0) AS fan_in, score, CASE WHEN regexp_matches(path, 'schema|model|entity|dto') THEN 0 WHEN regexp_matches(path, 'service|core|engine|logic') THEN 1
    WHEN regexp_matches(path, 'api|route|controller|handler') THEN 2 WHEN regexp_matches(path, 'ui|view|page|component') THEN 3 WHEN regexp_matches(path, 'test|spec') THEN 4 ELSE 5 END AS tier
  FROM files LEFT JOIN (SELECT dst, count(DISTINCT src) AS fan_in FROM edges GROUP BY dst) ON dst = node),
f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY tier ORDER BY fan_in DESC, score DESC, node) > 1 THEN 1 ELSE 0 END AS later FROM t)
SELECT node, tier, row_number() OVER (ORDER BY later, tier, fan_in DESC, score DESC, node) AS place FROM f""")
def refactor_order(spark, d):
    return G.refactor_order(files(spark, d), edges(spark, d))


@query()
def communities(spark, d):
    return G.communities(edges(spark, d))


@query("""SELECT l_orderkey AS change, count(DISTINCT p_size % 7) AS communities, count(DISTINCT p_size % 7) > 1 AS alert FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def cross_domain_changes(spark, d):
    """Changes against given labels; ``communities`` gives those of a graph."""
    changes = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("change"), F.col("l_partkey").alias("node"))
    return G.crosses_domains(changes, load(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 7).alias("community")))


@query(f"""WITH RECURSIVE {EDGES}, {UNDIRECTED}, {_reach('8', 3, table='both_ways')},
q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS id, vec_id % (SELECT count(*) FROM part) + 1 AS node, round(greatest(0, least(1, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(e, lambda x: x::DOUBLE)))), 6) AS s,
      label / 10 AS g FROM embeddings, q),
c AS (SELECT id, v.node, depth, round(1 / (60 + 100 * (1 - s)) + 1 / (60 + 10 * depth), 6) AS score FROM v JOIN reached r ON r.node = v.node WHERE g >= 0.4)
SELECT id, node, depth, score FROM (SELECT * FROM c UNION ALL SELECT id, node, -1, round(s / 60, 6) FROM v WHERE g >= 0.4 AND NOT EXISTS (SELECT 1 FROM c)) ORDER BY score DESC, id LIMIT 5""")
def cone_vector_search(spark, d):
    from quern.operators.vector import similarity

    e, n = load(spark, d, "embeddings"), load(spark, d, "part").agg(F.count("*").alias("n"))
    q = e.where("vec_id = 0").select(F.col("embedding").alias("q"))
    ripples = e.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(n))  # one row each
    ripples = ripples.select(F.col("vec_id").alias("id"), (F.col("vec_id") % F.col("n") + 1).alias("node"), (F.col("label") / 10).alias("gradient"), F.round(similarity(F.col("embedding"), F.col("q")), 6).alias("s"))
    return G.cone_search(edges(spark, d), seeds(spark, 8), ripples, F.col("s"), 3, 5)


@query("""SELECT p_partkey AS node_id, p_brand || '.' || p_partkey AS path, p_size AS visits, p_retailprice AS q_value FROM part WHERE p_brand = 'Brand#11' OR starts_with(p_brand || '.' || p_partkey, 'Brand#11.')""")
def tree_subtree(spark, d):
    p = load(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.concat_ws(".", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("visits"), F.col("p_retailprice").alias("q_value"))
    return G.subtree(p, "Brand#11")


CLOSURE = "closure AS (SELECT id AS node, id AS ancestor FROM nodes UNION ALL SELECT c.node, n.parent_id FROM closure c JOIN nodes n ON n.id = c.ancestor WHERE n.parent_id IS NOT NULL)"
BACK = f"""WITH RECURSIVE {NODES}, {CLOSURE}, b AS (SELECT ancestor AS id, count(*) AS visits, round(avg(reward_score), 6) AS value FROM closure JOIN nodes ON id = node GROUP BY ancestor)"""


@query(f"{BACK} SELECT * FROM b")
def backpropagated_tree(spark, d):
    return G.backpropagate(nodes(spark, d).select("id", "parent_id", F.col("reward_score").alias("reward")))


@query(f"""{BACK}, t AS (SELECT n.id, n.parent_id, value, visits FROM nodes n JOIN b ON b.id = n.id), r AS (SELECT sum(visits) AS a FROM t WHERE parent_id IS NULL)
SELECT t.id, t.parent_id, round(t.value + sqrt(2) * sqrt(ln(greatest(coalesce(p.visits, a), 1)) / greatest(t.visits, 1)), 6) AS uct FROM t LEFT JOIN t p ON p.id = t.parent_id, r""")
def ucb_tree(spark, d):
    n = nodes(spark, d).select("id", "parent_id", F.col("reward_score").alias("reward"))
    return G.ucb_tree(n.select("id", "parent_id").join(G.backpropagate(n), "id"))


@query(f"""WITH {EDGES}, {FILES}, near AS (SELECT dst AS node FROM edges WHERE src = 8 UNION SELECT src FROM edges WHERE dst = 8),
s AS (SELECT l_partkey AS node, l_orderkey || '-' || l_linenumber AS name, CAST(l_orderkey AS BIGINT) AS start_line FROM lineitem)
SELECT s.*, row_number() OVER (PARTITION BY s.node ORDER BY start_line, name) AS place FROM s JOIN near ON near.node = s.node QUALIFY place <= 5""")
def speculative_contracts(spark, d):
    s = load(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("name"), F.col("l_orderkey").alias("start_line"))
    return G.speculative_contracts(edges(spark, d), s, 8)


ENDPOINTS = """endpoints AS (SELECT p_type AS path, CASE WHEN p_size % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, p_size > 48 AS tagged, p_partkey % 50 AS file FROM part WHERE p_size % 5 = 0),
consumers AS (SELECT p_partkey AS id, p_type AS path, CASE WHEN p_size % 3 = 0 THEN 'GET' ELSE 'POST' END AS method, p_size > 25 AS tagged, p_partkey % 50 AS file FROM part WHERE p_size % 5 <> 0)"""


def contracts(spark, d):
    p = load(spark, d, "part")
    def side(rows, third):
        return rows.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("path"), F.when(F.col("p_size") % third == 0, "GET").otherwise("POST").alias("method"), (F.col("p_size") > (48 if third == 2 else 25)).alias("tagged"), (F.col("p_partkey") % 50).alias("file"))
    return side(p.where("p_size % 5 = 0"), 2), side(p.where("p_size % 5 <> 0"), 3)


@query(f"""WITH {ENDPOINTS}, k AS (SELECT path, list(DISTINCT method) AS methods, bool_or(tagged) AS b FROM endpoints GROUP BY path),
j AS (SELECT c.id, c.path, c.method, CASE WHEN methods IS NULL THEN 'ORPHAN' WHEN NOT list_contains(methods, c.method) THEN 'METHOD_MISMATCH' WHEN b AND NOT c.tagged THEN 'UNSYNCHRONIZED' END AS drift
      FROM consumers c LEFT JOIN k USING (path)) SELECT * FROM j WHERE drift IS NOT NULL""")
def contract_drift(spark, d):
    return G.contract_drift(*contracts(spark, d))


@query(f"WITH {ENDPOINTS} SELECT DISTINCT c.file AS src, e.file AS dst FROM consumers c JOIN endpoints e USING (path)")
def cross_repository_edges(spark, d):
    return G.cross_edges(*contracts(spark, d))


NAMED = "CASE WHEN {0} % 3 = 0 THEN 'web/page' || {0} || '.tsx' ELSE 'lib/part' || {0} || '.py' END"


@query(f"""WITH RECURSIVE {EDGES}, named AS (SELECT {NAMED.format('src')} AS src, {NAMED.format('dst')} AS dst FROM edges),
{_reach(NAMED.format('p_partkey') + ' ' + MANY.split(' ', 1)[1], 3, 'dst', 'src', 'named')}
SELECT count(*) AS files, CAST(sum(CAST(regexp_matches(lower(node), '(page|view|sheet)[^/]*\\.(tsx|jsx)$') AS INT)) AS BIGINT) AS views,
CASE WHEN count(*) <= 2 THEN 'LOW' WHEN count(*) <= 7 THEN 'MEDIUM' ELSE 'CRITICAL_BREAKING' END AS level FROM reached""")
def frontend_blast_radius(spark, d):
    """Consumers in files named after their numbers, a third of them pages."""
    e = edges(spark, d)
    named = e.select(F.expr(NAMED.format("src")).alias("src"), F.expr(NAMED.format("dst")).alias("dst"))
    return G.frontend_blast(named, many_seeds(spark, d).select(F.expr(NAMED.format("node")).alias("node")), 3)


@query(f"""WITH {NODES}, t AS (SELECT trajectory_id, count(*) AS total_nodes, max(depth) AS max_depth, CAST(sum(cost_tokens) AS BIGINT) AS total_tokens, CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms,
  count(*) FILTER (recommended) AS given, count(*) FILTER (recommended AND followed) AS kept FROM nodes GROUP BY trajectory_id),
c AS (SELECT trajectory_id, sum(n) / count(*) AS bf, max(n) AS mb FROM (SELECT trajectory_id, parent_id, count(*) AS n FROM nodes WHERE parent_id IS NOT NULL GROUP BY ALL) GROUP BY trajectory_id)
SELECT trajectory_id, total_nodes, max_depth, total_tokens, total_latency_ms, round(coalesce(bf, 0), 6) AS branching_factor, coalesce(mb, 0) AS max_branching,
  round(CASE WHEN given > 0 THEN kept / given ELSE 1 END, 6) AS adherence_rate FROM t LEFT JOIN c USING (trajectory_id)""")
def shadow_metrics(spark, d):
    return S.shadow_metrics(nodes(spark, d))


@query(f"""WITH RECURSIVE {NODES}, {CLOSURE}, u AS (SELECT trajectory_id, sum(cost_tokens) AS useful FROM nodes WHERE id IN (SELECT ancestor FROM closure JOIN nodes s ON s.id = node WHERE s.is_solution) GROUP BY trajectory_id),
t AS (SELECT trajectory_id, count(*) AS total_nodes, CAST(sum(cost_tokens) AS BIGINT) AS total_tokens, count(*) FILTER (latency_ms > 3000 OR cost_tokens > 2000) AS bottlenecks,
  count(*) FILTER (reward_score < 0 AND NOT is_pruned) AS unpruned_negative, round(CASE WHEN var_pop(reward_score) > 10 THEN 1.8 WHEN var_pop(reward_score) < 1 THEN 1.1 ELSE sqrt(2) END, 6)::DOUBLE AS advised_c FROM nodes GROUP BY trajectory_id)
SELECT t.*, round(CASE WHEN total_tokens > 0 THEN coalesce(useful, 0) / total_tokens ELSE 0 END, 6) AS token_efficiency FROM t LEFT JOIN u USING (trajectory_id)""")
def trajectory_diagnosis(spark, d):
    return S.diagnosis(nodes(spark, d))


@query(f"""WITH {NODES} SELECT trajectory_id, id, value_estimate FROM nodes WHERE NOT is_pruned AND NOT is_solution
QUALIFY row_number() OVER (PARTITION BY trajectory_id ORDER BY value_estimate DESC, depth DESC, created_at DESC, id DESC) = 1""")
def resume_nodes(spark, d):
    return S.resume_nodes(nodes(spark, d))


@query(f"""WITH {NODES}, m AS (SELECT trajectory_id, k FROM nodes WHERE is_solution)
SELECT DISTINCT n.trajectory_id, n.id, n.k AS place FROM nodes n JOIN m ON m.trajectory_id = n.trajectory_id AND n.k BETWEEN m.k - 2 AND m.k + 2""")
def observation_timeline(spark, d):
    return S.timeline(nodes(spark, d), "trajectory_id", "k", F.col("is_solution")).select("trajectory_id", "id", F.col("place").cast("long").alias("place"))


@query()
def policy_replay(spark, d):
    return P.replay(nodes(spark, d))


@query()
def policy_search(spark, d):
    return P.search(nodes(spark, d))


#: Metrics of two policies: all of a tree, and its first levels.
METRICS = f"""{NODES}, m AS (SELECT trajectory_id, p.policy, count(*) AS steps, CAST(sum(cost_tokens) AS BIGINT) AS tokens, bool_or(is_solution) AS solved FROM nodes, (VALUES ('balanced_mcts_default', 99), ('fast_reflex', 3)) AS p(policy, most) WHERE depth <= most GROUP BY trajectory_id, p.policy),
costs AS (SELECT *, tokens + 500 * steps AS cost FROM m)"""


def _metrics(spark, d):
    policies = spark.createDataFrame([("balanced_mcts_default", 99), ("fast_reflex", 3)], "policy string, most int")
    rows = nodes(spark, d).join(F.broadcast(policies), F.col("depth") <= F.col("most"))  # two rows
    return rows.groupBy("trajectory_id", "policy").agg(F.count("*").alias("steps"), F.sum("cost_tokens").alias("tokens"), F.bool_or("is_solution").alias("solved"))


@query(f"""WITH {METRICS}, b AS (SELECT trajectory_id, cost AS base_cost, solved AS base_solved FROM costs WHERE policy = 'balanced_mcts_default'), g AS (SELECT c.*, base_solved, CASE WHEN base_cost > 0 THEN (base_cost - cost) / base_cost ELSE 0 END AS gain FROM costs c JOIN b USING (trajectory_id))
SELECT trajectory_id, policy, cost, solved, round(gain, 6) AS gain, solved AND (NOT base_solved OR gain >= 0.10) AS optimal FROM g""")
def policy_comparison(spark, d):
    return P.compared(_metrics(spark, d))


@query(f"""WITH {METRICS}, f AS (SELECT trajectory_id, policy, 100 * CAST(solved AS INT) - 25 * (steps / 10) + least(30.0, greatest(-20.0, (2000 - cost) / 500)) AS f FROM costs),
p AS (SELECT a.trajectory_id, a.f - b.f AS gain, row_number() OVER (ORDER BY a.trajectory_id) AS k, count(*) OVER () AS n FROM f a JOIN f b ON a.trajectory_id = b.trajectory_id AND a.policy = 'fast_reflex' AND b.policy = 'balanced_mcts_default')
SELECT count(*) AS trees, round(avg(gain), 6) AS gain, count(*) >= 3 AND avg(gain) > 0 AS promoted FROM p WHERE n < 4 OR k > 0.7 * n""")
def policy_promotion(spark, d):
    return P.promotion(_metrics(spark, d), "fast_reflex")


@query()
def policy_replay_comparison(spark, d):
    return P.compared(P.replay(nodes(spark, d)))


@query(f"""WITH {METRICS}, b AS (SELECT policy, round(avg(100 * CAST(solved AS INT) - 25 * (steps / 10) + least(30.0, greatest(-20.0, (2000 - cost) / 500))), 6) AS fitness, count(*) AS trees, count(*) FILTER (solved) AS solved, CAST(sum(cost) AS BIGINT) AS cost FROM costs GROUP BY policy)
SELECT *, row_number() OVER (ORDER BY fitness DESC, policy) AS rank FROM b""")
def policy_sweep(spark, d):
    return P.sweep(_metrics(spark, d))


@query(f"""WITH {NODES} SELECT id, round(value_estimate + sqrt(2) * sqrt(ln(40) / greatest(visit_count, 1)), 6) AS uct, round(value_estimate + 1.25 * 0.5 * sqrt(40) / (1 + visit_count), 6) AS puct,
round(0.40 * (reward_score / 10) + 0.35 * value_estimate + 0.25 * (1.0 / visit_count), 6) AS efe, round(value_estimate + 0.35 * (1.0 / visit_count), 6) AS efe_plain,
round((1 + ln(1 + 10 * value_estimate)) * 1.5, 6) AS budget FROM nodes""")
def search_scores(spark, d):
    n, q, v = nodes(spark, d), F.col("value_estimate"), F.col("visit_count")
    return n.select(
        "id", F.round(scores.uct(q, v, F.lit(40)), 6).alias("uct"), F.round(scores.puct(q, F.lit(0.5), v, F.lit(40)), 6).alias("puct"),
        F.round(scores.expected_free_energy(F.col("reward_score") / 10, q, 1.0 / v), 6).alias("efe"), F.round(scores.expected_free_energy_plain(q, 1.0 / v), 6).alias("efe_plain"),
        F.round(scores.search_budget(q, F.lit(0.5)), 6).alias("budget"),
    )


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS b, p_retailprice AS c FROM part),
l AS (SELECT id, 2.4 - 0.35 * least(15, b % 20) - 0.002 * least(1500, c) + 1.8 * ((b % 5) / 5) - 0.8 * least(3.0, b / 20) - 1.1 * CAST(b = 7 AS INT) AS x FROM p),
s AS (SELECT id, 1 / (1 + exp(-least(6.0, greatest(-6.0, x)))) AS s FROM l)
SELECT id, round(s, 6) AS safe, round(1.96 * sqrt(s * (1 - s) / 10), 6) AS margin, CASE WHEN s >= 0.80 THEN 'safe' WHEN s >= 0.55 THEN 'moderate' WHEN s >= 0.35 THEN 'risky' ELSE 'critical' END AS tier FROM s""")
def change_risk(spark, d):
    b = F.col("p_size")
    p = scores.change_risk(b % 20, F.col("p_retailprice"), (b % 5) / 5, b / 20, (b == 7).cast("int"))
    rows = load(spark, d, "part").select(F.col("p_partkey").alias("id"), p.alias("p"))
    return rows.select("id", F.round("p", 6).alias("safe"), F.round(scores.risk_interval(F.col("p")), 6).alias("margin"), scores.risk_tier(F.col("p")).alias("tier"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 9 AS b FROM part), r AS (SELECT id, 0.95 - 0.02 * least(5, b) AS dual, CASE WHEN b > 3 THEN 0.88 ELSE 0.75 END AS ad,
CASE WHEN b <= 2 THEN 0.92 ELSE greatest(0.40, 0.90 - 0.08 * b) END AS sy FROM p)
SELECT id, round(greatest(dual, ad, sy), 6)::DOUBLE AS reward, CASE WHEN dual >= ad AND dual >= sy THEN 'dual_contract' WHEN ad >= sy THEN 'adapter' ELSE 'caller_sync' END AS action FROM r""")
def drift_resolution(spark, d):
    options = scores.drift_rewards(F.col("p_size") % 9)
    best = F.greatest(*options.values())
    action = None
    for name, reward in options.items():
        action = F.when(reward >= best, name) if action is None else action.when(reward >= best, name)
    return load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(best, 6).alias("reward"), action.alias("action"))


@query("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'drop table x' ELSE 'edit' END AS plan, p_size % 12 AS files, p_size % 9 AS blast, p_size % 3 AS hotspots FROM part),
r AS (SELECT id, list_filter([CASE WHEN regexp_matches(lower(plan), '\\b(drop|truncate|alter)\\s+table\\b') THEN 'ddl' END, CASE WHEN blast > 7 THEN 'blast' END, CASE WHEN hotspots > 0 THEN 'hotspot' END,
  CASE WHEN files > 8 THEN 'many_files' END], lambda x: x IS NOT NULL) AS r FROM c)
SELECT id, CASE WHEN list_contains(r, 'ddl') OR len(r) >= 3 THEN 'blocked' WHEN len(r) > 0 THEN 'review' ELSE 'approved' END AS verdict, array_to_string(r, ',') AS reasons FROM r""")
def risk_review(spark, d):
    s = F.col("p_size")
    plan = F.when(s % 10 == 0, "drop table x").otherwise("edit")
    return P.risk_review(load(spark, d, "part").select(F.col("p_partkey").alias("id"), plan.alias("plan"), (s % 12).alias("files"), (s % 9).alias("blast"), (s % 3).alias("hotspots")))
