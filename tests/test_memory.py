from pyspark.sql import functions as F

from quern.operators import memory as M


def test_freshness_and_alerts(rows):
    files = rows("path string, mtime timestamp", ("a", None)).withColumn("mtime", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    m = rows("id int, file_path string, stale boolean, created_at string", (1, "a", False, "2024-01-01 00:00:00"), (2, "a", False, "2024-01-02 00:00:00"), (3, "b", False, "2024-01-01 00:00:00"), (4, "a", True, "2024-01-03 00:00:00")).withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert {r.id: r.warning for r in M.freshness(m, files).collect()} == {1: "file_changed", 2: None, 3: "file_missing", 4: "stale"}
    alerts = rows("id int, resolved boolean, created_at string", (1, True, "2024-01-01"), (2, True, "2024-03-01"), (3, False, "2020-01-01")).withColumn("created_at", F.col("created_at").cast("date"))
    assert {r.id for r in M.pruned_alerts(alerts, F.lit("2024-03-10").cast("date")).collect()} == {2, 3}
    assert [r.id for r in M.drift_alerts(alerts).collect()] == [3]


def test_modulators_fold(rows):
    e = rows("key int, at int, id int, kind string, amount double", (1, 1, 1, "reward", 1.0), (1, 2, 2, "pain", 1.0), (2, 1, 3, "pain", 0.0))
    got = {r.key: (r.drive, r.alert, r.threat_threshold) for r in M.modulators(e).collect()}
    assert got == {1: (0.45, 0.3, 0.67), 2: (0.5, 0.2, 0.71)}


def test_pressure_and_sessions(rows):
    a = rows("key int, kind string, weight double", (1, "test_failure", 20.0), (1, "query", 1.0), (2, "ast_patch", 2.0))
    assert {r.key: (r.load, r.rest) for r in M.pressure(a).collect()} == {1: (100.5, True), 2: (5.0, False)}
    log = rows("id int, at int, event string, project string", (1, 5, "start", "p"), (1, 7, "start", "q"), (1, 9, "end", None), (2, 1, "start", "r"))
    assert {(r.id, r.project, r.started_at, r.ended_at, r.status) for r in M.sessions_state(log).collect()} == {(1, "p", 5, 9, "ended"), (2, "r", 1, None, "active")}


def test_rules_by_text(rows):
    cases = {"name 'x' is not defined": "MISSING_IMPORT", "coroutine was never awaited: await it": "ASYNC_AWAIT_MISMATCH", "cannot borrow `x`": "MUTABILITY_OR_BORROW", "expected i32, found str": "TYPE_MISMATCH", "INVARIANT[7] broken": "INVARIANT_VIOLATION", "slow": "GENERAL_DIAGNOSTIC"}
    got = {r.m: r.k for r in rows("m string", *[(c,) for c in cases]).select("m", M.diagnostic_kind(F.col("m"), F.lit("")).alias("k")).collect()}
    assert got == cases
    assert [r[0] for r in rows("m string", ("arity off",), ("x is None",), ("ModuleNotFound",), ("boom",)).select(M.replay_rule(F.col("m"))).collect()] == ["ARITY_PARITY", "ADD_GUARD", "INVERT_DEPENDENCY", "ISOLATE_SANDBOX"]


def test_context_stays_in_budget(rows):
    parts = rows("priority int, id int, body string", (1, 1, "x" * 400), (1, 2, "x" * 400), (2, 3, "x" * 4000))
    assert [r.id for r in M.task_context(parts, 250).orderBy("id").collect()] == [1, 2]


def test_searches(rows):
    obs = rows("id int, title string, content string, topic_key string, deleted_at string, scope string", (1, "Cache", None, None, None, "p"), (2, "x", "a CACHE", None, "now", "p"), (3, None, None, "cache-key", None, "q"))
    assert [r.id for r in M.search_observations(obs, "cache").collect()] == [3, 1]
    assert [r.id for r in M.search_observations(obs, "cache", scope="p").collect()] == [1]
    g = rows("id int, severity string, title string, content string, tags string, created_at int", (1, "high", "sql", None, None, 1), (2, "low", "css grid", None, None, 2))
    assert [r.id for r in M.search_gotchas(g, "a css").collect()] == [2] and [r.id for r in M.search_gotchas(g, "a b").collect()] == [1]
    r = rows("id int, project string, content string", *[(k, "p" if k % 3 else "q", "hit") for k in range(12)], (99, "p", "miss"))
    assert [x.id for x in M.cross_project_search(r, "HIT", 2).collect()] == [11, 10, 9, 6]


def test_points_of_paths_are_not_broadcast(spark, sf_dir):
    """Points grow with the files, whatever size Spark takes them to be."""
    from quern.plans.catalog import QUERIES

    for name in ("path_coupling", "hyperbolic_coupling"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
