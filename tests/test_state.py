import pytest
from pyspark.sql import functions as F

from quern.operators import state as St
from quern.operators import summaries as S


def at(rows, text="2024-01-01 00:01:00"):
    return F.lit(text).cast("timestamp")


def test_observations_revise_and_repeat(rows):
    w = rows(
        "id int, project string, scope string, type string, title string, content string, topic_key string",
        (1, "p", "s", "t", "x", "one", "Auth Model"), (2, "p", "s", "t", "y", "two", "auth-model"), (3, "p", "s", "t", "z", "same  text", None), (4, "p", "s", "t", "z", " Same text", None), (5, "p", "s", "t", "z", None, ""),
    )
    got = {r.id: (r.revision_count, r.duplicate_count, r.title) for r in St.save_observations(w).collect()}
    assert got == {1: (2, 0, "y"), 3: (1, 1, "z"), 5: (1, 0, "z")}


def test_reflex_fold(rows):
    e = rows("key string, at int, id int, threat double", ("f", 1, 1, 0.75), ("f", 2, 2, 0.80), ("g", 1, 3, 0.9), ("g", 2, 4, None), ("h", 1, 5, None))
    got = {r.key: r for r in St.reflexes(e).collect()}
    assert set(got) == {"f", "g"}
    assert got["f"].occurrences == 2 and got["f"].threat == pytest.approx(0.85) and got["f"].verdict == "veto"
    assert got["g"].clean_runs == 1 and got["g"].effective == pytest.approx(0.9 * (1 - 0.1680), abs=1e-4)


def test_queue_transitions(rows):
    q = rows("id int, status string, retry_count int, attempted_at timestamp", (1, "PENDING", 0, None), (2, "PENDING", 4, None), (3, "FAILED", 5, None), (4, "PENDING", 0, None), (5, "PROCESSED", 0, None)).withColumn("attempted_at", F.when(F.col("id") == 4, F.lit("2024-01-01 00:00:59.5").cast("timestamp")))
    results = rows("id int, ok boolean, error string", (1, True, None), (2, False, "boom"), (3, True, None), (4, True, None), (5, False, "late"))
    got = {r.id: (r.status, r.retry_count, r.error_message) for r in St.drained(q, results, at(rows)).collect()}
    assert got == {1: ("PROCESSED", 0, None), 2: ("FAILED", 5, "boom"), 3: ("FAILED", 5, None), 4: ("PENDING", 0, None), 5: ("PROCESSED", 0, None)}


def test_change_rows_know_soft_deletes(rows):
    old = rows("id int, v string, deleted_at string", (1, "a", None), (2, "b", None), (3, "c", None))
    new = rows("id int, v string, deleted_at string", (1, "a", None), (2, "b", "now"), (3, "C", None), (4, "d", None))
    got = {r.id: r.operation for r in St.changes(old, new, ["id"], "deleted_at").collect()}
    assert got == {2: "DELETE", 3: "UPSERT", 4: "UPSERT"}


def test_upserts(rows):
    base = rows("id int, a string, b string", (1, "x", "y"), (2, "x", "y"))
    got = St.merge_columns(base, rows("id int, a string, b string", (2, "z", None), (3, "n", "m")), ["id"], ["a", "b"])
    assert {tuple(r) for r in got.collect()} == {(1, "x", "y"), (2, "z", "y"), (3, "n", "m")}
    assert St.latest(rows("k int, t int, v string", (1, 1, "a"), (1, 2, "b"), (2, 1, None)), ["k"], ["t"]).count() == 2


def test_tolerant_timestamps(rows):
    got = [r[0] for r in rows("t string", ("1700000000",), ("2023-11-14T22:13:20Z",), ("2023-11-14 22:13:20",), ("soon",), (None,)).select(F.unix_seconds(St.timestamp(F.col("t")))).collect()]
    assert got == [1700000000, 1700000000, 1700000000, None, None]


def test_shadow_metrics(rows):
    n = rows(
        "id string, trajectory_id string, parent_id string, depth int, cost_tokens int, latency_ms int, recommended boolean, followed boolean",
        ("r", "t", None, 0, 150, 50, True, True), ("a", "t", "r", 1, 200, 60, False, False), ("b", "t", "r", 1, 180, 55, True, False), ("c", "t", "r", 1, 50, 1, False, False), ("d", "t", "a", 2, 100, 1, False, False),
    )
    r = S.shadow_metrics(n).first()
    assert (r.max_depth, r.branching_factor, r.max_branching, r.adherence_rate, r.total_tokens) == (2, 2.0, 3, 0.5, 680)


def test_consolidation_and_decay(rows):
    m = rows("topic string, content string, decayed double", ("a", "y", 0.2), ("a", "x", 0.4), ("a", "x", 0.3), ("b", "z", 0.9))
    got = {r.topic: (r.confidence, r.stale, r.summary) for r in St.consolidated(m).collect()}
    assert got == {"a": (1.0, True, "x | y"), "b": (0.8, False, "z")}
    d = St.decayed(rows("id int, confidence double, created_at string", (1, 0.8, "2024-01-01 00:00:00"), (2, 0.5, "2023-01-01"), (3, 0.9, None)), F.lit("2024-03-01").cast("date"))
    assert {r.id: (r.decayed, r.stale) for r in d.collect()} == {1: (0.4, False), 2: (pytest.approx(0.003687, abs=1e-6), True), 3: (0.9, False)}


def test_code_drift_first_line(rows):
    added = rows("id int, line_no int, line string", (1, 3, "x = eval(y)"), (1, 9, "eval(z)"), (2, 1, "parse(y)"))
    rules = rows("id int, content string", (7, "Never use eval, parse instead"), (8, "prohibited globals"))
    assert [tuple(r) for r in St.code_drift(added, rules).collect()] == [(7, 1, 3)]


def test_code_drift_keywords_substrings_and_files(rows):
    added = rows("id int, line_no int, line string, path string", (1, 1, "a.unwrap_or(b)", "src/a.rs"), (1, 2, "old_api(x)", "src/a.rs"), (2, 1, "print(x) # foo", "src/b.rs"), (3, 1, "print(y)", None))
    rules = rows(
        "id int, content string, path string",
        (1, "Never unwrap", ""), (2, "Deprecated: old_api", None), (3, "always print", "lib\\\\B.rs"), (4, "always print", "c.rs"), (5, "prefer foo", ""), (6, "never foo", "src/a.rs"),
    )
    got = sorted(tuple(r) for r in St.code_drift(added, rules).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 1)]
    assert {r.rule_id for r in St.code_drift(added, rules, whole_words=True).collect()} == {2, 3, 4}


def test_module_map(rows):
    files = rows("path string, language string", ("crates/core/src/a.rs", "rust"), ("crates/core/src/b.rs", "rust"), ("apps/web/src/x.ts", "ts"), ("top.py", "python"))
    edges = rows("src_path string, dst_path string", ("apps/web/src/x.ts", "crates/core/src/a.rs"), ("crates/core/src/b.rs", "crates/core/src/a.rs"))
    got = {r.module: (r.files, r.functions, r.depends_on) for r in S.capability_map(files, rows("path string", ("top.py",), ("top.py",)), edges).collect()}
    assert got == {"core": (2, 0, ""), "web": (1, 0, "core"), "root": (1, 2, "")}


def test_reflexes_and_modulators_equal_a_fold_in_order(rows):
    import math
    import random

    from quern.operators import memory as M

    rng = random.Random(8)
    log = [(rng.choice("abc"), rng.randrange(0, 20_000), k, rng.choice([None, None, 0.1, 0.35, 0.8, 0.95])) for k in range(300)] + [("z", 5, 900, None)]
    events = rows("key string, at long, id long, threat double", *log)
    got = {r.key: (round(r.threat, 9), r.occurrences, r.clean_runs) for r in St.reflexes(events, 1000).collect()}
    want = {}
    for key, _, _, threat in sorted(log, key=lambda e: e[1:3]):
        t, n, clean = want.get(key, (0.0, 0, 0))
        want[key] = (t, n, clean + 1) if threat is None else (threat if n == 0 else min(1.0, max(t, threat) + 0.05), n + 1, 0)
    assert got == {k: (round(t, 9), n, c) for k, (t, n, c) in want.items() if n}

    moods = [(key, at, k, rng.choice(["reward", "pain"]), rng.randrange(11) / 10) for key, at, k, _ in log]
    state = {}
    for key, _, _, kind, x in sorted(moods, key=lambda e: e[1:3]):
        d, a = state.get(key, (500, 200))
        half = lambda v: math.floor(abs(v) + 0.5 + 1e-9) * (1 if v >= 0 else -1)
        state[key] = (min(1000, max(10, d + half(300 * (x - 0.5)))), max(50, a - 150)) if kind == "reward" else (min(1000, max(50, d - half(200 * x))), min(1000, max(50, a + half(250 * x))))
    table = rows("key string, at long, id long, kind string, amount double", *moods)
    assert {r.key: (round(1000 * r.drive), round(1000 * r.alert)) for r in M.modulators(table, 1000).collect()} == state


def test_threatened_nodes_leave_a_gotcha(rows):
    nodes = rows("node_id long, title string, q_value double, threat double", (1, "a", 0.9, 0.8), (2, "b", 0.9, 0.1), (3, "c", 0.2, 0.9))
    assert sorted(r.id for r in St.promoted(nodes).collect()) == ["gotcha-1", "insight-1", "insight-2"]
