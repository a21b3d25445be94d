import pytest
from pyspark.sql import functions as F

from quern.functions import scores
from quern.operators import history as H
from quern.sources import readers


def test_habits_of_sessions(rows):
    edits = rows("commit string, file string", *[(c, f) for c, fs in {"c1": "dsv", "c2": "dsv", "c3": "ds", "c4": "mn"}.items() for f in fs])
    rules = {(r.trigger, r.consequent): r for r in H.habits(H.sessions(edits)).collect()}
    assert rules["d", "s"].confidence == 1.0 and rules["d", "s"].occurrences == 3
    assert rules["d", "v"].confidence == pytest.approx(2 / 3, abs=1e-6)
    assert rules["s", "d"].confidence == 1.0 and rules["v", "d"].confidence == 1.0
    assert not any(k[0] in "mn" for k in rules)
    chains = {r.trigger: r.choreography for r in H.choreographies(H.habits(H.sessions(edits))).collect()}
    assert chains["d"] == "s,v"


def test_synapse_weights_follow_order(rows):
    pairs = rows("src string, dst string, ts long, id long, dt double", ("a", "b", 1, 1, 15.0), ("a", "b", 2, 2, 5.0), ("c", "d", 1, 3, 15.0), ("e", "f", 1, 4, -10.0))
    weights = {r.src: r.weight for r in H.synapses(pairs).collect()}
    assert weights["a"] == pytest.approx(0.893402, abs=1e-6)
    assert weights["c"] == pytest.approx(0.695062, abs=1e-6)
    assert weights["e"] < 0.5


def test_spike_pairs_within_horizon(spark, rows):
    trace = rows("user_id int, event_id long, ts long, f string", (1, 1, 100, "x"), (1, 2, 115, "y"), (1, 3, 140, "z"), (1, 4, 9000, "x"))
    found = H.spike_pairs(trace.withColumn("ts", F.timestamp_seconds("ts")), "user_id", "f").collect()
    assert [(r.src, r.dst, r.dt) for r in sorted(found, key=lambda r: r.id)] == [("x", "y", 15.0), ("y", "z", 25.0)]


def test_scars_and_ripples(rows):
    failures = rows("file string, id long, message string", ("i.rs", 1, "b"), ("i.rs", 2, "a"), ("T.tsx", 3, "c"))
    scars = {r.file: r for r in H.threat_scars(failures).collect()}
    assert scars["i.rs"].threat_score == 0.70 and scars["i.rs"].messages == "b | a"
    assert [(r.file, r.error_gradient) for r in H.error_ripples(failures).collect()] == [("i.rs", 0.70), ("T.tsx", 0.55)]


def test_churn_of_nulls_and_empty(rows):
    schema = "commit long, author long, file string, insertions long, deletions long, is_fix boolean, ts timestamp"
    r = H.file_churn(rows(schema, (1, 1, "a", 10, None, True, None), (1, 2, "a", 5, 1, False, None))).first()
    assert (r.churn_score, r.commit_count, r.authors_count, r.fix_commits, r.hotspot_score, r.risk_level) == (16, 1, 2, 1, 24.0, "LOW")
    assert H.file_churn(rows(schema)).count() == 0


def test_churn_copies_no_row_and_counts_a_commit_once(spark, rows, sf_dir):
    from quern.plans.catalog import QUERIES

    schema = "commit int, author int, file string, insertions int, deletions int, is_fix boolean, ts int"
    data = [(1, 1), (1, 2), (1, 2), (2, None), (2, 1), (None, 3), (None, None), (3, 1)]
    table = rows(schema, *[(c, a, f, 1, None, False, k) for f in ("x", None) for k, (c, a) in enumerate(data)])
    got = {r.file: r[1:8] for r in H.file_churn(table).collect()}
    assert got == dict.fromkeys(("x", None), (8, 8, 0, 3, 3, 0, 7))
    for name in ("file_churn", "hotspots"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 4


def test_divergence_of_equal_shares_is_zero(rows):
    p = rows("subsystem string, mass int", ("a", 1), ("b", 1))
    assert H.subsystem_divergence(p, p).first().kl == pytest.approx(0)


def test_extinction_sigmoid(spark):
    got = [round(r[0], 4) for r in spark.range(1, 6).select(scores.extinction(F.col("id"))).collect()]
    assert got == [0.1680, 0.3100, 0.5000, 0.6900, 0.8320]


def test_history_from_log(rows):
    entry = "h1\x1fAnn\x1f1700000000\x1ffix: crash\n\n3\t1\tsrc/a.py\n-\t-\tlogo.png\n0\t2\tb.py"
    got = readers.parse_history(rows("entry string", (entry,))).orderBy("file").collect()
    assert [(r.file, r.insertions, r.deletions, r.is_fix) for r in got] == [("b.py", 0, 2, True), ("src/a.py", 3, 1, True)]


def test_thompson_is_seeded(rows):
    w = rows("src string, dst string, weight double", ("a", "b", 0.9), ("a", "c", 0.1))
    assert H.thompson(w).collect() == H.thompson(w).collect()


def test_synapse_chunks_equal_one_fold(rows):
    import math
    import random

    rng = random.Random(4)
    data = [("a", "b", t, k, rng.choice([1, -1]) * rng.random() * 900) for k, t in enumerate(sorted(rng.randrange(100_000) for _ in range(300)))]
    pairs = rows("src string, dst string, ts long, id long, dt double", *data)
    w = 0.5
    for *_, dt in data:
        w = min(1.0, max(0.01, w + 0.2 * (math.exp(-dt / 600) if dt > 0 else -0.5 * math.exp(dt / 300))))
    for seconds in (1, 3600, 10**9):
        r = H.synapses(pairs, seconds).first()
        assert r.weight == pytest.approx(w, abs=1e-9) and r.sample_count == 300


def test_co_changes_of_real_parts(spark, sf_dir):
    from quern.plans.catalog import QUERIES
    from quern.session import load

    pairs = QUERIES["part_co_changes"](spark, sf_dir)
    seen = pairs.select("file_a").union(pairs.select("file_b")).distinct().count()
    assert seen == load(spark, sf_dir, "lineitem").select("l_partkey").distinct().count() > 40


def test_sweeping_commits_are_cut_into_blocks(rows, monkeypatch):
    edits = rows("commit long, file long", *[(1, k) for k in range(25)], *[(2, k) for k in range(0, 25, 5)], (3, 1))
    want = {tuple(r) for r in H.co_changes(edits).collect()}
    monkeypatch.setattr(H, "COMMIT_BLOCK", 4)
    assert {tuple(r) for r in H.co_changes(edits).collect()} == want and len(want) == 300


def test_symbol_scars(rows):
    failures = rows("file string, id long, message string", ("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"))
    got = {(r.path, r.name): r.threat_score for r in H.symbol_scars(failures, rows("path string, name string", ("a", "f"), ("c", "g"), ("b", "h"))).collect()}
    assert got == {("a", "f"): 0.75, ("b", "h"): 0.6}


def test_rules_make_pairs_once(spark, rows):
    from quern.session import small_tasks

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    for given, kept in (("64MB", str(8 << 20)), ("4m", "4m")):
        spark.conf.set(name, given)
        small_tasks(spark)
        assert spark.conf.get(name) == kept
    spark.conf.unset(name)
    edits = rows("commit long, file long", *[(c, f) for c in range(3) for f in range(4)], *[(9, f) for f in range(1200)])
    plan = H.habits(edits)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1
    pairs = H.co_changes(edits)
    assert pairs.count() == 1200 * 1199 // 2
    assert pairs.where("together = 4").count() == 6 and pairs.where("together = 1").count() == 1200 * 1199 // 2 - 6
