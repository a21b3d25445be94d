"""Recorded search trees: new steps, trajectories and the way back.

Nodes have id, trajectory_id, parent_id, depth, reward_score, visit_count, value_estimate,
is_solution, is_pruned and created_at; trajectories id, project, status, total_steps,
cumulative_reward, created_at and completed_at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import hung, subtree_sums
from quern.storage import materialize

NODE = ("id", "trajectory_id", "parent_id", "depth", "reward_score", "visit_count", "value_estimate", "is_solution", "is_pruned", "created_at")


def judged(steps: DataFrame) -> DataFrame:
    """``steps`` with reward_score, is_solution and is_pruned, by what is known of each.

    A receipt (exit_code, passed, failed_count; all null: none) overrides whatever the step
    claims: a failed run is -1 and pruned, a passed one 10 for a solution, else 1. Without one,
    a claimed solution whose text shows a failure is rejected, -1; a claimed reward counts, but a
    positive one beside a failure is -1; else failures are -0.8, solutions 10, tests that
    passed 1, pruned steps -1, others 0. Steps have claims_solution, claims_pruned, reward
    (null: not claimed) and the signs syntax_failure, failure, success; is_test marks runs."""
    receipt = F.col("exit_code").isNotNull() | F.col("passed").isNotNull()
    broke = (F.coalesce("exit_code", F.lit(0)) != 0) | ~F.coalesce("passed", F.lit(False)) | (F.coalesce("failed_count", F.lit(0)) > 0)
    claims = F.coalesce("claims_solution", F.lit(False))
    syntax, failure = F.coalesce("syntax_failure", F.lit(False)), F.coalesce("failure", F.lit(False))
    any_failure, raw = syntax | failure, F.col("reward")
    pruned = F.coalesce("claims_pruned", failure)
    false_solution = claims & any_failure
    reward = (
        F.when(receipt & broke, -1.0).when(receipt & claims, 10.0).when(receipt, 1.0)
        .when(false_solution, -1.0).when((raw > 0) & failure, -1.0).when(raw.isNotNull(), raw)
        .when(any_failure, -0.8).when(claims, 10.0).when(F.coalesce("success", F.lit(False)) & F.coalesce("is_test", F.lit(False)), 1.0).when(pruned, -1.0).otherwise(0.0)
    )
    cut = (
        F.when(receipt, broke).when(false_solution, True).when((raw > 0) & failure, True)
        .when((raw < 0) & F.col("claims_pruned").isNull(), True).when(raw.isNull() & any_failure, True).otherwise(pruned)
    )
    solved = F.when(receipt, claims & ~broke).otherwise(claims & ~any_failure)
    return steps.withColumns({"reward_score": reward, "is_solution": solved, "is_pruned": cut})


def recorded(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """The nodes after a batch of judged steps (id, trajectory_id, parent_id, at, and what ``judged`` adds).

    A step without a parent hangs on the step before it in its trajectory, the first one on
    the trajectory's deepest live node, the newest of equals. Each step's reward goes to all
    its ancestors as a running mean. Trajectories without steps are passed through."""
    place = Window.partitionBy("trajectory_id").orderBy("at", "id")
    live = nodes.where(~F.coalesce("is_pruned", F.lit(False))).groupBy("trajectory_id")
    deepest = live.agg(F.max_by("id", F.struct("depth", "created_at", "id")).alias("deepest"))
    new = steps.withColumn("before", F.lag("id").over(place)).join(deepest, "trajectory_id", "left")
    new = materialize(new.withColumn("parent_id", F.coalesce("parent_id", "before", "deepest")), "new")
    # How many of the new steps are above each, by doubling pointers, a row a step in each round.
    known = new.select(F.col("id").alias("up"))
    single = new.select("id", F.col("parent_id").alias("up")).join(known, "up", "left_semi")
    chain = hung(materialize(single.select(F.col("id").alias("node"), "up", F.lit(1).alias("steps")), "steps"))
    deep = new.select("id", "parent_id").join(chain.select(F.col("node").alias("id"), F.col("root"), "steps"), "id", "left")
    deep = deep.select("id", F.coalesce("root", "id").alias("top"), F.coalesce("steps", F.lit(0)).alias("steps"))
    tops = new.select(F.col("id").alias("top"), F.col("parent_id").alias("on")).join(nodes.select(F.col("id").alias("on"), F.col("depth").alias("base")), "on", "left").select("top", "base")
    deep = deep.join(tops, "top").select("id", (F.coalesce(F.col("base") + 1, F.lit(0)) + F.col("steps")).cast("int").alias("depth"))
    fresh = new.join(deep, "id").select("id", "trajectory_id", "parent_id", "depth", "reward_score", F.lit(0).cast("long").alias("visit_count"), F.lit(0.0).alias("value_estimate"), "is_solution", "is_pruned", F.col("at").alias("created_at"))
    both = nodes.select(*NODE).unionByName(fresh)
    touched = steps.select("trajectory_id").distinct()
    tree = materialize(both.join(touched, "trajectory_id", "left_semi"), "tree")
    added = F.when(F.col("visit_count") == 0, 1).otherwise(0).cast("long")
    sums = subtree_sums(tree, more=added, gain=added * F.col("reward_score"))
    seen = F.col("visit_count") + F.coalesce("more", F.lit(0))
    value = (F.col("value_estimate") * F.col("visit_count") + F.coalesce("gain", F.lit(0.0))) / F.greatest(seen, F.lit(1))
    updated = tree.join(sums, "id").withColumns({"value_estimate": F.round(value, 6), "visit_count": seen}).select(*NODE)
    return nodes.join(touched, "trajectory_id", "left_anti").unionByName(updated)


def advanced(trajectories: DataFrame, steps: DataFrame) -> DataFrame:
    """Trajectories with a batch of judged steps counted in."""
    sums = steps.groupBy(F.col("trajectory_id").alias("id")).agg(F.count("*").alias("__n"), F.sum("reward_score").alias("__r"))
    rows = trajectories.join(sums, "id", "left")
    more = {"total_steps": F.col("total_steps") + F.coalesce("__n", F.lit(0)), "cumulative_reward": F.round(F.col("cumulative_reward") + F.coalesce("__r", F.lit(0.0)), 6)}
    return rows.withColumns(more).select(*trajectories.columns)


def completed(trajectories: DataFrame, ends: DataFrame) -> DataFrame:
    """Trajectories after ends (id, status, final_reward, at): status, time and a last reward."""
    e = ends.select("id", F.col("status").alias("__status"), F.coalesce("final_reward", F.lit(0.0)).alias("__r"), F.col("at").alias("__at"))
    rows = trajectories.join(e, "id", "left")
    done = {
        "status": F.coalesce("__status", "status"), "completed_at": F.coalesce("__at", "completed_at"),
        "cumulative_reward": F.round(F.col("cumulative_reward") + F.coalesce("__r", F.lit(0.0)), 6),
    }
    return rows.withColumns(done).select(*trajectories.columns)


def listed(trajectories: DataFrame, project: str | None = None, n: int = 20) -> DataFrame:
    """Newest trajectories, of one project or of all."""
    rows = trajectories.where(F.col("project") == project) if project is not None else trajectories
    return rows.orderBy(F.desc("created_at"), "id").limit(n)


def deleted(nodes: DataFrame, trajectories: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and trajectories without those of the given ids (column id)."""
    ids = gone.select("id").distinct()
    return nodes.join(ids.withColumnRenamed("id", "trajectory_id"), "trajectory_id", "left_anti").select(*nodes.columns), trajectories.join(ids, "id", "left_anti")


_FILE = "path string, file_path string, content string, before_content string"


def rollbacks(nodes: DataFrame, trajectories: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, node_id, trajectory_id, status, path, content): the files that going back to each wanted
    node (column id) restores: a row per file, or one row that says why there is none.

    A node without a snapshot that names files falls back on its parent's. Snapshots are JSON
    with ``files``, one file, or ``git_restore`` paths (content null: as committed). Nothing is
    written to disk. Status: ok, skipped_no_snapshot, not_found."""
    snap = F.from_json("rollback_snapshot", f"files array<struct<{_FILE}>>, {_FILE}, git_restore array<string>")

    def one(path: Column, content: Column) -> Column:
        return F.struct(path.alias("path"), content.alias("content"))

    s = F.col("s")
    many = F.transform(s["files"], lambda f: one(F.coalesce(f["path"], f["file_path"]), F.coalesce(f["content"], f["before_content"])))
    single = F.array(one(F.coalesce(s["file_path"], s["path"]), F.coalesce(s["content"], s["before_content"])))
    restored = F.transform(s["git_restore"], lambda p: one(p, F.lit(None).cast("string")))
    files = F.filter(F.coalesce(many, F.when(single[0]["path"].isNotNull() & single[0]["content"].isNotNull(), single), restored), lambda f: f["path"].isNotNull())
    known = nodes.select("id", "trajectory_id", "parent_id", "rollback_snapshot").join(trajectories.select(F.col("id").alias("trajectory_id")), "trajectory_id")
    known = known.withColumn("s", snap).select("id", "trajectory_id", "parent_id", F.coalesce(F.size(files) > 0, F.lit(False)).alias("has"), files.alias("files"), (F.trim(F.coalesce("rollback_snapshot", F.lit(""))) != "").alias("snapped"))
    own = wanted.select(F.col("id").alias("asked")).distinct().join(known, F.col("asked") == F.col("id"), "left")
    above = known.select(F.col("id").alias("pid"), F.col("has").alias("p_has"), F.col("files").alias("p_files"), F.col("snapped").alias("p_snapped"))
    rows = own.join(above, F.col("parent_id") == F.col("pid"), "left")
    use_parent = ~F.col("has") & F.col("pid").isNotNull()
    status = F.when(F.col("id").isNull(), "not_found").when(F.when(use_parent, F.col("p_snapped")).otherwise(F.col("snapped")), "ok").otherwise("skipped_no_snapshot")
    rows = rows.select(
        F.col("asked").alias("id"), F.when(use_parent, F.col("pid")).otherwise(F.col("id")).alias("node_id"), "trajectory_id", status.alias("status"),
        F.explode_outer(F.when(use_parent, F.col("p_files")).otherwise(F.col("files"))).alias("f"),
    )
    return rows.select("id", "node_id", "trajectory_id", "status", "f.path", "f.content")
