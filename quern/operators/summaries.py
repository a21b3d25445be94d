"""Summaries: graph counts, search-tree diagnosis, capability maps, contexts under a budget."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.operators.graph import subtree_sums


def graph_summary(files: DataFrame, functions: DataFrame, lessons: DataFrame, edges: DataFrame, below: str | None = None) -> DataFrame:
    """One row of counts; with ``below``, of paths that contain it. Four small aggregates, joined as one row."""
    def inside(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.contains(F.lower(column), F.lit(below.lower()))) if below else df

    parts = [
        inside(files, "path").agg(F.count("*").alias("files")),
        inside(functions, "path").agg(F.count("*").alias("functions"), F.count_if(F.col("strategy") == "heuristic").alias("heuristic")),
        inside(lessons, "file_path").agg(F.count("*").alias("lessons"), F.count_if(F.col("embedding").isNull()).alias("without_embedding")),
        inside(edges, "src_path").agg(F.count("*").alias("edges")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def file_counts(files: DataFrame, functions: DataFrame, lessons: DataFrame) -> DataFrame:
    """(path, functions, lessons) per file, 0 where there are none."""
    f = functions.groupBy("path").agg(F.count("*").alias("functions"))
    n = lessons.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("lessons"))
    return files.select("path").join(f, "path", "left").join(n, "path", "left").na.fill(0, ["functions", "lessons"])


def shadow_metrics(nodes: DataFrame) -> DataFrame:
    """Per trajectory: nodes, depth, cost, branching and adherence.

    nodes: id, trajectory_id, parent_id, depth, cost_tokens, latency_ms, recommended, followed."""
    totals = nodes.groupBy("trajectory_id").agg(
        F.count("*").alias("total_nodes"), F.max("depth").alias("max_depth"), F.sum("cost_tokens").alias("total_tokens"), F.sum("latency_ms").alias("total_latency_ms"),
        F.count_if("recommended").alias("given"), F.count_if(F.col("recommended") & F.col("followed")).alias("kept"),
    )
    children = nodes.where("parent_id is not null").groupBy("trajectory_id", "parent_id").agg(F.count("*").alias("n"))
    branching = children.groupBy("trajectory_id").agg((F.sum("n") / F.count("*")).alias("branching_factor"), F.max("n").alias("max_branching"))
    joined = totals.join(branching, "trajectory_id", "left")
    adherence = F.when(F.col("given") > 0, F.col("kept") / F.col("given")).otherwise(1.0)
    return joined.select(
        "trajectory_id", "total_nodes", "max_depth", "total_tokens", "total_latency_ms", F.round(F.coalesce("branching_factor", F.lit(0.0)), 6).alias("branching_factor"),
        F.coalesce("max_branching", F.lit(0)).alias("max_branching"), F.round(adherence, 6).alias("adherence_rate"),
    )


def diagnosis(nodes: DataFrame) -> DataFrame:
    """Per trajectory: bottlenecks, unpruned losses, advised exploration constant, token efficiency.

    A node is a bottleneck above 3000 ms or 2000 tokens. Token efficiency is the share of
    tokens on paths from the root to solutions."""
    variance = F.var_pop("reward_score")
    slow = (F.col("latency_ms") > 3000) | (F.col("cost_tokens") > 2000)
    c = F.when(variance > 10, 1.8).when(variance < 1, 1.1).otherwise(math.sqrt(2))
    totals = nodes.groupBy("trajectory_id").agg(
        F.count("*").alias("total_nodes"), F.sum("cost_tokens").alias("total_tokens"), F.count_if(slow).alias("bottlenecks"),
        F.count_if((F.col("reward_score") < 0) & ~F.col("is_pruned")).alias("unpruned_negative"), F.round(c, 6).alias("advised_c"),
    )
    solved = subtree_sums(nodes, solutions=F.coalesce(F.col("is_solution"), F.lit(False)).cast("long"))
    on_path = solved.where("solutions > 0").select("id")
    useful = nodes.join(on_path, "id").groupBy("trajectory_id").agg(F.sum("cost_tokens").alias("useful"))
    share = F.when(F.col("total_tokens") > 0, F.coalesce("useful", F.lit(0)) / F.col("total_tokens")).otherwise(0.0)
    return totals.join(useful, "trajectory_id", "left").withColumn("token_efficiency", F.round(share, 6)).drop("useful")


def resume_nodes(nodes: DataFrame) -> DataFrame:
    """The best open node of each trajectory: by value, depth, then time."""
    open_ = nodes.where(~F.col("is_pruned") & ~F.col("is_solution"))
    best = F.max_by(F.struct("id", "value_estimate"), F.struct("value_estimate", "depth", "created_at", "id"))
    return open_.groupBy("trajectory_id").agg(best.alias("b")).select("trajectory_id", "b.*")


def timeline(rows: DataFrame, session: str, order: str, anchor: Column, before: int = 2, after: int = 2) -> DataFrame:
    """Rows of each session from ``before`` places before to ``after`` behind rows that ``anchor`` marks."""
    from pyspark.sql import Window

    place = rows.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(order)))
    marks = place.where(anchor).select(session, F.explode(F.sequence(F.col("place") - before, F.col("place") + after)).alias("place")).distinct()
    return place.join(marks, [session, "place"])


def capability_map(files: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Per module: files, functions, languages and the other modules it depends on.

    files: path, language; edges: src_path, dst_path."""
    of = files.select("path", "language", text.module_of(F.col("path")).alias("module"))
    counts = functions.groupBy("path").agg(F.count("*").alias("n"))
    base = of.join(counts, "path", "left").groupBy("module").agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("functions"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    deps = module_edges(files, edges).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("depends_on"))
    return base.join(deps, F.col("module") == F.col("src"), "left").select("module", "files", "functions", "languages", F.coalesce("depends_on", F.lit("")).alias("depends_on"))


def module_edges(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) between different modules."""
    a = files.select(F.col("path").alias("src_path"), text.module_of(F.col("path")).alias("src"))
    b = files.select(F.col("path").alias("dst_path"), text.module_of(F.col("path")).alias("dst"))
    return edges.join(a, "src_path").join(b, "dst_path").where("src <> dst").select("src", "dst").distinct()


def reputations(votes: DataFrame, least_trials: int = 3, least: float = 0.35) -> DataFrame:
    """(source, successes, failures, reputation, purged) from votes (source, ok)."""
    counted = votes.groupBy("source").agg(F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("failures"))
    mean = scores.beta_mean(F.col("successes"), F.col("failures"))
    purged = (F.col("successes") + F.col("failures") >= least_trials) & (mean < least)
    return counted.select("source", "successes", "failures", F.round(mean, 6).alias("reputation"), purged.alias("purged"))


def candidate_files(files: DataFrame, goal: str, impact: DataFrame, semantic: DataFrame, changed: DataFrame, n: int = 20) -> DataFrame:
    """(path, score, reasons): additive points per file: 4 per goal token in the path, 6 or 4 for
    near or further impact, max(5, round(7 * similarity)) for semantic hits, 3 for open changes."""
    from quern.operators.lexical import _words

    goal_tokens = F.array(*[F.lit(w.lower()) for w in dict.fromkeys(_words(goal))]) if _words(goal) else F.array().cast("array<string>")
    shared = F.size(F.array_intersect(F.array_distinct(text.tokens(F.col("path"))), goal_tokens))
    parts = [
        files.select("path", (4 * shared).cast("double").alias("points"), F.lit("goal").alias("reason")),
        impact.select("path", F.when(F.col("depth") <= 1, 6.0).otherwise(4.0).alias("points"), F.lit("impact").alias("reason")),
        semantic.select("path", F.greatest(F.lit(5.0), F.round(7 * F.col("similarity"))).alias("points"), F.lit("semantic").alias("reason")),
        changed.select("path", F.lit(3.0).alias("points"), F.lit("changed").alias("reason")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.where("points > 0")
    scored = rows.groupBy("path").agg(F.sum("points").alias("score"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return scored.orderBy(F.desc("score"), "path").limit(n)


def phases(files: DataFrame) -> DataFrame:
    """(phase, path): a context plan: files in four bins by what they are for, a row each."""
    low = F.lower("path")
    phase = F.when(low.rlike("test|spec"), "verify").when(low.rlike("schema|model|entity|type|interface"), "contracts").when(low.rlike("page|view|component|ui|api|route"), "surface").otherwise("logic")
    return files.select(phase.alias("phase"), "path")
