"""Search policies replayed over recorded exploration trees, a fold per tree.

A tree is bounded by what one search explored, so a fold per trajectory is the natural unit:
thousands of trees run side by side."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.ordering import with_place


@dataclass(frozen=True)
class Policy:
    name: str
    c_puct: float
    prune_cost_threshold: int
    max_depth: int
    penalty_weight: float
    branching_factor: int
    early_stop_reward: float


#: Fixed parameter sets; the first is the baseline.
PRESETS = (
    Policy("balanced_mcts_default", 1.414, 4000, 10, 0.5, 3, 0.85),
    Policy("fast_reflex", 0.8, 2000, 5, 0.8, 2, 0.70),
    Policy("deep_deliberative", 2.0, 8000, 15, 0.3, 4, 0.90),
    Policy("conservative_validation", 1.2, 3000, 8, 0.9, 2, 0.95),
    Policy("aggressive_pruning", 1.0, 1500, 6, 0.7, 2, 0.75),
    Policy("wide_exploration", 2.4, 6000, 12, 0.2, 5, 0.88),
)
BASELINE = PRESETS[0].name


def walk(rows: list[dict], policy: Policy) -> dict:
    """Best-first replay: the frontier node of the highest score is explored next, ties in the
    order they came. Costs of what is explored add up until a solution or enough reward."""
    by_id = {n["id"]: n for n in rows}
    children: dict = {}
    for n in sorted(rows, key=lambda n: n["id"]):
        parent = n["parent_id"] if n["parent_id"] in by_id else None
        children.setdefault(parent, []).append(n)

    def value(n: dict, visits: int, depth: int) -> float:
        explore = policy.c_puct * math.sqrt(math.log(max(1, visits)) / max(1, n["visit_count"]))
        risky = any(w in str(n["note"] or "").lower() for w in ("error", "fail"))
        return max(n["value_estimate"], n["reward_score"]) + explore - policy.penalty_weight * risky - 0.02 * depth

    out = {"steps": 0, "tokens": 0, "latency_ms": 0, "solved": False, "pruned": 0, "reward": 0.0}
    tick, frontier = 0, []
    for n in children.get(None, ()):
        heapq.heappush(frontier, (-value(n, 1, 0), tick, 0, n["id"]))
        tick += 1
    done: set = set()
    while frontier:
        _, _, depth, key = heapq.heappop(frontier)
        n = by_id[key]
        if key in done:
            continue
        if depth > policy.max_depth or (n["cost_tokens"] > policy.prune_cost_threshold and n["reward_score"] < 0):
            out["pruned"] += 1
            continue
        done.add(key)
        out["steps"] += 1
        out["tokens"] += int(n["cost_tokens"])
        out["latency_ms"] += int(n["latency_ms"])
        out["reward"] += float(n["reward_score"])
        if n["is_solution"] or n["reward_score"] >= policy.early_stop_reward:
            out["solved"] = True
            break
        visits = max(1, n["visit_count"])
        ranked = sorted(children.get(key, ()), key=lambda c: -value(c, visits, depth + 1))
        out["pruned"] += max(0, len(ranked) - policy.branching_factor)
        for c in ranked[: policy.branching_factor]:
            heapq.heappush(frontier, (-value(c, visits, depth + 1), tick, depth + 1, c["id"]))
            tick += 1
    return out


REPLAY = "trajectory_id long, policy string, steps long, tokens long, latency_ms long, solved boolean, pruned long, reward double"


def replay(nodes: DataFrame, policies: tuple[Policy, ...] = PRESETS) -> DataFrame:
    """One row of metrics per (trajectory, policy). nodes: trajectory_id, id, parent_id,
    cost_tokens, latency_ms, reward_score, visit_count, value_estimate, is_solution, note."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parents = [None if pd.isna(p) else p for p in pdf["parent_id"]]
        tree = pdf.drop(columns="parent_id").to_dict("records")
        rows = [n | {"parent_id": p} for n, p in zip(tree, parents)]
        key = pdf["trajectory_id"].iloc[0]
        return pd.DataFrame([{"trajectory_id": key, "policy": p.name} | walk(rows, p) for p in policies])

    used = ("trajectory_id", "id", "parent_id", "cost_tokens", "latency_ms", "reward_score", "visit_count", "value_estimate", "is_solution", "note")
    return nodes.select(*used).groupBy("trajectory_id").applyInPandas(run, REPLAY)


def uct_search(rows: list[dict], simulations: int = 50, c: float = math.sqrt(2), threat_weight: float = 0.5, veto: bool = True) -> dict:
    """Tree search over a recorded tree: select by mean value, exploration, a penalty for risky
    notes and a bonus for solutions; expand the unvisited child of the highest estimate; the
    reached node's reward goes back to the root. Vetoed are risky nodes of negative reward."""
    by_id = {n["id"]: n for n in rows}
    children: dict = {}
    for n in sorted(rows, key=lambda n: (-n["value_estimate"], n["id"])):
        risky = any(w in str(n["note"] or "").lower() for w in ("error", "fail"))
        if not (veto and risky and n["reward_score"] < 0):
            children.setdefault(n["parent_id"] if n["parent_id"] in by_id else None, []).append((n, risky))
    visits, total = {}, {}

    def value(entry: tuple[dict, bool], above: int) -> float:
        n, risky = entry
        seen = visits[n["id"]]
        return total[n["id"]] / seen + c * math.sqrt(math.log(max(1, above)) / seen) - threat_weight * risky + 2.0 * bool(n["is_solution"])

    for done in range(simulations):
        path, options, above = [], children.get(None, []), done
        while options:
            fresh = next((e for e in options if e[0]["id"] not in visits), None)
            entry = fresh or max(options, key=lambda e: value(e, above))
            path.append(entry[0])
            if fresh or entry[0]["is_solution"]:
                break
            above, options = visits[entry[0]["id"]], children.get(entry[0]["id"], [])
        if not path:
            break
        for n in path:
            visits[n["id"]] = visits.get(n["id"], 0) + 1
            total[n["id"]] = total.get(n["id"], 0.0) + path[-1]["reward_score"]
    best, options = [], children.get(None, [])
    while options := [e for e in options if e[0]["id"] in visits]:
        top = max(options, key=lambda e: (visits[e[0]["id"]], total[e[0]["id"]] / visits[e[0]["id"]]))[0]
        best.append(top)
        options = children.get(top["id"], [])
    return {"path": [int(n["id"]) for n in best], "visited": len(visits), "solved": any(bool(by_id[k]["is_solution"]) for k in visits)}


def search(nodes: DataFrame, simulations: int = 50) -> DataFrame:
    """(trajectory_id, path, visited, solved): a tree search of each trajectory."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parents = [None if pd.isna(p) else p for p in pdf["parent_id"]]
        rows = [n | {"parent_id": p} for n, p in zip(pdf.drop(columns="parent_id").to_dict("records"), parents)]
        return pd.DataFrame([{"trajectory_id": pdf["trajectory_id"].iloc[0]} | uct_search(rows, simulations)])

    used = ("trajectory_id", "id", "parent_id", "reward_score", "value_estimate", "is_solution", "note")
    return nodes.select(*used).groupBy("trajectory_id").applyInPandas(run, "trajectory_id long, path array<long>, visited long, solved boolean")


def compared(metrics: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """Gain of each policy over the baseline, cost being tokens + 500 per step; optimal if it
    solves and either the baseline doesn't or the gain is a tenth or more."""
    cost = F.col("tokens") + 500 * F.col("steps")
    base = metrics.where(F.col("policy") == baseline).select("trajectory_id", cost.alias("base_cost"), F.col("solved").alias("base_solved"))
    rows = metrics.withColumn("cost", cost).join(base, "trajectory_id")
    gain = F.when(F.col("base_cost") > 0, (F.col("base_cost") - F.col("cost")) / F.col("base_cost")).otherwise(0.0)
    optimal = F.col("solved") & (~F.col("base_solved") | (gain >= 0.10))
    return rows.select("trajectory_id", "policy", "cost", "solved", F.round(gain, 6).alias("gain"), optimal.alias("optimal"))


def fitness(solved: Column, ratio: Column, prune_errors: Column, saved: Column) -> Column:
    return 100 * solved.cast("int") - 25 * ratio - 150 * prune_errors + F.least(F.lit(30.0), F.greatest(F.lit(-20.0), saved / 500))


def sweep(metrics: DataFrame) -> DataFrame:
    """(policy, fitness, trees, solved, cost, rank): policies by their mean fitness, best first."""
    cost = F.col("tokens") + 500 * F.col("steps")
    each = metrics.withColumn("cost", cost).withColumn("f", fitness(F.col("solved"), F.col("steps") / 10, F.lit(0), 2000 - F.col("cost")))
    per = each.groupBy("policy").agg(F.round(F.avg("f"), 6).alias("fitness"), F.count("*").alias("trees"), F.count_if("solved").alias("solved"), F.sum("cost").alias("cost"))
    return with_place(per, F.desc("fitness"), F.asc("policy"), name="rank")


def promotion(metrics: DataFrame, candidate: str, baseline: str = BASELINE, least_trees: int = 3) -> DataFrame:
    """Whether a candidate beats the baseline on the held-out last 30 % of trajectories (all, if
    fewer than four), by the mean of paired fitness differences."""
    cost = F.col("tokens") + 500 * F.col("steps")
    scored = metrics.select("trajectory_id", "policy", fitness(F.col("solved"), F.col("steps") / 10, F.lit(0), 2000 - cost).alias("fitness"))
    a = scored.where(F.col("policy") == candidate).select("trajectory_id", F.col("fitness").alias("f1"))
    b = scored.where(F.col("policy") == baseline).select("trajectory_id", F.col("fitness").alias("f0"))
    paired = a.join(b, "trajectory_id")
    placed = with_place(paired, "trajectory_id")
    n = placed.agg(F.count("*").alias("n"))
    held = placed.crossJoin(F.broadcast(n)).where((F.col("n") < 4) | (F.col("place") * 10 > F.col("n") * 7))  # one row; 0.7 * n is inexact
    means = held.agg(F.count("*").alias("trees"), F.avg(F.col("f1") - F.col("f0")).alias("mean"))
    return means.select("trees", F.round("mean", 6).alias("gain"), ((F.col("trees") >= least_trees) & (F.col("mean") > 0)).alias("promoted"))


def risk_review(changes: DataFrame) -> DataFrame:
    """(id, verdict, reasons) of planned changes (id, plan, files, blast, hotspots)."""
    reasons = F.filter(
        F.array(
            F.when(F.lower("plan").rlike(r"\b(drop|truncate|alter)\s+table\b"), "ddl"), F.when(F.col("blast") > 7, "blast"),
            F.when(F.col("hotspots") > 0, "hotspot"), F.when(F.col("files") > 8, "many_files"),
        ),
        lambda r: r.isNotNull(),
    )
    verdict = F.when(F.array_contains(reasons, "ddl") | (F.size(reasons) >= 3), "blocked").when(F.size(reasons) > 0, "review").otherwise("approved")
    return changes.select("id", verdict.alias("verdict"), F.array_join(reasons, ",").alias("reasons"))
