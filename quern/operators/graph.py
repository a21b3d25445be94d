"""Typed dependency and memory graphs as edge tables.

Edges have src and dst; weighted ones a weight, typed ones an edge_type. Traversals are joins
in a row with one row a node after each; what takes more hops than fit one plan is written
to the shared folder in between, so that lineage stays short. Joins of walks without a depth are
merge joins: tables small enough to be broadcast would go to the driver in every round."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import scores
from quern.ordering import with_place
from quern.storage import materialize


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(reverse(edges))


def neighbors(edges: DataFrame, node) -> DataFrame:
    """(node, direction) one hop away."""
    out = edges.where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("out").alias("direction"))
    into = edges.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("in").alias("direction"))
    return out.unionAll(into).distinct()


#: Hops that one plan joins in a row, before its rows are written and looked at.
HOPS = 8


def _hops(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def _relaxed(rows: DataFrame, hops: DataFrame, begin: int, n: int) -> DataFrame:
    """(node, depth, fresh) after ``n`` more hops along (src, dst, weight), in one plan: each hop
    joins the edges to the rows whose depth the hop before has lowered (fresh), and a node
    keeps its least depth. Rows pass on beside what they reach, so each hop reads them once."""
    for k in range(begin, begin + n):
        joined = rows.join(hops, (F.col("node") == F.col("src")) & (F.col("fresh") == k), "left")
        own = F.struct("node", F.struct("depth", "fresh").alias("d"))
        found = F.struct(F.col("dst").alias("node"), F.struct((F.col("depth") + F.col("weight")).alias("depth"), F.lit(k + 1).alias("fresh")).alias("d"))
        both = joined.select(F.explode(F.array(own, found)).alias("r")).select("r.*").where("node is not null")
        rows = both.groupBy("node").agg(F.min("d").alias("d")).select("node", "d.depth", "d.fresh")
    return rows


def reach(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the seeds (column node), at least depth;
    without a depth, all that can be reached. Null seeds, and edges with a null end, are left
    out; seeds without edges reach themselves.

    Hops are joins in a row, ``HOPS`` to a plan, with one row a node after each, so cycles end
    and dense graphs don't multiply rows. Up to that depth nothing is written or counted in
    between. A walk without a depth that isn't over then goes on over chains drawn together:
    see ``_reach_far``."""
    hops = _hops(edges).withColumn("weight", F.lit(1))
    rows = seeds.select("node").where("node is not null").distinct().select("node", F.lit(0).alias("depth"), F.lit(0).alias("fresh"))
    if depth is not None and depth <= HOPS:
        return _relaxed(rows, hops, 0, depth).select("node", "depth")
    hops, k = materialize(hops, "hops").hint("merge"), 0
    while depth is None or k < depth:
        n = HOPS if depth is None else min(HOPS, depth - k)
        rows, k = materialize(_relaxed(rows, hops, k, n), "reach"), k + n
        if rows.where(F.col("fresh") == k).isEmpty():
            break
        if depth is None:
            return _reach_far(hops, rows.where("depth = 0").select("node"))
    return rows.select("node", "depth")


def _reach_far(hops: DataFrame, seeds: DataFrame) -> DataFrame:
    """``reach`` without a depth. A node with one edge in, that is no seed, is one step behind
    that edge's source, so it hangs on the first node above that isn't such a node, at a
    distance found by doubling pointers; edges from it become longer edges from there. This
    is repeated as long as it takes away a tenth of the nodes; the walk goes over the rest."""
    seeds = materialize(seeds.select(F.col("node").alias("seed")), "seeds")
    layers = []
    while True:
        into = hops.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("up"), F.min("weight").alias("steps"))
        single = into.where("n = 1").join(seeds.hint("merge"), F.col("dst") == F.col("seed"), "left_anti").select(F.col("dst").alias("node"), "up", "steps")
        single = materialize(single, "single")
        if not (n := single.count()) or n * 10 < into.count():
            break
        rooted = hung(single)
        layers.append(rooted)
        moved = hops.join(single.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti").join(single.select(F.col("node").alias("src"), F.lit(1).alias("one")).hint("merge"), "src", "left")
        moved = moved.join(rooted.select(F.col("node").alias("src"), "root", "steps").hint("merge"), "src", "left").where("one is null or root is not null")
        moved = moved.select(F.coalesce("root", "src").alias("src"), "dst", (F.col("weight") + F.coalesce("steps", F.lit(0))).alias("weight")).where("src <> dst")
        hops = materialize(moved.groupBy("src", "dst").agg(F.min("weight").alias("weight")), "hops")
    rows, k = seeds.select(F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("fresh")), 0
    while True:
        rows, k = materialize(_relaxed(rows, hops.hint("merge"), k, HOPS), "reach"), k + HOPS
        if rows.where(F.col("fresh") == k).isEmpty():
            break
    rows = rows.select("node", "depth")
    for rooted in reversed(layers):
        below = rooted.join(rows.select(F.col("node").alias("root"), "depth").hint("merge"), "root").select("node", (F.col("depth") + F.col("steps")).alias("depth"))
        rows = materialize(rows.unionAll(below), "reach")
    return rows


def hung(single: DataFrame) -> DataFrame:
    """(node, root, steps): for nodes with one pointer (node, up, steps), the first above that
    has none, and the sum of steps to it. Pointers double each round; nodes whose pointers run
    in a cycle, or into one, are left out."""
    most, length = single.count(), 1
    live, done = single.select("node", F.col("up").alias("root"), "steps"), []
    while True:
        above = reduce(DataFrame.unionAll, [live.withColumn("ended", F.lit(False)), *(d.withColumn("ended", F.lit(True)) for d in done)])
        above = above.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"), "ended")
        joined = live.join(above.hint("merge"), "root", "left").withColumn("ended", F.coalesce("ended", F.lit(True)))
        joined = joined.select("node", F.coalesce("next", "root").alias("root"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), "ended")
        joined = materialize(joined, "pointers")
        done.append(joined.where("ended").drop("ended"))
        live, length = joined.where("not ended").drop("ended"), 2 * length
        if length > 2 * most or live.isEmpty():
            return reduce(DataFrame.unionAll, done)


def impact(edges: DataFrame, seeds: DataFrame, files: DataFrame, depth: int = 3) -> DataFrame:
    """What a change reaches and how badly: (node, depth, severity).

    ``files`` has node, path, functions and lessons. Files that define shared shapes break."""
    reached = reach(edges, seeds, depth).where("depth > 0").join(files, "node", "left")
    breaking = F.lower("path").rlike("schema|model|dto|entity|interface|type")
    warning = (F.coalesce("lessons", F.lit(0)) > 0) | (F.coalesce("functions", F.lit(0)) > 15) | (F.col("depth") <= 1)
    severity = F.when(breaking, "breaking").when(warning, "warning").otherwise("info")
    return reached.select("node", "depth", severity.alias("severity"))


def incoming(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Who depends on the seeds, directly or not: (node, depth)."""
    return reach(reverse(edges), seeds, depth).where("depth > 0")


def blast_edges(edges: DataFrame, seeds: DataFrame, depth: int = 5) -> DataFrame:
    """Edges (src, dst, depth) that importers of the seeds come in by, each at its least depth."""
    hit = reach(reverse(edges), seeds, depth - 1)
    return edges.join(hit, F.col("dst") == F.col("node")).select("src", "dst", (F.col("depth") + 1).alias("depth")).distinct()


def blast_level(count: Column) -> Column:
    return F.when(count <= 2, "LOW").when(count <= 7, "MEDIUM").otherwise("CRITICAL_BREAKING")


def frontend_blast(edges: DataFrame, consumers: DataFrame, depth: int = 10) -> DataFrame:
    """Files that an endpoint's consumers pull in, the views among them, and the level; one row."""
    reached = reach(reverse(edges), consumers, depth)
    view = F.lower("node").rlike(r"(page|view|sheet)[^/]*\.(tsx|jsx)$")
    return reached.agg(F.count("*").alias("files"), F.sum(view.cast("int")).alias("views")).withColumn("level", blast_level(F.col("files")))


def simple_paths(edges: DataFrame, start, goal, hops: int = 10, most: int | None = 1) -> DataFrame:
    """(path, hops): simple paths from start to goal, shortest first, then by path.

    Only nodes that can still reach the goal in time are extended."""
    kept = edges.select("src", "dst").distinct()
    ahead = reach(reverse(edges), edges.sparkSession.createDataFrame([(goal,)], ["node"]), hops)
    kept = kept.join(ahead, F.col("dst") == F.col("node")).select("src", "dst", F.col("depth").alias("togo"))
    walk = edges.sparkSession.createDataFrame([(start,)], ["node"]).select("node", F.array("node").alias("path"))
    done = []
    for k in range(1, hops + 1):
        more = walk.join(kept, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")) & (F.col("togo") <= hops - k))
        more = materialize(more.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "paths")
        done.append(more.where(F.col("node") == goal).select("path", F.lit(k).alias("hops")))
        walk = more.where(F.col("node") != goal)
        if walk.isEmpty():
            break
    found = reduce(DataFrame.unionAll, done).orderBy("hops", "path")
    return found.limit(most) if most else found


def neighborhood(edges: DataFrame, seeds: DataFrame, depth: int = 2, decay: float = 0.6) -> DataFrame:
    """(node, depth, weight): undirected surroundings; a node's weight is that of the edge it
    was reached by, times ``decay`` for each further step, the best edge at its least depth."""
    both = undirected(edges.select("src", "dst", "weight"))
    reached = reach(both, seeds, min(3, max(1, depth)))
    before = reached.select(F.col("node").alias("src"), F.col("depth").alias("from"))
    steps = reached.where("depth > 0").join(both, F.col("node") == F.col("dst")).join(before, "src").where(F.col("from") == F.col("depth") - 1)
    best = steps.groupBy("node", "depth").agg(F.max("weight").alias("weight"))
    return best.withColumn("weight", F.round(F.col("weight") * F.pow(F.lit(decay), F.col("depth") - 1), 6))


def stale_cascade(edges: DataFrame, memories: DataFrame, file, reason: str, depth: int | None = None) -> DataFrame:
    """Memories that a changed file makes stale, with old and new confidence.

    Seeds are the memories next to the file; staleness spreads along supersedes and
    derived_from until nothing new is reached (or ``depth`` steps far)."""
    near = neighbors(edges, file).select("node").join(memories, F.col("node") == F.col("id"), "left_semi")
    along = edges.where(F.col("edge_type").isin("supersedes", "derived_from"))
    hit = reach(along, near, depth)
    cut = F.greatest(F.lit(0.1), F.col("confidence") / 2)
    why = F.concat(F.lit("invalidated by "), F.lit(str(file)), F.lit(": "), F.lit(reason))
    return memories.join(hit, F.col("id") == F.col("node")).select("id", "depth", F.col("confidence").alias("old_confidence"), cut.alias("confidence"), F.lit(True).alias("stale"), why.alias("stale_reason"))


def coupling(edges: DataFrame, n: int | None = 20) -> DataFrame:
    """(node, fan_in, fan_out, score): degrees, highest sum first. Edges whose target isn't
    resolved (null dst) count for their source alone."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.where("dst is not null").select("dst", F.lit(0), F.lit(1)))
    degrees = ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out")).withColumn("score", F.col("fan_in") + F.col("fan_out"))
    return degrees.orderBy(F.desc("score"), "node").limit(n) if n else degrees


def _raised(rows: DataFrame, deps: DataFrame, begin: int, n: int) -> DataFrame:
    """(node, level, hops) after ``n`` more hops along (src, dst, weight), in one plan: hops is the
    length of the longest walk down so far, and level the greatest weight of one; nodes whose
    walks have just grown hand theirs up."""
    for k in range(begin, begin + n):
        joined = rows.join(deps.hint("merge"), (F.col("node") == F.col("dst")) & (F.col("hops") == k), "left")
        found = F.struct(F.col("src").alias("node"), (F.col("level") + F.col("weight")).alias("level"), F.lit(k + 1).alias("hops"))
        both = joined.select(F.explode(F.array(F.struct("node", "level", "hops"), found)).alias("r")).select("r.*").where("node is not null")
        rows = both.groupBy("node").agg(F.max("level").alias("level"), F.max("hops").alias("hops"))
    return rows


def _levels(nodes: DataFrame, deps: DataFrame, most_hops: int | None = None) -> tuple[DataFrame, bool]:
    """(node, level), null in and above cycles, and whether that is the end: nodes with a walk of
    k hops down get fewer with k, and once they stay as many as before they are those of cycles."""
    rows, k = nodes.select("node", F.lit(0).alias("level"), F.lit(0).alias("hops")), 0
    while True:
        rows, k = materialize(_raised(rows, deps, k, HOPS), "levels"), k + HOPS
        last, before = rows.agg(F.sum((F.col("hops") >= k).cast("int")), F.sum((F.col("hops") >= k - 1).cast("int"))).first()
        ended = not last or last == before
        if ended or (most_hops and k >= most_hops):
            return rows.select("node", F.when(F.col("hops") < k, F.col("level")).alias("level")), ended


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level, place): dependencies (dst) before dependents (src); a node's level is one
    above its highest dependency, and nodes of cycles, and above them, come last, with a null
    level (``cycles`` tells which are which). Null nodes, edges from or to what is no node and
    edges of a node to itself are left out. place orders by level and name over all nodes.

    Levels rise ``HOPS`` to a plan, one row a node after each. If that isn't the end, chains are
    drawn together first: a node of one dependency is as far above the first below that has
    none or several as there are nodes between; pointers are doubled to find it, and it hands
    its dependents down to it, as edges of that length. So rounds grow with the logarithm of a
    chain's length."""
    known = materialize(nodes.select("node").where("node is not null").distinct(), "topo")
    deps = _hops(edges).where("src <> dst")
    deps = deps.join(known.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").join(known.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi")
    return with_place(_all_levels(known, deps), F.asc_nulls_last("level"), F.asc("node"))


def _all_levels(nodes: DataFrame, hops: DataFrame) -> DataFrame:
    deps = materialize(hops.select("src", "dst", F.lit(1).alias("weight")), "topo")
    levels, ended = _levels(nodes, deps, HOPS)
    return levels if ended else _far_levels(nodes, deps)


def _far_levels(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    layers, left = [], nodes
    while True:
        down = deps.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("up"), F.min("weight").alias("steps"))
        single = materialize(down.where("n = 1").select(F.col("src").alias("node"), "up", "steps"), "single")
        if not (n := single.count()) or n * 10 < down.count():
            break
        rooted = hung(single)
        layers.append(rooted)
        # Nodes that hang on a cycle have no root: they stay, each above itself, which never ends.
        left = materialize(left.join(rooted.select("node").hint("merge"), "node", "left_anti"), "left")
        lost = single.join(rooted.select("node").hint("merge"), "node", "left_anti").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1).alias("weight"))
        moved = deps.join(single.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti").join(rooted.select(F.col("node").alias("dst"), "root", "steps").hint("merge"), "dst", "left")
        moved = moved.select("src", F.coalesce("root", "dst").alias("dst"), (F.col("weight") + F.coalesce("steps", F.lit(0))).alias("weight")).unionAll(lost)
        deps = materialize(moved.groupBy("src", "dst").agg(F.max("weight").alias("weight")), "topo")
        if not lost.isEmpty():
            break  # what points at itself would count as single for ever
    levels = _levels(left, deps)[0]
    for rooted in reversed(layers):
        above = rooted.join(levels.select(F.col("node").alias("root"), "level").hint("merge"), "root").select("node", (F.col("level") + F.col("steps")).alias("level"))
        levels = materialize(levels.unionAll(above), "levels")
    return levels


def _least_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): of the nodes that reach each, the one whose hash is least.

    A label is handed along every edge, and then a label's own label taken; in the order of
    hashes the least of a stretch lies anywhere in it, so that stretches grow by a factor."""
    order = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("id"))
    rows = materialize(nodes.select("node", order.alias("label")), "labels")
    while True:
        handed = edges.join(rows.hint("merge"), F.col("node") == F.col("src")).select(F.col("dst").alias("node"), "label", F.lit(False).alias("own"))
        both = rows.withColumn("own", F.lit(True)).unionByName(handed)
        least = both.groupBy("node").agg(F.min("label").alias("label"), F.max(F.when(F.col("own"), F.col("label"))).alias("old"))
        further = rows.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = least.join(further.hint("merge"), F.col("label.id") == F.col("via")).select("node", F.least("label", "further").alias("label"), "old")
        after = materialize(after, "labels")
        if after.where("label <> old").isEmpty():
            return rows.select("node", F.col("label.id").alias("label"))
        rows = after.drop("old")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): nodes that reach themselves, in groups that reach each other (strongly
    connected components of two nodes or more, and nodes with an edge to themselves); cycle is
    the least node of the group. Edges with a null end are left out.

    Nodes that are in or above cycles, and in or below them, are found by levels; of those
    left, each is labelled with one that reaches it, and the group of that one is who, among
    nodes of its label, reaches it back. Groups go, and the rest starts again."""
    hops = materialize(_hops(edges), "hops")
    found = [materialize(hops.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")), "cycles")]
    hops = hops.where("src <> dst")
    while True:
        for _ in range(2):  # down, then up
            nodes = hops.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
            bound = _all_levels(nodes, hops).where("level is null").select("node")
            hops = hops.join(bound.withColumnRenamed("node", "src").hint("merge"), "src", "left_semi").join(bound.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi")
            hops = materialize(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "hops")
        if hops.isEmpty():
            break
        nodes = materialize(hops.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "nodes")
        label = _least_labels(nodes, hops)
        a, b = label.select(F.col("node").alias("src"), F.col("label").alias("x")), label.select(F.col("node").alias("dst"), F.col("label").alias("y"))
        labelled = materialize(hops.join(a.hint("merge"), "src").join(b.hint("merge"), "dst"), "labelled")
        back = reach(reverse(labelled.where("x = y").select("src", "dst")), label.where("node = label").select("node")).select("node")
        group = materialize(label.join(back.hint("merge"), "node").select("node", F.col("label").alias("cycle")), "cycles")
        # One node alone is none: it lies between two cycles.
        found.append(group.join(group.groupBy("cycle").count().where("count > 1").select("cycle").hint("merge"), "cycle", "left_semi").select("node", "cycle"))
        gone = group.select("node")
        hops = hops.join(gone.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_anti")
        hops = materialize(hops.select("src", "dst"), "hops")
    # Nodes with an edge to themselves may be in a larger group, too.
    larger = reduce(DataFrame.unionAll, found[1:]) if found[1:] else found[0].limit(0)
    named = larger.join(larger.groupBy("cycle").agg(F.min("node").alias("least")).hint("merge"), "cycle").select("node", F.col("least").alias("cycle"))
    return named.unionAll(found[0].join(larger.select("node").hint("merge"), "node", "left_anti"))


#: Fixed order of roles: what others rest on comes first.
ROLES = ("schema|model|entity|dto", "service|core|engine|logic", "api|route|controller|handler", "ui|view|page|component", "test|spec")


def role_tier(path: Column) -> Column:
    tier = F.lit(len(ROLES))
    for k in reversed(range(len(ROLES))):
        tier = F.when(F.lower(path).rlike(ROLES[k]), k).otherwise(tier)
    return tier


def refactor_order(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, tier, place): one file of each tier first, then by tier, fan-in, score and name.

    ``files`` has node, path and score."""
    fan_in = edges.groupBy("dst").agg(F.countDistinct("src").alias("fan_in"))
    ranked = files.join(fan_in, F.col("node") == F.col("dst"), "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0))).withColumn("tier", role_tier(F.col("path")))
    key = [F.desc("fan_in"), F.desc("score"), "node"]
    ranked = ranked.withColumn("first", (F.row_number().over(W.partitionBy("tier").orderBy(*key)) > 1).cast("int"))
    return with_place(ranked, "first", "tier", *key).select("node", "tier", "place")


def communities(edges: DataFrame, rounds: int = 4, least: float = 0.3) -> DataFrame:
    """(node, community): synchronous label moving over the heaviest undirected edges.

    In a round, each node takes the label with the largest total weight around it if that
    beats ``least`` and its own label's weight; of equal labels the smallest. Labels only
    move to smaller ones in odd rounds, which keeps pairs from swapping for ever."""
    both = undirected(edges.select("src", "dst", "weight")).where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    both = materialize(both, "communities")
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        votes = both.join(labels, F.col("dst") == F.col("node")).groupBy("src", "community").agg(F.sum("weight").alias("pull"))
        own = labels.select(F.col("node").alias("src"), F.col("community").alias("own"))
        votes = votes.join(own, "src").withColumn("rank", F.round("pull", 9))
        best = _best_label(votes, least)
        moved = F.when((F.col("rank") > F.coalesce("stay", F.lit(0.0))) | ((F.col("rank") == F.col("stay")) & (F.col("label") < F.col("own"))), F.col("label")).otherwise(F.col("own"))
        moved = moved if k % 2 else F.least(moved, F.col("own"))
        labels = labels.join(best, F.col("node") == F.col("src"), "left").select("node", F.coalesce(moved, F.col("community")).alias("community"))
        labels = materialize(labels, "communities")
    return labels


def _best_label(votes: DataFrame, least: float) -> DataFrame:
    """Heaviest label around each node, the smallest of equals, and the weight of its own."""
    strong = votes.where(F.col("pull") > least)
    top = strong.groupBy("src").agg(F.max("rank").alias("rank"))
    label = strong.join(top, ["src", "rank"]).groupBy("src", "rank", "own").agg(F.min("community").alias("label"))
    stay = votes.where("community = own").select("src", F.col("rank").alias("stay"))
    return label.join(stay, "src", "left")


def crosses_domains(changes: DataFrame, labels: DataFrame) -> DataFrame:
    """(change, communities, alert) for changes (change, node)."""
    return changes.join(labels, "node", "left").groupBy("change").agg(F.countDistinct("community").alias("communities")).withColumn("alert", F.col("communities") > 1)


def cone_search(edges: DataFrame, seeds: DataFrame, ripples: DataFrame, query: Column, depth: int = 3, k: int = 5, least_gradient: float = 0.40) -> DataFrame:
    """Failure vectors inside the dependency cone of the seeds, by distance and depth:
    1 / (60 + 100 * cosine distance) + 1 / (60 + 10 * depth). Where the cone holds none, the
    nearest vectors of all, at depth -1, by similarity / 60.

    ``ripples`` has id, node, gradient and similarity (to the query)."""
    live = ripples.where(F.col("gradient") >= least_gradient).withColumn("similarity", query)
    cone = reach(undirected(edges), seeds, depth)
    score = 1 / (60 + 100 * (1 - F.col("similarity"))) + 1 / (60 + 10 * F.col("depth"))
    inside = live.join(cone, "node").select("id", "node", "depth", F.round(score, 6).alias("score"))
    none = inside.limit(1).agg((F.count("*") == 0).alias("none"))
    outside = live.select("id", "node", F.lit(-1).alias("depth"), F.round(F.col("similarity") / 60, 6).alias("score")).crossJoin(none).where("none").drop("none")
    return inside.unionAll(outside).orderBy(F.desc("score"), "id").limit(k)


def subtree(tree: DataFrame, prefix: str) -> DataFrame:
    """Nodes at or below a dotted path, best first."""
    below = (F.col("path") == prefix) | F.col("path").startswith(prefix + ".")
    return tree.where(below).orderBy(F.desc("q_value"), F.desc("visits"), "node_id")


def _jumps(nodes: DataFrame) -> Iterator[DataFrame]:
    """(id, up): parent pointers (id, parent_id), then pointers over 2, 4, 8 ... generations, as
    long as any leads to a node. Pointers that never end are a cycle, which raises."""
    known = nodes.select("id")
    up = nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("up"))
    up = materialize(up.join(known.select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"), "jumps")
    most, length = nodes.count(), 1
    while not up.isEmpty():
        if length > most:
            raise ValueError("parent pointers run in a cycle")
        yield up
        above = up.select(F.col("id").alias("up"), F.col("up").alias("above"))
        up = materialize(up.join(above, "up").select("id", F.col("above").alias("up")), "jumps")
        length *= 2


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, distance) over parent pointers (id, parent_id), each node its own at 0.

    Rounds double the distance, so a chain of n generations takes log n of them; there are as
    many rows as pairs of a node and an ancestor. Parents that are no node are left out."""
    pairs = nodes.select(F.col("id").alias("node"), F.col("id").alias("ancestor"), F.lit(0).alias("distance"))
    for k, up in enumerate(_jumps(nodes)):
        further = pairs.join(up, F.col("ancestor") == F.col("id")).select("node", F.col("up").alias("ancestor"), (F.col("distance") + (1 << k)).alias("distance"))
        pairs = materialize(pairs.unionAll(further), "ancestors")
    return pairs


def subtree_sums(nodes: DataFrame, **values: Column) -> DataFrame:
    """(id, *values): for each node (id, parent_id) the sums over itself and all its descendants.

    In round k a node's sum is over descendants less than 2^k generations down, and those at
    exactly 2^k hand theirs on, so every round has a row per node and there are log(depth)."""
    names = list(values)
    sums = materialize(nodes.select("id", *[v.alias(n) for n, v in values.items()]), "sums")
    for up in _jumps(nodes):
        below = up.join(sums, "id").groupBy("up").agg(*[F.sum(n).alias(f"__{n}") for n in names])
        joined = sums.join(below, F.col("id") == F.col("up"), "left")
        sums = materialize(joined.select("id", *[(F.col(n) + F.coalesce(f"__{n}", F.lit(0))).alias(n) for n in names]), "sums")
    return sums


def backpropagate(nodes: DataFrame) -> DataFrame:
    """(id, visits, value): visits are a node and its descendants, value their mean reward."""
    reward = F.coalesce("reward", F.lit(0.0))
    sums = subtree_sums(nodes, visits=F.lit(1).cast("long"), total=reward, known=F.col("reward").isNotNull().cast("long"))
    return sums.select("id", "visits", F.round(F.when(F.col("known") > 0, F.col("total") / F.col("known")), 6).alias("value"))


def ucb_tree(nodes: DataFrame, c: float = math.sqrt(2)) -> DataFrame:
    """(id, parent_id, uct) for nodes with visits and value; roots share the sum of root visits."""
    roots = nodes.where("parent_id is null").agg(F.sum("visits").alias("all_roots"))
    parent = nodes.select(F.col("id").alias("pid"), F.col("visits").alias("parent_visits"))
    joined = nodes.join(parent, F.col("parent_id") == F.col("pid"), "left").crossJoin(roots)
    above = F.coalesce("parent_visits", "all_roots")
    return joined.select("id", "parent_id", F.round(scores.uct(F.col("value"), F.col("visits"), above, c), 6).alias("uct"))


def speculative_contracts(edges: DataFrame, symbols: DataFrame, file, per_file: int = 5, files: DataFrame | None = None, siblings: int = 3) -> DataFrame:
    """Symbols (node, name, start_line) of a file's neighbours, the first five of each.

    A file without neighbours has, where ``files`` (node, path) are given, those of the first
    few files of its folder."""
    near = neighbors(edges, file).select("node").distinct()
    if files is not None and near.isEmpty():
        folder = F.regexp_replace("path", "[^/]*$", "")
        own = files.where(F.col("node") == file).select(folder.alias("folder"))
        near = files.where(F.col("node") != file).join(F.broadcast(own.limit(1)), folder == F.col("folder"), "left_semi").orderBy("path").limit(siblings).select("node")
    place = W.partitionBy("node").orderBy("start_line", "name")
    return symbols.join(near, "node", "left_semi").withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_file)


def contract_drift(endpoints: DataFrame, consumers: DataFrame) -> DataFrame:
    """Consumers whose endpoint is missing, has other methods, or changed on one side only.

    endpoints: path, method, tagged; consumers: id, path, method, tagged."""
    known = endpoints.groupBy("path").agg(F.collect_set("method").alias("methods"), F.max("tagged").alias("backend_tagged"))
    joined = consumers.join(known, "path", "left")
    kind = (
        F.when(F.col("methods").isNull(), "ORPHAN")
        .when(~F.array_contains("methods", F.col("method")), "METHOD_MISMATCH")
        .when(F.col("backend_tagged") & ~F.col("tagged"), "UNSYNCHRONIZED")
    )
    return joined.withColumn("drift", kind).where("drift is not null").select("id", "path", "method", "drift")


#: Tasks that pairs are dealt to, at most; fewer when there are fewer pairs of blocks.
PAIR_TASKS = 4096


def cross_edges(endpoints: DataFrame, consumers: DataFrame, block: int = 4096) -> DataFrame:
    """Distinct (src, dst): consumer files and the files of the endpoints they call.

    Pairs are as many as a path's callers times its servers, so they are never exchanged: each
    is made once, at the least path that its files share. A path's servers are dealt into
    blocks of about ``block``, one list each, and its callers into blocks of half as many; each pair of
    blocks is a task's work by a stated number of tasks, since adaptive execution would join
    these small tables into a few. A caller's pairs with a list are made in one step."""
    def listed(rows: DataFrame, file: str, paths: str) -> DataFrame:
        each = rows.where("path is not null").groupBy("file").agg(F.collect_set("path").alias("all"))
        several = F.when(F.size("all") > 1, F.col("all")).alias(paths)  # one path alone needs no comparison
        return each.select(F.col("file").alias(file), several, F.explode("all").alias("path"))

    def dealt(file: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(file), blocks).cast("int")

    def each_block(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    served, called = materialize(listed(endpoints, "dst", "served"), "served"), materialize(listed(consumers, "src", "called"), "called")
    blocks = served.groupBy("path").agg(F.ceil(F.count("*") / block).cast("int").alias("lists"))
    blocks = blocks.join(called.groupBy("path").agg(F.ceil(F.count("*") * 2 / block).cast("int").alias("groups")), "path")
    blocks = materialize(blocks, "blocks")
    tasks = min(PAIR_TASKS, blocks.agg(F.sum(F.col("lists").cast("long") * F.col("groups"))).first()[0] or 1)
    key = ["path", "group", "list"]
    # Lists hold structs, as null files count too; files of several paths are told apart where a list has some.
    servers = served.join(blocks, "path").groupBy("path", "groups", dealt("dst", "lists").alias("list")).agg(
        F.collect_list(F.struct("dst")).alias("every"), F.collect_list(F.when(F.col("served").isNull(), F.struct("dst"))).alias("one"),
        F.collect_list(F.when(F.col("served").isNotNull(), F.struct("dst", "served"))).alias("more"),
    )
    files = lambda rows: F.transform(rows, lambda x: x["dst"])
    mixed = F.size("more") > 0
    servers = servers.select("path", each_block("groups").alias("group"), "list", files("every").alias("every"), F.when(mixed, files("one")).alias("one"), F.when(mixed, F.col("more")).alias("more"))
    callers = called.join(blocks, "path").select("path", dealt("src", "groups").alias("group"), each_block("lists").alias("list"), "src", "called")
    met = callers.repartition(tasks, *key).join(servers.repartition(tasks, *key).hint("merge"), key)
    first = F.filter("more", lambda x: F.array_min(F.array_intersect("called", x["served"])) == F.col("path"))
    own = F.when(F.col("called").isNull() | F.col("more").isNull(), F.col("every")).otherwise(F.concat("one", files(first)))
    # Functions over lists aren't compiled, so they stay in a step of their own, below the one that makes the pairs.
    return met.select("src", own.alias("own")).select("src", F.explode("own").alias("dst"))


def mermaid(edges: DataFrame, direction: str = "LR", most: int = 200) -> str:
    """A flow chart of at most ``most`` edges; a report for people, made on the driver."""
    rows = edges.select("src", "dst").orderBy("src", "dst").limit(most).collect()
    names = {x: f"n{k}" for k, x in enumerate(dict.fromkeys(str(v) for r in rows for v in r))}
    lines = [f'    {k}["{v}"]' for v, k in names.items()] + [f"    {names[str(a)]} --> {names[str(b)]}" for a, b in rows]
    return "\n".join([f"graph {direction}", *lines])
