"""Change history: churn, hotspots, scars, habits, timing synapses.

History rows have commit, author, file, insertions, deletions, is_fix and ts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scores, text


def file_churn(history: DataFrame) -> DataFrame:
    """Churn, commits, authors, fixes and risk per file.

    Churn is insertions plus deletions; a null counts as 0. A commit is counted in its first row
    of a file, which is found where the commit's rows are: so only authors are left to be told
    apart, and no row is copied for each distinct count."""
    first = F.row_number().over(Window.partitionBy("commit", "file").orderBy("author")) == 1
    rows = history.select(
        "file", "author", F.coalesce("insertions", F.lit(0)).alias("insertions"), F.coalesce("deletions", F.lit(0)).alias("deletions"),
        F.col("is_fix").cast("int").alias("is_fix"), "ts", (first & F.col("commit").isNotNull()).cast("int").alias("first"),
    )
    per_file = rows.groupBy("file").agg(
        F.sum("insertions").alias("insertions"),
        F.sum("deletions").alias("deletions"),
        F.sum("first").alias("commit_count"),
        F.countDistinct("author").alias("authors_count"),
        F.sum("is_fix").alias("fix_commits"),
        F.max("ts").alias("last_modified"),
    )
    churn = (F.col("insertions") + F.col("deletions")).alias("churn_score")
    per_file = per_file.select("file", churn, "insertions", "deletions", "commit_count", "authors_count", "fix_commits", "last_modified")
    score = scores.hotspot(F.col("churn_score"), F.col("commit_count"), F.col("fix_commits"))
    return per_file.withColumn("hotspot_score", score).withColumn("risk_level", scores.hotspot_risk(score, F.col("fix_commits")))


def top_hotspots(churn: DataFrame, n: int = 15) -> DataFrame:
    return churn.orderBy(F.desc("hotspot_score"), "file").limit(n)


def recent_changes(history: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Commits of the last hours, newest first, with the files that each touched."""
    recent = history.where((F.col("ts") <= as_of) & (F.col("ts") >= as_of - F.make_interval(hours=F.lit(hours))))
    return recent.groupBy("commit", "author").agg(F.max("ts").alias("ts"), F.countDistinct("file").alias("files")).orderBy(F.desc("ts"), "commit")


def changes_with_impact(history: DataFrame, edges: DataFrame, n: int = 5, depth: int = 1) -> DataFrame:
    """(commit, file, node, depth): the files of the newest commits, and what each reaches along
    edges (src, dst); node null for files that reach nothing.

    Only the touched files are seeds, so the walk sees their surroundings, not the graph."""
    from quern.storage import materialize

    newest = history.groupBy("commit").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "commit").limit(n)
    touched = materialize(history.select("commit", "file").distinct().join(F.broadcast(newest.select("commit")), "commit", "left_semi"), "touched")  # n commits
    walk = touched.select("file", F.col("file").alias("node"), F.lit(0).alias("depth")).distinct()
    hops, layers = edges.select("src", "dst").distinct(), walk
    for k in range(1, depth + 1):
        walk = walk.join(hops, F.col("node") == F.col("src")).select("file", F.col("dst").alias("node"), F.lit(k).alias("depth")).distinct()
        walk = materialize(walk.join(layers.select("file", "node"), ["file", "node"], "left_anti").select("file", "node", "depth"), "impact")
        layers = layers.unionAll(walk)
    return touched.join(layers.where("depth > 0"), "file", "left").select("commit", "file", "node", "depth")


def commits_since(history: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """(file, insertions, deletions, commits): what the commits of the last hours changed, in one."""
    recent = history.where((F.col("ts") <= as_of) & (F.col("ts") >= as_of - F.make_interval(hours=F.lit(hours))))
    return recent.groupBy("file").agg(F.sum(F.coalesce("insertions", F.lit(0))).alias("insertions"), F.sum(F.coalesce("deletions", F.lit(0))).alias("deletions"), F.countDistinct("commit").alias("commits"))


def symbol_scars(failures: DataFrame, symbols: DataFrame, gain: float = 0.05) -> DataFrame:
    """(path, name, threat_score): each symbol of a file that failed: the file's scar and a
    little more, 1 at most. symbols: path, name."""
    counts = failures.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("incidents"))
    return symbols.select("path", "name").distinct().join(counts, "path").select("path", "name", F.least(F.lit(1.0), F.round(scores.scar(F.col("incidents")) + gain, 2)).alias("threat_score"))


def threat_scars(failures: DataFrame) -> DataFrame:
    """Threat per file from failure rows (file, id, message): grows with their number, and
    keeps the first three different messages."""
    firsts = failures.groupBy("file", "message").agg(F.min("id").alias("first"))
    place = Window.partitionBy("file").orderBy("first")
    kept = firsts.withColumn("place", F.row_number().over(place)).where("place <= 3")
    messages = kept.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "message"))), lambda m: m["message"]).alias("messages"))
    counts = failures.groupBy("file").agg(F.count("*").alias("incidents"))
    scored = counts.withColumn("threat_score", scores.scar(F.col("incidents")))
    return scored.join(messages, "file").select("file", "incidents", "threat_score", F.array_join("messages", " | ").alias("messages"))


def error_ripples(failures: DataFrame, least: float = 0.5, n: int = 10) -> DataFrame:
    """Files whose failures are frequent enough to replay, steepest first."""
    counts = failures.groupBy("file").agg(F.count("*").alias("incidents")).withColumn("error_gradient", scores.scar(F.col("incidents")))
    return counts.where(F.col("error_gradient") >= least).orderBy(F.desc("error_gradient"), F.desc("incidents"), "file").limit(n)


def sessions(history: DataFrame, least: int = 2, assets: str = r"(?i)\.(png|jpe?g|gif|svg|ico|lock|min\.js)$") -> DataFrame:
    """(commit, file): edits of commits that touch at least two files which aren't assets."""
    edits = history.select("commit", "file").where(~F.col("file").cast("string").rlike(assets)).distinct()
    sizes = edits.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return edits.join(sizes, "commit").select("commit", "file")


#: Files of a commit that meet in one group; a larger commit is cut into blocks, and all pairs of blocks meet.
COMMIT_BLOCK = 512


def co_changes(edits: DataFrame, most_files: int | None = None) -> DataFrame:
    """(file_a, file_b, together): how often two files change in one commit, a before b.

    A commit's files are gathered in one row and paired there; those of a sweeping commit are
    paired by blocks, so that no row or key holds more than two blocks. ``most_files`` leaves out
    sweeping commits, as an explicit choice of the caller; by default none is left out."""
    sizes = edits.groupBy("commit").agg(F.count("*").alias("n"))
    if most_files:
        edits = edits.join(sizes.where(F.col("n") <= most_files), "commit", "left_semi")
    small = edits.join(sizes.where(F.col("n") <= COMMIT_BLOCK), "commit", "left_semi").groupBy("commit").agg(F.collect_list("file").alias("files"))
    paired = small.select("files", F.explode("files").alias("file_a")).select("file_a", F.explode("files").alias("file_b")).where("file_a < file_b")
    large = sizes.where(F.col("n") > COMMIT_BLOCK).select("commit", F.ceil(F.col("n") / COMMIT_BLOCK).cast("int").alias("parts"))
    placed = edits.join(large, "commit").withColumn("own", F.pmod(F.xxhash64("file"), F.col("parts")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("commit", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "file")
    a = placed.select("commit", "i", "j", F.col("own").alias("own_a"), F.col("file").alias("file_a"))
    b = placed.select("commit", "i", "j", F.col("own").alias("own_b"), F.col("file").alias("file_b"))
    mine = (F.least("own_a", "own_b") == F.col("i")) & (F.greatest("own_a", "own_b") == F.col("j"))  # in one group only
    swept = a.join(b, ["commit", "i", "j"]).where((F.col("file_a") < F.col("file_b")) & mine).select("file_a", "file_b")
    return paired.unionAll(swept).groupBy("file_a", "file_b").agg(F.count("*").alias("together"))


def habits(edits: DataFrame, least_confidence: float = 0.5, least_pairs: int = 2, most: int = 5) -> DataFrame:
    """Association rules trigger -> consequent with confidence together / edits of the trigger,
    at most five per trigger."""
    pairs = co_changes(edits).where(F.col("together") >= least_pairs)
    ways = [F.struct(F.col(x).alias("trigger"), F.col(y).alias("consequent"), "together") for x, y in (("file_a", "file_b"), ("file_b", "file_a"))]
    both = pairs.select(F.inline(F.array(*ways)))  # in one row each: pairs are made once
    counts = edits.groupBy("file").agg(F.count("*").alias("occurrences"))
    rules = both.join(counts, F.col("trigger") == F.col("file")).drop("file")
    rules = rules.withColumn("confidence", F.col("together") / F.col("occurrences")).where(F.col("confidence") >= least_confidence)
    place = Window.partitionBy("trigger").orderBy(F.desc("confidence"), F.desc("together"), "consequent")
    return rules.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select("trigger", "consequent", "together", "occurrences", F.round("confidence", 6).alias("confidence"), "place")


def choreographies(rules: DataFrame) -> DataFrame:
    """One row per trigger: its consequents in order, and the best confidence."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "consequent"))), lambda r: r["consequent"].cast("string"))
    return rules.groupBy("trigger").agg(F.array_join(listed, ",").alias("choreography"), F.max("confidence").alias("confidence"), F.max("occurrences").alias("occurrences"))


def spike_pairs(events: DataFrame, by: str, item: str, ts: str = "ts", tie: str = "event_id", horizon: int = 1200) -> DataFrame:
    """Consecutive events of a trace on different items within the horizon: (src, dst, dt, ts, id)."""
    order = Window.partitionBy(by).orderBy(ts, tie)
    later = events.select(
        F.col(item).alias("src"), F.lead(item).over(order).alias("dst"), F.col(ts).alias("ts"), F.lead(ts).over(order).alias("next_ts"), F.lead(tie).over(order).alias("id")
    )
    dt = F.unix_micros("next_ts") / 1e6 - F.unix_micros("ts") / 1e6
    pairs = later.select("src", "dst", dt.alias("dt"), F.col("next_ts").alias("ts"), "id")
    return pairs.where((F.col("src") != F.col("dst")) & (F.abs("dt") <= horizon))


def synapses(pairs: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Weight per (src, dst) from spike-timing updates in time order.

    It starts at 0.5, and each update adds a fifth of its delta, held within 0.01 and 1. A
    run of updates is itself a shift held within bounds: w -> min(hi, max(lo, w + c)). So
    updates are folded by chunks of time first, and no task holds all of a busy pair."""
    def run(s: Column, u: Column) -> Column:
        shift = 0.2 * scores.synapse_delta(u["dt"])
        return F.struct((s["c"] + shift).alias("c"), held(s["lo"] + shift).alias("lo"), held(s["hi"] + shift).alias("hi"))

    def held(x: Column) -> Column:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.01), x))

    none = F.struct(F.lit(0.0).alias("c"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    updates = F.array_sort(F.collect_list(F.struct("ts", "id", "dt")))
    chunk = F.floor(F.col("ts").cast("double") / chunk_seconds)
    chunks = pairs.groupBy("src", "dst", chunk.alias("chunk")).agg(F.aggregate(updates, none, run).alias("f"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "f")))
    weight = F.aggregate(ordered, F.lit(0.5), lambda w, x: F.least(x["f"]["hi"], F.greatest(x["f"]["lo"], w + x["f"]["c"])))
    return chunks.groupBy("src", "dst").agg(weight.alias("weight"), F.sum("n").cast("int").alias("sample_count"))


def strongest(weights: DataFrame, least: float = 0.5, n: int = 20) -> DataFrame:
    return weights.where(F.col("weight") >= least).orderBy(F.desc("weight"), F.desc("sample_count"), "src", "dst").limit(n)


def thompson(weights: DataFrame, seed: int = 7) -> DataFrame:
    """Synapses with a draw from Beta(1 + 10w, 1 + 10(1 - w)), the same for the same seed and pair."""
    @F.pandas_udf("double")
    def draw(key: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, k & (1 << 63) - 1]).beta(1 + 10 * x, 1 + 10 * (1 - x)) for k, x in zip(key, w)])

    return weights.withColumn("sample", draw(F.xxhash64("src", "dst"), F.col("weight")))


def subsystem_divergence(expected: DataFrame, proposed: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """KL divergence in nats of proposed shares from expected ones; both (subsystem, mass)."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        total = df.agg(F.sum("mass").alias("total"))
        return df.groupBy("subsystem").agg(F.sum("mass").alias("mass")).crossJoin(total).select("subsystem", (F.col("mass") / F.col("total")).alias(name))

    p, q = shares(expected, "p"), shares(proposed, "q")
    both = p.join(q, "subsystem", "full_outer").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    term = F.when(F.col("q") > 0, F.col("q") * F.ln(F.col("q") / F.greatest(F.col("p"), F.lit(epsilon)))).otherwise(0.0)
    return both.agg(F.sum(term).alias("kl"), F.sum((F.col("q") > 0).cast("int")).alias("subsystems"))


def overshoot(kl: Column, files: Column, mean_files: Column) -> Column:
    """Whether a change reaches further than its kind usually does."""
    return ((kl >= 1.8) & (files > 3)) | ((files >= 8) & (files > 2.5 * mean_files))


def fix_rows(history: DataFrame, subject: str = "subject") -> DataFrame:
    return history.withColumn("is_fix", text.is_fix(F.col(subject)))


def postmortems(commits: DataFrame, known: DataFrame, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """Invariant nodes for the newest fixes and reverts that have none yet, and their edges to files."""
    fixes = commits.where(F.col("subject").rlike(r"(?i)^(fix|revert)")).orderBy(F.desc("ts"), "commit").limit(n)
    fixes = fixes.withColumn("id", F.concat(F.lit("invariant-"), F.substring(text.topic_key(F.col("subject")), 1, 60)))
    fixes = fixes.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"])
    nodes = fixes.select("id", F.lit("invariant").alias("kind"), F.col("subject").alias("title"))
    edges = fixes.select(F.col("id").alias("src"), F.explode("files").alias("dst"), F.lit("applies_to").alias("edge_type"), F.lit(1.0).alias("weight"))
    return nodes, edges
