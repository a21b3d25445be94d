"""Reads and upkeep of stored memories: lists, searches, freshness, composed retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import lexical
from quern.operators.lexical import within_budget


def newest(rows: DataFrame, n: int = 20, where: Column | None = None, least: int = 1, most: int = 100) -> DataFrame:
    """Rows with the highest ids, ``n`` held within ``least`` and ``most``."""
    rows = rows.where(where) if where is not None else rows
    return rows.orderBy(F.desc("id")).limit(max(least, min(most, n)))


def lessons_of(lessons: DataFrame, path: str, symbol: str | None = None) -> DataFrame:
    """Lessons on a file (equal, or stored under a longer path) and, if given, a symbol; newest first."""
    on = (F.col("file_path") == path) | F.col("file_path").endswith("/" + path)
    on = on & (F.col("symbol_name") == symbol) if symbol else on
    return lessons.where(on).orderBy(F.desc("id"))


def search_observations(rows: DataFrame, needle: str, n: int = 20, **equal: str) -> DataFrame:
    """Observations whose title, content or topic holds the needle, in the given type, project or scope; newest first."""
    low = F.lit(needle.lower())
    hit = F.lit(False)
    for c in ("title", "content", "topic_key"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), low)
    for column, value in equal.items():
        hit = hit & (F.col(column) == value)
    return newest(rows.where("deleted_at is null"), n, hit)


def recorded_lessons(lessons: DataFrame, new: DataFrame) -> DataFrame:
    """Lessons (id, file_path, symbol_name, kind, error_context, solution) with new rows (at, and the
    same but for id) numbered behind them in order; texts are trimmed, and rows without a
    solution aren't recorded."""
    from quern.ordering import with_place

    kept = new.where(F.trim(F.coalesce("solution", F.lit(""))) != "")
    top = lessons.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = with_place(kept, "at", "file_path", "solution").crossJoin(F.broadcast(top))  # one row
    fresh = rows.select(
        (F.col("top") + F.col("place")).alias("id"), "file_path", F.coalesce("symbol_name", F.lit("")).alias("symbol_name"),
        F.coalesce("kind", F.lit("lesson")).alias("kind"), F.trim("error_context").alias("error_context"), F.trim("solution").alias("solution"),
    )
    return lessons.select(*fresh.columns).unionByName(fresh)


def lesson_counts(lessons: DataFrame) -> DataFrame:
    """(file_path, lessons) per file."""
    return lessons.groupBy("file_path").agg(F.count("*").alias("lessons"))


def diagnostics_of(rows: DataFrame, path: str | None = None, n: int = 20) -> DataFrame:
    """Newest diagnostics (id, file_path, ...), of one file or of all; 1 to 100 of them."""
    return newest(rows, n, F.col("file_path") == path if path is not None else None)


def telemetry_of(rows: DataFrame, path: str) -> DataFrame:
    """Rows on a file, stored under that path or a longer one that ends in it."""
    return rows.where((F.col("file_path") == path) | F.col("file_path").endswith("/" + path))


def smart_search(symbols: DataFrame, lessons: DataFrame, semantic: DataFrame, query: str, n: int = 10, least: float = 0.3) -> DataFrame:
    """(part, id, rank, score): symbols whose name holds the query, lessons by BM25, and the nearest
    lessons (id, similarity) of ``least`` or more, each list on its own, not fused."""
    low = F.lit(query.lower())
    named = symbols.where(F.contains(F.lower("name"), low)).select("id", F.lit(1.0).alias("score"))
    found = lexical.search(lessons, query, {"error_context": 1.0, "solution": 1.0}, n=n)
    near = semantic.where(F.col("similarity") >= least).select("id", F.col("similarity").alias("score"))
    parts = []
    for name, rows in (("symbols", named), ("lessons", found), ("semantic", near)):
        first = rows.orderBy(F.desc("score"), "id").limit(n)
        parts.append(first.select(F.lit(name).alias("part"), "id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"), "score"))  # n rows
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def fused_tiers(words: DataFrame, dense: DataFrame, failures: DataFrame, n: int = 5, k: int = 60) -> DataFrame:
    """(id, score): three ranked lists (id, rank) fused by reciprocal ranks; the lexical one gives
    twice as many as the others."""
    return lexical.fuse(words.where(F.col("rank") <= 2 * n), dense.where(F.col("rank") <= n), failures.where(F.col("rank") <= n), k=k, n=n)


def active_threats(gotchas: DataFrame, n: int = 10) -> DataFrame:
    return gotchas.where(F.col("severity").isin("high", "critical")).orderBy(F.desc("created_at"), "id").limit(n)


def search_gotchas(gotchas: DataFrame, query: str, n: int = 10) -> DataFrame:
    """Gotchas that hold any query token of three letters or more, newest first; without tokens, active threats."""
    words = [w for w in dict.fromkeys(x.lower() for x in lexical._words(query)) if len(w) >= 3]
    if not words:
        return active_threats(gotchas, n)
    body = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "content", "tags")]))
    return gotchas.where(text.has_any(body, words)).orderBy(F.desc("created_at"), "id").limit(n)


def drift_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(~F.col("resolved")).orderBy(F.desc("created_at"), "id")


def pruned_alerts(alerts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Alerts that stay: open ones, and resolved ones not older than ``days``."""
    return alerts.where(~F.col("resolved") | (F.datediff(as_of, "created_at") <= days))


def freshness(memories: DataFrame, files: DataFrame) -> DataFrame:
    """(id, warning): stale memories, those of missing files, and those older than their file by over a second."""
    known = files.select(F.col("path").alias("file_path"), F.col("mtime"))
    warning = (
        F.when(F.col("stale"), "stale")
        .when(F.col("mtime").isNull(), "file_missing")
        .when(F.unix_micros("mtime") > F.unix_micros("created_at") + 1_000_000, "file_changed")
    )
    return memories.join(known, "file_path", "left").select("id", warning.alias("warning"))


def edges_of(edges: DataFrame, node) -> DataFrame:
    """A node's edges in both directions, heaviest first, then newest."""
    out = edges.where(F.col("src") == node).withColumn("direction", F.lit("out"))
    into = edges.where((F.col("dst") == node) & (F.col("src") != node)).withColumn("direction", F.lit("in"))
    return out.unionByName(into).orderBy(F.desc("weight"), F.desc("created_at"), "src", "dst")


def unified_search(symbols: DataFrame, lessons: DataFrame, needle: str, scope: str = "all", n: int = 20) -> DataFrame:
    """(kind, id, score): symbols by name at 1.0, then lessons by content at 0.9."""
    low = F.lit(needle.lower())
    code = symbols.where(F.contains(F.lower("name"), low)).select(F.lit("code").alias("kind"), "id", F.lit(1.0).alias("score"))
    noted = lessons.where(F.contains(F.lower("content"), low)).select(F.lit("lesson").alias("kind"), "id", F.lit(0.9).alias("score"))
    found = code if scope == "code" else noted if scope == "lessons" else code.unionAll(noted)
    return found.orderBy(F.desc("score"), "id").limit(n)


def deep_search(dense: DataFrame, lexical_hits: DataFrame, docs: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(id, score): the first 3k of a dense list and of a lexical one (id, rank) are fused, and the
    best 2k of those ranked anew by token overlap with the query."""
    fused = lexical.fuse(dense.where(F.col("rank") <= 3 * k), lexical_hits.where(F.col("rank") <= 3 * k), n=2 * k)
    overlap = lexical.overlap_score(F.lit(query), F.coalesce("text", F.lit("")))
    again = docs.join(F.broadcast(fused.select("id")), "id", "left_semi").select("id", F.round(overlap, 6).alias("score"))  # 2k rows
    return again.orderBy(F.desc("score"), "id").limit(k)


def cross_project_search(rows: DataFrame, needle: str, per_project: int = 5, n: int = 20) -> DataFrame:
    """Newest rows of each project that hold the needle: filtered, then ranked, then cut."""
    place = Window.partitionBy("project").orderBy(F.desc("id"))
    hits = rows.where(F.contains(F.lower("content"), F.lit(needle.lower()))).withColumn("place", F.row_number().over(place))
    return hits.where(F.col("place") <= per_project).orderBy(F.desc("id"), "project").limit(n).drop("place")


def find_symbol(symbols: DataFrame, files: DataFrame, name: str, prefix: str = "", n: int = 100) -> DataFrame:
    """Symbols whose name holds a text, with their file's language, below a path prefix."""
    hits = symbols.where(F.contains(F.lower("name"), F.lit(name.lower())) & F.col("path").startswith(prefix))
    return hits.join(files.select("path", "language"), "path").orderBy("name", "path").limit(n)


def symbol_ranges(symbols: DataFrame) -> DataFrame:
    """(path, first_line, last_line) of each file's symbols."""
    return symbols.groupBy("path").agg(F.coalesce(F.min("start_line"), F.lit(0)).alias("first_line"), F.coalesce(F.max("end_line"), F.lit(0)).alias("last_line"))


def localise(files: DataFrame, symbols: DataFrame, per_file: int = 3, around: int = 10) -> DataFrame:
    """(path, name, from_line, to_line): windows around the first symbols of chosen files."""
    place = Window.partitionBy("path").orderBy("start_line", "name")
    first = symbols.join(files.select("path").distinct(), "path", "left_semi").withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_file)
    return first.select("path", "name", F.greatest(F.lit(1), F.col("start_line") - around).alias("from_line"), (F.col("end_line") + around).alias("to_line"))


def task_context(parts: DataFrame, budget: int = 1200) -> DataFrame:
    """Parts (priority, id, body) of a task's context in order while their tokens fit the budget."""
    return within_budget(parts, budget, text.token_estimate(F.col("body")), ("priority", "id"))


def load_of(kind: Column, weight: Column) -> Column:
    """What an activity adds to the load: failures five times its weight, edits 2.5, tools 1.5, others half."""
    low = F.lower(kind)
    factor = F.when(low.rlike("error|failure|crash"), 5.0).when(low.rlike("patch|edit|mutation"), 2.5).when(low.rlike("tool|mcts"), 1.5).otherwise(0.5)
    return weight * factor


def pressure(activities: DataFrame, critical: float = 100.0) -> DataFrame:
    """(key, load, pressure, rest) of activities (key, kind, weight)."""
    total = F.round(F.sum(load_of(F.col("kind"), F.col("weight"))), 2)
    return activities.groupBy("key").agg(total.alias("load")).select("key", "load", F.round(F.col("load") / critical, 4).alias("pressure"), (F.col("load") >= critical).alias("rest"))


def modulators(events: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Drive and alertness per key after a log (key, at, id, kind in reward or pain, amount), in order.

    A reward moves drive by 0.30 of what it exceeds 0.50 by and lowers alertness by 0.15; a
    pain raises alertness by 0.25 of it and lowers drive by 0.20. Both start at 0.50 and 0.20
    and stay within bounds, in thousandths. A run of such steps is itself a shift held within
    bounds, so a log is folded by chunks of time first, and no task holds all of a busy key."""
    log = F.array_sort(F.collect_list(F.struct("at", "id", "kind", "amount")))

    def thousandths(x: Column) -> Column:
        return F.round(1000 * x).cast("long")

    def moves(e: Column) -> dict[str, tuple[Column, Column]]:
        """Per state: the shift of one event and the lower bound that it holds to."""
        good = e["kind"] == "reward"
        return {
            "drive": (F.when(good, thousandths(0.30 * F.round(e["amount"] - 0.5, 3))).otherwise(thousandths(-0.20 * e["amount"])), F.when(good, 10).otherwise(50).cast("long")),
            "alert": (F.when(good, -150).otherwise(thousandths(0.25 * e["amount"])).cast("long"), F.lit(50).cast("long")),
        }

    def held(x: Column, least: Column) -> Column:
        return F.least(F.lit(1000).cast("long"), F.greatest(least, x))

    def step(s: Column, e: Column) -> Column:
        return F.struct(*[
            F.struct((s[n]["c"] + shift).alias("c"), held(s[n]["lo"] + shift, least).alias("lo"), held(s[n]["hi"] + shift, least).alias("hi")).alias(n)
            for n, (shift, least) in moves(e).items()
        ])

    far = 1 << 40
    none = F.struct(*[F.struct(F.lit(0).cast("long").alias("c"), F.lit(-far).alias("lo"), F.lit(far).alias("hi")).alias(n) for n in ("drive", "alert")])
    chunk = F.floor(F.col("at").cast("double") / chunk_seconds)
    chunks = events.groupBy("key", chunk.alias("chunk")).agg(F.aggregate(log, none, step).alias("f"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "f")))

    def state(name: str, start: int) -> Column:
        run = lambda w, x: F.least(x["f"][name]["hi"], F.greatest(x["f"][name]["lo"], w + x["f"][name]["c"]))
        return (F.aggregate(ordered, F.lit(start).cast("long"), run) / 1000).alias(name)

    folded = chunks.groupBy("key").agg(state("drive", 500), state("alert", 200))
    threshold = F.greatest(F.lit(0.25), F.round(0.80 - 0.45 * F.col("alert"), 2))
    return folded.select("key", F.round("drive", 3).alias("drive"), F.round("alert", 3).alias("alert"), threshold.alias("threat_threshold"))


def replay_rule(error: Column) -> Column:
    """Operator that a failure's text calls for."""
    low = F.lower(error)
    return (
        F.when(low.rlike("signature|arity|argument"), "ARITY_PARITY").when(low.rlike("null|none|undefined"), "ADD_GUARD")
        .when(low.rlike("import|cannot find|modulenotfound"), "INVERT_DEPENDENCY").otherwise("ISOLATE_SANDBOX")
    )


def diagnostic_kind(message: Column, code: Column) -> Column:
    """Category of a compiler's or checker's message, by the first rule that holds: fixed values."""
    low = F.lower(message)
    return (
        F.when(message.rlike(r"INVARIANT\[|\[CRITICAL_VETO|NEVER OVERWRITE"), "INVARIANT_VIOLATION")
        .when(code.isin("F821", "TS2304", "E0425", "E0412") | message.rlike("is not defined|Cannot find name|unresolved import|cannot find value|cannot import name"), "MISSING_IMPORT")
        .when(low.contains("await") & (message.rlike("outside async|never awaited|not allowed") | (code == "TS1308")), "ASYNC_AWAIT_MISMATCH")
        .when(code.isin("E0502", "E0596", "E0382") | message.rlike("cannot borrow|use of moved value|borrow of moved value"), "MUTABILITY_OR_BORROW")
        .when(code.isin("TS2322", "E0308") | message.rlike("is not assignable to type|TypeError:") | (message.contains("expected") & message.contains("found")), "TYPE_MISMATCH")
        .otherwise("GENERAL_DIAGNOSTIC")
    )


def sessions_state(log: DataFrame) -> DataFrame:
    """(id, project, started_at, ended_at, status) per session of a log (id, at, event, project):
    the first start's project is kept."""
    started, ended = F.col("event") == "start", F.col("event") == "end"
    per = log.groupBy("id").agg(F.min_by("project", F.when(started, F.col("at"))).alias("project"), F.min(F.when(started, F.col("at"))).alias("started_at"), F.max(F.when(ended, F.col("at"))).alias("ended_at"))
    return per.withColumn("status", F.when(F.col("ended_at").isNotNull(), "ended").otherwise("active"))


def stale_projects(projects: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Sleeping projects that nobody opened for some days, longest first."""
    return projects.where((F.col("status") == "SLEEPING") & (F.datediff(as_of, "last_opened") > days)).orderBy("last_opened", "id")


def project_scale(files: Column) -> Column:
    return F.when(files < 100, "small").when(files < 1000, "medium").when(files < 10_000, "large").otherwise("huge")


def hyperbolic_coupling(points: DataFrame, pairs: DataFrame, tau: float = 1.0) -> DataFrame:
    """(a, b, coupling): e^(-distance / tau) of path points (path, point) for pairs (a, b).

    Points are joined by merge joins: they are far larger than the files that they are made from,
    by which Spark would choose to broadcast them."""
    from quern.operators.vector import poincare_distance

    left, right = points.select(F.col("path").alias("a"), F.col("point").alias("pa")), points.select(F.col("path").alias("b"), F.col("point").alias("pb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", F.exp(-poincare_distance(F.col("pa"), F.col("pb")) / tau).alias("coupling"))
