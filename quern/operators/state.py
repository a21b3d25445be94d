"""State-changing operators as pure functions: old state and changes in, new state out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.ordering import with_place


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row per key by ``order`` (columns that rise with time)."""
    packed = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("__row")
    return rows.groupBy(*keys).agg(packed).select("__row.*")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], deleted: str | None = None) -> DataFrame:
    """Base with the delta's rows in place of those of equal key; rows flagged ``deleted`` go."""
    live = delta.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else delta
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(live, allowMissingColumns=True)


def merge_columns(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keyed upsert that only overwrites the named columns, and those not by nulls."""
    renamed = delta.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = base.join(renamed, keys, "full_outer")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns])


def save_observations(writes: DataFrame) -> DataFrame:
    """Observations after a log of writes (id, session_id, project, scope, type, title, content,
    topic_key), in id order: writes with a topic key of one project and scope are revisions of
    one observation; others that are equal but for case and white space are duplicates of it.

    Kept are the first id, the newest revision's title and content and both counts."""
    topic = text.topic_key(F.col("topic_key"))
    digest = text.normalized_hash(F.coalesce("content", F.lit("")))
    rows = writes.withColumns({"topic": F.when(topic != "", topic), "normalized_hash": digest})
    topical = rows.where("topic is not null").groupBy("project", "scope", "topic").agg(
        F.min("id").alias("id"), F.max_by("title", "id").alias("title"), F.max_by("normalized_hash", "id").alias("normalized_hash"),
        F.count("*").alias("revision_count"), F.lit(0).cast("long").alias("duplicate_count"),
    )
    plain = rows.where("topic is null").groupBy("project", "scope", "type", "title", "normalized_hash").agg(F.min("id").alias("id"), (F.count("*") - 1).alias("duplicate_count"))
    plain = plain.select("project", "scope", F.lit(None).cast("string").alias("topic"), "id", "title", "normalized_hash", F.lit(1).cast("long").alias("revision_count"), "duplicate_count")
    return topical.unionByName(plain)


def touch(confidence: Column, times: Column) -> Column:
    return F.least(F.lit(1.0), confidence + 0.1 * times)


def ranked_lessons(lessons: DataFrame, files: DataFrame, symbols: DataFrame, least: float = 0.3) -> DataFrame:
    """(id, rank_score, active): a view of lessons by what is left of them; nothing is written back.

    Halved if stale; times 0.3 if the file is gone, else 0.6 if its symbol is; plus 0.05 per
    touch, 1 at most. lessons: id, file_path, symbol_name, confidence, touch_count, stale."""
    known_files = files.select(F.col("path").alias("file_path")).distinct().withColumn("file_there", F.lit(True))
    known = symbols.select(F.col("path").alias("file_path"), F.col("name").alias("symbol_name")).distinct().withColumn("symbol_there", F.lit(True))
    rows = lessons.join(known_files, "file_path", "left").join(known, ["file_path", "symbol_name"], "left")
    gone, lost = F.col("file_there").isNull(), F.col("symbol_there").isNull() & (F.coalesce("symbol_name", F.lit("")) != "")
    factor = F.when(F.col("stale"), 0.5).otherwise(1.0) * F.when(gone, 0.3).when(lost, 0.6).otherwise(1.0)
    score = F.round(F.least(F.lit(1.0), F.col("confidence") * factor + 0.05 * F.col("touch_count")), 2)
    return rows.select("id", score.alias("rank_score"), ((score >= least) & ~F.col("stale") & ~gone).alias("active"))


def decayed(memories: DataFrame, as_of: Column, threshold: float = 0.35, max_days: int = 90) -> DataFrame:
    """Memories (id, confidence, created_at) with their decayed confidence and whether they go stale."""
    days = F.datediff(as_of, timestamp(F.col("created_at")))
    now = F.round(scores.decayed_confidence(F.col("confidence"), days), 6)
    old = (F.col("confidence") < threshold) | ((days > max_days) & (F.col("confidence") <= 0.5))
    return memories.select("id", days.alias("days"), now.alias("decayed"), F.coalesce(old, F.lit(False)).alias("stale"))


def timestamp(value: Column) -> Column:
    """Epoch seconds, ISO 8601 or 'date time' text as a timestamp; null if it is none of them."""
    raw = F.trim(value.cast("string"))
    epoch = F.when(raw.rlike(r"^\d{1,12}$"), F.timestamp_seconds(F.expr("try_cast(1 as bigint)") * raw.try_cast("bigint")))
    return F.coalesce(epoch, F.try_to_timestamp(raw))


def stale_lessons(lessons: DataFrame, scanned: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, stale_reason) of lessons on scanned files that are gone or lost their symbol."""
    on = lessons.join(scanned.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    gone = on.join(files.select(F.col("path").alias("file_path")), "file_path", "left_anti").select("id", F.lit("file_deleted").alias("stale_reason"))
    there = on.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").where("symbol_name <> ''")
    lost = there.join(symbols.select(F.col("path").alias("file_path"), F.col("name").alias("symbol_name")), ["file_path", "symbol_name"], "left_anti")
    return gone.unionAll(lost.select("id", F.lit("symbol_removed").alias("stale_reason")))


def reflexes(events: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Reflex per key from a log (key, at, id, threat; null threat: a clean run), folded in order.

    A threat raises occurrences, sets threat to min(1, max(old, new) + 0.05), the first to
    itself, and ends extinction; clean runs extinguish by a sigmoid. A run of hits is itself
    min(1, max(old + rise, floor)), so a key's log is folded by chunks of time first, and no
    task holds all of a busy key."""
    log = F.array_sort(F.collect_list(F.struct("at", "id", "threat")))

    def step(s: Column, e: Column) -> Column:
        hit, first = e["threat"].isNotNull(), s["hits"] == 0
        after = F.greatest(s["rest"] + 0.05, e["threat"] + 0.05)
        return F.struct(
            (s["hits"] + hit.cast("int")).alias("hits"),
            F.when(hit & first, e["threat"]).otherwise(s["first"]).alias("first"),
            F.when(hit & first, F.lit(float("-inf"))).when(hit, after).otherwise(s["rest"]).alias("rest"),
            F.when(hit, 0).otherwise(s["clean"] + 1).alias("clean"),
        )

    zero = F.struct(F.lit(0).alias("hits"), F.lit(0.0).alias("first"), F.lit(float("-inf")).alias("rest"), F.lit(0).alias("clean"))
    chunk = F.floor(F.col("at").cast("double") / chunk_seconds)
    chunks = events.groupBy("key", chunk.alias("chunk")).agg(F.aggregate(log, zero, step).alias("f"))

    def join(s: Column, c: Column) -> Column:
        f = c["f"]
        start = F.when(s["occurrences"] == 0, f["first"]).otherwise(F.greatest(s["threat"], f["first"]) + 0.05)
        raised = F.least(F.lit(1.0), F.greatest(F.least(F.lit(1.0), start) + 0.05 * (f["hits"] - 1), f["rest"]))
        raised = F.when((s["occurrences"] == 0) & (f["hits"] == 1), f["first"]).otherwise(raised)
        return F.struct(
            F.when(f["hits"] > 0, raised).otherwise(s["threat"]).alias("threat"),
            (s["occurrences"] + f["hits"]).alias("occurrences"),
            F.when(f["hits"] > 0, f["clean"]).otherwise(s["clean_runs"] + f["clean"]).alias("clean_runs"),
        )

    none = F.struct(F.lit(0.0).alias("threat"), F.lit(0).alias("occurrences"), F.lit(0).alias("clean_runs"))
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "f")))
    folded = chunks.groupBy("key").agg(F.aggregate(ordered, none, join).alias("s")).select("key", "s.*")
    effective = scores.effective_threat(F.col("threat"), F.col("clean_runs"))
    return folded.where("occurrences > 0").withColumn("effective", F.round(effective, 6)).withColumn("verdict", scores.threat_verdict(effective))


def merged_habits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Habits per trigger after another mining: best confidence, occurrences counted up."""
    rows = old.select("trigger", "choreography", "confidence", "occurrences", F.lit(0).alias("age")).unionByName(new.select("trigger", "choreography", "confidence", F.lit(1).cast("long").alias("occurrences"), F.lit(1).alias("age")))
    return rows.groupBy("trigger").agg(F.max_by("choreography", "age").alias("choreography"), F.max("confidence").alias("confidence"), F.sum("occurrences").alias("occurrences"))


def changes(before: DataFrame, after: DataFrame, keys: list[str], deleted_at: str | None = None) -> DataFrame:
    """Change rows (keys, operation, payload) between two snapshots; a soft delete is a DELETE."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        live = df.where(F.col(deleted_at).isNull()) if deleted_at else df
        return live.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(name))

    both = packed(before, "old").join(packed(after, "new"), keys, "full_outer")
    operation = F.when(F.col("new").isNull(), "DELETE").when(F.col("old").isNull() | (F.col("old") != F.col("new")), "UPSERT")
    return both.withColumn("operation", operation).where("operation is not null").select(*keys, "operation", F.coalesce("new", "old").alias("payload"))


def drained(queue: DataFrame, results: DataFrame, as_of: Column, most: int = 5) -> DataFrame:
    """Queue rows (id, status, retry_count, attempted_at) after one drain; ``results`` has id, ok, error.

    Claimed are PENDING and FAILED below the limit whose back-off of 2^retries seconds since
    their last attempt is over; a result moves them to PROCESSED, PENDING or FAILED."""
    due = F.col("attempted_at").isNull() | (F.unix_micros(as_of) >= F.unix_micros("attempted_at") + F.pow(F.lit(2), F.col("retry_count")) * 1_000_000)
    claimed = F.col("status").isin("PENDING", "FAILED") & (F.col("retry_count") < most) & due & F.col("ok").isNotNull()
    tries = F.col("retry_count") + (claimed & ~F.col("ok")).cast("int")
    status = F.when(~claimed, F.col("status")).when(F.col("ok"), "PROCESSED").when(tries >= most, "FAILED").otherwise("PENDING")
    return queue.join(results, "id", "left").select("id", status.alias("status"), tries.alias("retry_count"), F.when(claimed & ~F.col("ok"), F.col("error")).alias("error_message"))


def queue_counters(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count_if(F.col("status") == "PROCESSED").alias("processed"), F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("retry_count") > 0).alias("retried"), F.count("*").alias("total"),
    )


def promoted(nodes: DataFrame, least: float = 0.85, warned: float = 0.70) -> DataFrame:
    """Insights from search nodes that did well, and a gotcha from each of those whose threat is
    ``warned`` or more, where nodes have one: (id, kind, title, confidence)."""
    def rows(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.concat(F.lit(f"{kind}-"), F.col("node_id").cast("string")).alias("id"), F.lit(kind).alias("kind"), "title", F.col("q_value").alias("confidence"))

    good = nodes.where(F.col("q_value") >= least)
    return rows(good, "insight").unionAll(rows(good.where(F.col("threat") >= warned), "gotcha")) if "threat" in nodes.columns else rows(good, "insight")


def active_tags(tags: DataFrame, as_of: Column, prefix: str = "", ttl: int = 1800, tau: float = 900.0) -> DataFrame:
    """Tags (id, symbol, weight, tagged_at) still alive, with their decayed strength."""
    age = (F.unix_micros(as_of) - F.unix_micros("tagged_at")) / 1e6
    live = (age >= 0) & (age <= ttl) & F.col("symbol").startswith(prefix)
    return tags.where(live).select("id", "symbol", F.round(scores.tag_strength(F.col("weight"), age, tau), 6).alias("strength"))


def consolidated(memories: DataFrame) -> DataFrame:
    """(topic, members, confidence, stale, summary) per topic of memories (id, topic, content, decayed)."""
    grouped = memories.groupBy("topic").agg(F.count("*").alias("members"), F.avg("decayed").alias("mean"), F.array_sort(F.collect_set("content")).alias("contents"))
    return grouped.select(
        "topic", "members", F.round(F.least(F.lit(1.0), 0.7 + 0.1 * F.least(F.col("members"), F.lit(3))), 6).alias("confidence"),
        (F.col("mean") < 0.4).alias("stale"), F.array_join(F.slice("contents", 1, 5), " | ").alias("summary"),
    )


#: A rule without prohibited terms alerts on its keywords if it holds one of these.
ENFORCING = r"never|do not|prohibited|deprecated|siempre|always|evitar|forbidden"
#: Words of a rule that are no keywords.
PLAIN_WORDS = ("never", "always", "with", "from", "that", "this", "have", "para", "siempre", "rule", "standard", "cents", "price", "prices")


def _same_file(path: Column, rule_path: Column) -> Column:
    """Whether one path holds the other or both end in the same name; no path matches all."""
    def plain(p: Column) -> Column:
        return F.lower(F.replace(F.coalesce(p, F.lit("")), F.lit("\\"), F.lit("/")))

    a, b = plain(path), plain(rule_path)
    name = r"[^/]+$"
    named = (F.regexp_extract(a, name, 0) != "") & (F.regexp_extract(a, name, 0) == F.regexp_extract(b, name, 0))
    return (a == "") | (b == "") | F.contains(a, b) | F.contains(b, a) | named


def code_drift(added: DataFrame, rules: DataFrame, whole_words: bool = False) -> DataFrame:
    """(rule_id, id, line_no): the first added line that breaks each convention; added: id, line_no, line.

    A line breaks a rule if it holds one of the rule's forbidden terms or, where a rule has
    none but an enforcing word, one of its keywords. Terms are found anywhere in a line, or
    as whole words only. Where both tables have a ``path``, rules meet lines of their file."""
    low = F.lower("content")
    terms = text.prohibited_terms(F.col("content"))
    keyword = F.filter(F.split(low, r"[^\p{L}\p{N}_]+"), lambda w: (F.octet_length(w) >= 3) & ~w.isin(*PLAIN_WORDS))
    sought = F.when(F.size(terms) > 0, terms).when(low.rlike(ENFORCING), keyword)
    paths = "path" in added.columns and "path" in rules.columns
    asked = rules.select(F.col("id").alias("rule_id"), F.array_distinct(sought).alias("terms"), *([F.col("path").alias("rule_path")] if paths else []))
    lines = added.withColumn("__low", F.lower("line"))
    if whole_words:
        words = F.regexp_extract_all("__low", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        meets = F.arrays_overlap(words, F.col("terms"))
    else:
        meets = F.exists("terms", lambda t: F.contains(F.col("__low"), t))
    if paths:
        meets = meets & _same_file(F.col("path"), F.col("rule_path"))
    hits = lines.crossJoin(asked.where("size(terms) > 0").coalesce(1)).where(meets)  # one part of rules: lines are read once
    return hits.groupBy("rule_id").agg(F.min(F.struct("id", "line_no")).alias("at")).select("rule_id", "at.id", "at.line_no")


def learned_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, name, kind, confidence): symbols added, removed or moved between two snapshots (path, name, line, length)."""
    joined = before.alias("b").join(after.alias("a"), ["path", "name"], "full_outer")
    moved = F.abs(F.col("a.line") - F.col("b.line"))
    kind = F.when(F.col("b.line").isNull(), "lesson").when(F.col("a.line").isNull(), "decision").when(moved > 0, "convention")
    share = F.least(F.lit(1.0), moved / F.greatest(F.col("a.length"), F.lit(1)))
    confidence = F.when(F.col("b.line").isNull(), 0.92).when(F.col("a.line").isNull(), 0.88).otherwise(F.round(0.65 + 0.30 * share, 6))
    return joined.select("path", "name", kind.alias("kind"), confidence.alias("confidence")).where("kind is not null")


def union_projects(projects: dict[str, DataFrame]) -> DataFrame:
    """Rows of several projects with the project's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("project", F.lit(p)) for p, df in projects.items()])


def first_mentions(rows: DataFrame) -> DataFrame:
    """(id, content, topic, confidence): the first row of each content (case ignored), in id order,
    0.95 falling by 0.05 a place to 0.60."""
    firsts = rows.groupBy(F.lower(F.trim("content")).alias("k")).agg(F.min("id").alias("id"), F.min_by("content", "id").alias("content"))
    confidence = F.round(F.greatest(F.lit(0.60), 0.95 - 0.05 * (F.col("place") - 1)), 2)
    return with_place(firsts, "id").select("id", "content", text.topic_of(F.col("content")).alias("topic"), confidence.alias("confidence"))
