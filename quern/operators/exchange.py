"""Patterns that pass between projects: cleaned, signed, inspected, judged by their use.

Patterns have pattern_id, title, category, description, rules (an array) and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scores, text

#: What an instruction hidden in a text looks like, and what it is called.
POISONING = (
    (r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior)\s+(?:instructions|prompts|context|rules)\b", "context_override"),
    (r"(?i)\b(?:system\s+override|admin\s+override|jailbreak|developer\s+mode|unrestricted\s+mode)\b", "privilege_escalation"),
    (r"(?i)\b(?:bypass|disable|suppress)\s+(?:all\s+)?(?:security|validation|linter|critic|guards)\b", "barrier_suppression"),
    (r"(?i)\b(?:curl|wget)\s+[^\n|]+\|\s*(?:sh|bash|python|powershell)\b", "shell_pipeline"),
    (r"(?i)\b(?:eval|exec|os\.system|subprocess\.Popen)\s*\(", "code_execution"),
    (r"(?i)<script[\s>]", "script_tag"),
)
HIGH_ENTROPY = "[REDACTED_HIGH_ENTROPY_TOKEN]"


def poisoning(value: Column) -> Column:
    """Names of the kinds of hidden instruction that a text shows."""
    return F.filter(F.array(*[F.when(value.rlike(p), name) for p, name in POISONING]), lambda x: x.isNotNull())


def cleaned(value: Column) -> Column:
    """Secrets and home folders replaced, then tokens that are long and look random."""
    safe = text.redact(F.coalesce(value, F.lit("")))
    tokens = F.array_distinct(F.filter(F.split(safe, r"[\s,;='\"`()\[\]{}]+"), lambda t: text.looks_secret(t)))
    return F.aggregate(tokens, safe, lambda s, t: F.replace(s, t, F.lit(HIGH_ENTROPY)))


def signature(pattern_id: str = "pattern_id", category: str = "category", rules: str = "rules", source: str = "source") -> Column:
    """sha256 over id, category, rules as a JSON list and source. Rules beyond printable ASCII are
    taken as they are, not as escapes."""
    quoted = F.transform(F.col(rules), lambda r: F.concat(F.lit('"'), F.replace(F.replace(r, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    listed = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return F.sha2(F.concat_ws("|", F.trim(F.col(pattern_id)), F.trim(F.col(category)), listed, F.trim(F.col(source))), 256)


def exported(patterns: DataFrame) -> DataFrame:
    """Patterns with cleaned texts, the number of texts that were changed, and their signature."""
    rules = F.transform(F.coalesce("rules", F.array().cast("array<string>")), cleaned)
    changed = (cleaned(F.col("title")) != F.coalesce("title", F.lit(""))).cast("int") + (cleaned(F.col("description")) != F.coalesce("description", F.lit(""))).cast("int")
    touched = F.size(F.filter(F.arrays_zip(F.coalesce("rules", F.array().cast("array<string>")).alias("a"), rules.alias("b")), lambda x: x["a"] != x["b"]))
    rows = patterns.select("pattern_id", "category", "source", cleaned(F.col("title")).alias("title"), cleaned(F.col("description")).alias("description"), rules.alias("rules"), (changed + touched).alias("redacted"))
    return rows.withColumn("signature", signature())


def inspected(patterns: DataFrame) -> DataFrame:
    """(pattern_id, valid, kinds, safe): whether a signed pattern is as it was signed, and what its
    texts try; unsafe ones belong in quarantine."""
    body = F.concat(F.array("title", "description"), F.col("rules"))
    kinds = F.array_sort(F.array_distinct(F.flatten(F.transform(body, lambda t: poisoning(F.coalesce(t, F.lit("")))))))
    valid = F.coalesce(F.lower("signature") == signature(), F.lit(False))
    return patterns.select("pattern_id", valid.alias("valid"), kinds.alias("kinds"), (valid & (F.size(kinds) == 0)).alias("safe"))


def imported(patterns: DataFrame, project: str, category: str | None = None) -> DataFrame:
    """Safe patterns of other projects, of one category or all, as this project may take them."""
    rows = patterns.where(F.col("source") != project)
    rows = rows.where(F.col("category") == category) if category else rows
    return rows.join(inspected(rows).where("safe").select("pattern_id"), "pattern_id", "left_semi")


def reputations(patterns: DataFrame, feedback: DataFrame, least_trials: int = 3, least: float = 0.35) -> DataFrame:
    """(pattern_id, successes, failures, reputation, purged) after feedback (pattern_id, ok); an
    exported pattern starts with one success."""
    votes = feedback.groupBy("pattern_id").agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("bad"))
    rows = patterns.select("pattern_id").join(votes, "pattern_id", "left")
    good, bad = F.coalesce("ok", F.lit(0)) + 1, F.coalesce("bad", F.lit(0))
    mean = scores.beta_mean(good, bad)
    return rows.select("pattern_id", good.alias("successes"), bad.alias("failures"), F.round(mean, 4).alias("reputation"), ((good + bad >= least_trials) & (mean < least)).alias("purged"))
