"""The registry of projects, their links and settings, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Lower case, forward slashes, none at the end."""
    return F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), "(.)/+$", "$1")


def registered(projects: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Projects (id, name, path, status, last_opened) with new ones (name, path) asleep.

    A name or path that is taken, by a stored project or an earlier new one, isn't registered;
    of new rows that clash, the first by name stays."""
    taken = projects.select(F.col("name"), normal_path(F.col("path")).alias("norm"))
    rows = new.select("name", "path", normal_path(F.col("path")).alias("norm"))
    rows = rows.groupBy("name").agg(F.min_by("path", "norm").alias("path"), F.min("norm").alias("norm"))
    rows = rows.groupBy("norm").agg(F.min("name").alias("name"), F.min_by("path", "name").alias("path"))
    rows = rows.join(taken.select("name"), "name", "left_anti").join(taken.select("norm"), "norm", "left_anti")
    top = projects.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    from quern.ordering import with_place

    numbered = with_place(rows.select("name", "path"), "name").crossJoin(F.broadcast(top))  # one row
    fresh = numbered.select((F.col("top") + F.col("place")).alias("id"), "name", "path", F.lit("SLEEPING").alias("status"), at.alias("last_opened"))
    return projects.select("id", "name", "path", "status", "last_opened").unionByName(fresh)


def deregistered(projects: DataFrame, names: DataFrame) -> DataFrame:
    return projects.join(names.select("name").distinct(), "name", "left_anti").select(*projects.columns)


def woken(projects: DataFrame, names: DataFrame, at: Column, status: str = "ACTIVE") -> DataFrame:
    """Projects after some (column name) wake, or take another status; waking is opening."""
    hit = names.select("name").distinct().withColumn("__hit", F.lit(True))
    rows = projects.join(hit, "name", "left")
    opened = F.when(F.col("__hit") & F.lit(status == "ACTIVE"), at).otherwise(F.col("last_opened"))
    return rows.withColumns({"status": F.when(F.col("__hit"), status).otherwise(F.col("status")), "last_opened": opened}).select(*projects.columns)


def _resolved(projects: DataFrame, wanted: DataFrame, column: str, out: str) -> DataFrame:
    """``wanted`` with the id of the project that a name, else a path, means; others go."""
    by_name = projects.select(F.col("name").alias(column), F.col("id").alias("__by_name"))
    by_path = projects.select(normal_path(F.col("path")).alias("__path"), F.col("id").alias("__by_path"))
    rows = wanted.join(by_name, column, "left").withColumn("__path", normal_path(F.col(column))).join(by_path, "__path", "left")
    return rows.withColumn(out, F.coalesce("__by_name", "__by_path")).where(F.col(out).isNotNull()).drop("__by_name", "__by_path", "__path")


def linked(projects: DataFrame, links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (source_id, target_id, relation) with new ones (source, target, relation), whose ends
    are names or paths; known links and unknown projects change nothing."""
    ends = _resolved(projects, _resolved(projects, new, "source", "source_id"), "target", "target_id")
    return links.select("source_id", "target_id", "relation").unionByName(ends.select("source_id", "target_id", "relation")).distinct()


def unlinked(projects: DataFrame, links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links without any between the given ends (source, target)."""
    ends = _resolved(projects, _resolved(projects, gone, "source", "source_id"), "target", "target_id")
    return links.join(ends.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti").select("source_id", "target_id", "relation")


def link_names(projects: DataFrame, links: DataFrame) -> DataFrame:
    """(source, target, relation): all links by the names of both ends."""
    a, b = projects.select(F.col("id").alias("source_id"), F.col("name").alias("source")), projects.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    return links.join(a, "source_id").join(b, "target_id").select("source", "target", "relation")


def configured(config: DataFrame, values: DataFrame) -> DataFrame:
    """Settings (key, value) with new values in place of old ones."""
    return config.join(values.select("key"), "key", "left_anti").unionByName(values.select("key", "value"))
