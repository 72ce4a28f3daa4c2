"""Roll-ups for the dashboard: one pass each, missing groups as zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STATUSES = ["queued", "running", "completed", "failed"]


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("status").agg(F.count("*").alias("tasks"))


def overview(tasks: DataFrame, users: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: tasks by status, users and nodes with those that are enabled."""
    t = tasks.agg(F.count("*").alias("tasks"), *[F.count_if(F.col("status") == s).alias(f"{s}_tasks") for s in STATUSES])
    u = users.agg(F.count("*").alias("users"), F.count_if(F.col("is_enabled").eqNullSafe(True)).alias("enabled_users"))
    n = nodes.agg(F.count("*").alias("models"), F.count_if(F.col("is_enabled").eqNullSafe(True)).alias("enabled_models"))
    return t.crossJoin(F.broadcast(u)).crossJoin(F.broadcast(n))  # one row each


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return F.when(whole > 0, F.round(100.0 * part / whole, places))


def recent(tasks: DataFrame, n: int = 6) -> DataFrame:
    """Counts over the latest n tasks only."""
    last = tasks.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)
    return last.agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum("finding_count").cast("long").alias("findings"), F.sum("file_count").cast("long").alias("files"))
