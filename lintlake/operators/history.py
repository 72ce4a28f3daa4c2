"""Task history: composed filters, conditional joins, whitelisted sort, total and page.

A join is only made where a filter or the sort order needs it, and the filtered frame carries no text column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from lintlake.schemas import SEVERITIES

SORTS = ("display_name", "tester_name", "model", "status", "file_count", "finding_count", "duration_ms", "created_at")


@dataclass(frozen=True)
class Filters:
    keyword: str | None = None
    tester: str | None = None
    status: str | None = None
    model_node_id: str | None = None
    severity: str | None = None
    start: str | None = None
    end: str | None = None
    owner_id: str | None = None
    case_insensitive: bool = False


def visible(tasks: DataFrame, viewer: DataFrame) -> DataFrame:
    """Row-level security for viewer(id, role), one row: an administrator sees all tasks, anybody else their own, nobody none."""
    who = F.broadcast(viewer.select(F.col("id").alias("_me"), (F.lower("role") == "admin").alias("_all")).limit(1))  # one row
    return tasks.join(who, F.col("_all") | (F.col("owner_id") == F.col("_me")), "left_semi")


def unchanging(tasks: DataFrame, f: Filters) -> DataFrame:
    """The filters on columns that never change, which can therefore come before the newest row of a task is chosen."""
    out = tasks
    if f.owner_id:
        out = out.where(F.col("owner_id") == f.owner_id)
    if f.start:
        out = out.where(F.col("created_at") >= F.lit(f.start).cast("timestamp_ntz"))
    if f.end:
        out = out.where(F.col("created_at") <= F.lit(f.end).cast("timestamp_ntz"))
    return out


def _like(column: str, keyword: str, ci: bool):
    """Substring with the wildcards of LIKE left alive, as in the original interface."""
    return (F.col(column).ilike if ci else F.col(column).like)(f"%{keyword}%")


def filtered(tasks: DataFrame, users: DataFrame, reports: DataFrame, f: Filters) -> DataFrame:
    out = unchanging(tasks, f)
    if f.keyword:
        out = out.where(_like("display_name", f.keyword, f.case_insensitive))
    if f.status:
        out = out.where(F.col("status") == f.status)
    if f.model_node_id:
        out = out.where(F.col("model_node_id") == f.model_node_id)
    if f.tester:
        owners = users.where(_like("username", f.tester, f.case_insensitive)).select(F.col("id").alias("owner_id"))
        out = out.join(owners, "owner_id", "left_semi")
    if f.severity:
        if f.severity not in SEVERITIES:
            raise ValueError(f"unknown severity: {f.severity}")
        hit = reports.where(F.col(f"{f.severity}_count") > 0).select(F.col("task_id").alias("id"))
        out = out.join(hit, "id", "left_semi")  # one report a task, so the semi join equals the inner join
    return out


def ordered(tasks: DataFrame, users: DataFrame, nodes: DataFrame, sort: str = "created_at", descending: bool = True) -> tuple[DataFrame, list]:
    """The frame with its sort key and the order: the key, then the id from high to low."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort column: {sort}")
    out = tasks
    if sort == "tester_name":
        out = out.join(users.select(F.col("id").alias("owner_id"), F.col("username").alias("tester_name")), "owner_id")
    if sort == "model":
        out = out.join(nodes.select(F.col("id").alias("model_node_id"), F.col("display_name").alias("model")), "model_node_id")
    key = F.col(sort)
    return out, [key.desc_nulls_last() if descending else key.asc_nulls_first(), F.col("id").desc()]


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 20) -> DataFrame:
    if offset < 0 or not 1 <= limit <= 100:
        raise ValueError("offset must be 0 or more, limit between 1 and 100")
    return df.orderBy(*order).offset(offset).limit(limit)
