"""The review queue as data: positions, the next task, and the state after dispatching or pinning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F



def order() -> list:
    return [F.col("queue_priority").desc(), F.col("created_at").asc(), F.col("id").asc()]


def positions(tasks: DataFrame) -> DataFrame:
    """(id, ahead): the number of queued tasks before each queued one, over all owners.

    A rank over one partition would not spread, so tasks are counted by priority and day first: the counts of the groups before a
    group are a small window, and the rank within a group is a partitioned one.
    """
    queued = tasks.where("status = 'queued'").select("id", "queue_priority", "created_at").withColumn("day", F.to_date("created_at"))
    groups = queued.groupBy("queue_priority", "day").agg(F.count("*").alias("n"))
    before = groups.select("queue_priority", "day", (F.sum("n").over(Window.orderBy(F.col("queue_priority").desc(), F.col("day").asc())) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("queue_priority", "day").orderBy(F.col("created_at").asc(), F.col("id").asc())) - 1
    return queued.join(before, ["queue_priority", "day"]).select("id", (F.col("before") + within).cast("long").alias("ahead"))


def with_positions(tasks: DataFrame) -> DataFrame:
    """Every task with `ahead`, null unless it is queued."""
    return tasks.join(positions(tasks), "id", "left")


def busy(tasks: DataFrame) -> DataFrame:
    """One row, `busy`: whether any task is running."""
    return tasks.where("status = 'running'").limit(1).agg((F.count("*") > 0).alias("busy"))


def progress(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(id, state, current, remaining) of tasks(id, status, progress, input_mode, display_name, file_count) and files(task_id, relative_path, pos).

    A running task is at the file that its progress points to, never beyond the last one; others are at the first.  Texts count
    as one file.  The files of one task are bounded by the limits of a submission.
    """
    of = files.groupBy(F.col("task_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "relative_path"))).alias("files"))
    t = tasks.join(of, "id", "left")
    text_mode = F.col("input_mode") == "text"
    total = F.greatest(F.col("file_count"), F.coalesce(F.size("files"), F.lit(0)), F.when(text_mode, 1).otherwise(0))
    done = F.when(F.col("status") == "running", F.least(F.floor(F.col("progress") / 100.0 * total), F.greatest(F.lit(0), total - 1))).otherwise(0).cast("int")
    ended, failed, queued = (F.col("status") == s for s in ("completed", "failed", "queued"))
    current = F.when(ended, None).when(text_mode, "snippet").otherwise(F.coalesce(F.nullif(F.get("files", done)["relative_path"], F.lit("")), F.col("display_name")))
    rest = F.when(ended, 0).when(failed, F.greatest(F.lit(0), total - done)).when(queued, total).otherwise(F.greatest(F.lit(0), total - done - 1)).cast("int")
    return t.select("id", F.when(ended | failed, F.col("status")).when(queued, "pending").otherwise("analyzing").alias("state"), current.alias("current"), rest.alias("remaining"))


def head(tasks: DataFrame) -> DataFrame:
    """The queued task that comes first, none while another one is running."""
    running = tasks.where("status = 'running'").select(F.lit(1).alias("busy")).limit(1)
    return tasks.where("status = 'queued'").orderBy(*order()).limit(1).join(running, how="left_anti")


def dispatched(tasks: DataFrame, first: DataFrame) -> DataFrame:
    """The tasks after the first one has been started."""
    chosen = F.broadcast(first.select("id", F.lit(True).alias("chosen")))  # one row at most
    out = tasks.join(chosen, "id", "left")
    go = F.coalesce("chosen", F.lit(False))
    return out.withColumn("status", F.when(go, "running").otherwise(F.col("status"))).withColumn("progress", F.when(go, F.greatest("progress", F.lit(1))).otherwise(F.col("progress"))).drop("chosen")


def pinned(tasks: DataFrame, task_id) -> DataFrame:
    """The tasks after one queued task has been given the highest priority."""
    top = F.broadcast(tasks.agg((F.coalesce(F.max("queue_priority"), F.lit(0)) + 1).alias("top")))  # one row
    move = (F.col("id") == task_id) & (F.col("status") == "queued")
    return tasks.crossJoin(top).withColumn("queue_priority", F.when(move, F.col("top")).otherwise(F.col("queue_priority"))).drop("top")
