"""A task's run as a fold over its attempts: the state after them, its log, and the requests that a run is made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions import text

# Fixed values of the state machine.
STARTED, STEP, RETRY_TOP, CHUNK_SHARE, CHUNK_TOP = 10, 25, 90, 85, 95
MESSAGE = 1000
LEAST_CHUNK = 1000


def chunk_progress(current: Column, done: Column, total: Column) -> Column:
    """Progress after `done` of `total` chunks; it never falls, and without chunks it stays."""
    reached = F.least(F.lit(CHUNK_TOP), STARTED + F.floor(done / total * CHUNK_SHARE))
    return F.when(total > 0, F.greatest(current, reached)).otherwise(current).cast("int")


def retry_progress(attempt: Column) -> Column:
    return F.least(F.lit(RETRY_TOP), STARTED + attempt * STEP).cast("int")


def applied(tasks: DataFrame, attempts: DataFrame, most: int) -> DataFrame:
    """(id, status, progress, finding_count, error_message, attempts, model_log) of each task after its attempts.

    attempts(task_id, attempt, at, succeeded, findings, message, audit): `at` is the stamp of its end, `audit` tells that the answer
    was read but broke the contract.  The first success ends the run, as does attempt `most`; later attempts count for nothing.
    An attempt given twice counts once.  A task without an attempt keeps what it has.  A run has at most `most` attempts, so the fold
    over one task is a bounded array.
    """
    usable = attempts.where((F.col("attempt") >= 1) & (F.col("attempt") <= most)).dropDuplicates(["task_id", "attempt"])
    each = F.struct("attempt", "at", "succeeded", "findings", "message", "audit")
    runs = usable.groupBy("task_id").agg(F.array_sort(F.collect_list(each)).alias("all"), F.min(F.when(F.col("succeeded"), F.col("attempt"))).alias("won"))
    runs = runs.withColumn("run", F.filter("all", lambda a: a.attempt <= F.coalesce(F.col("won"), F.lit(most)))).withColumn("last", F.element_at("run", -1))
    log = F.aggregate("run", F.lit(None).cast("string"), lambda acc, a: text.appended(text.appended(acc, a["at"], F.concat(F.lit("Attempt "), a.attempt.cast("string"), F.lit(" started."))), a["at"], _outcome(a)))
    over = F.col("last.attempt") >= most
    failed = F.when(F.col("last.audit") & over, f"model output audit failed after {most} attempts").otherwise(F.left(F.coalesce("last.message", F.lit("")), F.lit(MESSAGE)))
    retrying = F.left(F.concat(F.coalesce("last.message", F.lit("")), F.lit("; retrying ("), F.col("last.attempt").cast("string"), F.lit(f"/{most})")), F.lit(MESSAGE))
    won = F.col("won").isNotNull()
    ended = runs.select(
        F.col("task_id").alias("id"),
        F.when(won, "completed").when(over, "failed").otherwise("running").alias("status"),
        F.when(won | over, 100).otherwise(retry_progress(F.col("last.attempt"))).alias("progress"),
        F.when(won, F.col("last.findings")).otherwise(0).alias("finding_count"),
        F.when(won, None).when(over, failed).otherwise(retrying).alias("error_message"),
        F.size("run").alias("attempts"),
        log.alias("model_log"),
    )
    old = tasks.select("id", *[F.col(c).alias(f"old_{c}") for c in ("status", "progress", "finding_count", "error_message", "model_log")])
    ran = F.col("attempts").isNotNull()
    keep = lambda c: F.when(ran, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    return old.join(ended, "id", "left").select("id", keep("status"), keep("progress"), keep("finding_count"), keep("error_message"), F.coalesce("attempts", F.lit(0)).alias("attempts"), keep("model_log"))


def _outcome(a: Column) -> Column:
    n = a.attempt.cast("string")
    good = F.concat(F.lit("Attempt "), n, F.lit(" succeeded with "), F.coalesce(a.findings, F.lit(0)).cast("string"), F.lit(" finding(s)."))
    return F.when(a.succeeded, good).otherwise(F.concat(F.lit("Attempt "), n, F.lit(" failed: "), F.coalesce(a.message, F.lit(""))))


def shrunk(budget: Column, tries: Column) -> Column:
    """The chunk budget after so many context errors, each of which halves it; null where it would fall under the least budget."""
    left = F.floor(budget / F.pow(F.lit(2.0), tries)).cast("int")
    return F.when((tries <= 0) | (left >= LEAST_CHUNK) & (left < budget), F.when(tries <= 0, budget).otherwise(left))


def fan_out(batches: DataFrame, call: Callable[[list[dict]], list[str]], index: str = "batch", width: int = 4) -> DataFrame:
    """The batches with `answer`, worked on `width` at a time in any order; the index tells the order again.

    `call` takes the rows of an Arrow batch and gives one answer a row.  Partitions are the bound on what runs at once.
    """
    schema = batches.schema.add("answer", "string")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(call(b.to_pylist()), pa.string())], [*b.schema.names, "answer"])

    return batches.repartition(width, index).mapInArrow(run, schema)
