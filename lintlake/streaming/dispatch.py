"""A queue with one task at work at a time: arrivals come as micro-batches, the state is a table with one writer."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lintlake.operators import queue, state

_VERSION = "batch={:020d}"


def _versions(spark: SparkSession, path: str) -> list[str]:
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.exists(root):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(root)]
    done = [n for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The state after the last finished batch."""
    done = _versions(spark, path)
    return spark.read.parquet(os.path.join(path, done[-1])) if done else None


def step(path: str):
    """For foreachBatch: merges the batch into the state and starts the next task.

    A batch writes the version of its own number from the version before it, so giving it twice changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < _VERSION.format(number)]
        if before:
            old = spark.read.parquet(os.path.join(path, before[-1]))
            tasks = state.upserted(old, batch.select(*old.columns), "id", "updated_at")
        else:
            tasks = state.upserted(batch.limit(0), batch, "id", "updated_at")  # ids may come twice in the first batch too
        out = queue.dispatched(tasks, queue.head(tasks))
        out.write.mode("overwrite").parquet(os.path.join(path, _VERSION.format(number)))

    return run
