"""Following tasks until none is at work: every change of the state table is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

ACTIVE = ("queued", "running")


def counts(tasks: DataFrame) -> dict[str, int]:
    """How many tasks are at work, by status: two rows at most reach the driver."""
    found = {r.status: r.n for r in tasks.where(F.col("status").isin(*ACTIVE)).groupBy("status").agg(F.count("*").alias("n")).collect()}
    return {s: found.get(s, 0) for s in ACTIVE}


def follow(changes: DataFrame, state: Callable[[], DataFrame], report: Callable[[dict[str, int]], None], checkpoint: str, poll: str = "1400 milliseconds") -> StreamingQuery:
    """Calls report(counts) after every batch of changes; the query stops itself once the state holds no task at work.

    The state is read anew each time, so a batch that is given twice reports the same.
    """
    holder: list[StreamingQuery] = []

    def each(batch: DataFrame, _: int) -> None:
        now = counts(state())
        report(now)
        if not any(now.values()) and holder:
            holder[0].stop()

    query = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=poll).start()
    holder.append(query)
    return query
