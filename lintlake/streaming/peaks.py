"""Peaks over a sliding window of samples, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def peaks(samples: DataFrame, group: str, time: str, value: str, minutes: int = 30, slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(group, window, peak, samples) of a stream; rows later than the watermark are left out.

    Each row enters minutes/slide windows, so the slide is coarse here; the batch form gives the exact frame.
    """
    w = F.window(F.col(time), f"{minutes} minutes", slide)
    return samples.withWatermark(time, late).groupBy(group, w).agg(F.max(value).alias("peak"), F.count("*").alias("samples")).select(group, "window.start", "window.end", "peak", "samples")


def retained(samples: DataFrame, now: str, minutes: int = 30, most: int = 360, tie: str | None = None) -> DataFrame:
    """Batch: the last samples of a window before now, at most `most` of each group (the feature is this limit)."""
    from pyspark.sql import Window

    kept = samples.where(F.col("captured_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES"))
    n = F.row_number().over(Window.partitionBy("node_id").orderBy(F.col("captured_at").desc(), F.col(tie).desc() if tie else F.xxhash64(*[c for c, t in kept.dtypes if "map<" not in t])))
    return kept.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def retained_stream(samples: DataFrame, minutes: int = 30, most: int = 360, late: str = "10 minutes") -> DataFrame:
    """(node_id, captured_at, peak, samples) of a stream of (node_id, captured_at, value): after each batch the newest sample of a node,
    and the greatest value and number of the samples retained: those of the last minutes, at most `most` (the feature is this limit).

    The state of a node is the retained samples, so it is bounded; empty and infinite values count as samples without a value.
    """
    import math

    import pandas as pd

    def step(key, frames, state):  # type: ignore[no-untyped-def]
        kept = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            kept += zip(f["captured_at"].astype("int64").tolist(), (None if v is None or not math.isfinite(v) else float(v) for v in f["value"].tolist()), strict=True)
        kept.sort(key=lambda x: x[0])
        newest = kept[-1][0]
        unit = 10**9 if newest > 10**17 else 10**6  # nano- or microseconds
        kept = [x for x in kept if x[0] >= newest - minutes * 60 * unit][-most:]
        state.update(([t for t, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame({"node_id": [key[0]], "captured_at": [pd.Timestamp(newest, unit="ns" if unit == 10**9 else "us")], "peak": [max((v for _, v in kept if v is not None), default=None)], "samples": [len(kept)]})

    timed = samples.select("node_id", "captured_at", F.col("value").cast("double").alias("value")).withWatermark("captured_at", late)
    return timed.groupBy("node_id").applyInPandasWithState(step, "node_id string, captured_at timestamp, peak double, samples long", "times array<long>, values array<double>", "update", "NoTimeout")
