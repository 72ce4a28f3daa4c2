"""Operational metrics: text samples to numbers, counters to rates, sliding peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sample(text: Column, *names: str) -> Column:
    """The first plain decimal sample of the first of these names that has one (the form of a sample line is a fixed value)."""
    hits = [F.regexp_extract(text, rf"(?m)^{n}(?:\{{[^}}]*\}})?\s+([-+]?\d+(?:\.\d+)?)$", 1).try_cast("double") for n in names]
    return F.coalesce(*hits)


def percentage(x: Column) -> Column:
    """A share between 0 and 1 as a percentage; what is larger is one already."""
    return F.when((x >= 0) & (x <= 1), F.round(x * 100, 2)).otherwise(F.round(x, 2))


def number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def rates(samples: DataFrame, group: str, time: str, counter: str, *ties: str) -> DataFrame:
    """Adds `rate`: the growth of the counter a second since the sample before, never negative; `ties` order samples of one time."""
    w = Window.partitionBy(group).orderBy(time, *ties)
    seconds = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))) / 1e6
    grown = F.round((F.col(counter) - F.lag(counter).over(w)) / F.greatest(seconds, F.lit(0.001)), 2)
    return samples.withColumn("rate", F.when(grown.isNotNull(), F.greatest(F.lit(0.0), grown)))  # the first sample has none


def peaks(samples: DataFrame, group: str, time: str, value: str, minutes: int = 30) -> DataFrame:
    """Adds `peak`: the greatest value of the last minutes, empty and infinite ones left out."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    w = Window.partitionBy(group).orderBy(at).rangeBetween(-minutes * 60 * 1_000_000, 0)
    v = F.col(value)
    return samples.withColumn("peak", F.max(F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v)).over(w))


def cpu(samples: DataFrame, host: str, time: str, line: str) -> DataFrame:
    """(host, time, percent) from the first lines of /proc/stat: the share of time that was not idle since the sample before."""
    fields = F.transform(F.slice(F.split(F.trim(F.col(line)), r"\s+"), 2, 20), lambda x: x.try_cast("long"))
    df = samples.where(F.col(line).startswith("cpu ")).select(host, time, F.aggregate(fields, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (F.get(fields, F.lit(3)) + F.coalesce(F.get(fields, F.lit(4)), F.lit(0))).alias("idle"))
    w = Window.partitionBy(host).orderBy(time)
    total, idle = F.col("total") - F.lag("total").over(w), F.col("idle") - F.lag("idle").over(w)
    busy = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - idle / total) * 100)), 2)
    return df.select(host, time, F.when(total > 0, busy).alias("percent"))


def memory(text: Column) -> list[Column]:
    """Total, used and percentage from the text of /proc/meminfo."""
    total, free = (F.regexp_extract(text, rf"(?m)^{k}:\s+(\d+)", 1).try_cast("long") * 1024 for k in ("MemTotal", "MemAvailable"))
    used = F.when(total > 0, total - free)
    return [total.alias("memory_total_bytes"), used.alias("memory_used_bytes"), F.round(100.0 * used / total, 2).alias("memory_percent")]


def gpus(lines: DataFrame, column: str) -> DataFrame:
    """Seven comma-separated fields a line; shorter lines are dropped."""
    parts = F.transform(F.split(column, ","), lambda x: F.trim(x))
    df = lines.select(parts.alias("p")).where(F.size("p") >= 7)
    n = lambda i: F.get("p", F.lit(i)).try_cast("double")
    share = F.when(n(4) > 0, F.round(100.0 * n(3) / n(4), 2))
    return df.select(n(0).cast("int").alias("index"), F.get("p", F.lit(1)).alias("name"), n(2).alias("utilization_percent"), n(3).alias("memory_used_mb"), n(4).alias("memory_total_mb"), share.alias("memory_percent"), n(5).alias("temperature_c"), n(6).alias("power_w"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, never negative; null where one of them is missing."""
    us = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(us.isNotNull(), F.greatest(F.lit(0), F.floor(us / 1000).cast("long")))


def window_minutes(samples: DataFrame, group: str, time: str) -> DataFrame:
    """(group, minutes): whole minutes from the first to the last sample, half a minute rounded up."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    return samples.groupBy(group).agg(F.greatest(F.lit(0), F.floor((F.max(at) - F.min(at)) / 60_000_000 + 0.5).cast("long")).alias("minutes"))


def node_rows(scrapes: DataFrame) -> DataFrame:
    """One runtime row for each node from scrapes(node_id, display_name, base_url, captured_at, body, error).

    The newest scrape of a node tells; where it has no throughput of its own, the growth of the token counter since the scrape
    before gives it.  A failed scrape gives a row without values and the first 300 characters of the error.
    """
    w = Window.partitionBy("node_id").orderBy("captured_at", F.xxhash64("body", "error"))
    body, before = F.col("body"), F.lag("body").over(w)
    seconds = (F.unix_micros(F.col("captured_at").cast("timestamp")) - F.unix_micros(F.lag("captured_at").over(w).cast("timestamp"))) / 1e6
    last = F.row_number().over(Window.partitionBy("node_id").orderBy(F.col("captured_at").desc(), F.xxhash64("body", "error").desc()))
    narrow = scrapes.select("node_id", "display_name", "base_url", "captured_at", "body", "error").withColumn("before", before).withColumn("seconds", F.greatest(seconds, F.lit(0.001)))
    newest = narrow.withColumn("_n", last).where("_n = 1")

    def named(text: Column, name: str) -> Column:
        return sample(text, *[f"vllm{sign}{name}" for sign in (":", "_")])

    def throughput(kind: str) -> Column:
        grown = F.round((named(body, f"{kind}_tokens_total") - named(F.col("before"), f"{kind}_tokens_total")) / F.col("seconds"), 2)
        return F.coalesce(named(body, f"avg_{kind}_throughput_toks_per_s"), F.when(grown.isNotNull(), F.greatest(F.lit(0.0), grown))).alias(f"{kind}_throughput_tps")

    ok = F.col("error").isNull() & body.isNotNull()
    rows = {
        "prompt_throughput_tps": throughput("prompt"),
        "generation_throughput_tps": throughput("generation"),
        "running_requests": named(body, "num_requests_running").cast("int"),
        "pending_requests": named(body, "num_requests_waiting").cast("int"),
        "gpu_kv_cache_usage_percent": percentage(named(body, "gpu_cache_usage_perc")),
    }
    return newest.select("node_id", "display_name", "base_url", ok.alias("metrics_available"), F.when(~ok, F.left(F.coalesce("error", F.lit("")), F.lit(300))).alias("error"), *[F.when(ok, c).alias(k) for k, c in rows.items()])
