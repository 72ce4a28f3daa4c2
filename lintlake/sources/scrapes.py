"""Scrapes of metrics as files: node=<id, URL-encoded>/<milliseconds>.prom, or .error with the message of a scrape that failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, captured_at, body, error) of all scrapes below path; other files are left out."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{prom,error}").text(path)
    name = F.regexp_extract(F.input_file_name(), r"node=([^/]+)/(\d+)\.(prom|error)$", 0)
    df = raw.select(name.alias("name"), "value").where("name <> ''")
    part = lambda k: F.regexp_extract("name", r"node=([^/]+)/(\d+)\.(prom|error)$", k)
    failed = part(3) == "error"
    return df.select(F.url_decode(F.url_decode(part(1))).alias("node_id"), F.timestamp_millis(part(2).cast("long")).alias("captured_at"), F.when(~failed, F.col("value")).alias("body"), F.when(failed, F.col("value")).alias("error"))


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: each scrape is a new file."""
    raw = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{prom,error}").text(path)
    part = lambda k: F.regexp_extract(F.input_file_name(), r"node=([^/]+)/(\d+)\.(prom|error)$", k)
    df = raw.select(part(1).alias("node_id"), part(2).alias("at"), part(3).alias("kind"), "value").where("node_id <> ''")
    return df.select(F.url_decode(F.url_decode("node_id")).alias("node_id"), F.timestamp_millis(F.col("at").cast("long")).alias("captured_at"), F.when(F.col("kind") == "prom", F.col("value")).alias("body"), F.when(F.col("kind") == "error", F.col("value")).alias("error"))
