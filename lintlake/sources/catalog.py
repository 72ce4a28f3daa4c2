"""The catalog of models: one JSON array in a file, with defaults; without the file there are no models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

SCHEMA = "key string, display_name string, model_identifier string, served_model_name string, hf_repo string, ms_repo string, port int, description string"


def read(spark: SparkSession, path: str) -> DataFrame:
    try:
        df = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
        df.schema  # noqa: B018
    except AnalysisException:
        df = spark.createDataFrame([], SCHEMA)
    first = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    return df.where("key IS NOT NULL").select("key", first("display_name", "key").alias("display_name"), first("model_identifier", "key").alias("model_identifier"), first("served_model_name", "model_identifier", "key").alias("served_model_name"), "hf_repo", "ms_repo", F.coalesce("port", F.lit(8000)).alias("port"), "description")


def deployed(catalog: DataFrame, nodes: DataFrame) -> DataFrame:
    """Catalog entries with an enabled node under any of their names: names are exploded, so the OR becomes an equi join."""
    names = F.array_distinct(F.array_compact(F.array("key", "model_identifier", "served_model_name", "hf_repo", "ms_repo")))
    ids = catalog.select("key", F.explode(names).alias("name"))
    have = nodes.where(F.col("is_enabled").eqNullSafe(True)).select(F.explode(F.array("model_identifier", "display_name")).alias("name"))
    return catalog.join(ids.join(have, "name", "left_semi").select("key"), "key", "left_semi")
