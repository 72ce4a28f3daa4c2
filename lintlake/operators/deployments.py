"""Deployments of models: their catalog entry, their node, and which nodes are shown for use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions import text

# Fixed values of the data model.
ACTIVE = ("queued", "running")
LOCAL = "http://127.0.0.1:"


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def active(deployments: DataFrame) -> DataFrame:
    return deployments.where(F.col("status").isin(*ACTIVE))


def with_node(deployments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each deployment with the name of its node; the key may be null."""
    names = nodes.select(F.col("id").alias("model_node_id"), F.col("display_name").alias("node_name"))
    return deployments.join(names, "model_node_id", "left")


def resolved(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requests with what they leave open taken from the catalog, and `error` where that fails.

    requests(id, catalog_key, display_name, model_identifier, served_model_name, source, source_repository, model_dir, port, base_url),
    catalog as read: an empty text and a port of 0 count as missing.
    """
    known = catalog.select(F.col("key").alias("catalog_key"), *[F.col(c).alias(f"c_{c}") for c in ("display_name", "model_identifier", "served_model_name", "hf_repo", "ms_repo", "port")])
    df = requests.withColumn("catalog_key", _first(F.col("catalog_key"))).join(known, "catalog_key", "left")
    c = F.col
    have = c("c_model_identifier").isNotNull()
    name, model = _first(c("display_name"), c("c_display_name")), _first(c("model_identifier"), c("c_model_identifier"))
    served = F.coalesce(_first(c("served_model_name")), F.when(have, c("c_served_model_name")).otherwise(F.element_at(F.split(model, "/"), -1)))
    of_source = F.when(c("source") == "modelscope", _first(c("c_ms_repo"), c("c_model_identifier"))).when(c("source") == "huggingface", _first(c("c_hf_repo"), c("c_model_identifier"))).when(c("source") == "local", _first(c("model_dir"), c("c_model_identifier"))).otherwise(c("c_model_identifier"))
    repository = F.coalesce(_first(c("source_repository")), F.when(have, of_source))
    port = F.coalesce(F.nullif(c("port"), F.lit(0)), F.nullif(c("c_port"), F.lit(0)))
    url = F.coalesce(_first(c("base_url")), F.concat(F.lit(LOCAL), port.cast("string")))
    error = F.when(c("catalog_key").isNotNull() & ~have, "catalog model not found").when(name.isNull() | model.isNull(), "name and model are required").when(repository.isNull(), "source repository is required").when(url.isNull(), "url or port is required")
    return df.select("id", "catalog_key", name.alias("display_name"), model.alias("model_identifier"), served.alias("served_model_name"), repository.alias("source_repository"), port.alias("port"), url.alias("base_url"), error.alias("error"))


def shown(nodes: DataFrame, deployments: DataFrame) -> DataFrame:
    """Enabled nodes that are the default or have a deployment that succeeded; the caller sorts by `is_default` downwards, then by name."""
    done = deployments.where("status = 'succeeded' AND model_node_id IS NOT NULL").select(F.col("model_node_id").alias("id"), F.lit(True).alias("deployed")).distinct()
    out = nodes.where(F.col("is_enabled").eqNullSafe(True)).join(done, "id", "left")
    return out.where(F.coalesce("is_default", F.lit(False)) | F.col("deployed").isNotNull()).drop("deployed")


def finished(deployments: DataFrame, ends: DataFrame) -> DataFrame:
    """Deployments after ends(id, code, output): the tail of the output joins the log, code 0 succeeds."""
    e = ends.select("id", "code", "output")
    out = deployments.join(e, "id", "left")
    ran = F.col("code").isNotNull()
    line = F.coalesce(F.nullif(text.tail(F.col("output")), F.lit("")), F.lit("Deployment script finished."))
    log = F.when(F.coalesce("log", F.lit("")) == "", line).otherwise(F.concat(F.regexp_replace("log", r"\s+$", ""), F.lit("\n"), line))
    return out.select(
        *[c for c in deployments.columns if c not in ("status", "progress", "log", "error_message")],
        F.when(~ran, F.col("status")).when(F.col("code") == 0, "succeeded").otherwise("failed").alias("status"),
        F.when(ran, 100).otherwise(F.col("progress")).alias("progress"),
        F.when(ran, log).otherwise(F.col("log")).alias("log"),
        F.when(~ran, F.col("error_message")).when(F.col("code") != 0, F.concat(F.lit("deployment script exited with "), F.col("code").cast("string"))).alias("error_message"),
    )


def switched(nodes: DataFrame, node_id: Column) -> DataFrame:
    """The nodes after one of them has been deployed: it alone is enabled and the default; without it nothing changes."""
    other = F.col("id") != node_id
    return nodes.withColumn("is_enabled", ~other).withColumn("is_default", ~other)


def node_metrics(snapshots: DataFrame, node_id: str) -> DataFrame:
    """(captured_at, model) of snapshots(captured_at, models ARRAY): the first entry of one node in each, where there is one."""
    one = F.get(F.filter("models", lambda m: m.node_id == node_id), F.lit(0))
    return snapshots.select("captured_at", one.alias("model")).where("model IS NOT NULL")
