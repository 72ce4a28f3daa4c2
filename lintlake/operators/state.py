"""Changes of tables as functions from tables to tables: plain Parquet has no MERGE, so each returns the whole new state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Union by key, the newest version wins; of equal versions the new row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(version).desc(), F.col("_new").desc()))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def without(parent: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return parent.join(gone.select(key), key, "left_anti")


def cascaded(users: DataFrame, tasks: DataFrame, files: DataFrame, reports: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables after the users in gone(id) have been deleted with what belongs to them."""
    lost = tasks.join(gone.select(F.col("id").alias("owner_id")), "owner_id", "left_semi").select(F.col("id").alias("task_id"))
    return {
        "users": without(users, gone, "id"),
        "tasks": tasks.join(lost.select(F.col("task_id").alias("id")), "id", "left_anti"),
        "files": files.join(lost, "task_id", "left_anti"),
        "reports": reports.join(lost, "task_id", "left_anti"),
    }


def default_node(nodes: DataFrame) -> DataFrame:
    """Exactly one default: the one marked, or else the enabled node that was made first."""
    w = Window.orderBy(F.col("is_default").desc(), F.col("is_enabled").desc(), F.col("created_at").asc(), F.col("id").asc())
    return nodes.withColumn("_n", F.row_number().over(w)).withColumn("is_default", (F.col("_n") == 1) & F.col("is_enabled")).drop("_n")


def with_kinds(tasks: DataFrame) -> DataFrame:
    """Null check types become the empty list."""
    return tasks.withColumn("check_types", F.coalesce("check_types", F.array().cast("array<string>")))


def next_version(rows: DataFrame, group: str, version: str) -> DataFrame:
    """(group, newest, next): the highest version of each group and the one to come."""
    return rows.groupBy(group).agg(F.max(version).alias("newest")).withColumn("next", F.coalesce(F.col("newest"), F.lit(0)) + 1)


def patched(old: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """The rows with the values of patch(key, columns...) where these are not null; what a patch leaves out is kept."""
    columns = [c for c in patch.columns if c != key]
    new = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(new, key, "left").select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def deleted(parent: DataFrame, gone: DataFrame, key: str, children: DataFrame, reference: str) -> tuple[DataFrame, DataFrame]:
    """(the rows that stay, the keys that are refused because children still refer to them)."""
    held = gone.select(key).join(children.select(F.col(reference).alias(key)).distinct(), key, "left_semi")
    return without(parent, gone.select(key).join(held, key, "left_anti"), key), held


def nulled(children: DataFrame, gone: DataFrame, reference: str) -> DataFrame:
    """The children with the reference set to null where its row in gone(id) has been deleted."""
    lost = gone.select(F.col("id").alias(reference), F.lit(True).alias("_gone")).distinct()
    return children.join(lost, reference, "left").withColumn(reference, F.when(F.col("_gone").isNull(), F.col(reference))).select(*children.columns)


def registered(nodes: DataFrame, new: DataFrame, mock: str = "mock://") -> DataFrame:
    """The nodes after one of new(id, display_name, model_identifier, base_url) has been entered by its identifier as the enabled default.

    All other defaults are cleared; an existing node keeps its id; nodes whose address begins with `mock` are disabled.
    """
    n = new.select(*[F.col(c).alias(f"_{c}") for c in ("id", "display_name", "model_identifier", "base_url")])
    both = nodes.join(n, F.col("model_identifier") == F.col("_model_identifier"), "full_outer")
    put = F.col("_model_identifier").isNotNull()
    off = F.col("base_url").startswith(mock)
    out = both.select(F.coalesce("id", "_id").alias("id"), *[F.coalesce(f"_{c}", c).alias(c) for c in ("display_name", "model_identifier", "base_url")], F.when(put, True).otherwise(F.col("is_enabled")).alias("is_enabled"), put.alias("is_default"))
    return out.withColumn("is_enabled", F.col("is_enabled") & ~off).withColumn("is_default", F.col("is_default") & ~off)


def bootstrapped(table: DataFrame, first: DataFrame, present: str = "true") -> DataFrame:
    """The table, with the rows of `first` where no row of the table is `present` yet."""
    there = table.where(present).limit(1).select(F.lit(1).alias("_there"))
    return table.unionByName(first.join(F.broadcast(there), how="left_anti"), allowMissingColumns=True)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """A backup: every table as Parquet in a folder of its own name."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}")


def restored(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def set_default(nodes: DataFrame, node_id) -> DataFrame:
    return nodes.withColumn("is_default", F.col("id") == node_id)


def inserted(old: DataFrame, new: DataFrame, unique: str) -> DataFrame:
    """New rows whose unique value is not taken are appended."""
    return old.unionByName(new.join(old.select(unique), unique, "left_anti").select(*old.columns))


def moved_to_front(ids, first, most: int = 20):
    """An array of remembered ids with one put in front, without repeats, cut to its length."""
    return F.slice(F.array_distinct(F.concat(F.array(first), ids)), 1, most)
