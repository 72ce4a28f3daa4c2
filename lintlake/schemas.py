"""Value domains and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

# Fixed values of the data model.
SEVERITIES = ["high", "medium", "low", "suggestion"]
CATEGORIES = """memory_safety buffer_overflow pointer_safety resource_leak logic security input_validation integer_safety
concurrency performance style maintainability compatibility portability""".split()
CHECK_TYPES = [c for c in CATEGORIES if c not in ("security", "style")]
SNIPPET_KINDS = ["context", "removed", "added"]
UNKNOWN_RANK, NO_LINE = 99, 1_000_000_000

#: The schema of a model's answer.
SNIPPET = "array<struct<line:int,content:string,kind:string>>"
FINDING = f"struct<severity:string,category:string,title:string,description:string,file_path:string,line:int,remediation:string,code_snippet:{SNIPPET},fixed_snippet:{SNIPPET}>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, *columns: str) -> DataFrame:
    """One row an id, the one updated last, of the columns given; columns are pruned before the shuffle."""
    narrow = df.select(*dict.fromkeys(["id", *columns, "updated_at"])) if columns else df
    # of rows with equal stamps the content decides, so that the choice does not depend on their order
    content = [c for c, t in narrow.dtypes if "map<" not in t and "variant" not in t]
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("updated_at").desc(), F.xxhash64(*content)))
    return narrow.withColumn("_n", newest).where("_n = 1").drop("_n")


def severity_rank(column):
    out = F.lit(UNKNOWN_RANK)
    for i, s in reversed(list(enumerate(SEVERITIES))):
        out = F.when(F.col(column) == s, i).otherwise(out) if isinstance(column, str) else F.when(column == s, i).otherwise(out)
    return out
