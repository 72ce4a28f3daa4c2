"""Submitted source code: folders and ZIP archives with their guards, in the order in which the guards apply.

Every source gives rows, not exceptions: (submission, pos, relative_path, source_text, size_bytes, error), where an error stands in
the one row of a submission that is not taken.
"""

from __future__ import annotations

import io
import posixpath
import re
import stat
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lintlake.functions import responses, text

SCHEMA = "submission string, pos int, relative_path string, source_text string, size_bytes long, error string"
EXTENSIONS = (".c", ".h")


@dataclass(frozen=True)
class Limits:
    """Fixed default limits."""

    file_bytes: int = 1 << 20
    archive_bytes: int = 10 << 20
    extracted_bytes: int = 10 << 20
    files: int = 200
    entries: int = 1000
    path: int = 512


def inline(spark: SparkSession, source: str, limits: Limits = Limits()) -> DataFrame:
    """One text as a file snippet.c; a text with lone surrogates can't be written as UTF-8 and is an error."""
    try:
        source.encode()
    except UnicodeError:
        return spark.createDataFrame([("text", 0, "snippet.c", None, None, "not_unicode")], SCHEMA)
    df = spark.createDataFrame([("text", 0, "snippet.c", source)], "submission string, pos int, relative_path string, source_text string")
    df = df.withColumn("size_bytes", F.octet_length(F.encode("source_text", "UTF-8")).cast("long"))
    return df.withColumn("error", F.when(text.blank(F.col("source_text")), "blank").when(F.col("size_bytes") > limits.file_bytes, "file_too_large"))


def files(spark: SparkSession, path: str, limits: Limits = Limits()) -> DataFrame:
    """Single files of a folder; the length is checked before a content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    taken = text.suffix(name).isin(*EXTENSIONS)
    body = text.decode(F.when(F.col("length") <= limits.file_bytes, F.col("content")))
    out = raw.select(F.col("path").alias("submission"), F.lit(0).alias("pos"), name.alias("relative_path"), F.when(taken, body).alias("source_text"), F.col("length").alias("size_bytes"), taken.alias("_taken"))
    error = F.when(~F.col("_taken"), "extension").when(F.col("size_bytes") > limits.file_bytes, "file_too_large").when(text.blank(F.col("source_text")), "blank")
    return out.withColumn("error", error).drop("_taken")


def repeated(submission: str, path: str, pos: str) -> Column:
    """Whether a path has come before in its submission."""
    return F.row_number().over(Window.partitionBy(submission, path).orderBy(pos)) > 1


def folders(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """From entries(submission, pos, path, content BINARY): windows give running counts and sums, the first error wins.

    One submission holds at most limits.entries useful entries, so its window is small.
    """
    w = Window.partitionBy("submission").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = text.clean_path(F.col("path"))
    df = entries.withColumn("clean", path).withColumn("size", F.octet_length("content").cast("long")).withColumn("n", F.row_number().over(Window.partitionBy("submission").orderBy("pos")))
    df = df.withColumn("twice", repeated("submission", "clean", "pos"))
    df = df.withColumn("source", text.suffix(F.col("clean")).isin(*EXTENSIONS))
    df = df.withColumn("bytes", F.sum(F.when(F.col("source"), F.col("size"))).over(w)).withColumn("taken", F.count_if("source").over(w))
    guard = (
        F.when(F.col("n") > limits.entries, "too_many_entries")
        .when(text.unsafe_path(F.col("path"), limits.path).isNotNull(), text.unsafe_path(F.col("path"), limits.path))
        .when(F.col("twice"), "duplicate_path")
        .when(~F.col("source"), None)
        .when(F.col("size") > limits.file_bytes, "file_too_large")
        .when(F.col("bytes") > limits.extracted_bytes, "total_too_large")
        .when(F.col("taken") > limits.files, "too_many_files")
    )
    df = df.withColumn("wrong", guard).withColumn("source_text", text.decode(F.when(F.col("source") & F.col("wrong").isNull(), F.col("content"))))
    all_ = df.groupBy("submission").agg(F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("pos"))).alias("first"), F.count_if("source").alias("sources"), F.count_if(~text.blank(F.coalesce("source_text", F.lit("")))).alias("filled"))
    error = F.coalesce("first", F.when(F.col("sources") == 0, "no_source_files").when(F.col("filled") == 0, "all_blank"))
    verdict = all_.select("submission", error.alias("error"))
    good = df.where("source").join(verdict.where("error IS NULL").select("submission"), "submission", "left_semi")
    rows = good.select("submission", "pos", F.col("clean").alias("relative_path"), "source_text", F.col("size").alias("size_bytes"), F.lit(None).cast("string").alias("error"))
    bad = verdict.where("error IS NOT NULL").select("submission", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("relative_path"), F.lit(None).cast("string").alias("source_text"), F.lit(None).cast("long").alias("size_bytes"), "error")
    return rows.unionByName(bad)


def display_names(rows: DataFrame, default: str = "folder") -> DataFrame:
    """(submission, display_name) of the files of folders: the first part of the path of the last file that lies in a folder."""
    nested = F.when(F.col("relative_path").contains("/"), F.struct("pos", F.split("relative_path", "/")[0].alias("name")))
    return rows.where("error IS NULL").groupBy("submission").agg(F.coalesce(F.max(nested)["name"], F.lit(default)).alias("display_name"))


def created(submissions: DataFrame, files: DataFrame, nodes: DataFrame, domain: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, files, rejects) of submissions(submission, owner_id, model_node_id, name, default_name, input_mode, check_types) and their files.

    A submission needs an enabled node, check types of the domain and a file without an error; rejects(submission, error) tells what is
    missing.  The display name is the trimmed name or else the default; a task's id is made from the submission, those of files are random.
    """
    usable = nodes.where(F.col("is_enabled").eqNullSafe(True)).select(F.col("id").alias("model_node_id"), F.lit(True).alias("_node")).distinct()
    counts = files.groupBy("submission").agg(F.count_if(F.col("error").isNull()).alias("file_count"), F.first("error", ignorenulls=True).alias("_wrong"))
    df = submissions.join(usable, "model_node_id", "left").join(counts, "submission", "left").withColumn("_kinds", responses.supported(F.col("check_types"), domain))
    error = F.when(F.col("_node").isNull(), "model is not available").when(F.col("_kinds.verdict") != "ok", F.concat(F.lit("check types: "), F.col("_kinds.verdict"))).when(F.col("_wrong").isNotNull(), F.col("_wrong")).when(F.coalesce("file_count", F.lit(0)) == 0, "no files")
    judged = df.withColumn("error", error)
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("default_name"))
    # the id is made from the submission, so that it is the same wherever it is worked out again
    tasks = judged.where("error IS NULL").select(task_id(F.col("submission")).alias("id"), "submission", "owner_id", "model_node_id", name.alias("display_name"), "input_mode", F.lit("queued").alias("status"), F.lit(0).alias("progress"), F.lit(0).alias("queue_priority"), F.col("file_count").cast("int").alias("file_count"), F.col("_kinds.kinds").alias("check_types"))
    kept = files.where("error IS NULL").join(tasks.select("submission"), "submission", "left_semi")
    rows = kept.select(F.uuid().alias("id"), task_id(F.col("submission")).alias("task_id"), "pos", "relative_path", "source_text", "size_bytes")
    return tasks, rows, judged.where("error IS NOT NULL").select("submission", "error")


def task_id(submission: Column) -> Column:
    """A UUID made from the name of a submission."""
    h = F.md5(submission.cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def stored(tasks: DataFrame, files: DataFrame, path: str) -> None:
    """Appends tasks and their files to the tables below path; the files first, so that no task stands without its files."""
    files.write.mode("append").parquet(f"{path}/review_files")
    tasks.write.mode("append").parquet(f"{path}/review_tasks")


def _unpacked(name: str, content: bytes, limits: Limits) -> tuple[list[tuple], str | None]:
    """The source files of one archive, or the first guard that it breaks."""
    if not name.lower().endswith(".zip"):
        return [], "extension"
    if len(content) > limits.archive_bytes:
        return [], "archive_too_large"
    out, seen, total = [], set(), 0
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for n, entry in enumerate(z.infolist()):
                path = entry.filename.replace("\\", "/")
                clean = posixpath.normpath(path) if path else path
                checks = (
                    (n >= limits.entries, "too_many_entries"),
                    (not path or path[0] == "/" or bool(re.match("[A-Za-z]:", path)) or ".." in path.split("/"), "unsafe"),
                    (len(path) > limits.path, "too_long"),
                    (stat.S_ISLNK(entry.external_attr >> 16), "symlink"),
                )
                for broken, why in checks:
                    if broken:
                        return [], why
                if entry.is_dir():
                    continue
                if clean in seen:
                    return [], "duplicate_path"
                seen.add(clean)
                base = posixpath.basename(clean)
                if posixpath.splitext(base)[1].lower() not in EXTENSIONS:
                    continue
                total += entry.file_size
                if entry.file_size > limits.file_bytes:
                    return [], "file_too_large"
                if total > limits.extracted_bytes:
                    return [], "total_too_large"
                if len(out) >= limits.files:
                    return [], "too_many_files"
                body = z.read(entry)
                if len(body) > limits.file_bytes:
                    return [], "file_too_large"
                out.append((len(out), clean, text.decoded(body), len(body)))
    except (zipfile.BadZipFile, zipfile.LargeZipFile, EOFError, RuntimeError, NotImplementedError, UnicodeError):
        return [], "invalid_archive"
    if not out:
        return [], "no_source_files"
    return (out, None) if any(x[2].strip() for x in out) else ([], "all_blank")


def archives(content: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """From content(submission, name, content BINARY), for instance of the binaryFile source: one archive is one unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for sub, name, body in zip(*(b.column(c).to_pylist() for c in ("submission", "name", "content")), strict=True):
                got, error = _unpacked(name or "", body or b"", limits)
                rows += [(sub, *x, None) for x in got] if error is None else [(sub, 0, None, None, None, error)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["submission", "pos", "relative_path", "source_text", "size_bytes", "error"])

    return content.select("submission", "name", "content").mapInArrow(run, SCHEMA)
