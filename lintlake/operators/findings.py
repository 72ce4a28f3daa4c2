"""Findings within reports: order, histograms, scores, pages and the Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lintlake.functions import text
from lintlake.schemas import CATEGORIES, NO_LINE, SEVERITIES, severity_rank


def ranked(findings: Column) -> Column:
    """The array with its ordinals, sorted by severity, path and line; a missing line comes last, ties keep their order."""
    numbered = F.transform(findings, lambda f, i: F.struct(severity_rank(f.severity).alias("rank"), f.file_path.alias("path"), F.when(F.coalesce(f.line, F.lit(0)) == 0, NO_LINE).otherwise(f.line).alias("at"), i.alias("ordinal"), f.alias("f")))
    return F.array_sort(numbered)


def severity_counts(severities: Column) -> list[Column]:
    """How often each severity stands in an array of severities; the array is all that has to be read of the findings."""

    def of(severity: str) -> Column:
        return F.coalesce(F.size(F.filter(severities, lambda s: s == severity)), F.lit(0)).alias(f"{severity}_found")

    return [of(s) for s in SEVERITIES]


def category_counts(categories: Column) -> Column:
    """Of an array of categories, only those that occur, as a map."""
    pairs = F.transform(F.array(*[F.lit(c) for c in CATEGORIES]), lambda c: F.struct(c.alias("key"), F.size(F.filter(categories, lambda x: x == c)).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p.value > 0))


def merged(parts: DataFrame) -> DataFrame:
    """(task_id, score, finding_count) from parts(task_id, score, findings).

    With any finding the score is the least of all parts, at least 0; else their mean to two places, 100 without parts.
    """
    size = F.greatest(F.size("findings"), F.lit(0))
    out = parts.groupBy("task_id").agg(F.sum(size).alias("finding_count"), F.min("score").alias("least"), F.avg("score").alias("mean"))
    score = F.when(F.col("finding_count") > 0, F.greatest(F.lit(0.0), F.col("least"))).otherwise(F.coalesce(F.round("mean", 2), F.lit(100.0)))
    return out.select("task_id", score.alias("score"), "finding_count")


def flattened(parts: DataFrame, order: str) -> DataFrame:
    """(task_id, score, findings) of parts(task_id, score, findings, and the column that orders the parts of a task).

    The findings of all parts are put one after the other in that order, then sorted by severity, path and line; ties keep their order.
    The score is that of `merged`.
    """
    empty = F.array().cast(parts.schema["findings"].dataType)
    out = parts.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce("findings", empty).alias("findings")))).alias("parts"))
    flat = out.select("task_id", F.transform(ranked(F.flatten(F.transform("parts", lambda p: p.findings))), lambda x: x.f).alias("findings"))
    return merged(parts).select("task_id", "score").join(flat, "task_id")


def page(findings: Column, severity: Column, number: Column, size: int = 15) -> Column:
    """One page, from 1, of the findings of one severity."""
    return F.slice(F.filter(findings, lambda f: f.severity == severity), (number - 1) * size + 1, F.lit(size))


def first_where(items: Column, test) -> Column:
    """The first item that passes, or null."""
    return F.get(F.filter(items, test), F.lit(0))


def tone(score: Column) -> Column:
    return F.when(score >= 85, "good").when(score >= 60, "warning").otherwise("danger")


def _snippet(title: str, lines: Column) -> Column:
    body = F.array_join(F.transform(lines, lambda x: F.coalesce(x["content"], F.lit(""))), "\n")
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"**{title}:**\n\n```c\n"), body, F.lit("\n```\n\n"))).otherwise("")


def markdown(task_id: Column, name: Column, model: Column, score: Column, summary: Column, findings: Column) -> Column:
    """One report as Markdown, made of array functions only."""
    e = lambda c: F.coalesce(c, F.lit(""))

    def one(f: Column, i: Column) -> Column:
        place = text.location(f.file_path, f.line)
        head = F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". ["), F.upper(e(f.severity)), F.lit("] "), e(f.title), F.lit("\n\n- Category: `"), e(f.category), F.lit("`\n- Location: `"), place, F.lit("`\n\n"))
        return F.concat(head, e(f.description), F.lit("\n\n**Remediation:** "), e(f.remediation), F.lit("\n\n"), _snippet("Problematic code", f.code_snippet), _snippet("Suggested code", f.fixed_snippet))

    body = F.when(F.coalesce(F.size(findings), F.lit(0)) <= 0, F.lit("No findings.")).otherwise(F.array_join(F.transform(findings, one), ""))
    top = F.concat(F.lit("# C Language Code Review Report\n\n- Task: `"), e(task_id), F.lit("`\n- Submission: `"), e(name), F.lit("`\n- Model: `"), e(model), F.lit("`\n- Score: `"), text.general(score), F.lit("`\n\n## Summary\n\n"), e(summary), F.lit("\n\n## Findings\n\n"))
    return F.concat(F.regexp_replace(F.concat(top, body), r"\s+$", ""), F.lit("\n"))
