"""Model answers: take the contract object out of the text, repair, validate.

Well-formed text is the fast path of the same Arrow batch; only what a JSON parser cannot read is scanned.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lintlake.schemas import CATEGORIES, FINDING, SEVERITIES, SNIPPET_KINDS

KEYS = ("summary", "score", "findings")
MOST_FINDINGS = 2000
# Fixed bounds of the contract: (least, most) length of texts, and of snippets.
TEXTS = {"title": (1, 120), "description": (1, 360), "file_path": (1, 512), "remediation": (1, 360)}
MOST_LINES, SUMMARY = 2, (1, 240)
RESULT = f"status string, error string, summary string, score double, findings array<{FINDING}>"
_JSON = json.JSONDecoder()


def body(text: str) -> str:
    """The text without a code fence."""
    t = text.strip()
    if not t.startswith("```"):
        return t
    rows = t.splitlines()[1:]
    if rows and rows[-1].strip().startswith("```"):
        rows.pop()
    return "\n".join(rows).strip()


def contract(text: str) -> tuple[dict | None, str]:
    """The object with all keys, or None and why there is none: `truncated`, `fragments` or `no_json`."""
    t = body(text)
    fragments, partial, at = False, False, t.find("{")
    while at >= 0:
        try:
            value, _ = _JSON.raw_decode(t, at)
            fragments = True
            if all(k in value for k in KEYS):
                return value, ""
        except ValueError:
            partial = partial or at == 0 and any(f'"{k}"' in t for k in KEYS)
        at = t.find("{", at + 1)
    if partial:
        saved = rescued(t)
        return (saved, "") if saved else (None, "truncated")
    return None, "fragments" if fragments else "no_json"


def rescued(t: str) -> dict | None:
    """Of an object that breaks off: its summary and score, and the findings that are complete."""
    out: dict = {}
    for key in KEYS[:2]:
        m = re.search(rf'"{key}"\s*:\s*', t)
        if m is None:
            return None
        try:
            out[key] = _JSON.raw_decode(t, m.end())[0]
        except ValueError:
            return None
    m = re.search(r'"findings"[^:]*:[^\[]*\[', t)
    if m is None:
        return None
    found, at = [], m.end()
    skip = re.compile(r"[^{\]]*")
    while len(found) < MOST_FINDINGS:
        at = skip.match(t, at).end()
        if not t.startswith("{", at):
            break
        try:
            value, at = _JSON.raw_decode(t, at)
        except ValueError:
            break
        found.append(value)
    return {**out, "findings": found} if found else None


def snippet(rows, line):
    """Lines of code with an unknown kind as context and a missing number as the finding's; without any number a line is dropped."""
    if not isinstance(rows, list):
        return rows
    fallback = line if isinstance(line, int) else None
    fixed = [{**r, "kind": r.get("kind") if r.get("kind") in SNIPPET_KINDS else "context", "line": fallback if r.get("line") is None else r["line"]} for r in rows if isinstance(r, dict)]
    return [r for r in fixed if r["line"] is not None]


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def problems(value) -> str | None:
    """The first rule of the contract that an object breaks, or None."""
    if set(value) - set(KEYS):
        return "extra key"
    if not isinstance(value["summary"], str) or not SUMMARY[0] <= len(value["summary"]) <= SUMMARY[1]:
        return "summary"
    if isinstance(value["score"], bool) or not isinstance(value["score"], int | float) or not 0 <= value["score"] <= 100:
        return "score"
    if not isinstance(value["findings"], list) or len(value["findings"]) > MOST_FINDINGS:
        return "findings"
    for i, f in enumerate(value["findings"]):
        if not isinstance(f, dict) or set(f) - {*TEXTS, "severity", "category", "line", "code_snippet", "fixed_snippet"}:
            return f"findings.{i}"
        if f.get("severity") not in SEVERITIES:
            return f"findings.{i}.severity"
        if f.get("category") not in CATEGORIES:
            return f"findings.{i}.category"
        for key, (least, most) in TEXTS.items():
            if not isinstance(f.get(key), str) or not least <= len(f[key]) <= most:
                return f"findings.{i}.{key}"
        if f.get("line") is not None and not (_whole(f["line"]) and f["line"] >= 1):
            return f"findings.{i}.line"
        for key in ("code_snippet", "fixed_snippet"):
            rows = f.get(key, [])
            if not isinstance(rows, list) or len(rows) > MOST_LINES or any(not isinstance(r, dict) or set(r) - {"line", "content", "kind"} or not _whole(r.get("line")) or r["line"] < 1 or not isinstance(r.get("content"), str) for r in rows):
                return f"findings.{i}.{key}"
    return None


def parsed(text: str | None) -> tuple[str, str | None, dict | None]:
    """(status, error, object): status is `valid` or `invalid`."""
    if text is None:
        return "invalid", "no_json", None
    value, why = contract(text)
    if value is None:
        return "invalid", why, None
    if isinstance(value["findings"], list):
        for f in value["findings"]:
            if isinstance(f, dict):
                for key in ("code_snippet", "fixed_snippet"):
                    if key in f:
                        f[key] = snippet(f[key], f.get("line"))
    wrong = problems(value)
    return ("invalid", wrong, None) if wrong else ("valid", None, value)


def parse(raw: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status, error, summary, score, findings) of every raw answer; null answers are invalid."""
    schema = f"{key} {dict(raw.dtypes)[key]}, {RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.struct([("line", pa.int32()), ("content", pa.string()), ("kind", pa.string())])
        finding = pa.struct([(k, pa.string()) for k in ("severity", "category", "title", "description", "file_path")] + [("line", pa.int32()), ("remediation", pa.string()), ("code_snippet", pa.list_(line)), ("fixed_snippet", pa.list_(line))])
        for b in batches:
            rows = [parsed(t) for t in b.column(content).to_pylist()]
            got = [v or {} for _, _, v in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(key), pa.array([s for s, _, _ in rows], pa.string()), pa.array([e for _, e, _ in rows], pa.string()), pa.array([v.get("summary") for v in got], pa.string()), pa.array([None if "score" not in v else float(v["score"]) for v in got], pa.float64()), pa.array([v.get("findings") for v in got], pa.list_(finding))],
                names=[key, "status", "error", "summary", "score", "findings"],
            )

    return raw.select(key, content).mapInArrow(run, schema)


def raw_answers(tasks: DataFrame) -> DataFrame:
    """(task_id, entry, content): the raw answers that the logs of tasks hold."""
    entries = tasks.select(F.col("id").alias("task_id"), F.posexplode(F.split("model_log", r"\n\n(?=\[\d{4}-)")).alias("entry", "text"))
    return entries.where(F.col("text").contains("\nRaw model response:\n")).select("task_id", "entry", F.substring_index("text", "\nRaw model response:\n", -1).alias("content"))


def check_types(text: Column) -> Column:
    """(values, error) of a JSON list of strings, by the JVM's own JSON reader; null and anything else is an error."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    listed = F.from_json(text, "array<string>")
    good = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(listed, lambda x: x.isNull())
    error = F.when(value.isNull(), "not JSON").when(~F.coalesce(good, F.lit(False)), "not a list of strings")
    return F.struct(F.when(error.isNull(), listed).alias("values"), error.alias("error"))


def supported(kinds: Column, domain: list[str]) -> Column:
    """(kinds, verdict, unsupported): the kinds without repeats, in order; `none`, `unsupported` or `ok`, and those that the domain lacks."""
    odd = F.array_except(kinds, F.array(*[F.lit(k) for k in domain]))
    verdict = F.when(F.coalesce(F.size(kinds), F.lit(0)) <= 0, "none").when(F.size(odd) > 0, "unsupported").otherwise("ok")
    return F.struct(F.array_distinct(kinds).alias("kinds"), verdict.alias("verdict"), odd.alias("unsupported"))
