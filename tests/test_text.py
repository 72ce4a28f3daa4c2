from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lintlake.functions import responses, text


def _value(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize("s", ["", "a", "a\n", "a\r\nb\rc", "\n", "a\x0bb\x0cc\x1cd\x85e f g", "x\n\ny", "\r\n\r\n"])
def test_lines_as_python(spark, s):
    assert _value(spark, text.lines, s) == s.splitlines()


def test_budget():
    assert [text.budget(n) for n in (12000, 2000, 1500, 999, 10, 1)] == [5400, 1000, 1000, 449, 4, 1]


def _fold(source, most):
    """The packing rule, written out line by line."""
    out, cur, used = [], [], 0
    room = max(1, most - 9)
    for n, line in enumerate(source.splitlines(), 1):
        for seg in [line[i : i + room] for i in range(0, len(line), room)] or [""]:
            s = f"{n:06d}: {seg}"
            if cur and used + len(s) + 1 > most:
                out.append(cur)
                cur, used = [], 0
            cur.append((n, s))
            used += len(s) + 1
    return [*out, cur] if cur else out


@pytest.mark.parametrize("most", [1, 12, 45, 400])
def test_chunks(spark, most):
    sources = ["".join(f"int value_{i};\n" for i in range(7)), "", "x" * 100, "\n\n\n", "a\n" * 300, "短い行\n" * 5]
    df = spark.createDataFrame([("t", str(i), f"f{i}.c", s) for i, s in enumerate(sources)], "task_id string, id string, relative_path string, source_text string")
    rows = text.chunk(df, most).orderBy("file_id", "chunk").collect()
    for i, s in enumerate(sources):
        want = [(c[0][0], c[-1][0], sum(len(x) + 1 for _, x in c)) for c in _fold(s, most)] or [(1, 1, 0)]
        assert [(r.start_line, r.end_line, r.characters) for r in rows if r.file_id == str(i)] == want
    if most == 45:
        assert sum(r.file_id == "0" for r in rows) > 1 and max(r.end_line for r in rows if r.file_id == "0") == 7


def test_batches_keep_order_and_bounds(spark):
    df = spark.createDataFrame([("t", str(i), f"f{i}.c", "int a;\n" * 8) for i in range(4)], "task_id string, id string, relative_path string, source_text string")
    chunks = text.chunk(df, 1000)
    packed = text.pack(chunks, 1000).orderBy("batch", "path", "chunk").collect()
    assert max(r.batch for r in packed) <= len(packed)
    assert [r.path for r in packed] == sorted(r.path for r in packed)


def test_truncated_and_tail(spark):
    assert _value(spark, lambda c: text.truncated(c, 5), "abcdefgh") == "abcde\n... [truncated 3 chars]"
    assert _value(spark, lambda c: text.truncated(c, 5), "abc") == "abc"
    assert _value(spark, lambda c: text.truncated(c, 5), None) is None
    assert _value(spark, lambda c: text.tail(c, 3), "abcdef") == "def"


@pytest.mark.parametrize("path", ["/etc/passwd.c", "../escape.c", "src/../../escape.h", "src\\..\\escape.c", "C:/Windows/escape.c", "\\\\server\\share\\escape.c", ""])
def test_unsafe_paths(spark, path):
    assert _value(spark, text.unsafe_path, path) == "unsafe"


def test_paths(spark):
    assert _value(spark, text.unsafe_path, "src/a..b/x.c") is None
    assert _value(spark, text.unsafe_path, "a/" * 300 + "x.c") == "too_long"
    assert [_value(spark, text.suffix, p) for p in ("main.C", "README", "main.c.exe", ".c", "a/.h", "x\\y.h")] == [".c", "", ".exe", "", "", ".h"]
    assert _value(spark, text.clean_path, ".//a/./b//c.c") == "a/b/c.c"


def test_blank(spark):
    assert [_value(spark, text.blank, s) for s in ("", " \t", "　", "x")] == [True, True, True, False]


@pytest.mark.parametrize(("raw", "want"), [("int 值;".encode(), "int 值;"), ("值".encode("utf-8-sig"), "值"), ("int a; // 内存安全".encode("gb18030"), "int a; // 内存安全"), ("éabcdef".encode("utf-16-le"), "éabcdef"), (b"a\0b\0", "a\0b\0"), ("﻿abc".encode("utf-16-be"), "﻿abc"), (b"", "")])
def test_decode(spark, raw, want):
    assert text.decoded(raw) == want
    assert _value(spark, text.decode, bytearray(raw), "binary") == want


def test_output_budget(spark):
    e = "This model's maximum context length is 4096 tokens and your request has 2524 input tokens"
    assert _value(spark, lambda c: text.output_budget(c, 2048), e) == 1444
    assert _value(spark, lambda c: text.output_budget(c, 2048), "busy") is None
    assert _value(spark, text.context_error, e)


def test_general(spark):
    assert [_value(spark, text.general, x, "double") for x in (78.0, 92.5, 100.0, 0.0, None)] == ["78", "92.5", "100", "0", ""]


F1 = '{"severity": "high", "category": "logic", "title": "t", "description": "d", "file_path": "a.c", "line": 3, "remediation": "r", "code_snippet": [{"line": null, "content": "x", "kind": "odd"}], "fixed_snippet": []}'
GOOD = f'{{"summary": "s", "score": 90, "findings": [{F1}]}}'


@pytest.mark.parametrize(
    ("raw", "status", "error", "n"),
    [
        (GOOD, "valid", None, 1),
        (f"```json\n{GOOD}\n```", "valid", None, 1),
        (f"Here it is:\n{GOOD} done", "valid", None, 1),
        ('```json\n{"summary": "s", "score": 100, "findings": []}\n```', "valid", None, 0),
        ("not valid json", "invalid", "no_json", None),
        (None, "invalid", "no_json", None),
        ('{"a": 1}', "invalid", "fragments", None),
        (GOOD[:-2] + ', {"severity": "lo', "valid", None, 1),
        ('{"summary": "s", "score": 1, "findings": [{"title": "a "b" c"}, {"se', "invalid", "truncated", None),
        (GOOD.replace("90", "140"), "invalid", "score", None),
        (GOOD.replace('"s"', '"s", "note": 1'), "invalid", "extra key", None),
        (GOOD.replace('"logic"', '"odd"'), "invalid", "findings.0.category", None),
        (GOOD.replace('"line": 3', '"line": 0'), "invalid", "findings.0.line", None),
    ],
)
def test_contract(spark, raw, status, error, n):
    df = spark.createDataFrame([("k", raw)], "k string, raw string")
    r = responses.parse(df, "k", "raw").collect()[0]
    assert (r.status, r.error, None if r.findings is None else len(r.findings)) == (status, error, n)
    if n:
        assert (r.findings[0].code_snippet[0].line, r.findings[0].code_snippet[0].kind) == (3, "context")


def test_too_many_findings():
    value = {"summary": "s", "score": 1, "findings": [{}] * 2001}
    assert responses.problems(value) == "findings"
