from __future__ import annotations

import datetime as dt
import io
import stat
import zipfile

import pytest
from pyspark.sql import functions as F

from lintlake.functions import metrics, responses, text
from lintlake.operators import attempts, deployments, findings, history, queue, state
from lintlake.schemas import FINDING, latest
from lintlake.sources import catalog, scrapes, submissions
from lintlake.streaming import dispatch, peaks, progress

T0 = dt.datetime(2025, 1, 1)
TASK = "id string, status string, progress int, queue_priority int, created_at timestamp_ntz, updated_at timestamp_ntz"


def _tasks(spark, rows):
    return spark.createDataFrame([(i, s, 0, p, T0 + dt.timedelta(minutes=m), T0) for i, s, p, m in rows], TASK)


def test_queue(spark):
    t = _tasks(spark, [("a", "queued", 0, 5), ("b", "queued", 3, 9), ("c", "queued", 0, 5), ("d", "failed", 9, 0), ("e", "queued", 0, 2000)])
    assert {r.id: r.ahead for r in queue.positions(t).collect()} == {"b": 0, "a": 1, "c": 2, "e": 3}
    after = {r.id: (r.status, r.progress) for r in queue.dispatched(t, queue.head(t)).collect()}
    assert after["b"] == ("running", 1) and after["a"] == ("queued", 0)
    busy = t.withColumn("status", F.when(F.col("id") == "d", "running").otherwise(F.col("status")))
    assert queue.head(busy).count() == 0
    assert {r.id: r.queue_priority for r in queue.pinned(t, F.lit("c")).collect()}["c"] == 10
    assert {r.id: r.queue_priority for r in queue.pinned(t, F.lit("d")).collect()}["d"] == 9


def test_page_bounds(spark):
    df = spark.range(21).withColumn("created_at", F.col("id"))
    order = [F.col("created_at").desc(), F.col("id").desc()]
    assert history.page(df, order).count() == 20 and history.page(df, order, 20).count() == 1
    for bad in ((-1, 1), (0, 0), (0, 101)):
        with pytest.raises(ValueError):
            history.page(df, order, *bad)
    assert history.page(df, order, 0, 100).count() == 21
    with pytest.raises(ValueError):
        history.ordered(df, df, df, "password_hash")


def _finding(sev, line, path="a.c"):
    return (sev, "logic", "t", "d", path, line, "r", [], [])


def test_merge_and_order(spark):
    low = [_finding("low", n) for n in (2, 1, 3, 5, 4)]
    df = spark.createDataFrame([("t", 90.0, low), ("t", 40.0, [_finding("high", None)]), ("u", 80.0, []), ("u", 81.25, [])], f"task_id string, score double, findings array<{FINDING}>")
    got = {r.task_id: (r.score, r.finding_count) for r in findings.merged(df).collect()}
    assert got == {"t": (40.0, 6), "u": (80.63, 0)}
    flat = df.groupBy("task_id").agg(F.flatten(F.collect_list("findings")).alias("f")).where("task_id = 't'")
    rows = flat.select(findings.ranked(F.col("f")).alias("x")).collect()[0].x
    assert [(r.f.severity, r.f.line) for r in rows] == [("high", None), *[("low", n) for n in (1, 2, 3, 4, 5)]]
    assert [spark.range(1).select(findings.tone(F.lit(s)).alias("t")).collect()[0].t for s in (92, 78, 48)] == ["good", "warning", "danger"]


def test_markdown_without_findings(spark):
    df = spark.createDataFrame([("t", "n", "m", 78.0, None, None)], f"a string, b string, c string, s double, u string, f array<{FINDING}>")
    md = df.select(findings.markdown(*[F.col(c) for c in "abcsuf"]).alias("md")).collect()[0].md
    assert md.endswith("No findings.\n") and "- Score: `78`" in md


def test_state(spark):
    users = spark.createDataFrame([("u",), ("v",)], "id string")
    tasks = spark.createDataFrame([("t", "u"), ("s", "v")], "id string, owner_id string")
    files = spark.createDataFrame([("f", "t"), ("g", "s")], "id string, task_id string")
    left = state.cascaded(users, tasks, files, files, users.where("id = 'u'"))
    assert {k: [r.id for r in v.collect()] for k, v in left.items()} == {"users": ["v"], "tasks": ["s"], "files": ["g"], "reports": ["g"]}
    nodes = spark.createDataFrame([("a", False, True, 2), ("b", False, True, 1), ("c", False, False, 0)], "id string, is_default boolean, is_enabled boolean, created_at int")
    assert [r.id for r in state.default_node(nodes).where("is_default").collect()] == ["b"]
    assert state.default_node(nodes.where("false")).count() == 0


def test_metrics(spark):
    a = 'x_prompt_total{n="1"} 1000\nx_generation_total 2000\nx_running 2.0\nx_waiting 1.0\nx_cache 0.274\nx_odd 1e3\n'
    b = a.replace("1000", "1150").replace("2000", "2300")
    df = spark.createDataFrame([("n", T0, a), ("n", T0 + dt.timedelta(seconds=1), b)], "node string, ts timestamp_ntz, s string")
    df = df.select("node", "ts", metrics.sample(F.col("s"), "y", "x_prompt_total").alias("p"), metrics.sample(F.col("s"), "x_generation_total").alias("g"), metrics.percentage(metrics.sample(F.col("s"), "x_cache")).alias("c"), metrics.sample(F.col("s"), "x_odd").alias("o"))
    last = metrics.rates(metrics.rates(df, "node", "ts", "p").withColumnRenamed("rate", "pr"), "node", "ts", "g").orderBy("ts").collect()
    assert (last[0].pr, last[0].rate) == (None, None)
    assert (last[1].pr, last[1].rate, last[1].c, last[1].o) == (150.0, 300.0, 27.4, None)


def _zip(entries, **modes):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in entries:
            info = zipfile.ZipInfo(name)
            info.external_attr = modes.get(name.replace(".", "_"), 0o644) << 16
            z.writestr(info, body)
    return bytearray(out.getvalue())


@pytest.mark.parametrize(
    ("entries", "error"),
    [
        ([("p/src/main.c", b"int a;"), ("p/README.md", b"x"), ("p/a.h", b"int b;")], None),
        ([("../x.c", b"int a;")], "unsafe"),
        ([("/x.c", b"int a;")], "unsafe"),
        ([("a.c", b"int a;"), ("./a.c", b"int b;")], "duplicate_path"),
        ([("a.txt", b"x")], "no_source_files"),
        ([("a.c", b"  ")], "all_blank"),
        ([("a.c", b"x" * 60)], "file_too_large"),
        ([(f"{i}.c", b"x" * 40) for i in range(3)], "total_too_large"),
        ([(f"{i}.c", b"x") for i in range(4)], "too_many_files"),
        ([(f"{i}.txt", b"x") for i in range(9)], "too_many_entries"),
        ([("d" * 60 + ".c", b"x")], "too_long"),
    ],
)
def test_archives_and_folders(spark, entries, error):
    limits = submissions.Limits(file_bytes=50, archive_bytes=4000, extracted_bytes=100, files=3, entries=8, path=50)
    df = spark.createDataFrame([("s", "a.zip", _zip(entries))], "submission string, name string, content binary")
    rows = submissions.archives(df, limits).collect()
    folder = spark.createDataFrame([("s", i, p, bytearray(c)) for i, (p, c) in enumerate(entries)], "submission string, pos int, path string, content binary")
    other = submissions.folders(folder, limits).orderBy("pos").collect()
    if error:
        assert [r.error for r in rows] == [error] == [r.error for r in other]
    else:
        assert [r.relative_path for r in rows] == ["p/src/main.c", "p/a.h"] == [r.relative_path for r in other]
        assert all(r.error is None for r in [*rows, *other])


def test_bad_archives(spark):
    link = _zip([("l.c", b"x")], l_c=stat.S_IFLNK | 0o777)
    rows = [("a", "a.zip", bytearray(b"zip?")), ("b", "b.tar", bytearray(b"")), ("c", "c.zip", link), ("d", None, None)]
    got = submissions.archives(spark.createDataFrame(rows, "submission string, name string, content binary")).collect()
    assert {r.submission: r.error for r in got} == {"a": "invalid_archive", "b": "extension", "c": "symlink", "d": "extension"}


def test_files_and_inline(spark, tmp_path):
    (tmp_path / "a.c").write_bytes("int 值;".encode("gb18030"))
    (tmp_path / "b.txt").write_text("x")
    got = {r.relative_path: (r.source_text, r.error) for r in submissions.files(spark, str(tmp_path)).collect()}
    assert got["b.txt"] == (None, "extension") and got["a.c"][1] is None
    assert [submissions.inline(spark, s).collect()[0].error for s in ("int a;", " \n")] == [None, "blank"]


def test_catalog(spark, tmp_path):
    p = tmp_path / "catalog.json"
    p.write_text('[{"key": "k", "model_identifier": "lab/m"}, {"key": "x", "display_name": ""}]')
    c = catalog.read(spark, str(p))
    assert {r.key: (r.display_name, r.served_model_name, r.port) for r in c.collect()} == {"k": ("k", "lab/m", 8000), "x": ("x", "x", 8000)}
    nodes = spark.createDataFrame([("lab/m", "M", True), ("x", "X", False)], "model_identifier string, display_name string, is_enabled boolean")
    assert [r.key for r in catalog.deployed(c, nodes).collect()] == ["k"]
    assert catalog.read(spark, str(tmp_path / "none.json")).count() == 0


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "state")
    _tasks(spark, [("a", "queued", 0, 1), ("b", "queued", 5, 2)]).coalesce(1).write.parquet(str(src))
    step = dispatch.step(out)
    q = spark.readStream.schema(TASK).parquet(str(src)).writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    first = {r.id: r.status for r in dispatch.current(spark, out).collect()}
    assert first == {"a": "queued", "b": "running"}
    again = _tasks(spark, [("c", "queued", 9, 3)])
    step(again, 1)
    step(again, 1)  # given twice
    assert {r.id: r.status for r in dispatch.current(spark, out).collect()} == {"a": "queued", "b": "running", "c": "queued"}
    samples = spark.createDataFrame([("n", T0 + dt.timedelta(minutes=m), float(m % 7)) for m in range(60)], "node_id string, captured_at timestamp, v double")
    samples.coalesce(1).write.parquet(str(tmp_path / "s"))
    s = peaks.peaks(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "s")), "node_id", "captured_at", "v")
    q = s.writeStream.format("memory").queryName("peaks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT max(peak) AS m, max(samples) AS n FROM peaks").collect()[0] == (6.0, 30)
    kept = peaks.retained(samples.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz")), "2025-01-01 01:00:00", most=20)
    assert kept.count() == 20


def test_repeated_ids_in_the_first_batch(spark, tmp_path):
    old, new = _tasks(spark, [("a", "queued", 0, 1)]), _tasks(spark, [("a", "failed", 0, 1)]).withColumn("updated_at", F.lit(T0 + dt.timedelta(days=1)).cast("timestamp_ntz"))
    dispatch.step(str(tmp_path / "s"))(old.unionByName(new).unionByName(old), 0)
    assert [(r.id, r.status) for r in dispatch.current(spark, str(tmp_path / "s")).collect()] == [("a", "failed")]


def test_latest_does_not_depend_on_the_order_of_rows(spark):
    rows = [("a", f"v{i}", T0) for i in range(20)]
    pick = lambda r: latest(spark.createDataFrame(r, "id string, v string, updated_at timestamp_ntz")).collect()[0].v
    assert pick(rows) == pick(rows[::-1])


def test_visible(spark):
    t = spark.createDataFrame([("t", "u"), ("s", "v"), ("r", None)], "id string, owner_id string")
    seen = lambda rows: {r.id for r in history.visible(t, spark.createDataFrame(rows, "id string, role string")).collect()}
    assert seen([("u", "user")]) == {"t"} and seen([("u", "Admin")]) == {"t", "s", "r"} and seen([]) == set() and seen([("w", None)]) == set()


def test_attempts(spark):
    tasks = spark.createDataFrame([(i, "queued", 7, 5, "old", "log") for i in "abcde"], "id string, status string, progress int, finding_count int, error_message string, model_log string")
    at = T0 + dt.timedelta(hours=1)
    tries = [("a", 1, at, False, None, "no JSON", True), ("a", 2, at, True, 3, None, False), ("a", 3, at, False, None, "late", False), ("b", 1, at, False, None, "x" * 1200, True), ("b", 2, at, False, None, "schema", True), ("b", 3, at, False, None, "schema", True), ("c", 1, at, False, None, None, False), ("d", 3, at, False, None, "timeout", False), ("d", 3, at, False, None, "timeout", False)]
    df = spark.createDataFrame(tries, "task_id string, attempt int, at timestamp_ntz, succeeded boolean, findings int, message string, audit boolean")
    got = {r.id: r for r in attempts.applied(tasks, df, 3).collect()}
    brief = {k: (r.status, r.progress, r.finding_count, r.error_message, r.attempts) for k, r in got.items()}
    assert brief == {"a": ("completed", 100, 3, None, 2), "b": ("failed", 100, 0, "model output audit failed after 3 attempts", 3), "c": ("running", 35, 0, "; retrying (1/3)", 1), "d": ("failed", 100, 0, "timeout", 1), "e": ("queued", 7, 5, "old", 0)}
    assert got["a"].model_log.split("\n\n")[-1] == "[2025-01-01T01:00:00+00:00] Attempt 2 succeeded with 3 finding(s)." and got["e"].model_log == "log"
    long = spark.createDataFrame([("z" * 12_000, at)], "log string, at timestamp_ntz").select(text.appended(F.col("log"), F.col("at"), F.lit("more")).alias("x")).first().x
    assert long.startswith("z" * 12_000) and long.endswith("... [truncated 34 chars]")
    assert [r[0] for r in spark.createDataFrame([(12_000, 0), (12_000, 2), (3_000, 2)], "b int, n int").select(attempts.shrunk(F.col("b"), F.col("n"))).collect()] == [12_000, 3_000, None]


def test_check_types_as_json(spark):
    rows = ['["a", "b", "a"]', "[]", '{"a": 1}', "[1]", '["a", null]', "x", None, '"a"', '[["a"]]']
    got = [(r.x["values"], r.x.error) for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").orderBy("i").select(responses.check_types(F.col("t")).alias("x")).collect()]
    bad = (None, "not a list of strings")
    assert got == [(["a", "b", "a"], None), ([], None), bad, bad, bad, (None, "not JSON"), (None, "not JSON"), bad, bad]


def test_created_stored_and_backed_up(spark, tmp_path):
    subs = spark.createDataFrame([("s", "u", "m", " My name ", "d", "folder", ["logic", "logic"]), ("t", "u", "off", "", "d", "text", ["logic"]), ("v", "u", "m", "", "d", "text", ["nope"])], "submission string, owner_id string, model_node_id string, name string, default_name string, input_mode string, check_types array<string>")
    rows = spark.createDataFrame([("s", 0, "p/a.c", "int a;", 6, None), ("s", 1, "b.c", "int b;", 6, None), ("t", 0, "a.c", "x", 1, None)], submissions.SCHEMA)
    nodes = spark.createDataFrame([("m", True), ("off", False)], "id string, is_enabled boolean")
    tasks, files, rejects = submissions.created(subs, rows, nodes, ["logic"])
    assert [(r.display_name, r.file_count, r.check_types, r.status) for r in tasks.collect()] == [("My name", 2, ["logic"], "queued")]
    assert {r.submission: r.error for r in rejects.collect()} == {"t": "model is not available", "v": "check types: unsupported"}
    assert {r.submission: r.display_name for r in submissions.display_names(rows).collect()} == {"s": "p", "t": "folder"}
    for _ in range(2):
        submissions.stored(tasks, files, str(tmp_path / "db"))
    back = state.restored(spark, str(tmp_path / "db"), "review_tasks", "review_files")
    assert back["review_files"].select("task_id").distinct().join(back["review_tasks"], F.col("task_id") == F.col("id")).count() == 2 and back["review_files"].count() == 4
    state.snapshot(back, str(tmp_path / "backup"))
    assert state.restored(spark, str(tmp_path / "backup"), "review_tasks")["review_tasks"].count() == 2


def test_references(spark):
    parent, child = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, ref string")
    gone = parent.where("id IN ('a', 'c')")
    left, held = state.deleted(parent, gone, "id", child, "ref")
    assert {r.id for r in left.collect()} == {"a", "b"} and [r.id for r in held.collect()] == ["a"]
    assert {r.k: r.ref for r in state.nulled(child, gone, "ref").collect()} == {1: None, 2: "b", 3: None}
    old = spark.createDataFrame([("a", "k", 1), ("b", None, 2)], "id string, api_key string, n int")
    assert {tuple(r) for r in state.patched(old, spark.createDataFrame([("a", None, 5)], "id string, api_key string, n int"), "id").collect()} == {("a", "k", 5), ("b", None, 2)}
    assert state.with_kinds(spark.createDataFrame([(None,), (["x"],)], "check_types array<string>")).where("check_types IS NULL").count() == 0


def test_scrapes_and_node_rows(spark, tmp_path):
    for name, body in (("node=n%2F1/1000.prom", "vllm:prompt_tokens_total 5\n"), ("node=n%2F1/3000.prom", "vllm:prompt_tokens_total 9\n"), ("node=m/2000.error", "refused"), ("node=m/x.prom", "odd name"), ("other.prom", "odd place")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    s = scrapes.read(spark, str(tmp_path)).withColumn("display_name", F.col("node_id")).withColumn("base_url", F.lit("u"))
    got = {r.node_id: (r.metrics_available, r.error, r.prompt_throughput_tps) for r in metrics.node_rows(s).collect()}
    assert got == {"n/1": (True, None, 2.0), "m": (False, "refused", None)}
    q = scrapes.stream(spark, str(tmp_path)).writeStream.format("memory").queryName("scrapes").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scrapes").count() == 3


def test_retained_stream_is_exact(spark, tmp_path):
    rows = [("n", T0 + dt.timedelta(seconds=5 * i), float(i % 100)) for i in range(500)] + [("m", T0, float("nan"))]
    spark.createDataFrame(rows, "node_id string, captured_at timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "s"))
    out = peaks.retained_stream(spark.readStream.schema("node_id string, captured_at timestamp, value double").parquet(str(tmp_path / "s")))
    q = out.writeStream.format("memory").queryName("retained").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.node_id: (r.peak, r.samples) for r in spark.table("retained").collect()}
    assert got["n"] == (99.0, 360) and got["m"][1] == 1


def test_follow_ends_by_itself(spark, tmp_path):
    t = _tasks(spark, [("a", "running", 0, 1), ("b", "completed", 0, 1)])
    now, seen = [t], []
    t.coalesce(1).write.parquet(str(tmp_path / "in"))

    def report(counts):
        seen.append(counts)
        now[0] = t.withColumn("status", F.lit("completed"))
        t.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    q = progress.follow(spark.readStream.schema(TASK).parquet(str(tmp_path / "in")), lambda: now[0], report, str(tmp_path / "cp"), "100 milliseconds")
    q.awaitTermination(90)
    assert not q.isActive and seen[:2] == [{"queued": 0, "running": 1}, {"queued": 0, "running": 0}]


def test_lone_surrogates(spark):
    assert submissions.inline(spark, "int a; // \ud800").first().error == "not_unicode"


def test_packing_keeps_two_numbers(spark):
    rows = [("t", "a.c", i, 40) for i in range(5000)] + [("u", "a.c", 0, 500)]
    got = text.pack(spark.createDataFrame(rows, "task_id string, path string, chunk int, size int"), 100).collect()
    assert {r.batch for r in got if r.task_id == "u"} == {1} and max(r.batch for r in got) == 2500 and [r.batch for r in sorted(got) if r.task_id == "t"] == [i // 2 + 1 for i in range(5000)]


def test_deployments(spark):
    d = spark.createDataFrame([("x", "running", "n", 3, None, None)], "id string, status string, model_node_id string, progress int, log string, error_message string")
    e = spark.createDataFrame([("x", 2, "z" * 20_000)], "id string, code int, output string")
    r = deployments.finished(d, e).first()
    assert (r.status, r.progress, len(r.log), r.error_message) == ("failed", 100, 16_000, "deployment script exited with 2")


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
