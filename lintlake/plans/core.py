"""Queries over the tables of the review platform, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lintlake.functions import responses, text
from lintlake.operators import dashboard, findings, history, queue, state
from lintlake.plans.registry import latest_sql as L, query, stamp, stamp_sql
from lintlake.schemas import CATEGORIES, CHECK_TYPES, SEVERITIES, latest, table
from lintlake.sources import submissions

#: Columns of tasks without their logs.
TASK = "owner_id model_node_id input_mode display_name status progress queue_priority file_count finding_count duration_ms check_types created_at".split()
RANK_SQL = "CASE f.severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'suggestion' THEN 3 ELSE 99 END"


def tasks(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return latest(table(spark, d, "review_tasks"), *TASK, *more)


def reports(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "reports"), "task_id", *columns)


def parts(spark: SparkSession, d: str, *columns: str, **nested: str) -> DataFrame:
    """Latest reports with parts of their findings: only these are read, and only these pass the shuffle."""
    r = table(spark, d, "reports").where("result_json IS NOT NULL")
    return latest(r.select("id", "task_id", "updated_at", *columns, *[F.col(f"result_json.{v}").alias(k) for k, v in nested.items()]))


def files(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return latest(table(spark, d, "review_files"), "task_id", "relative_path", *columns)


def _history(spark, d, f: history.Filters, sort: str, descending: bool):
    users, nodes = table(spark, d, "users"), table(spark, d, "model_nodes")
    mine = latest(history.unchanging(table(spark, d, "review_tasks"), f), *TASK)  # these filters reach the scan
    counts = reports(spark, d, *[f"{s}_count" for s in SEVERITIES])
    return history.ordered(history.filtered(mine, users, counts, f), users, nodes, sort, descending)


F1 = history.Filters(status="completed", start="2025-06-01 00:00:00", severity="high")


@query(f"""SELECT t.id, t.display_name, u.username AS tester_name, r.id AS report_id, t.file_count, t.finding_count, {stamp_sql("t.created_at")} AS created_at
FROM {L("review_tasks")} t JOIN users u ON u.id = t.owner_id JOIN {L("reports")} r ON r.task_id = t.id
WHERE t.status = 'completed' AND t.created_at >= TIMESTAMP '2025-06-01 00:00:00' AND r.high_count > 0
ORDER BY u.username ASC NULLS FIRST, t.id DESC LIMIT 20 OFFSET 20""")
def history_page(spark, d):
    df, order = _history(spark, d, F1, "tester_name", False)
    shown = history.page(df, order, 20, 20)
    ids = reports(spark, d).select(F.col("id").alias("report_id"), F.col("task_id").alias("id"))
    return shown.join(ids, "id", "left").select("id", "display_name", "tester_name", "report_id", "file_count", "finding_count", stamp("created_at"))


@query(f"""SELECT count(*) AS total FROM {L("review_tasks")} t JOIN {L("reports")} r ON r.task_id = t.id
WHERE t.status = 'completed' AND t.created_at >= TIMESTAMP '2025-06-01 00:00:00' AND r.high_count > 0""")
def history_total(spark, d):
    df, _ = _history(spark, d, F1, "created_at", True)
    return df.agg(F.count("*").alias("total"))


@query(f"""SELECT t.id, t.display_name FROM {L("review_tasks")} t WHERE t.display_name LIKE '%.c%'
AND EXISTS (SELECT 1 FROM users u WHERE u.id = t.owner_id AND u.username LIKE '%a%')""")
def history_keyword_semi_join(spark, d):
    df, _ = _history(spark, d, history.Filters(keyword=".c", tester="a"), "created_at", True)
    return df.select("id", "display_name")


@query(f"""SELECT t.id, r.medium_count FROM {L("review_tasks")} t JOIN {L("reports")} r ON r.task_id = t.id WHERE r.medium_count > 0""")
def history_severity_join(spark, d):
    r = reports(spark, d, "medium_count").where("medium_count > 0").select(F.col("task_id").alias("id"), "medium_count")
    return tasks(spark, d).select("id").join(r, "id")


@query(f"""SELECT t.id, u.username AS tester_name, t.duration_ms FROM {L("review_tasks")} t JOIN users u ON u.id = t.owner_id
ORDER BY u.username DESC NULLS LAST, t.id DESC LIMIT 100""")
def history_sort_tester(spark, d):
    df, order = _history(spark, d, history.Filters(), "tester_name", True)
    return history.page(df, order, 0, 100).select("id", "tester_name", "duration_ms")


@query(f"""SELECT t.id, n.display_name AS model FROM {L("review_tasks")} t JOIN model_nodes n ON n.id = t.model_node_id
ORDER BY n.display_name ASC NULLS FIRST, t.id DESC LIMIT 50""")
def history_sort_model(spark, d):
    df, order = _history(spark, d, history.Filters(), "model", False)
    return history.page(df, order, 0, 50).select("id", "model")


@query(f"""SELECT t.id, t.duration_ms FROM {L("review_tasks")} t ORDER BY t.duration_ms ASC NULLS FIRST, t.id DESC LIMIT 100""")
def history_sort_duration(spark, d):
    df, order = _history(spark, d, history.Filters(), "duration_ms", False)
    return history.page(df, order, 0, 100).select("id", "duration_ms")


@query(f"""SELECT id, status, {stamp_sql("created_at")} AS created_at FROM {L("review_tasks")}
WHERE status = 'failed' AND created_at BETWEEN TIMESTAMP '2025-04-01' AND TIMESTAMP '2025-12-31' ORDER BY created_at DESC, id DESC LIMIT 20""")
def admin_tasks_page(spark, d):
    df, order = _history(spark, d, history.Filters(status="failed", start="2025-04-01 00:00:00", end="2025-12-31 00:00:00"), "created_at", True)
    return history.page(df, order).select("id", "status", stamp("created_at"))


@query(f"""SELECT t.id, t.owner_id FROM {L("review_tasks")} t WHERE t.owner_id = (SELECT min(id) FROM users WHERE lower(role) <> 'admin')""")
def visible_tasks_rls(spark, d):
    me = table(spark, d, "users").where("lower(role) <> 'admin'").agg(F.min_by(F.struct("id", "role"), "id").alias("x")).select("x.*")
    return history.visible(tasks(spark, d), me).select("id", "owner_id")


@query(f"""SELECT id, owner_id FROM {L("review_tasks")} WHERE EXISTS (SELECT 1 FROM users WHERE lower(role) = 'admin')""")
def visible_tasks_admin(spark, d):
    me = table(spark, d, "users").where("lower(role) = 'admin'").agg(F.min_by(F.struct("id", "role"), "id").alias("x")).select("x.*")
    return history.visible(tasks(spark, d), me).select("id", "owner_id")


@query(f"""SELECT t.id, {stamp_sql("t.created_at")} AS created_at FROM {L("review_tasks")} t WHERE owner_id = '{{OWNER}}' AND model_node_id IS NOT NULL ORDER BY t.created_at DESC, t.id DESC LIMIT 100""".replace("= '{OWNER}'", "= (SELECT min(owner_id) FROM review_tasks)"))
def history_of_owner(spark, d):
    owner = table(spark, d, "review_tasks").agg(F.min("owner_id")).first()[0]  # one value
    df, order = _history(spark, d, history.Filters(owner_id=owner), "created_at", True)
    return history.page(df.where("model_node_id IS NOT NULL"), order, 0, 100).select("id", stamp("created_at"))


@query(f"""SELECT id, file_count FROM {L("review_tasks")} WHERE model_node_id = (SELECT max(model_node_id) FROM review_tasks) ORDER BY file_count ASC NULLS FIRST, id DESC LIMIT 60""")
def history_of_node(spark, d):
    node = table(spark, d, "review_tasks").agg(F.max("model_node_id")).first()[0]  # one value
    df, order = _history(spark, d, history.Filters(model_node_id=node), "file_count", False)
    return history.page(df, order, 0, 60).select("id", "file_count")


@query("""SELECT id, display_name, (row_number() OVER (ORDER BY is_default DESC, created_at ASC, id))::INT AS place FROM model_nodes WHERE is_enabled""")
def enabled_nodes(spark, d):
    n = table(spark, d, "model_nodes").where(F.col("is_enabled").eqNullSafe(True))  # ten rows
    return n.select("id", "display_name", F.row_number().over(Window.orderBy(F.col("is_default").desc(), F.col("created_at").asc(), F.col("id"))).alias("place"))


@query(f"""SELECT t.id, r.id AS report_id, r.score FROM {L("review_tasks")} t LEFT JOIN {L("reports")} r ON r.task_id = t.id""")
def tasks_left_report(spark, d):
    r = reports(spark, d, "score").select(F.col("task_id").alias("id"), F.col("id").alias("report_id"), "score")
    return tasks(spark, d).select("id").join(r, "id", "left").select("id", "report_id", "score")


@query(f"""SELECT task_id, count(*) AS files, string_agg(relative_path, '|' ORDER BY relative_path, id) AS paths, sum(size_bytes)::BIGINT AS bytes
FROM {L("review_files")} GROUP BY task_id""")
def task_files_nested(spark, d):
    f = files(spark, d, "size_bytes").groupBy("task_id").agg(F.count("*").alias("files"), F.array_sort(F.collect_list(F.struct("relative_path", "id"))).alias("all"), F.sum("size_bytes").alias("bytes"))
    return f.select("task_id", "files", F.array_join(F.transform("all", lambda x: x.relative_path), "|").alias("paths"), "bytes")


@query(f"""SELECT id, (row_number() OVER (ORDER BY queue_priority DESC, created_at ASC, id ASC) - 1)::BIGINT AS ahead
FROM {L("review_tasks")} WHERE status = 'queued'""")
def queue_positions(spark, d):
    return queue.positions(tasks(spark, d))


@query(f"""SELECT id, queue_priority FROM {L("review_tasks")} WHERE status = 'queued' ORDER BY queue_priority DESC, created_at ASC, id ASC LIMIT 1""")
def queue_top1(spark, d):
    return tasks(spark, d).where("status = 'queued'").orderBy(*queue.order()).limit(1).select("id", "queue_priority")


_IDLE = f"(SELECT * REPLACE (CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status) FROM {L('review_tasks')})"


@query(f"""WITH t AS {_IDLE}, h AS (SELECT id FROM t WHERE status = 'queued' ORDER BY queue_priority DESC, created_at ASC, id ASC LIMIT 1)
SELECT id, CASE WHEN id IN (SELECT id FROM h) THEN 'running' ELSE status END AS status,
CASE WHEN id IN (SELECT id FROM h) THEN greatest(progress, 1) ELSE progress END AS progress FROM t""")
def dispatch_next_state(spark, d):
    idle = tasks(spark, d).withColumn("status", F.when(F.col("status") == "running", "failed").otherwise(F.col("status")))
    return queue.dispatched(idle, queue.head(idle)).select("id", "status", "progress")


@query(f"""WITH t AS {L("review_tasks")}, h AS (SELECT max(id) AS id FROM t WHERE status = 'queued')
SELECT id, CASE WHEN id = (SELECT id FROM h) THEN (SELECT coalesce(max(queue_priority), 0) + 1 FROM t) ELSE queue_priority END AS queue_priority FROM t""")
def pin_task_state(spark, d):
    t = tasks(spark, d)
    chosen = F.broadcast(t.where("status = 'queued'").agg(F.max("id").alias("pin")))  # one row
    return queue.pinned(t.crossJoin(chosen), F.col("pin")).select("id", "queue_priority")


@query(f"SELECT status, count(*) AS tasks FROM {L('review_tasks')} GROUP BY status")
def dashboard_status_counts(spark, d):
    return dashboard.status_counts(tasks(spark, d))


@query(f"""SELECT t.*, u.*, n.* FROM (SELECT count(*) AS tasks, {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_tasks" for s in dashboard.STATUSES)} FROM {L("review_tasks")}) t,
(SELECT count(*) AS users, count(*) FILTER (WHERE is_enabled) AS enabled_users FROM users) u, (SELECT count(*) AS models, count(*) FILTER (WHERE is_enabled) AS enabled_models FROM model_nodes) n""")
def dashboard_pivot(spark, d):
    return dashboard.overview(tasks(spark, d), table(spark, d, "users"), table(spark, d, "model_nodes"))


@query(f"""SELECT count(*) AS tasks, count(*) FILTER (WHERE status = 'completed') AS completed, sum(finding_count)::BIGINT AS findings, sum(file_count)::BIGINT AS files
FROM (SELECT * FROM {L("review_tasks")} ORDER BY created_at DESC, id DESC LIMIT 6)""")
def recent6_summary(spark, d):
    return dashboard.recent(tasks(spark, d))


@query(f"""SELECT model_node_id, count(*) AS tasks, round(100.0 * count(*) FILTER (WHERE status = 'running') / count(*), 1) AS running_percent,
round(100.0 * count(*) FILTER (WHERE status = 'failed') / count(*), 2) AS failed_percent FROM {L("review_tasks")} GROUP BY model_node_id""")
def running_percent(spark, d):
    t = tasks(spark, d).groupBy("model_node_id").agg(F.count("*").alias("tasks"), F.count_if(F.col("status") == "running").alias("r"), F.count_if(F.col("status") == "failed").alias("x"))
    return t.select("model_node_id", "tasks", dashboard.percent(F.col("r"), F.col("tasks"), 1).alias("running_percent"), dashboard.percent(F.col("x"), F.col("tasks")).alias("failed_percent"))


@query(f"""SELECT id, {", ".join(f"len([f FOR f IN result_json.findings IF f.severity = '{s}'])::INT AS {s}_found" for s in SEVERITIES)} FROM {L("reports")} WHERE result_json IS NOT NULL""")
def severity_histogram(spark, d):
    return parts(spark, d, severities="findings.severity").select("id", *findings.severity_counts(F.col("severities")))


@query(f"""SELECT id, {", ".join(f"{s}_count <> len([f FOR f IN result_json.findings IF f.severity = '{s}']) AS {s}_stale" for s in SEVERITIES)} FROM {L("reports")} WHERE result_json IS NOT NULL
AND ({" OR ".join(f"{s}_count <> len([f FOR f IN result_json.findings IF f.severity = '{s}'])" for s in SEVERITIES)})""")
def stale_counts(spark, d):
    stored = [f"{s}_count" for s in SEVERITIES]
    r = parts(spark, d, *stored, severities="findings.severity").select("id", *stored, *findings.severity_counts(F.col("severities")))
    wrong = {s: F.col(f"{s}_count") != F.col(f"{s}_found") for s in SEVERITIES}
    return r.where(wrong["high"] | wrong["medium"] | wrong["low"] | wrong["suggestion"]).select("id", *[c.alias(f"{s}_stale") for s, c in wrong.items()])


@query(f"""SELECT id, f.category AS category, count(*)::INT AS n FROM (SELECT id, unnest(result_json.findings) AS f FROM {L("reports")}) GROUP BY 1, 2""")
def category_counts_long(spark, d):
    r = parts(spark, d, categories="findings.category").select("id", findings.category_counts(F.col("categories")).alias("m"))
    return r.select("id", F.explode("m").alias("category", "n"))


@query(f"""WITH p AS (SELECT t.model_node_id AS task_id, r.result_json.score AS score, len(r.result_json.findings) AS n FROM {L("reports")} r JOIN {L("review_tasks")} t ON t.id = r.task_id WHERE r.result_json IS NOT NULL)
SELECT task_id, CASE WHEN sum(n) > 0 THEN greatest(0.0, min(score)) ELSE round(avg(score), 2) END AS score, sum(n)::BIGINT AS finding_count FROM p GROUP BY task_id""")
def merge_score(spark, d):
    each = parts(spark, d, score="score", findings="findings.severity").join(tasks(spark, d).select(F.col("id").alias("task_id"), "model_node_id"), "task_id")
    return findings.merged(each.select(F.col("model_node_id").alias("task_id"), "score", "findings"))


@query(f"""SELECT id, (row_number() OVER (PARTITION BY id ORDER BY {RANK_SQL}, f.file_path, coalesce(nullif(f.line, 0), 1000000000), i))::INT AS n, f.severity AS severity, f.file_path AS file_path, f.line AS line, f.title AS title
FROM (SELECT id, unnest(result_json.findings) AS f, generate_subscripts(result_json.findings, 1) AS i FROM {L("reports")})""")
def findings_sorted(spark, d):
    names = ("severity", "file_path", "line", "title")
    r = parts(spark, d, **{k: f"findings.{k}" for k in names}).select("id", F.posexplode(findings.ranked(F.arrays_zip(*names))).alias("at", "x"))
    return r.select("id", (F.col("at") + 1).alias("n"), "x.f.severity", "x.f.file_path", "x.f.line", "x.f.title")


@query(f"""SELECT r.id, s.severity, p.page::INT AS page, array_to_string([f.title FOR f IN r.result_json.findings IF f.severity = s.severity][p.page * 15 - 14:p.page * 15], '|') AS titles
FROM {L("reports")} r, (SELECT unnest({SEVERITIES}) AS severity) s, (SELECT unnest([1, 2]) AS page) p WHERE r.result_json IS NOT NULL""")
def findings_page15(spark, d):
    each = parts(spark, d, severity="findings.severity", title="findings.title").select("id", F.arrays_zip("severity", "title").alias("f"), F.explode(F.array(*map(F.lit, SEVERITIES))).alias("severity"))
    paged = each.select("id", "severity", "f", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"))
    return paged.select("id", "severity", "page", F.array_join(F.transform(findings.page(F.col("f"), F.col("severity"), F.col("page")), lambda f: f.title), "|").alias("titles"))


@query(f"SELECT id, score, CASE WHEN score >= 85 THEN 'good' WHEN score >= 60 THEN 'warning' ELSE 'danger' END AS tone FROM {L('reports')}")
def score_tone(spark, d):
    return reports(spark, d, "score").select("id", "score", findings.tone(F.col("score")).alias("tone"))


@query(f"""WITH n AS (SELECT task_id, list(relative_path ORDER BY relative_path, id) AS files FROM {L("review_files")} GROUP BY 1),
t AS (SELECT t.*, n.files, greatest(t.file_count, coalesce(len(n.files), 0), CASE WHEN input_mode = 'text' THEN 1 ELSE 0 END) AS total FROM {L("review_tasks")} t LEFT JOIN n ON n.task_id = t.id),
c AS (SELECT *, CASE WHEN status = 'running' THEN least(floor(progress / 100.0 * total)::INT, greatest(0, total - 1)) ELSE 0 END AS done FROM t)
SELECT id, CASE WHEN status IN ('completed', 'failed') THEN status WHEN status = 'queued' THEN 'pending' ELSE 'analyzing' END AS state,
CASE WHEN status = 'completed' THEN NULL WHEN input_mode = 'text' THEN 'snippet' ELSE coalesce(nullif(files[done + 1], ''), display_name) END AS current,
(CASE status WHEN 'completed' THEN 0 WHEN 'failed' THEN greatest(0, total - done) WHEN 'queued' THEN total ELSE greatest(0, total - done - 1) END)::INT AS remaining FROM c""")
def progress_summary(spark, d):
    f = files(spark, d).select("task_id", "relative_path", F.struct("relative_path", "id").alias("pos"))
    return queue.progress(tasks(spark, d), f)


_NL = "chr(10)"


def _snip(title: str, column: str) -> str:
    return f"CASE WHEN len({column}) > 0 THEN '**{title}:**' || {_NL} || {_NL} || '```c' || {_NL} || array_to_string([coalesce(x.content, '') FOR x IN {column}], {_NL}) || {_NL} || '```' || {_NL} || {_NL} ELSE '' END"


@query(f"""WITH r AS {L("reports")}, t AS {L("review_tasks")},
f AS (SELECT id, unnest(result_json.findings) AS f, generate_subscripts(result_json.findings, 1) AS i FROM r),
b AS (SELECT id, string_agg('### ' || i || '. [' || upper(f.severity) || '] ' || f.title || {_NL} || {_NL} || '- Category: `' || f.category || '`' || {_NL} || '- Location: `' || f.file_path || CASE WHEN coalesce(f.line, 0) <> 0 THEN ':' || f.line ELSE '' END || '`' || {_NL} || {_NL}
|| coalesce(f.description, '') || {_NL} || {_NL} || '**Remediation:** ' || coalesce(f.remediation, '') || {_NL} || {_NL} || {_snip("Problematic code", "f.code_snippet")} || {_snip("Suggested code", "f.fixed_snippet")}, '' ORDER BY i) AS body FROM f GROUP BY id)
SELECT r.task_id, regexp_replace('# C Language Code Review Report' || {_NL} || {_NL} || '- Task: `' || t.id || '`' || {_NL} || '- Submission: `' || t.display_name || '`' || {_NL} || '- Model: `' || n.display_name || '`' || {_NL} || '- Score: `' || format('{{:g}}', r.score) || '`' || {_NL} || {_NL} || '## Summary' || {_NL} || {_NL}
|| coalesce(r.summary, '') || {_NL} || {_NL} || '## Findings' || {_NL} || {_NL} || coalesce(b.body, 'No findings.'), '\\s+$', '') || {_NL} AS markdown
FROM r JOIN t ON t.id = r.task_id JOIN model_nodes n ON n.id = t.model_node_id LEFT JOIN b ON b.id = r.id""")
def markdown_report(spark, d):
    t = tasks(spark, d).select(F.col("id").alias("task_id"), "display_name", "model_node_id")
    n = table(spark, d, "model_nodes").select(F.col("id").alias("model_node_id"), F.col("display_name").alias("model"))
    r = reports(spark, d, "score", "summary", "result_json").join(t, "task_id").join(n, "model_node_id")
    return r.select("task_id", findings.markdown(*[F.col(c) for c in ("task_id", "display_name", "model", "score", "summary", "result_json.findings")]).alias("markdown"))


SPLIT_SQL = r"string_split_regex(source_text, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
LINES_SQL = f"CASE WHEN source_text = '' THEN [] WHEN {SPLIT_SQL}[-1] = '' THEN {SPLIT_SQL}[:-2] ELSE {SPLIT_SQL} END"


@query(f"SELECT id, len({LINES_SQL})::INT AS lines, coalesce(list_max([length(x) FOR x IN {LINES_SQL}]), 0)::INT AS longest FROM {L('review_files')} WHERE source_text IS NOT NULL")
def split_lines(spark, d):
    f = files(spark, d, "source_text").where("source_text IS NOT NULL").select("id", text.lines(F.col("source_text")).alias("x"))
    return f.select("id", F.size("x").alias("lines"), F.coalesce(F.array_max(F.transform("x", lambda v: F.length(v))), F.lit(0)).alias("longest"))


BUDGET = text.budget(2000)
_ROOM = max(1, BUDGET - text.PREFIX - 3)
CHUNK_SQL = f"""f AS (SELECT id, task_id, relative_path, source_text, {LINES_SQL} AS ls FROM {L("review_files")} WHERE source_text IS NOT NULL),
l AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM f),
s AS (SELECT id, ln, k, 9 + greatest(least(length(line) - k * {_ROOM}, {_ROOM}), 0) AS cost FROM l, LATERAL (SELECT unnest(range(0, greatest(1, ((length(line) + {_ROOM - 1}) // {_ROOM})::BIGINT))) AS k)),
o AS (SELECT id, ln, cost, row_number() OVER (PARTITION BY id ORDER BY ln, k) AS i FROM s),
w AS (SELECT id, i, ln, cost AS used, 0 AS chunk, ln AS first FROM o WHERE i = 1
  UNION ALL SELECT o.id, o.i, o.ln, CASE WHEN w.used + o.cost > {BUDGET} THEN o.cost ELSE w.used + o.cost END, w.chunk + CASE WHEN w.used + o.cost > {BUDGET} THEN 1 ELSE 0 END, CASE WHEN w.used + o.cost > {BUDGET} THEN o.ln ELSE w.first END
  FROM w JOIN o ON o.id = w.id AND o.i = w.i + 1),
c AS (SELECT f.task_id, f.id AS file_id, f.relative_path AS path, w.chunk, min(w.first) AS start_line, max(w.ln) AS end_line, max(w.used) AS characters FROM w JOIN f ON f.id = w.id GROUP BY ALL
  UNION ALL SELECT task_id, id, relative_path, 0, 1, 1, 0 FROM f WHERE len(ls) = 0)"""


@query(f"WITH RECURSIVE {CHUNK_SQL} SELECT file_id, chunk::INT AS chunk, start_line::INT AS start_line, end_line::INT AS end_line, characters::INT AS characters FROM c")
def chunk_files(spark, d):
    return text.chunk(files(spark, d, "source_text"), BUDGET).select("file_id", "chunk", "start_line", "end_line", "characters")


@query(f"""WITH RECURSIVE {CHUNK_SQL}, z AS (SELECT c.task_id, c.path, c.chunk, length('===== FILE: ' || c.path || ' =====' || {_NL}) + CASE WHEN len(f.ls) = 0 THEN length(f.source_text) ELSE c.characters - 1 END + 2 AS size, row_number() OVER (PARTITION BY c.task_id ORDER BY c.path, c.chunk, length('===== FILE: ' || c.path || ' =====' || {_NL}) + CASE WHEN len(f.ls) = 0 THEN length(f.source_text) ELSE c.characters - 1 END + 2) AS i FROM c JOIN f ON f.id = c.file_id),
b AS (SELECT task_id, path, chunk, i, size AS used, 1 AS batch FROM z WHERE i = 1
  UNION ALL SELECT z.task_id, z.path, z.chunk, z.i, CASE WHEN b.used + z.size > {BUDGET} THEN z.size ELSE b.used + z.size END, b.batch + CASE WHEN b.used + z.size > {BUDGET} THEN 1 ELSE 0 END FROM b JOIN z ON z.task_id = b.task_id AND z.i = b.i + 1)
SELECT task_id, path, chunk::INT AS chunk, batch::INT AS batch FROM b""")
def chunk_batches(spark, d):
    return text.pack(text.chunk(files(spark, d, "source_text"), BUDGET), BUDGET).select("task_id", "path", "chunk", "batch")


@query(f"""SELECT task_id, sum(length('===== FILE: ' || relative_path || ' =====' || {_NL} || source_text) + 2)::BIGINT - 2 AS characters,
sum(length('===== FILE: ' || relative_path || ' =====' || {_NL} || source_text) + 2) - 2 > {text.budget(12000)} AS split FROM {L("review_files")} WHERE source_text IS NOT NULL GROUP BY task_id""")
def should_chunk(spark, d):
    size = F.sum(text.payload(F.col("relative_path"), F.col("source_text")) + 2).cast("long") - 2
    return files(spark, d, "source_text").where("source_text IS NOT NULL").groupBy("task_id").agg(size.alias("characters")).withColumn("split", F.col("characters") > text.budget(12000))


@query(f"""SELECT id, task_id, (count(*) OVER w)::BIGINT AS files, (sum(size_bytes) OVER w)::BIGINT AS bytes, (count(*) OVER w) > 5 OR (sum(size_bytes) OVER w) > 8000 AS over
FROM {L("review_files")} WINDOW w AS (PARTITION BY task_id ORDER BY relative_path, id ROWS UNBOUNDED PRECEDING)""")
def running_caps(spark, d):
    w = Window.partitionBy("task_id").orderBy("relative_path", "id").rowsBetween(Window.unboundedPreceding, 0)
    f = files(spark, d, "size_bytes").select("id", "task_id", F.count("*").over(w).alias("files"), F.sum("size_bytes").over(w).alias("bytes"))
    return f.withColumn("over", (F.col("files") > 5) | (F.col("bytes") > 8000))


@query(f"""SELECT id, relative_path FROM {L("review_files")} QUALIFY row_number() OVER (PARTITION BY task_id[1:1], replace(relative_path, '\\', '/') ORDER BY id) > 1""")
def duplicate_paths(spark, d):
    # within one task no path comes twice, so the tasks whose ids begin alike stand for one submission
    f = files(spark, d).select("id", "relative_path", F.left("task_id", F.lit(1)).alias("submission"), F.translate("relative_path", "\\", "/").alias("clean"))
    return f.withColumn("twice", submissions.repeated("submission", "clean", "id")).where("twice").select("id", "relative_path")


@query(rf"""WITH p AS (SELECT id, relative_path, replace(relative_path, '\', '/') AS p FROM {L("review_files")})
SELECT id, CASE WHEN p = '' OR p LIKE '/%' OR regexp_matches(p, '^[A-Za-z]:') OR regexp_matches(p, '(^|/)\.\.(/|$)') THEN 'unsafe' WHEN length(p) > 512 THEN 'too_long' END AS wrong,
lower(regexp_extract(p, '[^/](\.[^./]+)$', 1)) AS suffix, lower(regexp_extract(p, '[^/](\.[^./]+)$', 1)) IN ('.c', '.h') AS source FROM p""")
def path_safety(spark, d):
    p = F.col("relative_path")
    return files(spark, d).select("id", text.unsafe_path(p).alias("wrong"), text.suffix(p).alias("suffix"), text.suffix(p).isin(".c", ".h").alias("source"))


@query(f"""SELECT id, size_bytes, octet_length(encode(source_text))::INT AS real_bytes FROM {L("review_files")} WHERE size_bytes <> octet_length(encode(source_text))""")
def wrong_sizes(spark, d):
    f = files(spark, d, "size_bytes", "source_text").select("id", "size_bytes", F.octet_length(F.encode("source_text", "UTF-8")).alias("real_bytes"))
    return f.where("size_bytes <> real_bytes")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]'))::INT AS cjk, len(regexp_extract_all(text, '[\x{0300}-\x{05FF}\x{FFFD}]'))::INT AS suspicious,
len(regexp_extract_all(text, '[\x{3040}-\x{30FF}]'))::INT AS kana, len(regexp_extract_all(text, '\x00'))::INT AS nul FROM documents WHERE text IS NOT NULL""")
def char_class_counts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *text.character_classes(F.col("text")))


_DOMAIN = "[" + ", ".join(f"'{c}'" for c in CHECK_TYPES) + "]"


@query(f"""SELECT id, array_to_string([check_types[i] FOR i IN range(1, len(check_types) + 1) IF list_position(check_types, check_types[i]) = i], ',') AS kinds, len(list_distinct(check_types))::INT AS n FROM {L("review_tasks")}""")
def check_types_distinct(spark, d):
    return tasks(spark, d).select("id", F.array_join(F.array_distinct("check_types"), ",").alias("kinds"), F.size(F.array_distinct("check_types")).alias("n"))


@query(f"""SELECT id, CASE WHEN len(check_types) = 0 OR check_types IS NULL THEN 'none' WHEN len([x FOR x IN check_types IF NOT list_contains({_DOMAIN}, x)]) > 0 THEN 'unsupported' ELSE 'ok' END AS verdict,
array_to_string([x FOR x IN check_types IF NOT list_contains({_DOMAIN}, x)], ',') AS unsupported FROM {L("review_tasks")}""")
def unsupported_types(spark, d):
    x = tasks(spark, d).select("id", responses.supported(F.col("check_types"), CHECK_TYPES).alias("x"))
    return x.select("id", "x.verdict", F.array_join("x.unsupported", ",").alias("unsupported"))


@query(None)
def json_contract_parse(spark, d):
    raw = responses.raw_answers(latest(table(spark, d, "review_tasks"), "model_log")).withColumn("ref", F.concat_ws("#", "task_id", F.col("entry").cast("string")))
    return responses.parse(raw, "ref", "content").select("ref", "status", "error", "summary", "score", F.size("findings").alias("findings"))


_TEXTS = " AND ".join(f"coalesce(length(f.{k}), 0) BETWEEN {a} AND {b}" for k, (a, b) in responses.TEXTS.items())
_LINES = " AND ".join(f"(f.{k} IS NULL OR len(f.{k}) <= {responses.MOST_LINES} AND len([x FOR x IN f.{k} IF x.line < 1 OR x.content IS NULL]) = 0)" for k in ("code_snippet", "fixed_snippet"))
_FINDING_OK = f"f.severity IN {tuple(SEVERITIES)} AND f.category IN {tuple(CATEGORIES)} AND {_TEXTS} AND (f.line IS NULL OR f.line >= 1) AND {_LINES}"


@query(f"""WITH r AS (SELECT id, result_json AS j FROM {L("reports")} WHERE result_json IS NOT NULL),
x AS (SELECT id, j, coalesce(length(j.summary), 0) BETWEEN {responses.SUMMARY[0]} AND {responses.SUMMARY[1]} AND j.score BETWEEN 0 AND 100 AND (SELECT coalesce(bool_and(coalesce({_FINDING_OK}, false)), true) FROM (SELECT unnest(j.findings) AS f)) AS ok FROM r)
SELECT id, CASE WHEN ok THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN ok THEN j.summary END AS summary, CASE WHEN ok THEN j.score END AS score, CASE WHEN ok THEN array_to_string([f.severity || ':' || f.file_path || ':' || coalesce(f.line, 0) || ':' || f.title FOR f IN j.findings], '|') END AS findings FROM x""")
def json_contract_round_trip(spark, d):
    """Every stored result as JSON text, within a code fence, read again by the contract."""
    r = latest(table(spark, d, "reports"), "result_json").where("result_json IS NOT NULL")
    raw = r.select("id", F.concat(F.lit("```json\n"), F.to_json("result_json", {"ignoreNullFields": "false"}), F.lit("\n```")).alias("content"))
    one = lambda f: F.concat_ws(":", f.severity, f.file_path, F.coalesce(f.line, F.lit(0)).cast("string"), f.title)
    return responses.parse(raw, "id", "content").select("id", "status", "summary", "score", F.array_join(F.transform("findings", one), "|").alias("findings"))


@query(f"""WITH e AS (SELECT id, unnest(string_split_regex(model_log, '\\n\\n\\[')) AS t FROM {L("review_tasks")}) SELECT id AS task_id, count(*) AS answers FROM e WHERE contains(t, {_NL} || 'Raw model response:' || {_NL}) GROUP BY id""")
def raw_answers_count(spark, d):
    return responses.raw_answers(latest(table(spark, d, "review_tasks"), "model_log")).groupBy("task_id").agg(F.count("*").alias("answers"))


@query(f"""SELECT id, CASE WHEN length(model_log) > 1000 THEN model_log[1:1000] || {_NL} || '... [truncated ' || (length(model_log) - 1000) || ' chars]' ELSE model_log END AS log, model_log[-200:] AS tail FROM {L("review_tasks")}""")
def log_truncate(spark, d):
    return latest(table(spark, d, "review_tasks"), "model_log").select("id", text.truncated(F.col("model_log"), 1000).alias("log"), text.tail(F.col("model_log"), 200).alias("tail"))


_HIT = f"[x FOR x IN string_split(model_log, {_NL}) IF regexp_matches(x, '(?i)error|failed|exception|traceback|docker:')]"


@query(f"SELECT id, array_to_string({_HIT}[-3:], ' / ') AS important FROM {L('review_tasks')} WHERE model_log IS NOT NULL AND len({_HIT}) > 0")
def log_important_lines(spark, d):
    out = latest(table(spark, d, "review_tasks"), "model_log").where("model_log IS NOT NULL").select("id", text.important(F.col("model_log")).alias("important"))
    return out.where("important <> ''")


@query(f"""WITH old AS (SELECT id, status, updated_at FROM {L("review_tasks")}), new AS (SELECT id, 'again' AS status, updated_at + INTERVAL 1 DAY AS updated_at FROM old WHERE status = 'failed')
SELECT id, status FROM (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, n DESC) = 1""")
def latest_union_upsert(spark, d):
    old = tasks(spark, d).select("id", "status", "updated_at")
    new = old.where("status = 'failed'").select("id", F.lit("again").alias("status"), (F.col("updated_at") + F.expr("INTERVAL 1 DAY")).alias("updated_at"))
    return state.upserted(old, new, "id", "updated_at").select("id", "status")


@query("""SELECT id, is_enabled AND row_number() OVER (ORDER BY is_default DESC, is_enabled DESC, created_at, id) = 1 AS is_default FROM (SELECT * REPLACE (false AS is_default) FROM model_nodes)""")
def default_model_backfill(spark, d):
    return state.default_node(table(spark, d, "model_nodes").withColumn("is_default", F.lit(False))).select("id", "is_default")


_GONE = "(SELECT id FROM users WHERE NOT is_enabled)"


@query(f"""SELECT (SELECT count(*) FROM users WHERE id NOT IN {_GONE}) AS users, (SELECT count(*) FROM {L("review_tasks")} WHERE owner_id NOT IN {_GONE}) AS tasks,
(SELECT count(*) FROM {L("review_files")} WHERE task_id NOT IN (SELECT id FROM review_tasks WHERE owner_id IN {_GONE})) AS files,
(SELECT count(*) FROM {L("reports")} WHERE task_id NOT IN (SELECT id FROM review_tasks WHERE owner_id IN {_GONE})) AS reports""")
def cascade_delete(spark, d):
    users = table(spark, d, "users")
    left = state.cascaded(users, tasks(spark, d), files(spark, d), reports(spark, d), users.where("NOT is_enabled").select("id"))
    counts = [df.agg(F.count("*").alias(name)) for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(F.broadcast(c))  # one row each
    return out


@query("""SELECT id, coalesce(nullif(description, ''), nullif(display_name, ''), model_identifier) AS label FROM model_nodes""")
def coalesce_chain(spark, d):
    n = table(spark, d, "model_nodes")
    return n.select("id", text.first_filled(F.col("description"), F.col("display_name"), F.col("model_identifier")).alias("label"))


_LABELS = {"memory_safety": "Memory", "logic": "Logic", "style": "Style"}


@query(f"""SELECT f.category AS category, coalesce(map {_LABELS}[f.category], f.category) AS label, count(*) AS n FROM (SELECT unnest(result_json.findings) AS f FROM {L("reports")}) GROUP BY 1, 2""")
def label_lookup(spark, d):
    f = parts(spark, d, categories="findings.category").select(F.explode("categories").alias("category"))
    return f.select("category", text.labelled(F.col("category"), _LABELS).alias("label")).groupBy("category", "label").agg(F.count("*").alias("n"))


@query(f"""SELECT repository, language, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM (SELECT split_part(replace(relative_path, '\\', '/'), '/', 1) AS repository, lower(regexp_extract(relative_path, '\\.([^./]+)$', 1)) AS language, size_bytes FROM {L("review_files")}) GROUP BY 1, 2""")
def repository_sizes(spark, d):
    f = files(spark, d, "size_bytes").select(F.split(F.translate("relative_path", "\\", "/"), "/")[0].alias("repository"), F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1)).alias("language"), "size_bytes")
    return f.groupBy("repository", "language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query(f"""SELECT t.id, t.file_count, coalesce(n.files, 0) AS files FROM {L("review_tasks")} t LEFT JOIN (SELECT task_id, count(*) AS files FROM {L("review_files")} GROUP BY 1) n ON n.task_id = t.id WHERE t.file_count <> coalesce(n.files, 0)""")
def wrong_file_counts(spark, d):
    n = files(spark, d).groupBy("task_id").agg(F.count("*").alias("files"))
    t = tasks(spark, d).select("id", "file_count").join(n.withColumnRenamed("task_id", "id"), "id", "left")
    return t.select("id", "file_count", F.coalesce("files", F.lit(0)).alias("files")).where("file_count <> files")


assert set(CHECK_TYPES) < set(CATEGORIES)
