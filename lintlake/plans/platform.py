"""Queries of task runs, deployments, runtime metrics and changes of tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lintlake.functions import metrics, responses, text
from lintlake.operators import attempts, deployments, findings, queue, state
from lintlake.plans.core import CHUNK_SQL, BUDGET, RANK_SQL, files, parts, tasks
from lintlake.plans.registry import latest_sql as L, query
from lintlake.schemas import CHECK_TYPES, latest, table
from lintlake.sources import submissions

_NL = "chr(10)"


@query(f"""SELECT id, CASE WHEN file_count > 0 THEN greatest(progress, least(95, 10 + floor(least(finding_count, file_count) / file_count * 85))) ELSE progress END::INT AS chunked, least(90, 10 + finding_count * 25)::INT AS retried FROM {L("review_tasks")}""")
def derived_progress(spark, d):
    done = F.least("finding_count", "file_count")
    return tasks(spark, d).select("id", attempts.chunk_progress(F.col("progress"), done, F.col("file_count")).alias("chunked"), attempts.retry_progress(F.col("finding_count")).alias("retried"))


_TRIES = f"""(SELECT id AS task_id, regexp_extract(e, 'Attempt (\\d+)', 1)::INT AS attempt, contains(e, 'succeeded') AS ok, coalesce(try_cast(regexp_extract(e, 'succeeded with (\\d+) finding', 1) AS INT), 0) AS findings,
CASE WHEN contains(e, 'failed: ') THEN regexp_extract(e, 'failed: ([^\\n]*)', 1) END AS message, started_at FROM (SELECT id, started_at, unnest(regexp_extract_all(model_log, '\\] Attempt \\d+ (?:succeeded with \\d+ finding|failed: [^\\n]*)')) AS e FROM {L("review_tasks")}))"""
_AT = "'[' || strftime(started_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(started_at, '%f') = '000000' THEN '' ELSE '.' || strftime(started_at, '%f') END || '+00:00] '"


def _tried(spark, d):
    """The attempts that the logs tell of, as a table."""
    t = latest(table(spark, d, "review_tasks"), "model_log", "started_at").select("id", "started_at", F.explode(F.regexp_extract_all("model_log", F.lit(r"\] Attempt \d+ (?:succeeded with \d+ finding|failed: [^\n]*)"), 0)).alias("e"))
    part = lambda p: F.regexp_extract("e", p, 1)
    failed = F.col("e").contains("failed: ")
    return t.select(F.col("id").alias("task_id"), part(r"Attempt (\d+)").cast("int").alias("attempt"), F.col("started_at").alias("at"), F.col("e").contains("succeeded").alias("succeeded"), F.coalesce(part(r"succeeded with (\d+) finding").try_cast("int"), F.lit(0)).alias("findings"), F.when(failed, part(r"failed: ([^\n]*)")).alias("message"), F.col("e").contains("schema").alias("audit"))


@query(f"""WITH a AS (SELECT DISTINCT * FROM {_TRIES} WHERE attempt BETWEEN 1 AND 2), w AS (SELECT task_id, min(attempt) FILTER (ok) AS won, FROM a GROUP BY 1),
r AS (SELECT a.* FROM a JOIN w USING (task_id) WHERE attempt <= coalesce(won, 2)), l AS (SELECT *, count(*) OVER (PARTITION BY task_id) AS n FROM r QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY attempt DESC) = 1),
g AS (SELECT task_id, string_agg({_AT} || 'Attempt ' || attempt || ' started.' || {_NL} || {_NL} || {_AT} || 'Attempt ' || attempt || CASE WHEN ok THEN ' succeeded with ' || findings || ' finding(s).' ELSE ' failed: ' || message END, {_NL} || {_NL} ORDER BY attempt) AS log FROM r GROUP BY 1)
SELECT t.id, CASE WHEN l.task_id IS NULL THEN t.status WHEN ok THEN 'completed' WHEN attempt >= 2 THEN 'failed' ELSE 'running' END AS status, (CASE WHEN l.task_id IS NULL THEN t.progress WHEN ok OR attempt >= 2 THEN 100 ELSE least(90, 10 + 25 * attempt) END)::INT AS progress,
CASE WHEN l.task_id IS NULL THEN t.finding_count WHEN ok THEN l.findings ELSE 0 END::INT AS finding_count,
CASE WHEN l.task_id IS NULL THEN t.error_message WHEN ok THEN NULL WHEN attempt >= 2 THEN CASE WHEN contains(message, 'schema') THEN 'model output audit failed after 2 attempts' ELSE message[1:1000] END ELSE (message || '; retrying (' || attempt || '/2)')[1:1000] END AS error_message,
coalesce(l.n, 0)::INT AS attempts, CASE WHEN l.task_id IS NULL THEN t.model_log ELSE g.log END AS model_log FROM {L("review_tasks")} t LEFT JOIN l ON l.task_id = t.id LEFT JOIN g ON g.task_id = t.id""")
def apply_attempts(spark, d):
    return attempts.applied(tasks(spark, d, "error_message", "model_log"), _tried(spark, d), 2)


@query(f"""SELECT id, CASE WHEN coalesce(model_log, '') = '' THEN {_AT} || 'Final audit result.' ELSE CASE WHEN length(model_log || {_NL} || {_NL} || {_AT} || 'Final audit result.') > 600
THEN (model_log || {_NL} || {_NL} || {_AT} || 'Final audit result.')[1:600] || {_NL} || '... [truncated ' || (length(model_log || {_NL} || {_NL} || {_AT} || 'Final audit result.') - 600) || ' chars]' ELSE model_log || {_NL} || {_NL} || {_AT} || 'Final audit result.' END END AS log
FROM {L("review_tasks")} WHERE started_at IS NOT NULL""")
def log_append(spark, d):
    t = latest(table(spark, d, "review_tasks"), "model_log", "started_at").where("started_at IS NOT NULL")
    return t.select("id", text.appended(F.col("model_log"), F.col("started_at"), F.lit("Final audit result."), 600).alias("log"))


@query(f"""SELECT id, CASE WHEN tries = 0 THEN size_bytes WHEN floor(size_bytes / pow(2, tries)) >= 1000 THEN floor(size_bytes / pow(2, tries))::INT END AS budget FROM (SELECT id, size_bytes, length(relative_path) % 4 AS tries FROM {L("review_files")})""")
def shrunk_budgets(spark, d):
    f = files(spark, d, "size_bytes")
    return f.select("id", attempts.shrunk(F.col("size_bytes"), F.length("relative_path") % 4).alias("budget"))


@query(f"""WITH f AS (SELECT id, unnest(result_json.findings) AS f, generate_subscripts(result_json.findings, 1) AS i FROM {L("reports")})
SELECT id AS task_id, (row_number() OVER (PARTITION BY id ORDER BY {RANK_SQL}, f.file_path, coalesce(nullif(f.line, 0), 1000000000), i % 3, i))::INT AS n, f.severity AS severity, f.file_path AS file_path, f.line AS line, f.title AS title FROM f""")
def flattened_findings(spark, d):
    names = ("severity", "file_path", "line", "title")
    each = parts(spark, d, score="score", **{k: f"findings.{k}" for k in names}).select("id", "score", F.arrays_zip(*names).alias("f"))
    chunks = each.select(F.col("id").alias("task_id"), "score", "f", F.explode(F.array(*map(F.lit, range(3)))).alias("chunk"))
    mine = chunks.withColumn("findings", F.filter("f", lambda _, i: (i + 1) % 3 == F.col("chunk"))).select("task_id", "score", "findings", "chunk")
    r = findings.flattened(mine, "chunk").select("task_id", F.posexplode("findings").alias("at", "f"))
    return r.select("task_id", (F.col("at") + 1).alias("n"), "f.severity", "f.file_path", "f.line", "f.title")


@query(f"""SELECT id, (SELECT f.title FROM (SELECT unnest(result_json.findings) AS f, generate_subscripts(result_json.findings, 1) AS i) WHERE f.severity = 'high' ORDER BY i LIMIT 1) AS title FROM {L("reports")} WHERE result_json IS NOT NULL""")
def first_high_finding(spark, d):
    r = parts(spark, d, severity="findings.severity", title="findings.title")
    return r.select("id", findings.first_where(F.arrays_zip("severity", "title"), lambda f: f.severity == "high")["title"].alias("title"))


_JSON_SQL = "CASE id[1:1] WHEN '0' THEN '{\"a\": 1}' WHEN '1' THEN '[\"logic\", 1]' WHEN '2' THEN 'logic' WHEN '3' THEN '[]' WHEN '4' THEN '[\"a\", null]' ELSE '[' || array_to_string(['\"' || x || '\"' FOR x IN check_types], ', ') || ']' END"


@query(f"""SELECT id, CASE WHEN id[1:1] IN ('0', '1', '4') THEN 'not a list of strings' WHEN id[1:1] = '2' THEN 'not JSON' END AS error, CASE WHEN id[1:1] = '3' THEN '' WHEN id[1:1] NOT IN ('0', '1', '2', '4') THEN array_to_string(check_types, '|') END AS values
FROM {L("review_tasks")} WHERE check_types IS NOT NULL""")
def parsed_check_types(spark, d):
    given = F.create_map(*[F.lit(x) for kv in {"0": '{"a": 1}', "1": '["logic", 1]', "2": "logic", "3": "[]", "4": '["a", null]'}.items() for x in kv])
    t = tasks(spark, d).where("check_types IS NOT NULL").select("id", responses.check_types(F.coalesce(F.try_element_at(given, F.left("id", F.lit(1))), F.to_json("check_types"))).alias("x"))
    return t.select("id", "x.error", F.array_join("x.values", "|").alias("values"))


@query(f"""WITH RECURSIVE {CHUNK_SQL}, z AS (SELECT c.task_id, c.path, c.chunk, c.start_line, c.end_line, length('===== FILE: ' || c.path || ' =====' || {_NL}) + CASE WHEN len(f.ls) = 0 THEN length(f.source_text) ELSE c.characters - 1 END + 2 AS size,
row_number() OVER (PARTITION BY c.task_id ORDER BY c.path, c.chunk, length('===== FILE: ' || c.path || ' =====' || {_NL}) + CASE WHEN len(f.ls) = 0 THEN length(f.source_text) ELSE c.characters - 1 END + 2) AS i FROM c JOIN f ON f.id = c.file_id),
b AS (SELECT task_id, path, chunk, start_line, end_line, i, size AS used, 1 AS batch FROM z WHERE i = 1
  UNION ALL SELECT z.task_id, z.path, z.chunk, z.start_line, z.end_line, z.i, CASE WHEN b.used + z.size > {BUDGET} THEN z.size ELSE b.used + z.size END, b.batch + CASE WHEN b.used + z.size > {BUDGET} THEN 1 ELSE 0 END FROM b JOIN z ON z.task_id = b.task_id AND z.i = b.i + 1),
k AS (SELECT task_id, count(DISTINCT batch) AS k FROM b GROUP BY 1), g AS (SELECT task_id, path, chunk, count(*) AS same FROM c GROUP BY ALL)
SELECT b.task_id, b.batch::INT AS batch, 'Review.' || {_NL} || {_NL} || 'Only this part.' || {_NL} || 'Batch ' || b.batch || ' of ' || k.k || ', containing ' || count(*) || ' source chunk(s):' || {_NL} || string_agg('- ' || b.path || ', lines ' || b.start_line || '-' || b.end_line, {_NL} ORDER BY b.path, b.chunk, b.start_line, b.end_line) AS prompt
FROM b JOIN k ON k.task_id = b.task_id WHERE b.task_id NOT IN (SELECT task_id FROM g WHERE same > 1) GROUP BY b.task_id, b.batch, k.k""")
def batch_prompts(spark, d):
    chunks = text.chunk(files(spark, d, "source_text"), BUDGET)
    # a path that a task holds twice has chunks that the packing can't tell apart
    twice = chunks.groupBy("task_id", "path", "chunk").agg(F.count("*").alias("n")).where("n > 1").select("task_id").distinct()
    where = chunks.select("task_id", "path", "chunk", "start_line", "end_line")
    packed = text.pack(chunks, BUDGET).join(twice, "task_id", "left_anti").join(where, ["task_id", "path", "chunk"])
    each = packed.groupBy("task_id", "batch").agg(F.array_sort(F.collect_list(F.struct("path", "chunk", "start_line", "end_line"))).alias("chunks"))
    count = F.count("*").over(Window.partitionBy("task_id"))
    return each.select("task_id", "batch", text.batch_prompt(F.lit("Review."), "Only this part.", F.col("batch"), count, F.col("chunks")).alias("prompt"))


@query(f"""SELECT id, greatest(0, (epoch_us(completed_at) - epoch_us(started_at)) // 1000)::BIGINT AS elapsed, strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(created_at, '%f') = '000000' THEN '' ELSE '.' || strftime(created_at, '%f') END || '+00:00' AS created FROM {L("review_tasks")} WHERE started_at IS NOT NULL AND completed_at IS NOT NULL""")
def elapsed_and_iso(spark, d):
    t = latest(table(spark, d, "review_tasks"), "started_at", "completed_at", "created_at").where("started_at IS NOT NULL AND completed_at IS NOT NULL")
    return t.select("id", metrics.elapsed_ms(F.col("started_at"), F.col("completed_at")).alias("elapsed"), text.iso(F.col("created_at")).alias("created"))


@query("""SELECT user_id, greatest(0, floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 60000000.0 + 0.5))::BIGINT AS minutes FROM events GROUP BY user_id""")
def sample_windows(spark, d):
    return metrics.window_minutes(table(spark, d, "events"), "user_id", "ts")


@query("""WITH s AS (SELECT c_custkey AS k, c_custkey % 5 AS v FROM customer)
SELECT k::VARCHAR AS node_id, v <> 4 AS metrics_available, CASE WHEN v = 4 THEN repeat('refused ', 37) || 'refu' END AS error,
CASE WHEN v = 0 THEN 12.5 WHEN v IN (1, 2) THEN round((k % 100) / 0.5, 2) END::DOUBLE AS prompt, CASE WHEN v = 2 THEN 0.0 WHEN v IN (0, 1) THEN 8.0 END::DOUBLE AS generation,
CASE WHEN v <> 4 AND v <> 3 THEN 2 END::INT AS running, CASE WHEN v <> 4 THEN k % 7 END::INT AS pending, CASE WHEN v = 1 THEN 27.4 WHEN v = 2 THEN 55.0 END::DOUBLE AS cache FROM s""")
def node_runtime(spark, d):
    k, v = F.col("c_custkey"), F.col("c_custkey") % 5
    num = k.cast("string")
    early = F.concat(F.lit('# HELP\nvllm:prompt_tokens_total{m="a"} 1000\nvllm:generation_tokens_total 2000\n'))
    late = F.concat(
        F.lit('# HELP\nvllm:prompt_tokens_total{m="a"} '), F.when(v == 3, "1e3").otherwise((1000 + k % 100).cast("string")), F.lit("\nvllm:generation_tokens_total "), F.when(v == 2, "1990").when(v == 3, "").otherwise("2004"), F.lit("\n"),
        F.when(v == 0, "vllm_avg_prompt_throughput_toks_per_s 12.5\n").otherwise(""), F.when(v == 3, "vllm:num_requests_running NaN\n").otherwise("vllm:num_requests_running 2.9\n"),
        F.lit("vllm_num_requests_waiting "), (k % 7).cast("string"), F.lit(".0\n"), F.when(v == 1, 'vllm:gpu_cache_usage_perc{x="1",y="2"} 0.274\n').when(v == 2, "vllm_gpu_cache_usage_perc 55.0\n").otherwise(""),
    )
    at = lambda ms: F.timestamp_millis(F.lit(1_700_000_000_000 + ms))
    two = F.array(F.struct(at(0).alias("captured_at"), early.alias("body"), F.lit(None).cast("string").alias("error")), F.struct(at(500).alias("captured_at"), F.when(v != 4, late).alias("body"), F.when(v == 4, F.repeat(F.lit("refused "), F.lit(90))).alias("error")))
    s = table(spark, d, "customer").select(num.alias("node_id"), F.col("c_name").alias("display_name"), F.lit("http://n").alias("base_url"), F.explode(two).alias("x")).select("node_id", "display_name", "base_url", "x.*")
    r = metrics.node_rows(s)
    return r.select("node_id", "metrics_available", "error", F.col("prompt_throughput_tps").alias("prompt"), F.col("generation_throughput_tps").alias("generation"), F.col("running_requests").alias("running"), F.col("pending_requests").alias("pending"), F.col("gpu_kv_cache_usage_percent").alias("cache"))


_DEPLOYED = f"""(SELECT id, CASE status WHEN 'completed' THEN 'succeeded' ELSE status END AS status, CASE WHEN progress % 3 <> 1 THEN model_node_id END AS model_node_id, progress, error_message, left(model_log, 400) AS log FROM {L("review_tasks")})"""


def _deployments(spark, d):
    """The tasks in the part of deployments: some without a node."""
    t = latest(table(spark, d, "review_tasks"), "status", "model_node_id", "progress", "error_message", "model_log")
    return t.select("id", F.when(F.col("status") == "completed", "succeeded").otherwise(F.col("status")).alias("status"), F.when(F.col("progress") % 3 != 1, F.col("model_node_id")).alias("model_node_id"), "progress", "error_message", F.left("model_log", F.lit(400)).alias("log"))


@query(f"SELECT id, status FROM {_DEPLOYED} WHERE status IN ('queued', 'running')")
def active_deployments(spark, d):
    return deployments.active(_deployments(spark, d)).select("id", "status")


@query(f"SELECT x.id, n.display_name AS node_name FROM {_DEPLOYED} x LEFT JOIN model_nodes n ON n.id = x.model_node_id")
def deployment_nodes(spark, d):
    return deployments.with_node(_deployments(spark, d), table(spark, d, "model_nodes")).select("id", "node_name")


@query(f"SELECT id, display_name, is_default FROM model_nodes WHERE is_enabled AND (coalesce(is_default, false) OR id IN (SELECT model_node_id FROM {_DEPLOYED} WHERE status = 'succeeded' AND model_node_id IS NOT NULL)) ORDER BY is_default DESC, display_name")
def shown_nodes(spark, d):
    n = deployments.shown(table(spark, d, "model_nodes"), _deployments(spark, d))
    return n.select("id", "display_name", "is_default").orderBy(F.col("is_default").desc(), F.col("display_name").asc())


@query(f"""WITH e AS (SELECT id, progress % 4 AS code, CASE WHEN progress % 4 = 1 THEN '' ELSE model_log END AS output FROM {L("review_tasks")} WHERE status <> 'queued')
SELECT x.id, x.model_node_id, CASE WHEN e.id IS NULL THEN x.status WHEN e.code = 0 THEN 'succeeded' ELSE 'failed' END AS status, (CASE WHEN e.id IS NULL THEN x.progress ELSE 100 END)::INT AS progress,
CASE WHEN e.id IS NULL THEN x.log ELSE CASE WHEN coalesce(x.log, '') = '' THEN '' ELSE regexp_replace(x.log, '\\s+$', '') || {_NL} END || CASE WHEN coalesce(e.output, '') = '' THEN 'Deployment script finished.' ELSE e.output[-16000:] END END AS log,
CASE WHEN e.id IS NULL THEN x.error_message WHEN e.code <> 0 THEN 'deployment script exited with ' || e.code END AS error_message FROM {_DEPLOYED} x LEFT JOIN e ON e.id = x.id""")
def finished_deployments(spark, d):
    t = latest(table(spark, d, "review_tasks"), "status", "progress", "model_log").where("status <> 'queued'")
    code = F.col("progress") % 4
    return deployments.finished(_deployments(spark, d), t.select("id", code.alias("code"), F.when(code == 1, "").otherwise(F.col("model_log")).alias("output")))


@query("SELECT id, id = (SELECT max(id) FROM model_nodes) AS is_enabled, id = (SELECT max(id) FROM model_nodes) AS is_default FROM model_nodes")
def switched_nodes(spark, d):
    nodes = table(spark, d, "model_nodes")
    top = F.broadcast(nodes.agg(F.max("id").alias("top")))  # one row
    return deployments.switched(nodes.crossJoin(top), F.col("top")).select("id", "is_enabled", "is_default")


@query("""WITH r AS (SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 4 THEN 'gone' ELSE 'k' || (s_suppkey % 4) END AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'Own' ELSE '' END AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'own/model' END AS model,
CASE s_suppkey % 4 WHEN 0 THEN 'modelscope' WHEN 1 THEN 'huggingface' WHEN 2 THEN 'local' ELSE 'other' END AS source, CASE WHEN s_suppkey % 11 = 0 THEN 9000 ELSE 0 END AS port FROM supplier),
c AS (SELECT 'k' || i AS key, 'Model ' || i AS name, 'lab/m' || i AS model, CASE WHEN i % 2 = 0 THEN 'hf/m' || i END AS hf, 8100 + i AS port FROM range(4) t(i)),
j AS (SELECT r.*, c.key AS ck, c.name AS cn, c.model AS cm, c.hf, c.port AS cp, coalesce(nullif(r.name, ''), c.name) AS n, coalesce(r.model, c.model) AS m FROM r LEFT JOIN c ON c.key = nullif(r.key, '')),
x AS (SELECT *, CASE WHEN ck IS NULL THEN NULL WHEN source = 'huggingface' THEN coalesce(hf, cm) ELSE cm END AS repo, coalesce(nullif(port, 0), cp) AS p FROM j)
SELECT k AS id, n AS display_name, m AS model_identifier, CASE WHEN ck IS NOT NULL THEN cm ELSE string_split(m, '/')[-1] END AS served_model_name, repo AS source_repository, p::INT AS port, 'http://127.0.0.1:' || p AS base_url,
CASE WHEN nullif(key, '') IS NOT NULL AND ck IS NULL THEN 'catalog model not found' WHEN n IS NULL OR m IS NULL THEN 'name and model are required' WHEN repo IS NULL THEN 'source repository is required' WHEN p IS NULL THEN 'url or port is required' END AS error FROM x""")
def resolved_requests(spark, d):
    k = F.col("s_suppkey")
    key = F.when(k % 5 == 0, "").when(k % 5 == 4, "gone").otherwise(F.concat(F.lit("k"), (k % 4).cast("string")))
    source = F.when(k % 4 == 0, "modelscope").when(k % 4 == 1, "huggingface").when(k % 4 == 2, "local").otherwise("other")
    none = F.lit(None).cast("string")
    r = table(spark, d, "supplier").select(k.alias("id"), key.alias("catalog_key"), F.when(k % 3 == 0, "Own").otherwise("").alias("display_name"), F.when(k % 7 == 0, "own/model").alias("model_identifier"), none.alias("served_model_name"), source.alias("source"), F.lit("").alias("source_repository"), none.alias("model_dir"), F.when(k % 11 == 0, 9000).otherwise(0).alias("port"), none.alias("base_url"))
    i = F.col("id").cast("string")
    model = F.concat(F.lit("lab/m"), i)
    c = spark.range(4).select(F.concat(F.lit("k"), i).alias("key"), F.concat(F.lit("Model "), i).alias("display_name"), model.alias("model_identifier"), model.alias("served_model_name"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("hf/m"), i)).alias("hf_repo"), none.alias("ms_repo"), (8100 + F.col("id")).cast("int").alias("port"))
    return deployments.resolved(r, c).drop("catalog_key")


@query("""SELECT user_id, epoch_us(ts) AS at, value FROM events WHERE event_type = (SELECT min(event_type) FROM events)""")
def snapshot_metrics(spark, d):
    e = table(spark, d, "events")
    kind = e.agg(F.min("event_type").alias("kind"))
    both = e.crossJoin(F.broadcast(kind))  # one row
    node = F.when(F.col("event_type") == F.col("kind"), "here").otherwise("there")
    s = both.select("user_id", F.col("ts").alias("captured_at"), F.array(F.struct(F.lit("other").alias("node_id"), F.lit(-1.0).alias("value")), F.struct(node.alias("node_id"), F.col("value").cast("double").alias("value")), F.struct(node.alias("node_id"), F.lit(-2.0).alias("value"))).alias("models"))
    r = deployments.node_metrics(s.select(F.struct("user_id", "captured_at").alias("captured_at"), "models"), "here")
    return r.select("captured_at.user_id", F.unix_micros(F.col("captured_at.captured_at").cast("timestamp")).alias("at"), F.col("model.value").alias("value"))


@query("""SELECT p_brand AS name, max(p_size)::INT AS newest, (max(p_size) + 1)::INT AS next FROM part GROUP BY 1""")
def next_versions(spark, d):
    return state.next_version(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("int").alias("version")), "name", "version")


@query("""SELECT id, CASE WHEN is_enabled THEN upper(display_name) ELSE display_name END AS display_name, api_key, CASE WHEN is_enabled THEN 5 ELSE timeout_seconds END::INT AS timeout_seconds FROM model_nodes""")
def patched_nodes(spark, d):
    nodes = table(spark, d, "model_nodes").select("id", "display_name", "api_key", "timeout_seconds", "is_enabled")
    patch = nodes.where("is_enabled").select("id", F.upper("display_name").alias("display_name"), F.lit(None).cast("string").alias("api_key"), F.lit(5).alias("timeout_seconds"))
    return state.patched(nodes.drop("is_enabled"), patch, "id")


@query(f"""SELECT id, id IN (SELECT model_node_id FROM review_tasks WHERE status = 'failed') AS refused FROM model_nodes WHERE is_enabled OR id IN (SELECT model_node_id FROM review_tasks WHERE status = 'failed')""")
def deleted_nodes(spark, d):
    nodes = table(spark, d, "model_nodes")
    used = table(spark, d, "review_tasks").where("status = 'failed'").select("model_node_id")
    left, held = state.deleted(nodes, nodes.where("NOT is_enabled").select("id"), "id", used, "model_node_id")
    return left.select("id").join(used.select(F.col("model_node_id").alias("id"), F.lit(True).alias("refused")).distinct(), "id", "left").select("id", F.coalesce("refused", F.lit(False)).alias("refused"))


@query(f"""SELECT id, CASE WHEN model_node_id NOT IN (SELECT id FROM model_nodes WHERE NOT is_enabled) THEN model_node_id END AS model_node_id FROM {_DEPLOYED}""")
def nulled_references(spark, d):
    return state.nulled(_deployments(spark, d).select("id", "model_node_id"), table(spark, d, "model_nodes").where("NOT is_enabled"), "model_node_id")


@query("""WITH n AS (SELECT id, display_name, model_identifier, CASE WHEN length(display_name) % 2 = 0 THEN 'mock://x' ELSE base_url END AS base_url, is_enabled FROM model_nodes), m AS (SELECT min(model_identifier) AS x FROM model_nodes)
SELECT id, CASE WHEN model_identifier = x THEN 'Mine' ELSE display_name END AS display_name, model_identifier, CASE WHEN model_identifier = x THEN 'http://mine' ELSE base_url END AS base_url,
(is_enabled OR model_identifier = x) AND (model_identifier = x OR base_url NOT LIKE 'mock://%') AS is_enabled, model_identifier = x AS is_default FROM n, m UNION ALL SELECT 'new', 'New', 'lab/new-one', 'mock://new', false, false""")
def registered_nodes(spark, d):
    base = F.when(F.length("display_name") % 2 == 0, "mock://x").otherwise(F.col("base_url"))
    nodes = table(spark, d, "model_nodes").select("id", "display_name", "model_identifier", base.alias("base_url"), "is_enabled", "is_default")
    first = nodes.agg(F.min("model_identifier").alias("model_identifier")).select(F.lit("other").alias("id"), F.lit("Mine").alias("display_name"), "model_identifier", F.lit("http://mine").alias("base_url"))
    new = spark.range(1).select(F.lit("new").alias("id"), F.lit("New").alias("display_name"), F.lit("lab/new-one").alias("model_identifier"), F.lit("mock://new").alias("base_url"))
    return state.registered(nodes, first.unionByName(new))


@query("""SELECT username, role FROM users UNION ALL SELECT 'first', 'admin' WHERE NOT EXISTS (SELECT 1 FROM users WHERE lower(role) = 'admin') UNION ALL SELECT 'guest', 'nobody' WHERE NOT EXISTS (SELECT 1 FROM users WHERE role = 'nobody')""")
def bootstrapped_users(spark, d):
    users = table(spark, d, "users").select("username", "role")
    row = lambda a, b: spark.range(1).select(F.lit(a).alias("username"), F.lit(b).alias("role"))
    return state.bootstrapped(state.bootstrapped(users, row("first", "admin"), "lower(role) = 'admin'"), row("guest", "nobody"), "role = 'nobody'")


@query(f"""SELECT t.id, q.ahead FROM {L("review_tasks")} t LEFT JOIN (SELECT id, (row_number() OVER (ORDER BY queue_priority DESC, created_at ASC, id ASC) - 1)::BIGINT AS ahead FROM {L("review_tasks")} WHERE status = 'queued') q ON q.id = t.id""")
def tasks_with_positions(spark, d):
    return queue.with_positions(tasks(spark, d)).select("id", "ahead")


@query("""SELECT count(*) > 0 AS busy FROM review_tasks WHERE status = 'running'""")
def any_running(spark, d):
    return queue.busy(table(spark, d, "review_tasks"))


_DOMAIN = "[" + ", ".join(f"'{c}'" for c in CHECK_TYPES) + "]"
_WRONG = f"""(SELECT t.*, n.id AS node, f.n AS files, f.blank FROM {L("review_tasks")} t LEFT JOIN (SELECT id FROM model_nodes WHERE is_enabled) n ON n.id = t.model_node_id LEFT JOIN (SELECT task_id, count(*) FILTER (NOT bad) AS n, bool_or(bad) AS blank FROM (SELECT task_id, source_text IS NULL AS bad FROM {L("review_files")}) GROUP BY 1) f ON f.task_id = t.id)"""


@query(f"""SELECT id AS submission, CASE WHEN error IS NULL THEN coalesce(nullif(trim(status), ''), display_name) END AS display_name, CASE WHEN error IS NULL THEN files END::INT AS file_count, error FROM (SELECT *, CASE WHEN node IS NULL THEN 'model is not available' WHEN coalesce(len(check_types), 0) = 0 THEN 'check types: none'
WHEN len([x FOR x IN check_types IF NOT list_contains({_DOMAIN}, x)]) > 0 THEN 'check types: unsupported' WHEN blank THEN 'blank' WHEN coalesce(files, 0) = 0 THEN 'no files' END AS error FROM {_WRONG})""")
def created_tasks(spark, d):
    t = tasks(spark, d).select(F.col("id").alias("submission"), "owner_id", "model_node_id", F.concat(F.lit(" "), F.col("status")).alias("name"), F.col("display_name").alias("default_name"), "input_mode", "check_types")
    f = files(spark, d, "source_text", "size_bytes").select(F.col("task_id").alias("submission"), F.lit(0).alias("pos"), "relative_path", "source_text", "size_bytes", F.when(F.col("source_text").isNull(), "blank").alias("error"))
    made, _, rejects = submissions.created(t, f, table(spark, d, "model_nodes"), CHECK_TYPES)
    none = F.lit(None)
    return made.select("submission", "display_name", "file_count", none.cast("string").alias("error")).unionByName(rejects.select("submission", none.cast("string").alias("display_name"), none.cast("int").alias("file_count"), "error"))


@query(f"""SELECT task_id, batch, n FROM (SELECT task_id, (row_number() OVER (PARTITION BY task_id ORDER BY id))::INT AS batch, length(relative_path)::VARCHAR AS n FROM {L("review_files")})""")
def fanned_out(spark, d):
    w = Window.partitionBy("task_id").orderBy("id")
    f = files(spark, d).select("task_id", F.row_number().over(w).alias("batch"), "relative_path")
    return attempts.fan_out(f, lambda rows: [str(len(r["relative_path"])) for r in rows]).select("task_id", "batch", F.col("answer").alias("n"))
