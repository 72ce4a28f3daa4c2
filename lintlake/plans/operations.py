"""Queries of the operational metrics, the star-schema tables and the smaller functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lintlake.functions import metrics, text
from lintlake.operators import state
from lintlake.plans.registry import latest_sql as L, query
from lintlake.schemas import latest, table
from lintlake.sources import catalog
from lintlake.streaming import peaks

_TOTALS = "SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM events"


def _totals(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("total", F.sum("value").over(w))


@query(f"""WITH t AS ({_TOTALS}) SELECT * FROM (SELECT event_id, user_id, greatest(0.0, round((total - lag(total) OVER w) / greatest((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0.001), 2)) AS rate,
lag(total) OVER w AS before FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE before IS NOT NULL""".replace("SELECT * FROM (", "SELECT event_id, user_id, rate FROM ("))
def counter_rate(spark, d):
    return metrics.rates(_totals(spark, d), "user_id", "ts", "total", "event_id").where("rate IS NOT NULL").select("event_id", "user_id", "rate")


@query("""SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS peak FROM events""")
def sliding_peaks_30m(spark, d):
    return metrics.peaks(table(spark, d, "events"), "user_id", "ts", "value").select("event_id", "user_id", "peak")


@query("""SELECT event_id, event_id + 0.25::DOUBLE AS prompt, CASE WHEN event_id % 103 <= 100 THEN round((event_id % 103)::DOUBLE, 2) ELSE round((event_id % 103) / 100.0::DOUBLE, 2) END AS cache FROM events""")
def prom_extract(spark, d):
    share = F.format_string("%d.%02d", F.floor(F.col("event_id") % 103 / 100), F.col("event_id") % 103 % 100)
    scrape = F.concat(F.lit('# HELP x\nprompt_tokens_total{model="a"} '), F.col("event_id").cast("string"), F.lit(".25\nnode:cache_usage "), share, F.lit("\n"))
    e = table(spark, d, "events").select("event_id", scrape.alias("scrape"))
    return e.select("event_id", metrics.sample(F.col("scrape"), "absent_metric", "prompt_tokens_total").alias("prompt"), metrics.percentage(metrics.sample(F.col("scrape"), "node:cache_usage", "node_cache_usage")).alias("cache"))


@query("""WITH s AS (SELECT user_id, event_id, sum(1 + event_id % 7) OVER w AS busy, sum(event_id % 5) OVER w AS idle FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
x AS (SELECT user_id, event_id, busy + idle - lag(busy + idle) OVER v AS total, idle - lag(idle) OVER v AS idle FROM s WINDOW v AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN total > 0 THEN round(greatest(0.0, least(100.0, (1 - idle / total) * 100)), 2) END AS percent FROM x""")
def cpu_percent(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    busy, idle = F.sum(1 + F.col("event_id") % 7).over(w), F.sum(F.col("event_id") % 5).over(w)
    line = F.concat_ws(" ", F.lit("cpu "), busy.cast("string"), F.lit("0"), F.lit("0"), idle.cast("string"), F.lit("0"), F.lit("0"))
    return metrics.cpu(table(spark, d, "events").select("user_id", "event_id", line.alias("line")), "user_id", "event_id", "line")


@query("""SELECT c_custkey, 1024 * (1000 + c_custkey) AS memory_total_bytes, 1024 * c_custkey AS memory_used_bytes, round(100.0 * c_custkey / (1000 + c_custkey), 2) AS memory_percent FROM customer""")
def memory_usage(spark, d):
    info = F.concat(F.lit("MemTotal:   "), (F.col("c_custkey") + 1000).cast("string"), F.lit(" kB\nMemFree: 1 kB\nMemAvailable: 1000 kB\n"))
    c = table(spark, d, "customer").select("c_custkey", info.alias("info"))
    return c.select("c_custkey", *metrics.memory(F.col("info")))


@query("""SELECT s_suppkey::INT AS index, s_name AS name, CASE WHEN s_acctbal >= 0 THEN round(s_acctbal, 2) END AS utilization_percent, 10.0::DOUBLE AS memory_used_mb, ((s_suppkey % 3) * 20.0)::DOUBLE AS memory_total_mb,
CASE WHEN s_suppkey % 3 > 0 THEN round(1000.0 / ((s_suppkey % 3) * 20.0), 2) END AS memory_percent, 40.0::DOUBLE AS temperature_c, NULL::DOUBLE AS power_w FROM supplier WHERE s_suppkey % 4 <> 0""")
def gpu_devices(spark, d):
    load = F.when(F.col("s_acctbal") >= 0, F.format_string("%.2f", F.round("s_acctbal", 2))).otherwise("[N/A]")
    line = F.concat_ws(", ", F.col("s_suppkey").cast("string"), "s_name", load, F.lit("10"), ((F.col("s_suppkey") % 3) * 20).cast("string"), F.lit("40"), F.when(F.col("s_suppkey") % 4 != 0, F.lit("[N/A]")))
    return metrics.gpus(table(spark, d, "supplier").select(line.alias("line")), "line")


@query("""WITH c AS (SELECT 'k' || n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'lab/corvid-coder-7b' WHEN n_nationkey % 3 = 1 THEN 'Lumen Audit 14B' END AS mid FROM nation),
n AS (SELECT * FROM model_nodes WHERE is_enabled) SELECT key FROM c WHERE EXISTS (SELECT 1 FROM n WHERE n.model_identifier IN (c.key, c.mid) OR n.display_name IN (c.key, c.mid))""")
def catalog_deployed_or_join(spark, d):
    k = F.concat(F.lit("k"), F.col("n_nationkey").cast("string"))
    mid = F.when(F.col("n_nationkey") % 3 == 0, "lab/corvid-coder-7b").when(F.col("n_nationkey") % 3 == 1, "Lumen Audit 14B")
    c = table(spark, d, "nation").select(k.alias("key"), mid.alias("model_identifier"), mid.alias("served_model_name"), F.lit(None).cast("string").alias("hf_repo"), F.lit(None).cast("string").alias("ms_repo"))
    return catalog.deployed(c, table(spark, d, "model_nodes")).select("key")


@query("""SELECT event_id, CASE WHEN least(2047, 4096 - event_id - 128) >= 128 AND 4096 - event_id - 128 >= 128 THEN least(2047, 4096 - event_id - 128) END AS tokens, event_id % 3 <> 0 AS context FROM events WHERE event_id % 3 <> 0
UNION ALL SELECT event_id, NULL, false FROM events WHERE event_id % 3 = 0""")
def output_budget(spark, d):
    n = F.col("event_id").cast("string")
    short = F.concat(F.lit("This model's maximum context length is 4096 tokens and your request has "), n, F.lit(" input tokens"))
    long = F.concat(F.lit("Maximum context length is 4096 tokens. However, you requested 9 tokens ("), n, F.lit(" in the messages, 2048 in the completion)"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 1, short).when(F.col("event_id") % 3 == 2, long).otherwise("node is busy").alias("error"))
    return e.select("event_id", text.output_budget(F.col("error"), 2048).alias("tokens"), text.context_error(F.col("error")).alias("context"))


@query(f"""SELECT owner_id, string_agg(id, ',' ORDER BY n) AS remembered FROM (SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY created_at DESC, id DESC) AS n FROM {L("review_tasks")}) WHERE n <= 20 GROUP BY owner_id""")
def remembered_ids(spark, d):
    t = latest(table(spark, d, "review_tasks"), "owner_id", "created_at")
    newest = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.col("created_at").desc(), F.col("id").desc()))
    near = t.withColumn("n", newest).where("n <= 20")  # the feature is this limit
    ids = near.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("x"))
    rest = F.transform(F.slice("x", 2, 20), lambda v: v.id)
    return ids.select("owner_id", F.array_join(state.moved_to_front(rest, F.col("x")[0].id), ",").alias("remembered"))


@query("""SELECT id, id = (SELECT max(id) FROM model_nodes WHERE is_enabled) AS is_default FROM model_nodes""")
def single_default(spark, d):
    nodes = table(spark, d, "model_nodes")
    chosen = F.broadcast(nodes.where("is_enabled").agg(F.max("id").alias("chosen")))  # one row
    return state.set_default(nodes.crossJoin(chosen), F.col("chosen")).select("id", "is_default")


@query("""SELECT username FROM users UNION ALL SELECT c_name FROM customer WHERE c_name NOT IN (SELECT username FROM users)""")
def insert_unique(spark, d):
    return state.inserted(table(spark, d, "users").select("username"), table(spark, d, "customer").select(F.col("c_name").alias("username")), "username")


@query(r"""SELECT doc_id, text IS NULL OR NOT regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]') AS blank FROM documents""")
def blank_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.blank(F.col("text")), F.lit(True)).alias("blank"))


@query(f"""SELECT id, n::INT AS n, coalesce(f.file_path, 'unknown') || CASE WHEN coalesce(f.line, 0) <> 0 THEN ':' || f.line ELSE '' END AS location FROM (SELECT id, unnest(result_json.findings) AS f, generate_subscripts(result_json.findings, 1) AS n FROM {L("reports")})""")
def location_strings(spark, d):
    r = table(spark, d, "reports").select("id", "updated_at", F.arrays_zip(F.col("result_json.findings.file_path").alias("path"), F.col("result_json.findings.line").alias("line")).alias("places"))
    each = latest(r).select("id", F.posexplode("places").alias("at", "x"))
    return each.select("id", (F.col("at") + 1).alias("n"), text.location(F.col("x.path"), F.col("x.line")).alias("location"))


@query("""SELECT o_orderkey, format('{:g}', (o_orderkey % 10001) / 100.0::DOUBLE) AS score FROM orders""")
def general_numbers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.general((F.col("o_orderkey") % 10001) / 100.0).alias("score"))


@query(f"""SELECT owner_id, status, count(*) AS tasks, count(DISTINCT model_node_id) AS nodes, round(avg(duration_ms), 2) AS mean_ms, max(duration_ms) AS longest_ms FROM {L("review_tasks")} GROUP BY GROUPING SETS ((owner_id, status), (status), ())""")
def task_rollup(spark, d):
    t = latest(table(spark, d, "review_tasks"), "owner_id", "status", "model_node_id", "duration_ms")
    owner, status = F.col("owner_id"), F.col("status")
    return t.groupingSets([[owner, status], [status], []], owner, status).agg(F.count("*").alias("tasks"), F.countDistinct("model_node_id").alias("nodes"), F.round(F.avg("duration_ms"), 2).alias("mean_ms"), F.max("duration_ms").alias("longest_ms"))


_ENDS = f"(SELECT id, unnest(regexp_extract_all(model_log, '\\] Attempt \\d+ (?:succeeded|failed: [^\\n]*)')) AS e FROM {L('review_tasks')})"


@query(f"""SELECT CASE WHEN contains(e, 'succeeded') THEN 'succeeded' ELSE 'failed' END AS outcome, regexp_replace(regexp_extract(e, 'failed: (.*)', 1), '\\d+', 'N', 'g') AS reason, count(*) AS attempts, count(DISTINCT id) AS tasks FROM {_ENDS} GROUP BY 1, 2""")
def attempt_outcomes(spark, d):
    t = latest(table(spark, d, "review_tasks"), "model_log").select("id", F.explode(text.attempts(F.col("model_log"))).alias("a"))
    return t.groupBy("a.outcome", F.regexp_replace("a.reason", r"\d+", "N").alias("reason")).agg(F.count("*").alias("attempts"), F.countDistinct("id").alias("tasks"))


@query(f"""SELECT id, status, max(n)::INT AS attempts FROM (SELECT t.id, t.status, regexp_extract(x.e, 'Attempt (\\d+)', 1)::INT AS n FROM {L("review_tasks")} t JOIN {_ENDS} x ON x.id = t.id) GROUP BY 1, 2""")
def attempts_per_task(spark, d):
    t = latest(table(spark, d, "review_tasks"), "model_log", "status").withColumn("a", text.attempts(F.col("model_log"))).where(F.size("a") > 0)
    return t.select("id", "status", F.array_max(F.transform("a", lambda x: x.number)).alias("attempts"))


@query(f"""SELECT id, row_number() OVER (PARTITION BY owner_id ORDER BY CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 ELSE 2 END, CASE WHEN status = 'queued' THEN -queue_priority END NULLS LAST,
CASE WHEN status = 'queued' THEN created_at END NULLS LAST, created_at DESC, id DESC)::INT AS place FROM {L("review_tasks")}""")
def workspace_order(spark, d):
    t = latest(table(spark, d, "review_tasks"), "owner_id", "status", "queue_priority", "created_at")
    queued = F.col("status") == "queued"
    state_rank = F.when(F.col("status") == "running", 0).when(queued, 1).otherwise(2)
    w = Window.partitionBy("owner_id").orderBy(state_rank, F.when(queued, -F.col("queue_priority")).asc_nulls_last(), F.when(queued, F.col("created_at")).asc_nulls_last(), F.col("created_at").desc(), F.col("id").desc())
    return t.select("id", F.row_number().over(w).alias("place"))


@query(f"""SELECT id, f.title AS title, replace(replace(replace(replace(replace(f.title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS shown FROM (SELECT id, unnest(result_json.findings) AS f FROM {L("reports")})""")
def escaped_titles(spark, d):
    r = table(spark, d, "reports").select("id", "updated_at", F.col("result_json.findings.title").alias("titles"))  # nothing else is read
    return latest(r).select("id", F.explode("titles").alias("title")).select("id", "title", text.escaped(F.col("title")).alias("shown"))


@query(f"""SELECT id, CASE WHEN duration_ms IS NULL THEN '--' ELSE (duration_ms // 1000) || '.' || (duration_ms % 1000 // 100) || ' s' END AS duration FROM {L("review_tasks")}""")
def formatted_durations(spark, d):
    return latest(table(spark, d, "review_tasks"), "duration_ms").select("id", text.readable_duration(F.col("duration_ms")).alias("duration"))


_SIZE = " ".join(f"WHEN b < {1024 ** (k + 1)} THEN (floor(b * 10 / 1024.0 ** {k} + 0.5)::BIGINT // 10) || '.' || (floor(b * 10 / 1024.0 ** {k} + 0.5)::BIGINT % 10) || ' {u}'" for k, u in enumerate(("KB", "MB", "GB", "TB"), 1))


@query(f"""SELECT id, scale, CASE WHEN b IS NULL THEN '--' WHEN b < 1024 THEN b || ' B' {_SIZE} END AS size FROM (SELECT id, scale, size_bytes::DOUBLE::BIGINT * scale AS b FROM {L("review_files")}, (SELECT unnest([1, 100, 50000, 30000000]::BIGINT[]) AS scale))""")
def formatted_sizes(spark, d):
    f = latest(table(spark, d, "review_files"), "size_bytes").select("id", "size_bytes", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 100, 50_000, 30_000_000)])).alias("scale"))
    return f.select("id", "scale", text.readable_bytes(F.col("size_bytes") * F.col("scale")).alias("size"))


@query(f"""SELECT id, 'Check these:' || array_to_string([chr(10) || '- ' || CASE x WHEN 'logic' THEN 'logic errors' ELSE x END FOR x IN [check_types[i] FOR i IN range(1, len(check_types) + 1) IF list_position(check_types, check_types[i]) = i]], '') AS prompt FROM {L("review_tasks")}""")
def check_type_prompts(spark, d):
    t = latest(table(spark, d, "review_tasks"), "check_types")
    return t.select("id", text.kinds_text(F.col("check_types"), {"logic": "logic errors"}, "Check these:").alias("prompt"))


@query("""WITH n AS (SELECT model_identifier, display_name FROM model_nodes), new AS (SELECT model_identifier, 'New ' || display_name AS display_name FROM n WHERE length(display_name) % 2 = 0 UNION ALL SELECT 'lab/' || username, username FROM users)
SELECT model_identifier, display_name FROM new UNION ALL SELECT * FROM n WHERE model_identifier NOT IN (SELECT model_identifier FROM new)""")
def upsert_nodes(spark, d):
    nodes = table(spark, d, "model_nodes").select("model_identifier", "display_name", F.lit(0).alias("version"))
    renamed = nodes.where(F.length("display_name") % 2 == 0).select("model_identifier", F.concat(F.lit("New "), F.col("display_name")).alias("display_name"), F.lit(1).alias("version"))
    users = table(spark, d, "users").select(F.concat(F.lit("lab/"), F.col("username")).alias("model_identifier"), F.col("username").alias("display_name"), F.lit(1).alias("version"))
    return state.upserted(nodes, renamed.unionByName(users), "model_identifier", "version").drop("version")


@query("""SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' - INTERVAL 30 MINUTE) WHERE n <= 360""")
def retained_samples(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("node_id"), F.col("ts").alias("captured_at"))
    return peaks.retained(e, "2024-01-10 00:00:00", tie="event_id").select("event_id", F.col("node_id").alias("user_id"))


@query(f"""SELECT id, display_name, status FROM {L("review_tasks")} WHERE id = (SELECT min(id) FROM review_tasks)""")
def point_lookup(spark, d):
    t = table(spark, d, "review_tasks")
    first = F.broadcast(t.agg(F.min("id").alias("id")))  # one row
    return latest(t.select("id", "display_name", "status", "updated_at").join(first, "id", "left_semi"), "display_name", "status").select("id", "display_name", "status")
