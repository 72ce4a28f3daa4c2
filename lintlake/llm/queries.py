"""The pN queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lintlake.llm import answers, leakage, neardup, offensive, secrets, syntax, tokenize, truncation
from lintlake.llm.env import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.decode_corpus(p6_ids(spark, sf_dir))


SQL["p6_decoded"] = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_runs(spark, sf_dir).select("doc_id", "item_id").distinct()


@query
def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


@query
def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leakage.without_leaks(docs, p7_runs(spark, sf_dir)).select("doc_id", "source", "repository")


@query
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p7_runs(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("run_words").alias("longest_run"))
    items = table(spark, sf_dir, "eval_items", "item_id", "suite")
    return items.join(found, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.broken_files(table(spark, sf_dir, "review_files", "id", "relative_path", "source_text"))


@query
def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.check_files(table(spark, sf_dir, "review_files", "id", "relative_path", "source_text"))


@query
def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(p2_checked(spark, sf_dir))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "review_files", "id", "source_text"))


@query
def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redact(table(spark, sf_dir, "review_files", "id", "source_text"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.pairs(*neardup.similar(table(spark, sf_dir, "review_files", "id", "source_text")))


@query
def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(*neardup.similar(table(spark, sf_dir, "review_files", "id", "source_text")))


def _stored(spark: SparkSession, sf_dir: str):
    return table(spark, sf_dir, "review_tasks", "id", "model_node_id", "model_log"), table(spark, sf_dir, "reports", "id", "task_id", "result_json")


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(*_stored(spark, sf_dir))[0].where("cut").select("record_id", "field", "finding_no")


@query
def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.judged(*_stored(spark, sf_dir))[0])


@query
def p4_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(*_stored(spark, sf_dir))[1]


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_attempts(spark, sf_dir).where("defect IS NOT NULL")


@query
def p3_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, reports = table(spark, sf_dir, "review_tasks", "id", "model_log"), table(spark, sf_dir, "reports", "task_id", "summary", "result_json")
    return answers.broken(tasks, reports)


@query
def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offensive.score(table(spark, sf_dir, "documents", "doc_id", "source", "text"), table(spark, sf_dir, "doc_labels", "doc_id", "is_abusive"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where(F.col("score") >= offensive.THRESHOLD).select("doc_id").distinct()


@query
def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offensive.rates(p8_scores(spark, sf_dir))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _runs(table_: str, key: str) -> str:
    return f"(SELECT {key}, unnest([array_to_string(ws[i:i + 11], ' ') FOR i IN range(1, len(ws) - 10)]) AS g FROM (SELECT {key}, regexp_extract_all({_LOWER.format('text')}, '[a-z0-9]+') AS ws FROM {table_} WHERE text IS NOT NULL))"


_LEAKS = f"(SELECT DISTINCT d.doc_id, e.item_id FROM {_runs('documents', 'doc_id')} d JOIN {_runs('eval_items', 'item_id')} e ON d.g = e.g)"
SQL["p7_found"] = f"SELECT * FROM {_LEAKS}"
SQL["p7_clean"] = f"SELECT doc_id, source, repository FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM {_LEAKS})"
#: Runs are the islands of the diagonals on which equal runs of twelve words lie.
_PLACES = "(SELECT {k}, i, array_to_string(ws[i:i + 11], ' ') AS g FROM (SELECT {k}, ws, unnest(range(1, len(ws) - 10)) AS i FROM (SELECT DISTINCT {k}, regexp_extract_all({low}, '[a-z0-9]+') AS ws FROM {t} WHERE text IS NOT NULL)))"
SQL["p7_runs"] = f"""
WITH m AS (SELECT d.doc_id, e.item_id, d.i AS di, e.i AS ei FROM {_PLACES.format(k="doc_id", t="documents", low=_LOWER.format("text"))} d JOIN {_PLACES.format(k="item_id", t="eval_items", low=_LOWER.format("text"))} e ON d.g = e.g),
r AS (SELECT *, di - row_number() OVER (PARTITION BY doc_id, item_id, di - ei ORDER BY di) AS island FROM m),
n AS (SELECT doc_id, item_id, min(di) AS di, min(ei) AS ei, count(*) + 11 AS words FROM r GROUP BY doc_id, item_id, di - ei, island)
SELECT doc_id, item_id, words::INT AS run_words, (di - 1)::INT AS doc_word, (ei - 1)::INT AS item_word FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, di, ei) = 1"""
SQL["p7_items"] = f"""SELECT e.item_id, any_value(e.suite) AS suite, count(DISTINCT r.doc_id) AS documents, coalesce(max(r.run_words), 0)::INT AS longest_run FROM eval_items e LEFT JOIN ({SQL["p7_runs"]}) r ON r.item_id = e.item_id GROUP BY e.item_id"""
#: The same pairs by a prefix filter over exact frequencies and a full count.
_PAIRS = """w AS (SELECT id, any_value(regexp_extract_all(source_text, '[A-Za-z0-9_]+')) AS ws FROM review_files WHERE source_text IS NOT NULL GROUP BY id),
t AS (SELECT DISTINCT id, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) AS g FROM w),
f AS (SELECT g, count(*) AS df FROM t GROUP BY g), n AS (SELECT id, count(*) AS n FROM t GROUP BY id),
p AS (SELECT t.id, t.g, n.n, row_number() OVER (PARTITION BY t.id ORDER BY f.df, t.g) AS r FROM t JOIN f ON f.g = t.g JOIN n ON n.id = t.id),
q AS (SELECT id, g, n FROM p WHERE r <= n - (7 * n + 9) // 10 + 1),
c AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb FROM q a JOIN q b ON a.g = b.g AND a.id < b.id WHERE 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n)),
o AS (SELECT id_a, id_b, na, nb, count(*) AS k FROM c JOIN t a ON a.id = c.id_a JOIN t b ON b.id = c.id_b AND b.g = a.g GROUP BY ALL),
s AS (SELECT id_a, id_b FROM o WHERE 10 * k >= 7 * (na + nb - k))"""
SQL["p1_found"] = f"WITH {_PAIRS} SELECT id_a, id_b FROM s"
SQL["p1_classes"] = f"""
WITH {_PAIRS}, h AS (SELECT id, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM t GROUP BY id), k AS (SELECT h, min(id) AS class_id, count(*) AS copies FROM h GROUP BY h),
b AS (SELECT DISTINCT x.h AS a, y.h AS b FROM s JOIN h x ON x.id = s.id_a JOIN h y ON y.id = s.id_b WHERE x.h <> y.h), l AS (SELECT h, count(DISTINCT o) AS links FROM (SELECT a AS h, b AS o FROM b UNION ALL SELECT b, a FROM b) GROUP BY h)
SELECT h.id AS file_id, k.class_id, k.copies, coalesce(l.links, 0) AS links FROM h JOIN k ON k.h = h.h LEFT JOIN l ON l.h = h.h"""
