"""Queries of freshness, retention, queues and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import scalars as X
from quillon.functions.python_udfs import html_to_text
from quillon.operators import mapping as M
from quillon.operators import sinks as W
from quillon.operators import upkeep as U
from quillon.plans import adapters as A
from quillon.runtime import read

R, I = A.SQL_RUNS, A.SQL_INSTANCES
T = f"TIMESTAMP '{A.NOW}'"
FRESH = f"""last AS (SELECT instance_id, max(ts) AS last_success FROM runs WHERE kind = 'ingest' AND status = 'ok' GROUP BY instance_id),
fresh AS (SELECT i.instance_id, last_success, CASE WHEN i.status = 'disabled' THEN 'disabled' WHEN i.status = 'error' THEN 'error' WHEN last_success IS NULL THEN 'no_data'
  WHEN epoch({T}) - floor(epoch(last_success)) >= 86400 THEN 'very_stale' WHEN epoch({T}) - floor(epoch(last_success)) >= 14400 THEN 'stale' ELSE 'fresh' END AS state FROM instances i LEFT JOIN last USING (instance_id))"""
STREAK = """streaks AS (SELECT instance_id, count(*) FILTER (status = 'error' AND ok_after = 0) AS streak FROM (
  SELECT *, sum((status <> 'error')::INT) OVER (PARTITION BY instance_id ORDER BY ts DESC, run_id DESC) AS ok_after FROM runs) GROUP BY instance_id)"""


def _fresh(s, d):
    return U.freshness(A.instances(s, d), A.runs(s, d), A.now())


def _host(c):
    return F.regexp_extract(c, "//([^/]*)", 1)


QUERIES = {
    "freshness_by_instance": (lambda s, d: _fresh(s, d).select("instance_id", "last_success", "state"), f"WITH {R}, {I}, {FRESH} SELECT instance_id, last_success, state FROM fresh"),
    "freshness_summary": (
        lambda s, d: U.freshness_summary(_fresh(s, d)),
        f"WITH {R}, {I}, {FRESH} SELECT s AS state, (SELECT count(*) FROM fresh WHERE state = s OR s = 'total') AS n FROM (SELECT unnest(['disabled', 'error', 'no_data', 'very_stale', 'stale', 'fresh', 'total']) AS s)",
    ),
    "last_success_gauge": (
        lambda s, d: U.metrics(("last_success", U.last_success(A.instances(s, d), A.runs(s, d)).withColumn("v", F.coalesce(F.unix_timestamp("last_success"), F.lit(0))), ["instance_id"], "v")).select("name", F.col("labels")["instance_id"].alias("instance"), "value"),
        f"WITH {R}, {I}, {FRESH} SELECT 'last_success' AS name, instance_id::VARCHAR AS instance, coalesce(floor(epoch(last_success)), 0)::DOUBLE AS value FROM fresh",
    ),
    "consecutive_failures": (lambda s, d: U.failure_streaks(A.runs(s, d)), f"WITH {R}, {STREAK} SELECT * FROM streaks"),
    "backoff": (
        lambda s, d: U.failure_streaks(A.runs(s, d)).select("instance_id", X.backoff_seconds(F.col("streak")).alias("wait")),
        f"WITH {R}, {STREAK} SELECT instance_id, least(60.0 * power(2.0, greatest(streak, 1) - 1), 3600.0)::DOUBLE AS wait FROM streaks",
    ),
    "finalize_runs": (
        lambda s, d: U.finalize(A.runs(s, d), A.instances(s, d), U.failure_streaks(A.runs(s, d)), A.now(), disable_at=2).select("instance_id", "status", F.unix_timestamp("next_run").alias("next_run")),
        f"""WITH {R}, {I}, {STREAK}, l AS (SELECT instance_id, arg_max(status, (ts, run_id)) AS last_status FROM runs GROUP BY instance_id)
        SELECT instance_id, CASE WHEN last_status = 'error' AND streak >= 2 THEN 'disabled' ELSE status END AS status,
        (epoch({T}) + CASE WHEN last_status = 'error' THEN least(60.0 * power(2.0, greatest(streak, 1) - 1), 3600.0) WHEN stream THEN 0 ELSE 3600 END)::BIGINT AS next_run FROM instances JOIN l USING (instance_id) JOIN streaks USING (instance_id)""",
    ),
    "due_instances": (
        lambda s, d: U.due(A.instances(s, d).withColumn("next_run", F.when(F.col("instance_id") % 4 > 0, A.now() + F.make_dt_interval(secs=(F.col("instance_id") % 3 - 1).cast("decimal(18,6)")))), A.now()).select("instance_id"),
        f"WITH {I} SELECT instance_id FROM instances WHERE status = 'enabled' AND (instance_id % 4 = 0 OR instance_id % 3 < 2)",
    ),
    "latest_status": (lambda s, d: U.latest_by(A.runs(s, d), "instance_id", "status", "started_at", "run_id"), f"WITH {R} SELECT instance_id, arg_max(status, (ts, run_id)) AS status FROM runs GROUP BY instance_id"),
    "snapshot_crosstab": (
        lambda s, d: U.crosstab(read(s, d, "events"), "user_id", ["view", "signup", "error", "click", "purchase"], "event_type"),
        "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{v}') AS {v}" for v in ("view", "signup", "error", "click", "purchase")) + " FROM events GROUP BY user_id",
    ),
    "recover_stale": (
        lambda s, d: U.recover(A.runs(s, d).withColumn("status", F.when(F.col("run_id") % 5 == 0, "running").otherwise(F.col("status")))).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {R} SELECT CASE WHEN run_id % 5 = 0 THEN 'error' ELSE status END AS status, count(*) AS n FROM runs GROUP BY 1",
    ),
    "retention_prune": (
        lambda s, d: U.prune(A.runs(s, d), "finished_at", A.now(), 14).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        f"WITH {R} SELECT status, count(*) AS n FROM runs WHERE NOT ts < {T} - INTERVAL 14 DAY GROUP BY status",
    ),
    "orphan_gc": (
        lambda s, d: U.orphans(read(s, d, "article_text").select(F.col("raw_pointer").alias("uri"), F.col("created_at").alias("modified")).where("uri is not null"), read(s, d, "er_queue_item").select(F.col("source_record").alias("uri")), A.now(), 86400).select("uri", "modified"),
        f"SELECT raw_pointer AS uri, created_at AS modified FROM article_text WHERE raw_pointer IS NOT NULL AND epoch({T}) - floor(epoch(created_at)) > 86400 AND raw_pointer NOT IN (SELECT source_record FROM er_queue_item WHERE source_record IS NOT NULL)",
    ),
    "host_capped": (
        lambda s, d: U.host_capped(read(s, d, "article_text").select("entity_id", _host(F.col("url")).alias("host"), F.col("entity_id").alias("pos"))).select("entity_id", "host"),
        "SELECT entity_id, host FROM (SELECT entity_id, regexp_extract(url, '//([^/]*)', 1) AS host, row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]*)', 1) ORDER BY entity_id) AS k FROM article_text) WHERE k <= 5",
    ),
    "fetch_candidates": (
        lambda s, d: U.fetch_candidates(read(s, d, "article_text").select(F.col("entity_id").alias("id"), F.col("created_at").alias("at")), read(s, d, "article_text"), 50, 3),
        """WITH n AS (SELECT entity_id AS id, created_at AS "at" FROM article_text ORDER BY created_at DESC NULLS FIRST, entity_id LIMIT 200)
        SELECT id, "at" FROM n JOIN article_text t ON t.entity_id = id WHERE coalesce(text, '') = '' AND coalesce(attempts, 0) < 3 ORDER BY "at" DESC NULLS FIRST, id LIMIT 50""",
    ),
    "extraction_candidates": (
        lambda s, d: U.extraction_candidates(read(s, d, "article_text").select(F.col("entity_id").alias("id"), F.col("created_at").alias("at"), F.lit(False).alias("processed"), F.nullif("last_error", F.lit("")).alias("title"), F.col("raw_pointer").alias("source_record")), 100).select("id"),
        """WITH n AS (SELECT entity_id AS id, nullif(last_error, '') AS title, raw_pointer FROM article_text ORDER BY created_at DESC NULLS FIRST, entity_id LIMIT 100) SELECT id FROM n WHERE title IS NOT NULL AND raw_pointer IS NOT NULL""",
    ),
    "article_bodies": (
        lambda s, d: U.body(read(s, d, "article_text").select(F.col("entity_id").alias("id")), read(s, d, "article_text"), 200).select("id", F.length("body").cast("long").alias("n")),
        "SELECT entity_id AS id, length(nullif(trim(text[1:200], ' '), '')) AS n FROM article_text",
    ),
    "dedup_enqueue": (
        lambda s, d: read(s, d, "er_queue_item").dropDuplicates(["source_record", "entity_id"]).groupBy("connector_id").agg(F.count(F.lit(1)).alias("n")),
        "SELECT min(connector_id) AS connector_id, count(DISTINCT (source_record, entity_id)) AS n FROM er_queue_item GROUP BY connector_id",
    ),
    "dead_letter_split": (
        lambda s, d: W.split_errors(read(s, d, "er_queue_item").select("id", "status", F.when(F.from_json("raw_entity", "id string, schema string")["schema"].isNull(), F.lit("unparseable")).alias("error")))[1].groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        "SELECT status, count(*) AS n FROM er_queue_item WHERE NOT json_valid(raw_entity) OR json_extract_string(raw_entity, '$.schema') IS NULL GROUP BY status",
    ),
    "validate_rows": (
        lambda s, d: M.validate(A.entities(s, d), ("Company", "Person", "Organization")).groupBy("error").agg(F.count(F.lit(1)).alias("n")),
        "SELECT CASE WHEN schema_name NOT IN ('Company', 'Person', 'Organization') THEN 'unknown schema' END AS error, count(*) AS n FROM ftm_entity GROUP BY 1",
    ),
    "notifications": (
        lambda s, d: W.notification(read(s, d, "merge_audit").select("id", F.when(F.col("score") < 0.92, "warning").otherwise("info").alias("severity"), F.col("canonical_id").alias("title"), F.coalesce("reason", F.lit("")).alias("body"))).select("id", "message"),
        "SELECT id, CASE WHEN score < 0.92 THEN '[WARNING] ' ELSE '' END || canonical_id || chr(10) || chr(10) || coalesce(reason, '') AS message FROM merge_audit",
    ),
    "html_text": (
        lambda s, d: read(s, d, "article_text").where("text is not null").select("entity_id", html_to_text(F.concat(F.lit("<html><nav>Menu</nav><p>"), F.regexp_replace(F.regexp_replace("text", "[<>&]", " "), "\n", "</p><p>"), F.lit("</p></html>"))).alias("body")),
        None,
    ),
}
