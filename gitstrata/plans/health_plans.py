"""Metric, log, vector and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gitstrata.operators import health as ops
from gitstrata.operators import vectors
from gitstrata.plans.registry import query

H, L = "f_health_metrics", "f_request_log"
STATUS = "CASE WHEN value >= threshold_critical THEN 'critical' WHEN value >= threshold_warning THEN 'warning' ELSE 'healthy' END"


def window(minutes):
    return f"w AS (SELECT * FROM f_health_metrics WHERE ts >= (SELECT max(ts) FROM f_health_metrics) - INTERVAL {minutes} MINUTE)"


@query("metric_status", f"SELECT event_id, name, {STATUS} AS status FROM f_health_metrics", H)
def _(t):
    return ops.metric_status(t.f_health_metrics).select("event_id", "name", "status")


@query("health_summary", f"""
SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN warning > 0 THEN 'warning' ELSE 'healthy' END AS overall FROM (SELECT CAST(ts AS DATE) AS day, name, count(*) FILTER (s = 'healthy') AS healthy, count(*) FILTER (s = 'warning') AS warning, count(*) FILTER (s = 'critical') AS critical
 FROM (SELECT *, {STATUS} AS s FROM f_health_metrics) GROUP BY 1, 2)""", H)
def _(t):
    return ops.health_summary(t.f_health_metrics.withColumn("day", F.to_date("ts")), ["day", "name"])


@query("counters", "SELECT endpoint, count(*) AS operations, count(*) FILTER (status_code >= 400) AS errors FROM f_request_log GROUP BY 1", L)
def _(t):
    return ops.counters(t.f_request_log, "endpoint")


@query("metric_average", f"WITH {window(600)} SELECT name, round(avg(value), 9) AS average, count(*) AS points FROM w GROUP BY 1", H)
def _(t):
    return ops.metric_average(t.f_health_metrics, 600).withColumn("average", F.round("average", 9))


TREND = f"""WITH {window(600)}, e AS (SELECT name, count(*) AS points, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, avg(value) AS average FROM w GROUP BY 1),
 g AS (SELECT *, CASE WHEN first <> 0 THEN (last - first) / first * 100 ELSE 0 END AS pct FROM e), tr AS (SELECT *, CASE WHEN points < 3 THEN 'insufficient_data' WHEN pct > 10 THEN 'increasing' WHEN pct < -10 THEN 'decreasing' ELSE 'stable' END AS trend FROM g)
"""


@query("metric_trend", TREND + "SELECT name, points, first, last, trend FROM tr", H)
def _(t):
    return ops.metric_trend(t.f_health_metrics, 600)


@query("metric_summary", TREND + """SELECT name, points, first, last, trend, round(average, 2) AS average, (SELECT count(*) FROM events WHERE event_type = tr.name) AS operations, (SELECT count(*) FROM events WHERE event_type = tr.name AND event_type = 'error') AS errors FROM tr""", H)
def _(t):
    log = t.f_request_log.withColumn("name", F.substring("endpoint", 2, 100))
    return ops.metric_summary(t.f_health_metrics, log, 600)


@query("moving_average", """
SELECT event_id, name, round(avg(value) OVER (PARTITION BY name ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW), 9) AS moving_average FROM f_health_metrics""", H)
def _(t):
    return ops.moving_average(t.f_health_metrics, 30).select("event_id", "name", F.round("moving_average", 9).alias("moving_average"))


@query("status_changes", f"""
SELECT event_id, name, status, previous_status FROM (SELECT *, lag(status) OVER (PARTITION BY name ORDER BY ts, event_id) AS previous_status FROM (SELECT *, {STATUS} AS status FROM f_health_metrics)) WHERE previous_status IS NOT NULL AND previous_status <> status""", H)
def _(t):
    return ops.status_changes(t.f_health_metrics).select("event_id", "name", "status", "previous_status")


@query("tail_per_key", """
SELECT name, event_id, ts, CAST(row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS INTEGER) AS position FROM f_health_metrics QUALIFY position <= 100""", H)
def _(t):
    return ops.tail_per_key(t.f_health_metrics.select("name", "event_id", "ts"), "name", 100)


@query("recent_requests_per_user", """
SELECT user_id, request_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) AS INTEGER) AS position FROM f_request_log QUALIFY position <= 50""", L)
def _(t):
    return ops.tail_per_key(t.f_request_log.select("user_id", "request_id", "ts"), "user_id", 50, tie="request_id").select("user_id", "request_id", "position")


@query("request_rates", """
SELECT endpoint, user_id, count(*) AS requests, avg(CASE WHEN status_code >= 400 THEN 1 ELSE 0 END) AS error_share, round(avg(duration_ms), 6) AS avg_duration_ms FROM f_request_log GROUP BY 1, 2""", L)
def _(t):
    return ops.request_rates(t.f_request_log, ["endpoint", "user_id"]).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query("expiring_keys", """
SELECT o_orderkey, CAST(floor(date_diff('second', TIMESTAMP '1997-06-01 12:00:00', o_orderdate) / 86400) AS BIGINT) AS days_until_expiry, floor(date_diff('second', TIMESTAMP '1997-06-01 12:00:00', o_orderdate) / 86400) < 0 AS expired
FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-06-08 12:00:00'""")
def _(t):
    keys = t.orders.select("o_orderkey", F.col("o_orderdate").alias("expires_at"), (F.col("o_orderstatus") == "O").alias("is_active"))
    out = ops.expiring(keys, F.lit("1997-06-01 12:00:00").cast("timestamp_ntz"))
    return out.select("o_orderkey", "days_until_expiry", "expired")


def first_vector(t):
    return t.embeddings.filter("vec_id = 0").select("embedding").scalar()


DOT = "list_sum(list_transform(generate_series(1, 64), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"


@query("similar_vectors", f"""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, e.label, {DOT} / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS c FROM embeddings e, q)
SELECT vec_id, label, round(c, 9) AS similarity FROM s ORDER BY c DESC, vec_id LIMIT 5""")
def _(t):
    return ops.similar(t.embeddings, first_vector(t)).select("vec_id", "label", F.round("similarity", 9).alias("similarity"))


@query("similar_vectors_l2", """
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT e.vec_id, 1 - list_sum(list_transform(generate_series(1, 64), lambda i: (e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE) ** 2)) AS c FROM embeddings e, q)
SELECT vec_id, round(c, 9) AS similarity FROM s ORDER BY c DESC, vec_id LIMIT 5""")
def _(t):
    return ops.similar(t.embeddings, first_vector(t), metric="l2sq").select("vec_id", F.round("similarity", 9).alias("similarity"))


@query("similar_many", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
 n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v),
 s AS (SELECT q.vec_id AS query, n.vec_id AS id, round(list_dot_product(q.e, n.e) / (q.len * n.len), 12) AS c FROM n q JOIN n ON q.vec_id % 100 = 0 AND q.vec_id <> n.vec_id)
SELECT query, id, round(c, 9) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS INTEGER) AS position FROM s QUALIFY position <= 5""")
def _(t):
    """Every hundredth vector against all."""
    out = vectors.similar_many(t.embeddings, t.embeddings.filter("vec_id % 100 = 0"))
    return out.select("query", "id", F.round("similarity", 9).alias("similarity"), "position")


@query("validate_ranges", """
SELECT event_id, CASE WHEN value > 100 THEN 'value' ELSE '' END || CASE WHEN value > 100 AND user_id < 20 THEN '|' ELSE '' END || CASE WHEN user_id < 20 THEN 'user_id' ELSE '' END AS violations, NOT (value > 100 OR user_id < 20) AS is_valid FROM events""")
def _(t):
    out = ops.validate(t.events, {"value": (0, 100), "user_id": (20, None)})
    return out.select("event_id", F.array_join("violations", "|").alias("violations"), "is_valid")


@query("session_duration", """
SELECT session_id, date_diff('second', started_at, CASE WHEN completed_at IS NOT NULL THEN completed_at WHEN status IN ('completed', 'failed') THEN TIMESTAMP '2002-01-01' END) AS duration_seconds FROM f_analysis_sessions""", "f_analysis_sessions")
def _(t):
    return ops.session_duration(t.f_analysis_sessions, F.lit("2002-01-01").cast("timestamp_ntz")).select("session_id", "duration_seconds")


@query("coerce_types", "SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, 'Brand#', '') AS BIGINT) AS brand_number, TRY_CAST(p_name AS BIGINT) AS name_number FROM part")
def _(t):
    rows = t.part.select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").alias("brand_number"), F.col("p_name").alias("name_number"))
    return ops.coerce(rows, {"brand_number": "bigint", "name_number": "bigint"})
