"""Monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import monitoring as MO
from barsmith.plans.registry import register

KEY = "CASE WHEN symbol IS NULL THEN kind ELSE kind || '_' || symbol END"


@register("message_counts", fixtures=["fx_messages"], sql=f"""
WITH t AS (SELECT count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS up FROM fx_messages)
SELECT {KEY} AS key, kind, symbol, count(*) AS messages, max(ts) AS last_activity,
  (SELECT CASE WHEN up > 0 THEN n / up ELSE 0.0 END FROM t) AS overall_rate
FROM fx_messages GROUP BY kind, symbol
""")
def message_counts(spark):
    """Message counts and last activity per (kind, symbol), overall rate."""
    return MO.message_counts(spark.table("fx_messages"))


@register("error_counts", fixtures=["fx_messages"], sql="""
SELECT symbol AS error_type, count(*) AS errors FROM fx_messages WHERE kind = 'ERROR' GROUP BY symbol
""")
def error_counts(spark):
    """Error messages per error type (the reporting source)."""
    e = spark.table("fx_messages").filter(F.col("kind") == "ERROR").withColumnRenamed("symbol", "error_type")
    return MO.error_counts(e)


@register("health_rollup", fixtures=["fx_status"], sql="""
WITH l AS (SELECT component, arg_max(status, (ts, event_id)) AS status FROM fx_status GROUP BY component),
c AS (SELECT count(*) AS total_components, count(*) FILTER (WHERE status = 'healthy') AS healthy,
  count(*) FILTER (WHERE status = 'degraded') AS degraded, count(*) FILTER (WHERE status = 'unhealthy') AS unhealthy FROM l)
SELECT CASE WHEN total_components = 0 THEN 'unknown' WHEN unhealthy > 0 THEN 'unhealthy' WHEN degraded > 0 THEN 'degraded' ELSE 'healthy' END AS status,
  CASE WHEN total_components = 0 THEN 'No health checks registered' WHEN unhealthy > 0 THEN CAST(unhealthy AS VARCHAR) || ' component(s) unhealthy'
    WHEN degraded > 0 THEN CAST(degraded AS VARCHAR) || ' component(s) degraded' ELSE 'All components healthy' END AS message,
  total_components, healthy, degraded, unhealthy FROM c
""")
def health_rollup(spark):
    """Overall health from the latest status of each component."""
    return MO.health_rollup(spark.table("fx_status"), seq="event_id")


@register("component_status", fixtures=["fx_status"], sql="""
SELECT component, arg_max(status, (ts, event_id)) AS status, max(ts) AS last_check FROM fx_status GROUP BY component
""")
def component_status(spark):
    """A16 components section: latest status per component."""
    return MO.component_latest(spark.table("fx_status"), seq="event_id")


@register("rolling_message_rate", fixtures=["fx_messages"], sql=f"""
WITH m AS (SELECT *, {KEY} AS key FROM fx_messages),
w AS (SELECT *, count(*) OVER win AS cnt, min(ts) OVER win AS old FROM m
  WINDOW win AS (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN cnt >= 2 AND (epoch_us(ts) - epoch_us(old)) / 1e6 > 0 THEN cnt / ((epoch_us(ts) - epoch_us(old)) / 1e6) END AS raw FROM w)
SELECT event_id, ts, kind, symbol, duration_s, key,
  last_value(raw IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate
FROM r
""")
def rolling_message_rate(spark):
    """Message rate over each key's last 100 messages, after every message."""
    return MO.rolling_message_rate(spark.table("fx_messages"), seq="event_id")


@register("operation_timing", fixtures=["fx_messages"], sql="""
WITH u AS (SELECT *, CAST(round(duration_s * 1e6) AS BIGINT) AS us FROM fx_messages),
w AS (SELECT event_id, ts, kind AS operation, duration_s,
  CAST(sum(us) OVER win AS DOUBLE) / count(us) OVER win / 1000.0 AS avg_ms, max(us) OVER win / 1000.0 AS max_ms,
  min(us) OVER win / 1000.0 AS min_ms, count(us) OVER win AS sample_count
  FROM u WINDOW win AS (PARTITION BY kind ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT *, avg_ms > 1000.0 AS slow FROM w
""")
def operation_timing(spark):
    """Timing statistics per operation over its last 100 samples (the
    message kinds stand in for operations, their durations for timings)."""
    t = spark.table("fx_messages").select("event_id", "ts", F.col("kind").alias("operation"), "duration_s")
    return MO.operation_timing(t, seq="event_id")


@register("connection_transitions", fixtures=["fx_status"], sql="""
SELECT * FROM (SELECT *, lag(status) OVER (PARTITION BY component ORDER BY ts, event_id) AS old_status FROM fx_status) x
WHERE old_status IS NOT NULL AND old_status <> status
""")
def connection_transitions(spark):
    """Status changes per component."""
    return MO.connection_transitions(spark.table("fx_status"), seq="event_id")
