"""Monitoring over event logs.

A14 message_counts, A15 error_counts, A16 health_rollup, W9
rolling_message_rate, W10 operation_timing, W11 connection_transitions.

The live process kept counters, last-100 deques and status maps in memory;
here they are aggregates and bounded windows over message/status logs.  The
last-100 windows are evaluated per (key, block) with a 99-row halo, so a key
holding most of the traffic still spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.operators import ordered

# Window length of rate and timing statistics, slow threshold.
WINDOW = 100
SLOW_SECONDS = 1.0


def message_key(kind: str = "kind", symbol: str = "symbol") -> Column:
    """``<kind>_<symbol>``, or the kind alone when there is no symbol."""
    return F.when(F.col(symbol).isNull(), F.col(kind)).otherwise(F.concat_ws("_", kind, symbol))


def message_counts(messages: DataFrame, ts: str = "ts", start=None, end=None) -> DataFrame:
    """Messages and last activity per (kind, symbol); ``overall_rate`` =
    all messages / uptime seconds (uptime = start..end, default the log's
    span; 0 when the span is 0)."""
    per = messages.groupBy("kind", "symbol").agg(
        F.count(F.lit(1)).alias("messages"), F.max(ts).alias("last_activity"))
    tot = messages.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    lo = F.lit(start).cast("timestamp_ntz") if start is not None else tot.select("lo").scalar()
    hi = F.lit(end).cast("timestamp_ntz") if end is not None else tot.select("hi").scalar()
    up = (F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))) / F.lit(1e6)
    rate = F.when(up > 0, tot.select("n").scalar() / up).otherwise(F.lit(0.0))
    return per.select(message_key().alias("key"), "kind", "symbol", "messages", "last_activity",
                      rate.alias("overall_rate"))


def error_counts(errors: DataFrame, error_type: str = "error_type") -> DataFrame:
    """Errors per type."""
    return errors.groupBy(error_type).agg(F.count(F.lit(1)).alias("errors"))


def health_rollup(status_log: DataFrame, ts: str = "ts", seq: str | None = None) -> DataFrame:
    """Latest status per component, then one row: overall status
    (unhealthy if any, else degraded if any, else healthy; 'unknown' without
    components), message and counts by status."""
    order = F.struct(F.col(ts), *([F.col(seq)] if seq else []))
    latest = status_log.groupBy("component").agg(F.max_by("status", order).alias("status"))
    c = latest.agg(F.count(F.lit(1)).alias("total_components"),
                   F.count_if(F.col("status") == "healthy").alias("healthy"),
                   F.count_if(F.col("status") == "degraded").alias("degraded"),
                   F.count_if(F.col("status") == "unhealthy").alias("unhealthy"))
    status = F.when(F.col("total_components") == 0, "unknown") \
              .when(F.col("unhealthy") > 0, "unhealthy") \
              .when(F.col("degraded") > 0, "degraded").otherwise("healthy")
    msg = F.when(F.col("total_components") == 0, F.lit("No health checks registered")) \
           .when(F.col("unhealthy") > 0, F.format_string("%d component(s) unhealthy", "unhealthy")) \
           .when(F.col("degraded") > 0, F.format_string("%d component(s) degraded", "degraded")) \
           .otherwise(F.lit("All components healthy"))
    return c.select(status.alias("status"), msg.alias("message"), "total_components",
                    "healthy", "degraded", "unhealthy")


def component_latest(status_log: DataFrame, ts: str = "ts", seq: str | None = None) -> DataFrame:
    """Latest status and time per component (the components section)."""
    order = F.struct(F.col(ts), *([F.col(seq)] if seq else []))
    return status_log.groupBy("component").agg(F.max_by("status", order).alias("status"),
                                                F.max(ts).alias("last_check"))


def _seconds(a: Column, b: Column) -> Column:
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)


def rolling_message_rate(messages: DataFrame, ts: str = "ts", seq: str | None = None,
                         window: int = WINDOW) -> DataFrame:
    """After each message of a key, messages / seconds spanned by the
    key's last ``window`` messages; needs >= 2 messages and a span > 0, else
    the previous rate stands (NULL before the first)."""
    m = messages.withColumn("key", message_key())
    order = [ts] + ([seq] if seq else [])
    s = ordered.sequence(m, ["key"], order, rownum="_g")
    b = ordered.halo_blocks(s, "_g", window - 1)
    w = ordered.block_window(["key"], "_g", -(window - 1), 0)
    b = b.withColumn("_cnt", F.count(F.lit(1)).over(w)).withColumn("_old", F.min(ts).over(w)) \
         .filter(~F.col("_halo"))
    span = _seconds(F.col(ts), F.col("_old"))
    b = b.withColumn("_raw", F.when((F.col("_cnt") >= 2) & (span > 0), F.col("_cnt") / span))
    out = ordered.sequence(b.drop("_blk", "_halo"), ["key"], ["_g"],
                           ordered.seconds_chunk(ts, ordered.CHUNK_SECONDS),
                           rownum=None, ffill={"_raw": "rate"})
    return out.drop("_g", "_cnt", "_old", "_raw")


def operation_timing(timings: DataFrame, op: str = "operation", dur: str = "duration_s",
                     ts: str = "ts", seq: str | None = None, window: int = WINDOW) -> DataFrame:
    """After each recorded duration, avg / max / min (ms) and sample
    count over the operation's last ``window`` durations; ``slow`` when the
    average exceeds one second.  Durations accumulate as integer
    microseconds, so window sums are exact whatever the summation order."""
    order = [ts] + ([seq] if seq else [])
    t = timings.withColumn("_us", F.round(F.col(dur) * F.lit(1e6)).cast("long"))
    s = ordered.sequence(t, [op], order, rownum="_g")
    b = ordered.halo_blocks(s, "_g", window - 1)
    w = ordered.block_window([op], "_g", -(window - 1), 0)
    n = F.count("_us").over(w)
    b = b.withColumns({"avg_ms": F.sum("_us").over(w) / n / F.lit(1000.0),
                       "max_ms": F.max("_us").over(w) / F.lit(1000.0),
                       "min_ms": F.min("_us").over(w) / F.lit(1000.0), "sample_count": n})
    b = b.filter(~F.col("_halo")).withColumn("slow", F.col("avg_ms") > SLOW_SECONDS * 1000)
    return b.drop("_g", "_blk", "_halo", "_us")


def connection_transitions(status_log: DataFrame, key: str = "component", status: str = "status",
                           ts: str = "ts", seq: str | None = None) -> DataFrame:
    """Status changes per connection: rows whose previous status exists
    and differs."""
    order = [ts] + ([seq] if seq else [])
    s = ordered.sequence(status_log, [key], order, rownum=None, prev={status: "old_status"})
    return s.filter(F.col("old_status").isNotNull() & (F.col("old_status") != F.col(status)))
