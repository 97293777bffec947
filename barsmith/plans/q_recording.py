"""Recording and strategy queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barsmith.functions.scalars import asset_class, symbol_group
from barsmith.operators import recording as RC
from barsmith.operators import strategies as SG
from barsmith.plans.registry import register
from barsmith.session import scratch_path

# The 80 fixture instruments (16 bases x 5 suffixes, fx_ticks rule).
SUFFIXES = ("", "H2024_FUT", "20240119C00150000_OPT", "USD_CASH", "20240119P00150000_FOP")
SYMBOLS = [f"S{u:02d}{sfx}" for u in range(16) for sfx in SUFFIXES]

EVENTS_SQL = """e AS (SELECT id, datetime, symbol, last AS open,
  CASE WHEN lastsize > 50 THEN 1 WHEN lastsize < 20 THEN -1 ELSE 0 END AS position FROM fx_ticks),
nd AS (SELECT datetime, row_number() OVER (ORDER BY datetime) AS g FROM (SELECT DISTINCT datetime FROM e) x),
f AS (SELECT e.symbol, nd.g, e.datetime, e.open, e.position FROM e JOIN nd ON e.datetime = nd.datetime)"""


def events(spark):
    t = spark.table("fx_ticks")
    pos = F.when(F.col("lastsize") > 50, 1).when(F.col("lastsize") < 20, -1).otherwise(0)
    return t.select("id", "datetime", "symbol", symbol_group("symbol").alias("symbol_group"),
                    asset_class("symbol").alias("asset_class"), F.col("last").alias("open"),
                    pos.alias("position"))


def listed(rows):
    """Events of the listed instruments; any other fails the query instead of
    being left out of the wide table."""
    known = F.col("symbol").isin(SYMBOLS) | F.col("symbol").isNull()
    stray = F.raise_error(F.concat(F.lit("instrument is not listed: "), F.col("symbol")))
    return rows.withColumn("symbol", F.when(known, F.col("symbol")).otherwise(stray.cast("string")))


def _name(c):
    return c.replace("_FUT_", "_").replace("_OPT_OPT_", "_OPT_")


def _pivot_sql():
    cols = []
    for s in SYMBOLS:
        cols.append(f"max(CASE WHEN symbol = '{s}' THEN open END) AS \"{_name(s + '_OPEN')}\"")
        cols.append(f"max(CASE WHEN symbol = '{s}' THEN position END) AS \"_p_{s}\"")
    outs = []
    for s in SYMBOLS:
        outs.append(f"\"{_name(s + '_OPEN')}\"")
        outs.append(f"coalesce(lag(\"_p_{s}\") OVER (ORDER BY datetime), 0) AS \"{_name(s + '_POSITION')}\"")
    return f"""WITH {EVENTS_SQL},
w AS (SELECT datetime, {', '.join(cols)} FROM e GROUP BY datetime)
SELECT datetime, {', '.join(outs)} FROM w"""


PIVOT_SQL = _pivot_sql()


@register("recorded_pivot", fixtures=["fx_ticks"], sql=PIVOT_SQL)
def recorded_pivot(spark):
    """A13 (+W3): the wide recorded table of every instrument's open price and
    shifted position, one row per datetime."""
    return RC.recorded_pivot(listed(events(spark)), SYMBOLS, seq="id")


@register("position_shift", fixtures=["fx_ticks"], sql=f"""
WITH {EVENTS_SQL},
sh AS (SELECT symbol, g + 1 AS g, position AS p FROM f),
grid AS (SELECT symbol, g FROM f UNION SELECT symbol, g FROM sh)
SELECT grid.symbol, nd.datetime, coalesce(sh.p, 0) AS position
FROM grid LEFT JOIN sh ON grid.symbol = sh.symbol AND grid.g = sh.g JOIN nd ON nd.g = grid.g
""")
def position_shift(spark):
    """Each instrument's position on the previous recorded row (0 first)."""
    return RC.position_shift(events(spark), seq="id")


@register("backtest_position", fixtures=["fx_ticks"], sql=f"""
WITH {EVENTS_SQL},
q AS (SELECT s.symbol, nd.g, coalesce(f.position, 0) AS q FROM (SELECT DISTINCT symbol FROM e) s CROSS JOIN nd
  LEFT JOIN f ON f.symbol = s.symbol AND f.g = nd.g),
p AS (SELECT symbol, g, coalesce(lag(q) OVER (PARTITION BY symbol ORDER BY g), 0) AS p FROM q),
ch AS (SELECT symbol, g, p, lag(p) OVER (PARTITION BY symbol ORDER BY g) AS pp FROM p),
lc AS (SELECT symbol, max(g) AS gstar FROM ch WHERE pp IS NULL OR p <> pp GROUP BY symbol),
latest AS (SELECT symbol, p AS position FROM p WHERE g = (SELECT max(g) FROM nd))
SELECT l.symbol, l.position, CASE WHEN l.position <> 0 THEN f.open ELSE 0.0 END AS avg_cost
FROM latest l JOIN lc ON l.symbol = lc.symbol LEFT JOIN f ON f.symbol = l.symbol AND f.g = lc.gstar
""")
def backtest_position(spark):
    """Latest backtest position and average cost per instrument."""
    return RC.backtest_position(events(spark), seq="id")


@register("export_recorded", fixtures=["fx_ticks"], sql=PIVOT_SQL)
def export_recorded(spark):
    """The recorded table written as Parquet and read back."""
    path = scratch_path(spark, "recorded", f"rec-{uuid.uuid4().hex}")
    RC.export_recorded(RC.recorded_pivot(listed(events(spark)), SYMBOLS, seq="id"), path)
    return spark.read.parquet(path)


@register("sma_crossover", fixtures=["fx_bars", "fx_symbols"], sql="""
WITH b AS (SELECT b.id, b.datetime, s.symbol, b.open, b.high, b.low, b.close, b.volume
  FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id),
w AS (SELECT *,
  CASE WHEN count(*) OVER w10 = 10 THEN CAST(sum(mu) OVER w10 AS DOUBLE) / 10.0 / 1e6 END AS sma_fast,
  CASE WHEN count(*) OVER w20 = 20 THEN CAST(sum(mu) OVER w20 AS DOUBLE) / 20.0 / 1e6 END AS sma_slow
  FROM (SELECT *, CAST(round(close * 1e6) AS BIGINT) AS mu FROM b) b WINDOW w10 AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
    w20 AS (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, sma_fast - sma_slow AS dd FROM w)
SELECT * EXCLUDE (dd, pd, mu), CASE WHEN pd <= 0 AND dd > 0 THEN 'BUY' WHEN pd >= 0 AND dd < 0 THEN 'SELL' END AS signal
FROM (SELECT *, lag(dd) OVER (PARTITION BY symbol ORDER BY datetime) AS pd FROM d) x
""")
def sma_crossover(spark):
    """SMA(10) / SMA(20) crossover signals over daily bars."""
    b = spark.table("fx_bars").join(spark.table("fx_symbols").select(
        F.col("id").alias("symbol_id"), "symbol"), "symbol_id") \
        .select("id", "datetime", "symbol", "open", "high", "low", "close", "volume")
    return SG.sma_crossover(b)


@register("apply_strategy", fixtures=["fx_ticks"], sql="""
WITH t AS (SELECT * FROM fx_ticks WHERE last IS NOT NULL),
w AS (SELECT symbol, datetime, last,
  first_value(last) OVER (PARTITION BY symbol, CAST(datetime AS DATE) ORDER BY datetime, id) AS o,
  lag(last) OVER (PARTITION BY symbol, CAST(datetime AS DATE) ORDER BY datetime, id) AS prev FROM t)
SELECT symbol, datetime, CASE WHEN last > o THEN 'BUY' ELSE 'SELL' END AS signal, last AS price FROM w
WHERE (last > o AND prev <= o) OR (last < o AND prev >= o)
""")
def apply_strategy(spark):
    """A user callback (session breakout) run per instrument and day
    (days above the session row limit would be split)."""
    t = spark.table("fx_ticks").filter(F.col("last").isNotNull()).select("id", "datetime", "symbol", "last")
    return SG.apply_strategy(t, SG.session_breakout, order=("datetime", "id"))
