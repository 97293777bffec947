"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.functions import calendar as C
from barsmith.operators import reports as R
from barsmith.plans.registry import register

SLIP = """CASE WHEN (direction = 'LONG' AND entry_price > market_price) OR (direction = 'SHORT' AND entry_price < market_price)
  THEN -abs(entry_price - market_price) ELSE abs(entry_price - market_price) END"""

PRICES_SQL = """px AS (SELECT s.symbol, max(b.close) AS last_price FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id GROUP BY s.symbol)"""


def bar_prices(spark):
    """Per-symbol valuation price from the bars store (close as 'last')."""
    b = spark.table("fx_bars").join(spark.table("fx_symbols").select(
        F.col("id").alias("symbol_id"), "symbol"), "symbol_id")
    return R.last_price(b.withColumnRenamed("close", "last"), mode="max")


@register("closed_trades_report", fixtures=["fx_trades"], sql=f"""
SELECT *, {SLIP} AS slippage FROM fx_trades
WHERE exit_time IS NOT NULL AND entry_time >= TIMESTAMP '1996-01-01' AND exit_time <= TIMESTAMP '1997-12-31'
""")
def closed_trades_report(spark):
    """Closed trades entered from 1996 and exited by end-1997, with slippage."""
    return R.closed_trades_report(spark.table("fx_trades"), "1996-01-01", "1997-12-31")


@register("closed_trades_by_algo", fixtures=["fx_trades"], sql=f"""
SELECT *, {SLIP} AS slippage FROM fx_trades
WHERE exit_time IS NOT NULL AND entry_time >= TIMESTAMP '1995-01-01' AND algo = '2-HIGH'
""")
def closed_trades_by_algo(spark):
    """P12 with the algo filter and an open end."""
    return R.closed_trades_report(spark.table("fx_trades"), "1995-01-01", None, algo="2-HIGH")


@register("last_price_max", fixtures=["fx_ticks"], sql="""
SELECT symbol, max(last) AS last_price FROM fx_ticks GROUP BY symbol
""")
def last_price_max(spark):
    """A9 (reference mode): MAX(last) per symbol."""
    return R.last_price(spark.table("fx_ticks"), mode="max")


@register("last_price_latest", fixtures=["fx_ticks"], sql="""
SELECT symbol, arg_max(last, datetime) FILTER (WHERE last IS NOT NULL) AS last_price FROM fx_ticks GROUP BY symbol
""")
def last_price_latest(spark):
    """A9 (latest mode): last price at the greatest time."""
    return R.last_price(spark.table("fx_ticks"), mode="latest")


@register("open_positions", fixtures=["fx_trades", "fx_bars", "fx_symbols"], sql=f"""
WITH {PRICES_SQL}
SELECT t.*, coalesce(px.last_price, 0.0) AS last_price,
  CASE WHEN px.last_price IS NULL THEN 0.0 WHEN direction = 'SHORT' THEN entry_price - px.last_price ELSE px.last_price - entry_price END AS unrealized_pnl,
  {SLIP} AS slippage
FROM fx_trades t LEFT JOIN px ON t.symbol = px.symbol WHERE t.exit_time IS NULL
""")
def open_positions(spark):
    """Open positions valued at the per-symbol price."""
    return R.open_positions(spark.table("fx_trades"), bar_prices(spark))


@register("distinct_algos", fixtures=["fx_trades"], sql="SELECT DISTINCT algo FROM fx_trades")
def distinct_algos(spark):
    """A10: the algos with trades."""
    return R.distinct_algos(spark.table("fx_trades"))


@register("account_summary", fixtures=["fx_account_values"], sql="""
WITH p AS (SELECT account,
  max(CASE WHEN tag = 'NetLiquidation' THEN TRY_CAST(value AS DOUBLE) END) AS nl,
  max(CASE WHEN tag = 'PreviousDayEquityWithLoanValue' THEN TRY_CAST(value AS DOUBLE) END) AS pd,
  max(CASE WHEN tag = 'UnrealizedPnL' THEN TRY_CAST(value AS DOUBLE) END) AS up,
  max(CASE WHEN tag = 'RealizedPnL' THEN TRY_CAST(value AS DOUBLE) END) AS rp,
  max(CASE WHEN tag = 'ExcessLiquidity' THEN TRY_CAST(value AS DOUBLE) END) AS el,
  max(CASE WHEN tag = 'MaintMarginReq' THEN TRY_CAST(value AS DOUBLE) END) AS mm,
  max(CASE WHEN tag = 'SMA' THEN TRY_CAST(value AS DOUBLE) END) AS sma
  FROM fx_account_values GROUP BY account)
SELECT account, coalesce(nl, 0.0) - coalesce(pd, 0.0) AS daily_pnl, coalesce(up, 0.0) AS unrealized_pnl,
  coalesce(rp, 0.0) AS realized_pnl, coalesce(nl, 0.0) AS net_liquidity, coalesce(el, 0.0) AS excess_liquidity,
  coalesce(mm, 0.0) AS maint_margin, coalesce(sma, 0.0) AS sma FROM p
""")
def account_summary(spark):
    """Account figures from tag/value rows."""
    return R.account_summary(spark.table("fx_account_values"))


def _short(c):
    x = f"upper({c})"
    for a, b in R.SHORT_CODES:
        x = f"regexp_replace({x}, '{a}', '{b}')"
    return x


@register("report_view", fixtures=["fx_trades", "fx_bars", "fx_symbols"], sql=f"""
WITH {PRICES_SQL},
p AS (SELECT t.*, coalesce(px.last_price, 0.0) AS last_price,
  CASE WHEN px.last_price IS NULL THEN 0.0 WHEN direction = 'SHORT' THEN entry_price - px.last_price ELSE px.last_price - entry_price END AS unrealized_pnl,
  {SLIP} AS slippage
  FROM fx_trades t LEFT JOIN px ON t.symbol = px.symbol WHERE t.exit_time IS NULL)
SELECT *, CASE WHEN coalesce(exit_reason, '') = '' THEN 'active' ELSE 'completed' END AS pos_status,
  CASE WHEN coalesce(unrealized_pnl, 0.0) = 0 THEN '' WHEN coalesce(unrealized_pnl, 0.0) > 0 THEN 'positive' ELSE 'negative' END AS pnl_status,
  upper(substring(regexp_replace(algo, '([A-Z])', ' \\1', 'g'), 1, 1)) || substring(regexp_replace(algo, '([A-Z])', ' \\1', 'g'), 2) AS algo_name,
  {_short('direction')} AS direction_code, {_short('order_type')} AS order_type_code,
  {_short("coalesce(exit_reason, '')")} AS exit_reason_code,
  CASE WHEN target = 0 THEN NULL ELSE target END AS target_shown, CASE WHEN stop = 0 THEN NULL ELSE stop END AS stop_shown,
  CASE WHEN last_price = 0 THEN NULL ELSE last_price END AS last_price_shown
FROM p
""")
def report_view(spark):
    """Dashboard view of the open positions."""
    return R.report_view(R.open_positions(spark.table("fx_trades"), bar_prices(spark)))


@register("trading_calendar", dates=['previous_weekday', 'week_start'], fixtures=["fx_ticks"], sql="""
WITH t AS (SELECT DISTINCT datetime AS ts FROM fx_ticks),
b AS (SELECT ts, CAST(ts AS DATE) - INTERVAL 1 DAY AS pd, ts - INTERVAL 7 DAY AS bd,
  CAST(date_trunc('month', ts) + INTERVAL 14 DAY AS DATE) AS d15 FROM t),
c AS (SELECT *, d15 + CAST((5 - dayofweek(d15) + 7) % 7 AS INTEGER) AS tf FROM b)
SELECT ts,
  CAST(CASE dayofweek(pd) WHEN 6 THEN pd - INTERVAL 1 DAY WHEN 0 THEN pd - INTERVAL 2 DAY ELSE pd END AS DATE) AS previous_weekday,
  CASE dayofweek(bd) WHEN 6 THEN bd - INTERVAL 1 DAY WHEN 0 THEN bd - INTERVAL 2 DAY ELSE bd END AS backdate,
  (dayofweek(ts) = 5 OR (dayofweek(ts) = 4 AND hour(ts) >= 17)) AND day(ts) > 14 AND day(ts) < 22 AS is_third_friday,
  ts > CAST(tf AS TIMESTAMP) + INTERVAL 16 HOUR AS after_third_friday,
  CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS DATE) AS week_start
FROM c
""")
def trading_calendar(spark):
    """calendar facts for every tick time."""
    return C.trading_calendar(spark.table("fx_ticks"), "datetime", "7D")


@register("backfill_plan", fixtures=["fx_bars", "fx_symbols"], sql="""
WITH l AS (SELECT s.symbol, max(b.datetime) AS last_stored FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id GROUP BY s.symbol),
d AS (SELECT symbol, last_stored, epoch_us(TIMESTAMP '2002-03-15 09:30:00') - epoch_us(last_stored) AS us FROM l),
e AS (SELECT *, floor(us / 86400000000) AS days, floor((us - floor(us / 86400000000) * 86400000000) / 1000000) AS secs FROM d)
SELECT symbol, last_stored, CASE WHEN days < 0 OR secs < 60 THEN NULL
  WHEN days = 0 AND secs > 1 THEN CAST(CAST(secs AS BIGINT) AS VARCHAR) || ' S'
  WHEN days > 0 AND days < 31 THEN CAST(CAST(days AS BIGINT) AS VARCHAR) || ' D'
  WHEN days > 31 AND days < 365 THEN CAST(CAST(ceil(days / 30) AS BIGINT) AS VARCHAR) || ' M'
  ELSE CAST(CAST(ceil(days / 365) AS BIGINT) AS VARCHAR) || ' Y' END AS duration
FROM e
""")
def backfill_plan(spark):
    """F8: per symbol, the duration to request from the last stored bar to
    the as-of time."""
    b = spark.table("fx_bars").join(spark.table("fx_symbols").select(
        F.col("id").alias("symbol_id"), "symbol"), "symbol_id")
    last = b.groupBy("symbol").agg(F.max("datetime").alias("last_stored"))
    now = F.lit("2002-03-15 09:30:00").cast("timestamp_ntz")
    return last.select("symbol", "last_stored", C.duration_label("last_stored", now).alias("duration"))


@register("convert_timezone", fixtures=["fx_ticks"], sql="""
SELECT id, timezone('Asia/Tokyo', datetime AT TIME ZONE 'UTC') AS tokyo,
  timezone('UTC', timezone('Asia/Tokyo', datetime AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo') AS back_to_utc,
  CAST(strptime(strftime(datetime, '%Y-%m-%d %H:%M:%S') || '+09:00', '%Y-%m-%d %H:%M:%S%z') AT TIME ZONE 'UTC' AS TIMESTAMP) AS from_offset,
  strftime(timezone('America/New_York', datetime AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M') AS ny_text
FROM fx_ticks
""")
def convert_timezone(spark):
    """zone conversions of every tick time (to Tokyo and back, text with
    an offset parsed to UTC, formatted New York time)."""
    from barsmith.functions import timeutil as TU
    t = spark.table("fx_ticks")
    tokyo = TU.to_local("datetime", "Asia/Tokyo")
    txt = F.concat(F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"), F.lit("+09:00"))
    return t.select("id", tokyo.alias("tokyo"), TU.to_utc(tokyo, "Asia/Tokyo").alias("back_to_utc"),
                    TU.parse_utc(txt).alias("from_offset"),
                    TU.format_ts(TU.to_local("datetime", "America/New_York"), "yyyy-MM-dd HH:mm").alias("ny_text"))
