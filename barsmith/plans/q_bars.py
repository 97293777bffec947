"""Bar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.functions import scalars as S
from barsmith.operators import bars as B
from barsmith.plans.registry import register
from barsmith.plans.sqlparts import ac, is_opt, sg

T_META = f"t AS (SELECT *, {sg('symbol')} AS symbol_group, {ac('symbol')} AS asset_class FROM fx_ticks)"
META_T = """m AS (SELECT symbol, arg_max(symbol_group, (datetime, id)) FILTER (WHERE symbol_group IS NOT NULL) AS symbol_group,
  arg_max(asset_class, (datetime, id)) FILTER (WHERE asset_class IS NOT NULL) AS asset_class FROM {src} GROUP BY symbol)"""
OHLC_OK = "open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL"


def ticks(spark):
    return B.with_meta_columns(spark.table("fx_ticks"))


def bars_with_symbols(spark):
    b = spark.table("fx_bars")
    s = spark.table("fx_symbols")
    return b.join(s.withColumnRenamed("id", "symbol_id").drop("expiry"), "symbol_id") \
            .select("id", "datetime", "symbol", "symbol_group", "asset_class",
                    "open", "high", "low", "close", "volume")


B_SYM = """b AS (SELECT fb.id, fb.datetime, s.symbol, s.symbol_group, s.asset_class, fb.open, fb.high, fb.low, fb.close, fb.volume
  FROM fx_bars fb JOIN fx_symbols s ON fb.symbol_id = s.id)"""


# ------------------------------------------------------------------ flagship
@register("daily_bars", fixtures=["fx_ticks"], sql=f"""
WITH {T_META},
r AS (SELECT max(lo) AS s, min(hi) AS e FROM (SELECT symbol, min(datetime) AS lo, max(datetime) AS hi FROM t GROUP BY symbol) x),
f AS (SELECT t.* FROM t, r WHERE t.datetime <= r.e AND (r.s > r.e OR t.datetime >= r.s)),
d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY datetime, symbol, symbol_group, asset_class ORDER BY id) AS rn FROM f) y WHERE rn = 1),
b AS (SELECT symbol, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS datetime,
  arg_min(last, (datetime, id)) FILTER (WHERE last IS NOT NULL) AS open, max(last) AS high, min(last) AS low,
  arg_max(last, (datetime, id)) FILTER (WHERE last IS NOT NULL) AS close, CAST(coalesce(sum(lastsize), 0) AS BIGINT) AS volume
  FROM d GROUP BY symbol, date_trunc('day', datetime)),
{META_T.format(src='d')}
SELECT b.datetime, b.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume
FROM b JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def daily_bars(spark):
    """Daily OHLCV bars per instrument from raw ticks: range sync, keep-first
    de-duplication, time bars at 1D (the full ``resample`` path)."""
    return B.resample(spark.table("fx_ticks"), "1D", seq="id")


@register("resample_ticks_time", fixtures=["fx_ticks"], sql=f"""
WITH {T_META},
b AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', datetime) AS datetime,
  arg_min(last, (datetime, id)) FILTER (WHERE last IS NOT NULL) AS open, max(last) AS high, min(last) AS low,
  arg_max(last, (datetime, id)) FILTER (WHERE last IS NOT NULL) AS close, CAST(coalesce(sum(lastsize), 0) AS BIGINT) AS volume
  FROM t GROUP BY symbol, time_bucket(INTERVAL '15 minutes', datetime)),
{META_T.format(src='t')}
SELECT b.datetime, b.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume
FROM b JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def resample_ticks_time(spark):
    """A1: 15-minute bars from ticks."""
    return B.resample_ticks_time(ticks(spark), "15T", seq="id")


@register("resample_bars_month", fixtures=["fx_bars", "fx_symbols"], sql=f"""
WITH {B_SYM},
a AS (SELECT symbol, CAST(last_day(datetime) AS TIMESTAMP) AS datetime,
  arg_min(open, (datetime, id)) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, (datetime, id)) FILTER (WHERE close IS NOT NULL) AS close, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume
  FROM b GROUP BY symbol, last_day(datetime)),
{META_T.format(src='b')}
SELECT a.datetime, a.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume
FROM a JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def resample_bars_month(spark):
    """A2 (downsampling): daily bars to month-end bars, no gap fill."""
    return B.resample_bars_time(bars_with_symbols(spark), "1M", seq="id")


@register("resample_bars_fill", fixtures=["fx_bars", "fx_symbols"], sql=f"""
WITH {B_SYM},
a AS (SELECT symbol, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS bucket,
  arg_min(open, (datetime, id)) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, (datetime, id)) FILTER (WHERE close IS NOT NULL) AS close, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume
  FROM b GROUP BY symbol, date_trunc('day', datetime)),
st AS (SELECT symbol, count(*) AS n, min(bucket) AS lo, max(bucket) AS hi FROM a GROUP BY symbol),
nin AS (SELECT symbol, count(*) AS n_in FROM b GROUP BY symbol),
fl AS (SELECT st.symbol, lo, hi, (date_diff('day', lo, hi) + 1) > n_in AS fill FROM st JOIN nin USING (symbol)),
grid AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS TIMESTAMP) AS bucket FROM fl WHERE fill),
g AS (SELECT grid.symbol, grid.bucket, CAST(coalesce(a.volume, 0) AS BIGINT) AS volume,
  last_value(a.open IGNORE NULLS) OVER w AS open, last_value(a.high IGNORE NULLS) OVER w AS high,
  last_value(a.low IGNORE NULLS) OVER w AS low, last_value(a.close IGNORE NULLS) OVER w AS close
  FROM grid LEFT JOIN a ON grid.symbol = a.symbol AND grid.bucket = a.bucket
  WINDOW w AS (PARTITION BY grid.symbol ORDER BY grid.bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
gf AS (SELECT symbol, bucket, CASE WHEN volume <= 0 THEN close ELSE open END AS open,
  CASE WHEN volume <= 0 THEN close ELSE high END AS high, CASE WHEN volume <= 0 THEN close ELSE low END AS low,
  close, volume FROM g),
u AS (SELECT symbol, bucket, open, high, low, close, volume FROM a WHERE symbol IN (SELECT symbol FROM fl WHERE NOT fill)
  UNION ALL SELECT symbol, bucket, open, high, low, close, volume FROM gf),
{META_T.format(src='b')}
SELECT u.bucket AS datetime, u.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume
FROM u JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def resample_bars_fill(spark):
    """A2 (upsampling): sparse daily bars to a dense daily grid with gap fill."""
    return B.resample_bars_time(bars_with_symbols(spark), "1D", seq="id", ffill=True)


@register("resample_tick_count", fixtures=["fx_ticks"], sql=f"""
WITH {T_META},
s AS (SELECT *, row_number() OVER w AS g,
  last_value(last IGNORE NULLS) OVER wr AS fp, last_value(lastsize IGNORE NULLS) OVER wr AS fs FROM t
  WINDOW w AS (PARTITION BY symbol ORDER BY datetime, id),
         wr AS (PARTITION BY symbol ORDER BY datetime, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT symbol, (g - 1) // 5 AS grp, min(datetime) AS datetime,
  arg_min(fp, g) FILTER (WHERE fp IS NOT NULL) AS open, max(fp) AS high, min(fp) AS low,
  arg_max(fp, g) FILTER (WHERE fp IS NOT NULL) AS close, CAST(coalesce(sum(fs), 0) AS BIGINT) AS volume
  FROM s GROUP BY symbol, (g - 1) // 5),
{META_T.format(src='t')}
SELECT b.datetime, b.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume
FROM b JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def resample_tick_count(spark):
    """A3: 5-tick bars."""
    return B.resample_tick_count(ticks(spark), 5, seq="id")


@register("resample_volume", fixtures=["fx_ticks"], sql=f"""
WITH {T_META},
s AS (SELECT *, row_number() OVER w AS g, sum(coalesce(lastsize, 0)) OVER wr AS cum,
  last_value(last IGNORE NULLS) OVER wr AS fp, last_value(lastsize IGNORE NULLS) OVER wr AS fs FROM t
  WINDOW w AS (PARTITION BY symbol ORDER BY datetime, id),
         wr AS (PARTITION BY symbol ORDER BY datetime, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
mk AS (SELECT *, round_even(round_even(CAST(cum AS DOUBLE), 1) / 500.0, 0) * 500 AS mark FROM s),
m0 AS (SELECT symbol, mark AS mark0 FROM mk WHERE g = 1),
gg AS (SELECT mk.*, CASE WHEN mark = mark0 THEN 0.0 ELSE mark / 500 END AS grp FROM mk JOIN m0 USING (symbol)),
b AS (SELECT symbol, grp, min(datetime) AS datetime,
  arg_min(fp, g) FILTER (WHERE fp IS NOT NULL) AS open, max(fp) AS high, min(fp) AS low,
  arg_max(fp, g) FILTER (WHERE fp IS NOT NULL) AS close, CAST(coalesce(sum(fs), 0) AS BIGINT) AS volume
  FROM gg GROUP BY symbol, grp),
{META_T.format(src='t')}
SELECT b.datetime, b.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume
FROM b JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def resample_volume(spark):
    """A4: 500-volume bars."""
    return B.resample_volume(ticks(spark), 500, seq="id")


@register("ticks_to_bars", fixtures=["fx_ticks"], sql="""
SELECT symbol, time_bucket(INTERVAL '1 hour', datetime) AS datetime,
  arg_min(last, (datetime, id)) AS open, max(last) AS high, min(last) AS low,
  arg_max(last, (datetime, id)) AS close, CAST(coalesce(sum(lastsize), 0) AS BIGINT) AS volume
FROM fx_ticks WHERE last IS NOT NULL GROUP BY symbol, time_bucket(INTERVAL '1 hour', datetime)
""")
def ticks_to_bars(spark):
    """A5: hourly OHLCV per symbol from ticks with a price."""
    return B.ticks_to_bars(spark.table("fx_ticks"), "1H", keys=["symbol"], seq="id")


@register("symbol_metadata", fixtures=["fx_ticks"], sql=f"""
WITH {T_META}, {META_T.format(src='t')} SELECT symbol, symbol_group, asset_class FROM m
""")
def symbol_metadata(spark):
    """Last symbol_group / asset_class per symbol."""
    return B.symbol_metadata(ticks(spark), seq="id")


@register("dedupe_per_instrument", fixtures=["fx_bars_raw", "fx_symbols"], sql="""
WITH r AS (SELECT b.datetime, s.symbol, s.symbol_group, s.asset_class, b.seq1, b.seq2, b.seq3,
  b.open, b.high, b.low, b.close, b.volume FROM fx_bars_raw b JOIN fx_symbols s ON b.symbol_id = s.id)
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY datetime, symbol, symbol_group, asset_class
  ORDER BY seq1 DESC, seq2 DESC, seq3 DESC) AS rn FROM r) x WHERE rn = 1
""")
def dedupe_per_instrument(spark):
    """Keep the last row per (datetime, symbol, group, class)."""
    b = spark.table("fx_bars_raw")
    s = spark.table("fx_symbols").withColumnRenamed("id", "symbol_id")
    r = b.join(s, "symbol_id").select("datetime", "symbol", "symbol_group", "asset_class",
                                     "seq1", "seq2", "seq3", "open", "high", "low", "close", "volume")
    return B.dedupe_per_instrument(r, keep="last", seq=["seq1", "seq2", "seq3"])


@register("sync_time_range", fixtures=["fx_ticks"], sql="""
WITH r AS (SELECT max(lo) AS s, min(hi) AS e FROM (SELECT symbol, min(datetime) AS lo, max(datetime) AS hi FROM fx_ticks GROUP BY symbol) x)
SELECT t.* FROM fx_ticks t, r WHERE t.datetime <= r.e AND (r.s > r.e OR t.datetime >= r.s)
""")
def sync_time_range(spark):
    """U4: trim every symbol to the common time range."""
    return B.sync_time_range(spark.table("fx_ticks"))


@register("lag_matrix", fixtures=["fx_ticks"], sql="""
SELECT *, lag(last, 1) OVER w AS last1, lag(last, 2) OVER w AS last2,
  lag(lastsize, 1) OVER w AS lastsize1, lag(lastsize, 2) OVER w AS lastsize2
FROM fx_ticks WINDOW w AS (PARTITION BY symbol ORDER BY datetime, id)
""")
def lag_matrix(spark):
    """The last 3 values of last / lastsize beside each tick."""
    return B.lag_matrix(spark.table("fx_ticks"), ["last", "lastsize"], 3, ["symbol"], ["datetime", "id"])


@register("forward_fill", fixtures=["fx_ticks"], sql="""
SELECT * REPLACE (last_value(last IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY datetime, id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last) FROM fx_ticks
""")
def forward_fill(spark):
    """Carry the last price down per symbol."""
    return B.forward_fill(spark.table("fx_ticks"), ["last"], ["symbol"], ["datetime", "id"])


@register("recent_window", fixtures=["fx_ticks"], sql="""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC, id DESC) AS rn FROM fx_ticks) x
WHERE rn <= 100
""")
def recent_window(spark):
    """The 100 most recent ticks of every symbol (the bar window size)."""
    return B.recent_window(spark.table("fx_ticks"), 100, ["symbol"], ["datetime", "id"])


@register("tick_scalars", fixtures=["fx_ticks"], sql=f"""
SELECT id, symbol, {sg('symbol')} AS symbol_group, {ac('symbol')} AS asset_class,
  coalesce(round_even(round_even(last / 0.05, 0) * 0.05, 2), 0.0) AS last_tick,
  coalesce(last, (bid + ask) / 2) AS mid,
  TRY_CAST(CAST(lastsize AS VARCHAR) AS DOUBLE) IS NOT NULL AS size_is_number,
  round_even(TRY_CAST(CAST(bid AS VARCHAR) AS DOUBLE), 2) AS bid_2dp,
  {is_opt('symbol')} AS is_option
FROM fx_ticks
""")
def tick_scalars(spark):
    """F1 round_to_tick, F2 to_decimal, F3 is_number, F4 symbol_group,
    F5 asset_class, F11 mid_price over every tick."""
    t = spark.table("fx_ticks")
    return t.select("id", "symbol", S.symbol_group("symbol").alias("symbol_group"),
                    S.asset_class("symbol").alias("asset_class"),
                    S.round_to_tick("last", 0.05).alias("last_tick"),
                    S.mid_price("last", "bid", "ask").alias("mid"),
                    S.is_number("lastsize").alias("size_is_number"),
                    S.to_decimal("bid", 2).alias("bid_2dp"),
                    F.substring("symbol", -3, 3).isin("OPT", "FOP").alias("is_option"))


@register("regularize_index", fixtures=["fx_bars", "fx_symbols"], sql=f"""
WITH {B_SYM},
a AS (SELECT symbol, CAST(date_trunc('day', datetime) AS TIMESTAMP) AS bucket,
  arg_min(open, (datetime, id)) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, (datetime, id)) FILTER (WHERE close IS NOT NULL) AS close, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume,
  count(*) AS n FROM b GROUP BY symbol, date_trunc('day', datetime)),
st AS (SELECT symbol, (date_diff('day', min(bucket), max(bucket)) + 1) > sum(n) AS fill FROM a GROUP BY symbol),
{META_T.format(src='b')}
SELECT timezone('Asia/Tokyo', a.bucket AT TIME ZONE 'UTC') AS datetime, a.symbol, m.symbol_group, m.asset_class,
  open, high, low, close, volume
FROM a JOIN st USING (symbol) JOIN m USING (symbol) WHERE {OHLC_OK} AND (NOT st.fill OR volume > 0)
""")
def regularize_index(spark):
    """bars with text timestamps put on a daily grid without fill, in
    Tokyo time."""
    b = bars_with_symbols(spark).withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))
    return B.regularize_index(b, "1D", tz="Asia/Tokyo", seq="id")
