"""Store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith import schemas
from barsmith.functions.scalars import asset_class as _ac
from barsmith.operators import store as ST
from barsmith.plans.registry import register
from barsmith.plans.sqlparts import ac

STORE_FX = ["fx_ticks", "fx_symbols", "fx_bars"]

# SQL twins of the tick symbol dimension (S5 over fx_symbols) and tick store
DIM_SQL = f"""tk AS (SELECT *, {ac('symbol')} AS asset_class FROM fx_ticks),
newk AS (SELECT k.symbol, k.asset_class, CAST(NULL AS DATE) AS expiry FROM (SELECT DISTINCT symbol, asset_class FROM tk) k
  WHERE NOT EXISTS (SELECT 1 FROM fx_symbols s WHERE s.symbol = k.symbol AND s.asset_class = k.asset_class)),
dim AS (SELECT id, symbol, symbol_group, asset_class, expiry FROM fx_symbols
  UNION ALL SELECT (SELECT max(id) FROM fx_symbols) + row_number() OVER (ORDER BY symbol, asset_class), symbol, symbol, asset_class, expiry FROM newk)"""


def _nz(c):
    return f"CASE WHEN {c} = 0 OR isnan({c}) THEN NULL ELSE {c} END"


TICKS_SQL = DIM_SQL + f""",
tstore AS (SELECT datetime, symbol_id, bid, bidsize, ask, asksize, last, lastsize FROM (
  SELECT tk.datetime, d.symbol_id, {_nz('tk.bid')} AS bid, {_nz('tk.bidsize')} AS bidsize, {_nz('tk.ask')} AS ask,
    {_nz('tk.asksize')} AS asksize, {_nz('tk.last')} AS last, {_nz('tk.lastsize')} AS lastsize,
    row_number() OVER (PARTITION BY tk.datetime, d.symbol_id ORDER BY tk.id) AS rn
  FROM tk JOIN (SELECT symbol, asset_class, min(id) AS symbol_id FROM dim GROUP BY symbol, asset_class) d
  ON tk.symbol = d.symbol AND tk.asset_class = d.asset_class) x WHERE rn = 1)"""


def tick_batch(spark):
    t = spark.table("fx_ticks")
    return t.withColumn("asset_class", _ac("symbol"))


def tick_dim(spark):
    return ST.assign_symbol_ids(tick_batch(spark).select("symbol", "asset_class"),
                                spark.table("fx_symbols"))


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def tick_store(spark, dim=None):
    dim = dim if dim is not None else tick_dim(spark)
    return ST.ingest_ticks(tick_batch(spark), empty(spark, schemas.TICKS), dim, seq="id").drop("date")


@register("assign_symbol_ids", dates=['expiry'], fixtures=["fx_ticks", "fx_symbols"],
          sql=f"WITH {DIM_SQL} SELECT * FROM dim")
def assign_symbol_ids(spark):
    """Get-or-create ids for every tick symbol against the symbol table."""
    return tick_dim(spark)


@register("scan_market_table", fixtures=["fx_bars"], sql="""
SELECT datetime, symbol_id, open, close, volume FROM fx_bars WHERE volume > 40 AND datetime >= TIMESTAMP '1996-01-01'
""")
def scan_market_table(spark):
    """Typed scan with pruned columns and pushed-down filters."""
    return spark.table("fx_bars").select("datetime", "symbol_id", "open", "close", "volume") \
        .filter((F.col("volume") > 40) & (F.col("datetime") >= F.lit("1996-01-01").cast("timestamp_ntz")))


@register("ingest_bars", dates=['date'], fixtures=["fx_bars_raw", "fx_symbols", "fx_bars"], sql="""
WITH b AS (SELECT r.*, s.symbol, s.asset_class FROM fx_bars_raw r JOIN fx_symbols s ON r.symbol_id = s.id),
j AS (SELECT b.datetime, d.id AS symbol_id, b.open, b.high, b.low, b.close, b.volume, b.seq1, b.seq2, b.seq3
  FROM b JOIN (SELECT symbol, asset_class, min(id) AS id FROM fx_symbols GROUP BY symbol, asset_class) d
  ON b.symbol = d.symbol AND b.asset_class = d.asset_class),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY datetime, symbol_id ORDER BY seq1, seq2, seq3) AS rn FROM j) x WHERE rn = 1),
ex AS (SELECT datetime, symbol_id FROM fx_bars WHERE datetime < TIMESTAMP '1998-01-01')
SELECT datetime, symbol_id, open, high, low, close, CAST(volume AS BIGINT) AS volume, CAST(datetime AS DATE) AS date
FROM f WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.datetime = f.datetime AND ex.symbol_id = f.symbol_id)
""")
def ingest_bars(spark):
    """S3: idempotent bar ingest of the raw batch into a store that already
    holds everything before 1998 (rows that would be appended)."""
    s = spark.table("fx_symbols")
    batch = spark.table("fx_bars_raw").join(
        s.select(F.col("id").alias("symbol_id"), "symbol", "asset_class"), "symbol_id") \
        .drop("symbol_id", "id")
    existing = spark.table("fx_bars").filter(F.col("datetime") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return ST.ingest_bars(batch, existing, s, seq=["seq1", "seq2", "seq3"])


@register("ingest_ticks", dates=['date'], fixtures=["fx_ticks", "fx_symbols"], sql=f"""
WITH {TICKS_SQL}
SELECT datetime, symbol_id, bid, bidsize, ask, asksize, last, lastsize, CAST(datetime AS DATE) AS date
FROM tstore WHERE datetime >= TIMESTAMP '2024-01-15'
""")
def ingest_ticks(spark):
    """Ingest the first half of January, then the whole batch again:
    only the second half is appended (insert-ignore, falsy -> NULL)."""
    dim = tick_dim(spark)
    batch = tick_batch(spark)
    first = ST.ingest_ticks(batch.filter(F.col("datetime") < F.lit("2024-01-15").cast("timestamp_ntz")),
                            empty(spark, schemas.TICKS), dim, seq="id")
    return ST.ingest_ticks(batch, first, dim, seq="id")


@register("validate_bars", fixtures=["fx_bars_raw", "fx_symbols"], sql="""
SELECT r.seq1, r.seq2, r.seq3,
  CASE WHEN s.symbol IS NULL THEN 'missing:symbol' WHEN r.datetime IS NULL THEN 'missing:datetime'
    WHEN r.open IS NULL THEN 'missing:open' WHEN r.high IS NULL THEN 'missing:high' WHEN r.low IS NULL THEN 'missing:low'
    WHEN r.close IS NULL THEN 'missing:close' WHEN r.volume IS NULL THEN 'missing:volume'
    WHEN r.high < greatest(r.open, r.close) THEN 'high_below_open_close'
    WHEN r.low > least(r.open, r.close) THEN 'low_above_open_close'
    WHEN r.volume < 0 THEN 'negative_volume' END AS reason
FROM fx_bars_raw r JOIN fx_symbols s ON r.symbol_id = s.id
""")
def validate_bars(spark):
    """Validity flag and first failing reason for every raw bar."""
    s = spark.table("fx_symbols").select(F.col("id").alias("symbol_id"), "symbol")
    v = ST.validate_bars(spark.table("fx_bars_raw").join(s, "symbol_id"))
    return v.select("seq1", "seq2", "seq3", "reason")


@register("validate_ticks", fixtures=["fx_ticks"], sql="""
SELECT id, CASE WHEN symbol IS NULL THEN 'missing:symbol' WHEN datetime IS NULL THEN 'missing:datetime'
  WHEN bid IS NOT NULL AND ask IS NOT NULL AND bid > ask THEN 'bid_above_ask'
  WHEN bidsize < 0 THEN 'negative:bidsize' WHEN asksize < 0 THEN 'negative:asksize' WHEN lastsize < 0 THEN 'negative:lastsize'
  WHEN bid < 0 THEN 'negative:bid' WHEN ask < 0 THEN 'negative:ask' WHEN last < 0 THEN 'negative:last' END AS reason,
  CASE WHEN symbol IS NULL OR datetime IS NULL OR (bid IS NOT NULL AND ask IS NOT NULL AND bid > ask)
    OR bidsize < 0 OR asksize < 0 OR lastsize < 0 OR bid < 0 OR ask < 0 OR last < 0 THEN false ELSE true END AS is_valid
FROM fx_ticks
""")
def validate_ticks(spark):
    """Tick checks (crossed quotes, negative sizes / prices)."""
    return ST.validate_ticks(spark.table("fx_ticks")).select("id", "reason", "is_valid")


@register("time_range_filter", fixtures=["fx_bars"], sql="""
SELECT * FROM fx_bars WHERE datetime BETWEEN TIMESTAMP '1995-03-01' AND TIMESTAMP '1995-12-31 12:00:00'
""")
def time_range_filter(spark):
    """P10: inclusive time range, checked against the 365-day limit."""
    return ST.time_range_filter(spark.table("fx_bars"), "1995-03-01", "1995-12-31T12:00:00", 365)


@register("prepare_history", fixtures=["fx_bars"], sql="""
SELECT timezone('America/New_York', datetime AT TIME ZONE 'UTC') AS datetime, open, high, low, close, CAST(volume AS BIGINT) AS volume
FROM fx_bars
""")
def prepare_history(spark):
    """Typed bars history in New York time, ids dropped, time ordered."""
    return ST.prepare_history(spark.table("fx_bars"), "bars", tz="America/New_York")


@register("historical_bars", fixtures=["fx_bars", "fx_symbols"], sql="""
SELECT s.symbol, b.datetime, b.open, b.high, b.low, b.close, b.volume
FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id
WHERE s.asset_class = 'STK' AND b.datetime BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'
""")
def historical_bars(spark):
    """Stock bars of 1997, ordered by (symbol, datetime)."""
    return ST.historical_bars(spark.table("fx_bars"), spark.table("fx_symbols"), None,
                              "1997-01-01", "1997-12-31", asset_class="STK")


@register("historical_ticks", fixtures=["fx_ticks", "fx_symbols"], sql=f"""
WITH {TICKS_SQL}
SELECT d.symbol, t.datetime, t.bid, t.bidsize, t.ask, t.asksize, t.last, t.lastsize
FROM tstore t JOIN dim d ON t.symbol_id = d.id
WHERE t.datetime BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'
""")
def historical_ticks(spark):
    """Ticks of every asset class between Jan 5 and Jan 20."""
    dim = tick_dim(spark)
    return ST.historical_ticks(tick_store(spark, dim), dim, None, "2024-01-05", "2024-01-20",
                               asset_class=None)


@register("symbol_list_semi_join", fixtures=["fx_bars", "fx_symbols", "fx_trades"], sql="""
SELECT s.symbol, b.datetime, b.open, b.high, b.low, b.close, b.volume
FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id
WHERE s.symbol IN (SELECT symbol FROM fx_trades WHERE exit_time IS NULL AND algo = '1-URGENT')
  AND b.datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'
""")
def symbol_list_semi_join(spark):
    """Bars of the symbols an algo holds open positions in (the symbol
    list is itself a DataFrame, so the filter is a semi join)."""
    syms = spark.table("fx_trades").filter(F.col("exit_time").isNull() & (F.col("algo") == "1-URGENT")) \
        .select("symbol")
    return ST.historical_bars(spark.table("fx_bars"), spark.table("fx_symbols"), syms,
                              "1996-01-01", "1996-06-30", asset_class=None)


@register("greeks_join", fixtures=["fx_greeks", "fx_bars"], sql="""
SELECT g.*, b.datetime AS bar_datetime, b.symbol_id AS bar_symbol_id, b.close AS bar_close, b.volume AS bar_volume
FROM fx_greeks g LEFT JOIN fx_bars b ON g.bar_id = b.id
""")
def greeks_join(spark):
    """Greeks with their bar (tick_id is NULL and never matches)."""
    return ST.greeks_join(spark.table("fx_greeks"), spark.table("fx_bars"))


@register("missing_rows", fixtures=["fx_greeks", "fx_bars"], sql="""
SELECT b.* FROM fx_bars b WHERE NOT EXISTS (SELECT 1 FROM fx_greeks g WHERE g.bar_id = b.id)
""")
def missing_rows(spark):
    """Anti join on the key: bars that have no greeks row."""
    g = spark.table("fx_greeks").select(F.col("bar_id").alias("id"))
    return ST.missing_rows(spark.table("fx_bars"), g, keys=["id"])


@register("latest_tick", fixtures=["fx_ticks", "fx_symbols"], sql=f"""
WITH {TICKS_SQL},
l AS (SELECT symbol_id, arg_max((datetime, bid, bidsize, ask, asksize, last, lastsize), datetime) AS r FROM tstore GROUP BY symbol_id)
SELECT d.symbol, r[1] AS tick_datetime, nullif(r[2], 0) AS tick_bid, r[3] AS tick_bidsize, nullif(r[4], 0) AS tick_ask,
  r[5] AS tick_asksize, nullif(r[6], 0) AS tick_last, r[7] AS tick_lastsize
FROM l JOIN dim d ON l.symbol_id = d.id
""")
def latest_tick(spark):
    """Newest tick of every symbol."""
    dim = tick_dim(spark)
    return ST.latest_tick(tick_store(spark, dim), dim)


@register("latest_bar", fixtures=["fx_bars", "fx_symbols"], sql="""
WITH l AS (SELECT symbol_id, arg_max((datetime, open, high, low, close, volume), datetime) AS r FROM fx_bars GROUP BY symbol_id)
SELECT s.symbol, r[1] AS bar_datetime, nullif(r[2], 0) AS bar_open, nullif(r[3], 0) AS bar_high, nullif(r[4], 0) AS bar_low,
  nullif(r[5], 0) AS bar_close, r[6] AS bar_volume
FROM l JOIN fx_symbols s ON l.symbol_id = s.id
""")
def latest_bar(spark):
    """Newest bar of every symbol."""
    return ST.latest_bar(spark.table("fx_bars"), spark.table("fx_symbols"))


@register("symbols_list", dates=['expiry'], fixtures=["fx_ticks", "fx_symbols"], sql=f"""
WITH {DIM_SQL} SELECT id, symbol, symbol_group, asset_class, expiry, (SELECT count(*) FROM dim) AS count FROM dim
""")
def symbols_list(spark):
    """All symbols ordered by symbol, with the count."""
    return ST.symbols_list(tick_dim(spark))


@register("symbol_statistics", fixtures=["fx_ticks", "fx_symbols", "fx_bars"], sql=f"""
WITH {TICKS_SQL},
b AS (SELECT symbol_id, count(*) AS bars_count, min(open) AS min_price, max(high) AS max_price, min(volume) AS min_volume,
  max(volume) AS max_volume, min(datetime) AS earliest, max(datetime) AS latest FROM fx_bars GROUP BY symbol_id),
t AS (SELECT symbol_id, count(*) AS ticks_count, min(datetime) AS ticks_earliest, max(datetime) AS ticks_latest FROM tstore GROUP BY symbol_id)
SELECT d.id AS symbol_id, d.symbol, d.symbol_group, d.asset_class, coalesce(b.bars_count, 0) AS bars_count, b.min_price, b.max_price,
  b.min_volume, b.max_volume, b.earliest, b.latest, coalesce(t.ticks_count, 0) AS ticks_count, t.ticks_earliest, t.ticks_latest
FROM dim d LEFT JOIN b ON b.symbol_id = d.id LEFT JOIN t ON t.symbol_id = d.id
""")
def symbol_statistics(spark):
    """Bar and tick statistics of every symbol."""
    dim = tick_dim(spark)
    return ST.symbol_statistics(spark.table("fx_bars"), tick_store(spark, dim), dim)


@register("store_summary", fixtures=["fx_ticks", "fx_symbols", "fx_bars"], sql=f"""
WITH {TICKS_SQL}
SELECT (SELECT count(*) FROM dim) AS total_symbols, count(*) AS total_bars, (SELECT count(*) FROM tstore) AS total_ticks,
  min(datetime) AS earliest_bar, max(datetime) AS latest_bar FROM fx_bars
""")
def store_summary(spark):
    """Totals and bar time range."""
    dim = tick_dim(spark)
    return ST.store_summary(dim, spark.table("fx_bars"), tick_store(spark, dim))


@register("quality_report", fixtures=["fx_bars_raw", "fx_ticks"], sql="""
WITH b AS (SELECT count(*) AS total_bars, count(*) FILTER (WHERE coalesce(high < open OR high < close OR low > open OR low > close OR volume < 0, false)) AS invalid_bars FROM fx_bars_raw),
t AS (SELECT count(*) AS total_ticks, count(*) FILTER (WHERE (bid IS NOT NULL AND ask IS NOT NULL AND bid > ask)
  OR bidsize < 0 OR asksize < 0 OR lastsize < 0 OR bid < 0 OR ask < 0 OR last < 0) AS ticks_failing_checks FROM fx_ticks)
SELECT CASE WHEN invalid_bars = 0 THEN 'good' ELSE 'issues_found' END AS overall_status, total_bars, total_bars - invalid_bars AS valid_bars,
  invalid_bars, total_ticks, total_ticks AS valid_ticks, CAST(0 AS BIGINT) AS invalid_ticks, ticks_failing_checks FROM b, t
""")
def quality_report(spark):
    """Bar OHLC quality counts (plus tick check failures)."""
    return ST.quality_report(spark.table("fx_bars_raw"), spark.table("fx_ticks"))


@register("records_json", fixtures=["fx_bars", "fx_symbols"], sql="""
SELECT s.symbol, CAST(to_json({'symbol': s.symbol, 'datetime': strftime(b.datetime, '%Y-%m-%dT%H:%M:%S'), 'open': b.open, 'volume': b.volume}) AS VARCHAR) AS record
FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id
""")
def records_json(spark):
    """History rows as JSON records with ISO time."""
    b = spark.table("fx_bars").join(spark.table("fx_symbols").select(
        F.col("id").alias("symbol_id"), "symbol"), "symbol_id") \
        .select("symbol", "datetime", "open", "volume")
    return ST.records_json(b)
