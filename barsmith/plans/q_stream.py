"""Normalisation and streaming queries (P1-P3, P5-P7, F13, W4, S6, S7, TS1-TS7).

Stream queries read the driver's ``events`` parquet as a file stream, apply
the same fixture SQL to the streaming view, run with ``availableNow`` into a
file table under the checkpoint folder and return that table (stream =
batch twin for closed windows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from barsmith.operators import normalize as NO
from barsmith.operators import store as ST
from barsmith.plans.registry import register
from barsmith.plans.sqlparts import ac, sg
from barsmith.session import scratch_path
from barsmith.sources.fixtures import FIXTURE_SQL
from barsmith.sources.instruments import CANONICAL
from barsmith.streaming import streams as SS
from barsmith.plans.q_catalog import _live_sql, contracts, JUL1

QUOTES_SQL = f"""q AS (SELECT symbol, {sg('symbol')} AS symbol_group, {ac('symbol')} AS asset_class, datetime AS timestamp,
  'QUOTE' AS kind, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask,
  CASE WHEN {ac('symbol')} = 'CSH' AND last IS NULL AND bid IS NOT NULL AND ask IS NOT NULL THEN (bid + ask) / 2 ELSE last END AS last,
  CAST(bidsize AS DOUBLE) AS bidSize, CAST(asksize AS DOUBLE) AS askSize, CAST(lastsize AS DOUBLE) AS lastSize,
  CAST(NULL AS DOUBLE) AS volume FROM fx_ticks)"""


def quotes(spark):
    return NO.normalize_quotes(spark.table("fx_ticks"))


def fixture_stream(spark, fixture, wide=False):
    """A fixture over ``events`` as a stream: the whole table replayed in time
    order, several micro-batches (``wide``: of several files)."""
    view = f"events_stream_{uuid.uuid4().hex}"
    SS.replay(spark.table("events"), "ts", seq="event_id", wide=wide).createOrReplaceTempView(view)
    return spark.sql(FIXTURE_SQL[fixture][0].replace("FROM events", f"FROM {view}"))


def ticks_stream(spark, wide=False):
    return fixture_stream(spark, "fx_ticks", wide)


@register("normalize_quotes", fixtures=["fx_ticks"], sql=f"WITH {QUOTES_SQL} SELECT * FROM q")
def normalize_quotes(spark):
    """Quote messages from ticks (CASH mid price when last is missing)."""
    return quotes(spark)


@register("normalize_ticks", fixtures=["fx_ticks"], sql=f"""
SELECT symbol, {sg('symbol')} AS symbol_group, {ac('symbol')} AS asset_class, datetime AS timestamp, 'TICK' AS kind,
  last AS price, coalesce(CAST(lastsize AS DOUBLE), 0.0) AS size, CAST(0.0 AS DOUBLE) AS volume FROM fx_ticks WHERE last IS NOT NULL
""")
def normalize_ticks(spark):
    """Trade tick messages (rows without a price dropped)."""
    return NO.normalize_ticks(spark.table("fx_ticks"))


@register("normalize_bars", fixtures=["fx_bars", "fx_symbols"], sql="""
SELECT s.symbol, s.symbol AS symbol_group, CASE s.asset_class WHEN 'CASH' THEN 'CSH' ELSE s.asset_class END AS asset_class,
  b.datetime AS timestamp, 'BAR' AS kind, coalesce(b.open, 0.0) AS open, coalesce(b.high, 0.0) AS high,
  coalesce(b.low, 0.0) AS low, coalesce(b.close, 0.0) AS close, coalesce(CAST(b.volume AS DOUBLE), 0.0) AS volume
FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id
""")
def normalize_bars(spark):
    """Bar messages (the store's symbols carry their type in sec_type)."""
    b = spark.table("fx_bars").join(spark.table("fx_symbols").select(
        F.col("id").alias("symbol_id"), "symbol", F.col("asset_class").alias("sec_type")), "symbol_id")
    return NO.normalize_bars(b).withColumn("symbol_group", F.col("symbol"))


BOOK_SQL = """bk AS (SELECT symbol, 'ORDERBOOK' AS kind, datetime AS timestamp,
  coalesce(list({'price': CAST(price AS DOUBLE), 'size': CAST(size AS DOUBLE), 'market_maker': coalesce(market_maker, '')}
    ORDER BY CAST(price AS DOUBLE) DESC, CAST(size AS DOUBLE) DESC) FILTER (WHERE side = 'BID'), []) AS bids,
  coalesce(list({'price': CAST(price AS DOUBLE), 'size': CAST(size AS DOUBLE), 'market_maker': coalesce(market_maker, '')}
    ORDER BY CAST(price AS DOUBLE) ASC, CAST(size AS DOUBLE) DESC) FILTER (WHERE side = 'ASK'), []) AS asks
  FROM fx_book_levels GROUP BY symbol, datetime)"""


@register("normalize_order_book", nested=['bids', 'asks'], fixtures=["fx_book_levels"], sql=f"WITH {BOOK_SQL} SELECT * FROM bk")
def normalize_order_book(spark):
    """P5: order book snapshots from depth levels."""
    return NO.normalize_order_book(spark.table("fx_book_levels"))


@register("book_top", fixtures=["fx_book_levels"], sql=f"""
WITH {BOOK_SQL}
SELECT symbol, timestamp, coalesce(bids[1].price, 0.0) AS bid, coalesce(bids[1].size, 0.0) AS bidsize,
  coalesce(asks[1].price, 0.0) AS ask, coalesce(asks[1].size, 0.0) AS asksize FROM bk
""")
def book_top(spark):
    """best bid / ask per snapshot (zeros without a book side)."""
    return NO.book_top_of_levels(spark.table("fx_book_levels"))


@register("prefix_option_columns", fixtures=["fx_greeks", "fx_symbols"], sql="""
SELECT g.*, s.asset_class AS sec_type,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.price END AS opt_price,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.underlying END AS opt_underlying,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.dividend END AS opt_dividend,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN CAST(g.volume AS DOUBLE) END AS opt_volume,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.iv END AS opt_iv,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.oi END AS opt_oi,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.delta END AS opt_delta,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.gamma END AS opt_gamma,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.vega END AS opt_vega,
  CASE WHEN s.asset_class IN ('OPT', 'FOP') THEN g.theta END AS opt_theta
FROM fx_greeks g JOIN fx_symbols s ON s.id = g.bar_id // 100000000
""")
def prefix_option_columns(spark):
    """Option fields of the greeks as opt_* columns (options only)."""
    g = spark.table("fx_greeks")
    s = spark.table("fx_symbols").select(F.col("id").alias("_sid"), F.col("asset_class").alias("sec_type"))
    j = g.join(s, F.floor(F.col("bar_id") / 100000000) == F.col("_sid")).drop("_sid")
    return NO.prefix_option_columns(j)


@register("ensure_option_columns", fixtures=["fx_ticks"], sql="""
SELECT *, CAST(NULL AS DOUBLE) AS opt_price, CAST(NULL AS DOUBLE) AS opt_underlying, CAST(NULL AS DOUBLE) AS opt_dividend,
  CAST(NULL AS DOUBLE) AS opt_volume, CAST(NULL AS DOUBLE) AS opt_iv, CAST(NULL AS DOUBLE) AS opt_oi,
  CAST(NULL AS DOUBLE) AS opt_delta, CAST(NULL AS DOUBLE) AS opt_gamma, CAST(NULL AS DOUBLE) AS opt_theta,
  CAST(NULL AS DOUBLE) AS opt_vega FROM fx_ticks
""")
def ensure_option_columns(spark):
    """Ticks without option data get all ten opt_* columns (NULL)."""
    return NO.ensure_option_columns(spark.table("fx_ticks"))


CHANGES_SQL = f"""WITH {QUOTES_SQL},
c AS (SELECT *, lag(last) OVER (PARTITION BY symbol ORDER BY timestamp) AS prev_price,
  row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM q WHERE asset_class = 'CSH')"""


@register("price_change_ticks", fixtures=["fx_ticks"], sql=f"""
{CHANGES_SQL} SELECT * EXCLUDE (rn) FROM c WHERE rn > 1 AND last IS DISTINCT FROM prev_price
""")
def price_change_ticks(spark):
    """CASH quotes whose price changed."""
    return NO.price_change_ticks(quotes(spark))


@register("stream_price_changes", fixtures=["fx_ticks"], sql=f"""
{CHANGES_SQL} SELECT symbol, timestamp, last, prev_price FROM c WHERE rn > 1 AND last IS DISTINCT FROM prev_price
""")
def stream_price_changes(spark):
    """TS6: the same changes from a quote stream with per-symbol value state."""
    q = NO.normalize_quotes(ticks_stream(spark))
    path = SS.run_to_table(SS.stream_price_changes(q), "price-changes")
    return spark.read.parquet(path)


@register("stream_normalize", fixtures=["fx_ticks"], sql=f"WITH {QUOTES_SQL} SELECT * FROM q")
def stream_normalize(spark):
    """TS1: quote normalisation on the tick stream."""
    q = SS.stream_normalize(ticks_stream(spark))["QUOTE"]
    return spark.read.parquet(SS.run_to_table(q, "normalize"))


@register("stream_bars", fixtures=["fx_ticks"], sql="""
WITH b AS (SELECT symbol, time_bucket(INTERVAL '1 hour', datetime) AS datetime,
  time_bucket(INTERVAL '1 hour', datetime) + INTERVAL 1 HOUR AS window_end,
  arg_min(last, (datetime, id)) FILTER (WHERE last IS NOT NULL) AS open, max(last) AS high, min(last) AS low,
  arg_max(last, (datetime, id)) FILTER (WHERE last IS NOT NULL) AS close, CAST(coalesce(sum(lastsize), 0) AS BIGINT) AS volume
  FROM fx_ticks GROUP BY symbol, time_bucket(INTERVAL '1 hour', datetime))
SELECT * FROM b WHERE open IS NOT NULL AND window_end <= (SELECT max(datetime) FROM fx_ticks) - INTERVAL 10 MINUTE
""")
def stream_bars(spark):
    """TS2: completed hourly bars from the tick stream (10-minute watermark)."""
    b = SS.stream_bars(ticks_stream(spark), "1 hour", "10 minutes", seq="id")
    return spark.read.parquet(SS.run_to_table(b, "bars"))


@register("stream_latest", fixtures=["fx_ticks"], sql=f"""
WITH {QUOTES_SQL}
SELECT symbol, arg_max((symbol_group, asset_class, timestamp, bid, ask, last, bidSize, askSize, lastSize, volume), timestamp) AS r FROM q GROUP BY symbol
""".replace("SELECT symbol, arg_max", "SELECT symbol, r[1] AS symbol_group, r[2] AS asset_class, r[3] AS timestamp, r[4] AS bid, r[5] AS ask, r[6] AS last, r[7] AS bidSize, r[8] AS askSize, r[9] AS lastSize, r[10] AS volume FROM (SELECT symbol, arg_max", 1) + ") z")
def stream_latest(spark):
    """TS3: the latest quote per symbol, maintained by a stateful stream."""
    q = NO.normalize_quotes(ticks_stream(spark))
    base = SS.run_latest_table(SS.stream_latest(q), "latest")
    return SS.read_latest_table(spark, base)


@register("stream_message_rate", fixtures=["fx_messages"], sql="""
WITH w AS (SELECT kind, symbol, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS messages
  FROM fx_messages GROUP BY kind, symbol, time_bucket(INTERVAL '1 hour', ts))
SELECT kind, symbol, window_start, messages, messages / 3600 AS rate FROM w
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM fx_messages) - INTERVAL 10 MINUTE
""")
def stream_message_rate(spark):
    """TS4: hourly message counts and rates per (kind, symbol), closed windows."""
    m = fixture_stream(spark, "fx_messages")
    return spark.read.parquet(SS.run_to_table(SS.stream_message_rate(m), "rates"))


def _nz(c):
    return f"CASE WHEN {c} = 0 OR isnan({c}) THEN NULL ELSE {c} END"


def _at_rest(c):
    """A price as stored (exact decimal) and read back."""
    return f"CAST(CAST({_nz(c)} AS DECIMAL(20, 8)) AS DOUBLE)"


@register("stream_ingest", dates=['date'], fixtures=["fx_ticks"], sql=f"""
WITH tk AS (SELECT *, {ac('symbol')} AS asset_class FROM fx_ticks),
dim AS (SELECT symbol, asset_class, row_number() OVER (ORDER BY symbol, asset_class) AS symbol_id FROM (SELECT DISTINCT symbol, asset_class FROM tk) k)
SELECT tk.datetime, dim.symbol_id, {_at_rest('bid')} AS bid, {_nz('bidsize')} AS bidsize, {_at_rest('ask')} AS ask,
  {_nz('asksize')} AS asksize, {_at_rest('last')} AS last, {_nz('lastsize')} AS lastsize, CAST(tk.datetime AS DATE) AS date
FROM tk JOIN dim ON tk.symbol = dim.symbol AND tk.asset_class = dim.asset_class
""")
def stream_ingest(spark):
    """TS5: the tick stream ingested idempotently into a fresh store (ids
    created as symbols appear); the store's content."""
    t = ticks_stream(spark, wide=True)
    from barsmith.functions.scalars import asset_class
    t = t.withColumn("asset_class", asset_class("symbol"))
    root = scratch_path(spark, "stores", f"ticks-{uuid.uuid4().hex}")
    SS.stream_ingest(t, f"{root}/ticks", f"{root}/symbols")
    return ST.read_store(spark, f"{root}/ticks")


@register("stream_instrument_changes", fixtures=["fx_contracts"], sql=f"""
WITH o AS ({_live_sql('fx_contracts', 202407, 20240701)}),
n AS ({_live_sql("(SELECT * REPLACE (coalesce(exchange, 'IDEALPRO') AS exchange) FROM fx_contracts)", 202407, 20240701)})
SELECT *, 'ADDED' AS change, 1 AS version FROM o
UNION ALL SELECT *, 'ADDED', 2 FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.symbol IS NOT DISTINCT FROM n.symbol
  AND o.sec_type IS NOT DISTINCT FROM n.sec_type AND o.exchange IS NOT DISTINCT FROM n.exchange AND o.currency IS NOT DISTINCT FROM n.currency
  AND o.expiry IS NOT DISTINCT FROM n.expiry AND o.strike IS NOT DISTINCT FROM n.strike AND o.opt_type IS NOT DISTINCT FROM n.opt_type)
UNION ALL SELECT *, 'REMOVED', 2 FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.symbol IS NOT DISTINCT FROM n.symbol
  AND o.sec_type IS NOT DISTINCT FROM n.sec_type AND o.exchange IS NOT DISTINCT FROM n.exchange AND o.currency IS NOT DISTINCT FROM n.currency
  AND o.expiry IS NOT DISTINCT FROM n.expiry AND o.strike IS NOT DISTINCT FROM n.strike AND o.opt_type IS NOT DISTINCT FROM n.opt_type)
""")
def stream_instrument_changes(spark):
    """TS7: two raw list versions (the second with missing exchanges
    filled) dropped into a watched folder; the stream cleans each as of
    Jul 1 and reports the first as added and the changes of the second."""
    root = scratch_path(spark, "lists", f"run-{uuid.uuid4().hex}")
    v1 = contracts(spark)
    v2 = contracts(spark).withColumn("exchange", F.coalesce("exchange", F.lit("IDEALPRO")))
    for i, v in ((1, v1), (2, v2)):
        SS.publish_version(v, root, i)
    out = SS.stream_instrument_changes(spark, root, f"{root}/versions", as_of=JUL1)
    return spark.read.parquet(out).select(*CANONICAL, "change", F.col("version").cast("int").alias("version"))


QUOTE_MSG_SCHEMA = ("symbol string, symbol_group string, asset_class string, timestamp string, kind string, "
                    "bid double, ask double, last double, bidSize double, askSize double, lastSize double, volume double")


@register("publish_messages", fixtures=["fx_ticks"], sql=f"""
WITH {QUOTES_SQL},
j AS (SELECT kind, CAST(to_json({{'symbol': symbol, 'symbol_group': symbol_group, 'asset_class': asset_class,
  'timestamp': strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), 'kind': kind, 'bid': bid, 'ask': ask, 'last': last,
  'bidSize': bidSize, 'askSize': askSize, 'lastSize': lastSize, 'volume': volume}}) AS VARCHAR) AS v FROM q)
SELECT kind AS key, replace(regexp_replace(v, '"[A-Za-z_]+":null,?', '', 'g'), ',}}', '}}') AS value FROM j
""")
def publish_messages(spark):
    """S6 (batch form): quotes as keyed JSON messages (NULL fields omitted)."""
    return NO.publish_messages(quotes(spark))


@register("subscribe_messages", fixtures=["fx_ticks"], sql=f"""
WITH {QUOTES_SQL}
SELECT * REPLACE (timezone('America/New_York', timestamp AT TIME ZONE 'UTC') AS timestamp) FROM q
""")
def subscribe_messages(spark):
    """S7 (batch form): decode the published quote messages, New York time."""
    msgs = NO.publish_messages(quotes(spark))
    return NO.subscribe_messages(msgs, QUOTE_MSG_SCHEMA, kind="QUOTE", tz="America/New_York")


@register("stream_publish_subscribe", fixtures=["fx_ticks"], sql=f"""
WITH {QUOTES_SQL}
SELECT * REPLACE (timezone('America/New_York', timestamp AT TIME ZONE 'UTC') AS timestamp) FROM q
WHERE asset_class = 'CSH'
""")
def stream_publish_subscribe(spark):
    """S6 + S7 on streams: the quote stream is published per kind to a
    folder; a subscriber stream reads the QUOTE folder, keeps the CASH
    symbols (a comma list) and converts times to New York."""
    root = scratch_path(spark, "bus", f"run-{uuid.uuid4().hex}")
    q = NO.normalize_quotes(ticks_stream(spark))
    SS.publish_stream(q, f"{root}/topic", "publish")
    cash = ",".join(f"S{u:02d}USD_CASH" for u in range(16))
    sub = SS.subscribe_stream(spark, f"{root}/topic", QUOTE_MSG_SCHEMA, symbols=cash, kind="QUOTE",
                              tz="America/New_York")
    return spark.read.parquet(SS.run_to_table(sub, "subscribe"))


@register("stream_message_rate_exact", fixtures=["fx_messages"], sql="""
WITH m AS (SELECT *, CASE WHEN symbol IS NULL THEN kind ELSE kind || '_' || symbol END AS key FROM fx_messages),
w AS (SELECT *, count(*) OVER win AS cnt, min(ts) OVER win AS old FROM m
  WINDOW win AS (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
r AS (SELECT *, CASE WHEN cnt >= 2 AND (epoch_us(ts) - epoch_us(old)) / 1e6 > 0 THEN cnt / ((epoch_us(ts) - epoch_us(old)) / 1e6) END AS raw FROM w)
SELECT key, ts, event_id,
  last_value(raw IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate
FROM r
""")
def stream_message_rate_exact(spark):
    """TS4 exact form: the last-100-messages rate per key, kept in list state
    on the message stream (batch twin: W9)."""
    m = fixture_stream(spark, "fx_messages")
    return spark.read.parquet(SS.run_to_table(SS.stream_message_rate_exact(m, seq="event_id"), "rates-exact"))
