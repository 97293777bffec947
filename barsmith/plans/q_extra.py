"""Further registered queries: resampled history, response envelopes, message
routing, order book history, volume rolls, contract tuples, long recordings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barsmith.operators import bars as B
from barsmith.operators import futures as FU
from barsmith.operators import normalize as NO
from barsmith.operators import ordered
from barsmith.operators import recording as RC
from barsmith.operators import store as ST
from barsmith.operators import strategies as SG
from barsmith.plans.q_bars import B_SYM, META_T, OHLC_OK, bars_with_symbols, ticks
from barsmith.plans.q_futures import DAILY_SQL, FUT, fut_daily
from barsmith.plans.q_recording import EVENTS_SQL, events
from barsmith.plans.q_store import TICKS_SQL, tick_dim, tick_store
from barsmith.plans.q_stream import QUOTE_MSG_SCHEMA, QUOTES_SQL, quotes, ticks_stream
from barsmith.plans.registry import register
from barsmith.plans.sqlparts import ac, sg
from barsmith.session import scratch_path
from barsmith.streaming import streams as SS

WEEK = "CAST(date_trunc('week', datetime) AS TIMESTAMP) + INTERVAL 6 DAY"
BAR_AGG = """arg_min(open, datetime) FILTER (WHERE open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
  arg_max(close, datetime) FILTER (WHERE close IS NOT NULL) AS close, CAST(coalesce(sum(volume), 0) AS BIGINT) AS volume"""


@register("resample_week", fixtures=["fx_bars", "fx_symbols"], sql=f"""
WITH {B_SYM}, a AS (SELECT symbol, {WEEK} AS datetime, {BAR_AGG} FROM b GROUP BY symbol, {WEEK}),
{META_T.format(src='b')}
SELECT a.datetime, a.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume FROM a JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def resample_week(spark):
    """Weekly bars, labelled by the Sunday that ends the week."""
    return B.resample_bars_time(bars_with_symbols(spark), "1W", seq="id", ffill=False)


def _quarters():
    """The label of every three months from a symbol's first month."""
    months = "(date_diff('month', date_trunc('month', o), date_trunc('month', datetime)))"
    return f"CAST(last_day(date_trunc('month', o) + to_months(CAST(3 * ceil({months} / 3.0) AS INTEGER))) AS TIMESTAMP)"


def _fortnights():
    first, end = (WEEK.replace("datetime", c) for c in ("o", "datetime"))
    return f"{first} + to_days(CAST(14 * ceil(date_diff('day', {first}, {end}) / 14.0) AS INTEGER))"


def _several(label):
    return f"""
WITH {B_SYM}, w AS (SELECT *, min(datetime) OVER (PARTITION BY symbol) AS o FROM b),
a AS (SELECT symbol, {label} AS label, {BAR_AGG} FROM w GROUP BY symbol, {label}),
{META_T.format(src='b')}
SELECT a.label AS datetime, a.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume FROM a JOIN m USING (symbol) WHERE {OHLC_OK}
"""


@register("resample_fortnight", fixtures=["fx_bars", "fx_symbols"], sql=_several(_fortnights()))
def resample_fortnight(spark):
    """Bars of two weeks, the first ending with the week of a symbol's
    first bar."""
    return B.resample_bars_time(bars_with_symbols(spark), "2W", seq="id", ffill=False)


@register("resample_quarter", fixtures=["fx_bars", "fx_symbols"], sql=_several(_quarters()))
def resample_quarter(spark):
    """Bars of three months, the first ending with the month of a
    symbol's first bar."""
    return B.resample_bars_time(bars_with_symbols(spark), "3M", seq="id", ffill=False)


@register("history_resampled", fixtures=["fx_bars", "fx_symbols"], sql=f"""
WITH b AS (SELECT s.symbol, fb.* EXCLUDE (id, symbol_id) FROM fx_bars fb JOIN fx_symbols s ON fb.symbol_id = s.id
  WHERE s.asset_class = 'STK' AND datetime >= TIMESTAMP '1995-01-01'),
a AS (SELECT symbol, CAST(last_day(datetime) AS TIMESTAMP) AS datetime, {BAR_AGG} FROM b GROUP BY symbol, last_day(datetime))
SELECT symbol, timezone('America/New_York', datetime AT TIME ZONE 'UTC') AS datetime, open, high, low, close, volume FROM a WHERE {OHLC_OK}
""")
def history_resampled(spark):
    """J1 with a resolution and a zone, open-ended: monthly bars, New York times."""
    return ST.historical_bars(spark.table("fx_bars"), spark.table("fx_symbols"), start="1995-01-01", resolution="1M",
                              tz="America/New_York")


@register("history_envelope", fixtures=["fx_bars", "fx_symbols"], sql="""
WITH b AS (SELECT s.symbol, fb.datetime FROM fx_bars fb JOIN fx_symbols s ON fb.symbol_id = s.id WHERE s.asset_class = 'STK'),
g AS (SELECT symbol, strftime(min(datetime), '%Y-%m-%dT%H:%M:%S') AS start, strftime(max(datetime), '%Y-%m-%dT%H:%M:%S') AS "end",
  count(*) AS count FROM b GROUP BY symbol)
SELECT s.symbol, g.start, g."end", '1D' AS resolution, coalesce(g.count, 0) AS count,
  CASE WHEN g.start IS NULL THEN 'error' ELSE 'success' END AS status,
  CASE WHEN g.start IS NULL THEN 'no rows for ' || s.symbol END AS message
FROM (SELECT DISTINCT symbol FROM fx_symbols) s LEFT JOIN g ON s.symbol = g.symbol
""")
def history_envelope(spark):
    """The response header of every requested symbol, with its status."""
    rows = ST.historical_bars(spark.table("fx_bars"), spark.table("fx_symbols"), order=False)
    return ST.history_envelope(rows, "1D", requested=spark.table("fx_symbols"))


@register("realtime_snapshot", fixtures=["fx_ticks", "fx_symbols"], sql=f"""
WITH {TICKS_SQL},
l AS (SELECT symbol_id, arg_max((datetime, bid, bidsize, ask, asksize, last, lastsize), datetime) AS r FROM tstore GROUP BY symbol_id),
h AS (SELECT symbol_id, time_bucket(INTERVAL '1 hour', datetime) AS datetime,
  arg_min(last, datetime) FILTER (WHERE last IS NOT NULL) AS open, max(last) AS high, min(last) AS low,
  arg_max(last, datetime) FILTER (WHERE last IS NOT NULL) AS close, CAST(coalesce(sum(lastsize), 0) AS BIGINT) AS volume
  FROM tstore WHERE last IS NOT NULL GROUP BY symbol_id, time_bucket(INTERVAL '1 hour', datetime)),
k AS (SELECT symbol_id, arg_max((datetime, open, high, low, close, volume), datetime) AS r FROM h GROUP BY symbol_id)
SELECT d.symbol, l.r[1] AS tick_datetime, nullif(l.r[2], 0) AS tick_bid, l.r[3] AS tick_bidsize, nullif(l.r[4], 0) AS tick_ask,
  l.r[5] AS tick_asksize, nullif(l.r[6], 0) AS tick_last, l.r[7] AS tick_lastsize, k.r[1] AS bar_datetime, nullif(k.r[2], 0) AS bar_open,
  nullif(k.r[3], 0) AS bar_high, nullif(k.r[4], 0) AS bar_low, nullif(k.r[5], 0) AS bar_close, k.r[6] AS bar_volume
FROM dim d JOIN l ON l.symbol_id = d.id LEFT JOIN k ON k.symbol_id = d.id
""")
def realtime_snapshot(spark):
    """The newest tick and the newest hourly bar of every symbol side by side."""
    dim = tick_dim(spark)
    store = tick_store(spark, dim)
    hourly = B.ticks_to_bars(store, "1H", keys=("symbol_id",))
    return ST.realtime_snapshot(store, hourly, dim)


@register("prepare_history_ticks", fixtures=["fx_ticks"], sql="""
SELECT datetime, symbol, CAST(bid AS DOUBLE) AS bid, CAST(bidsize AS BIGINT) AS bidsize, CAST(ask AS DOUBLE) AS ask,
  CAST(asksize AS BIGINT) AS asksize, CAST(last AS DOUBLE) AS last, CAST(lastsize AS BIGINT) AS lastsize FROM fx_ticks
""")
def prepare_history_ticks(spark):
    """P11 on ticks."""
    return ST.prepare_history(spark.table("fx_ticks"), "ticks")


@register("prepare_history_greeks", fixtures=["fx_greeks", "fx_bars"], sql="""
SELECT b.datetime, g.* EXCLUDE (volume), CAST(g.volume AS BIGINT) AS volume FROM fx_greeks g JOIN fx_bars b ON g.bar_id = b.id
""")
def prepare_history_greeks(spark):
    """P11 on greeks, with the time of their bar."""
    g = spark.table("fx_greeks").join(spark.table("fx_bars").select(F.col("id").alias("bar_id"), "datetime"), "bar_id")
    return ST.prepare_history(g, "greeks")


@register("greeks_join_ticks", fixtures=["fx_ticks", "fx_greeks"], sql="""
WITH g AS (SELECT * REPLACE (CASE WHEN seq2 % 3 > 0 THEN seq1 * 7 + seq2 END AS tick_id) FROM fx_greeks)
SELECT g.*, t.datetime AS tick_datetime, t.asksize AS tick_symbol_id, t.last AS tick_last FROM g LEFT JOIN fx_ticks t ON g.tick_id = t.id
""")
def greeks_join_ticks(spark):
    """J4, tick side: greeks with tick ids, some NULL, some that match nothing."""
    g = spark.table("fx_greeks").withColumn("tick_id", F.when(F.col("seq2") % 3 > 0, (F.col("seq1") * 7 + F.col("seq2")).cast("long")))
    t = spark.table("fx_ticks").withColumn("symbol_id", F.col("asksize"))
    return ST.greeks_join(g, ticks=t)


@register("resample_keep_last", fixtures=["fx_ticks"], sql=f"""
WITH t AS (SELECT *, date_trunc('hour', datetime) AS h, {sg('symbol')} AS symbol_group, {ac('symbol')} AS asset_class FROM fx_ticks),
s AS (SELECT *, row_number() OVER w AS g, last_value(last IGNORE NULLS) OVER wr AS fp, last_value(lastsize IGNORE NULLS) OVER wr AS fs FROM t
  WINDOW w AS (PARTITION BY symbol ORDER BY h, id), wr AS (PARTITION BY symbol ORDER BY h, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b0 AS (SELECT symbol, (g - 1) // 2 AS grp, min(h) AS datetime, arg_min(fp, g) FILTER (WHERE fp IS NOT NULL) AS open, max(fp) AS high,
  min(fp) AS low, arg_max(fp, g) FILTER (WHERE fp IS NOT NULL) AS close, CAST(coalesce(sum(fs), 0) AS BIGINT) AS volume FROM s GROUP BY symbol, (g - 1) // 2),
b AS (SELECT * FROM b0 QUALIFY row_number() OVER (PARTITION BY symbol, datetime ORDER BY grp DESC) = 1),
m AS (SELECT DISTINCT symbol, symbol_group, asset_class FROM t)
SELECT b.datetime, b.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume FROM b JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def resample_keep_last(spark):
    """The whole resample call on ticks of coarse times: of 2-tick bars that begin
    at one time the last stays."""
    t = spark.table("fx_ticks").withColumn("datetime", F.date_trunc("hour", "datetime").cast("timestamp_ntz"))
    return B.resample(t, "2K", seq="id", sync_last_timestamp=False)


@register("resample_ticks_tz", fixtures=["fx_ticks"], sql=f"""
WITH t AS (SELECT * REPLACE (datetime + INTERVAL 300 DAY AS datetime), {sg('symbol')} AS symbol_group, {ac('symbol')} AS asset_class FROM fx_ticks),
b AS (SELECT symbol, time_bucket(INTERVAL '15 minutes', datetime) AS datetime,
  arg_min(last, (datetime, id)) FILTER (WHERE last IS NOT NULL) AS open, max(last) AS high, min(last) AS low,
  arg_max(last, (datetime, id)) FILTER (WHERE last IS NOT NULL) AS close, CAST(coalesce(sum(lastsize), 0) AS BIGINT) AS volume
  FROM t GROUP BY symbol, time_bucket(INTERVAL '15 minutes', datetime)),
{META_T.format(src='t')}
SELECT timezone('America/New_York', b.datetime AT TIME ZONE 'UTC') AS datetime, b.symbol, m.symbol_group, m.asset_class, open, high, low, close, volume
FROM b JOIN m USING (symbol) WHERE {OHLC_OK}
""")
def resample_ticks_tz(spark):
    """A1 in New York time over the end of daylight saving (ticks moved to
    autumn): the repeated hour keeps its two sets of bars."""
    t = ticks(spark).withColumn("datetime", F.col("datetime") + F.expr("INTERVAL 300 DAYS"))
    return B.resample_ticks_time(t, "15T", seq="id", tz="America/New_York")


@register("roll_gap_cumulative", dates=["expiry", "date"], fixtures=FUT, sql=f"""
WITH RECURSIVE {DAILY_SQL}
SELECT f.*, coalesce((SELECT sum(coalesce(g.gap, 0.0)) FROM gp g WHERE g.root = f.root AND g.E >= f.date), 0.0) AS gap FROM flags f
""")
def roll_gap_cumulative(spark):
    """W7, cumulative: flag rows with the sum of the gaps of all later rolls."""
    dd = FU.daily_close_diff(fut_daily(spark), "last")
    return FU.roll_gap(dd, FU.contract_flags(dd, FU.roll_calendar(fut_daily(spark))), mode="cumulative")


VOLUME_SQL = """d AS (SELECT root, symbol, expiry, CAST(datetime AS DATE) AS date, CAST(sum(lastsize) AS BIGINT) AS volume
  FROM fx_fut_ticks GROUP BY root, symbol, expiry, CAST(datetime AS DATE)),
cs AS (SELECT root, symbol, dense_rank() OVER (PARTITION BY root ORDER BY expiry, symbol) AS k FROM (SELECT DISTINCT root, symbol, expiry FROM d) x),
dk AS (SELECT d.*, cs.k FROM d JOIN cs ON d.root = cs.root AND d.symbol = cs.symbol),
x AS (SELECT a.root, a.symbol, max(a.date) AS roll_date FROM dk a JOIN dk b ON a.root = b.root AND a.date = b.date AND b.k = a.k + 1
  WHERE b.volume > a.volume GROUP BY a.root, a.symbol),
e AS (SELECT cs.root, cs.symbol, cs.k, x.roll_date, coalesce(sum(CASE WHEN x.roll_date IS NULL THEN 1 ELSE 0 END)
  OVER (PARTITION BY cs.root ORDER BY cs.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM cs LEFT JOIN x ON cs.root = x.root AND cs.symbol = x.symbol),
f AS (SELECT *, CASE WHEN roll_date IS NOT NULL THEN max(roll_date) OVER (PARTITION BY root ORDER BY k) END AS end_day FROM e WHERE open = 0)"""


@register("roll_calendar_volume", dates=["start_day", "end_day"], fixtures=FUT, sql=f"""
WITH {VOLUME_SQL}
SELECT root, symbol, lag(end_day) OVER (PARTITION BY root ORDER BY k) AS start_day, end_day FROM f
""")
def roll_calendar_volume(spark):
    """W6 without usable expiries: the days each contract owns, by volume."""
    t = spark.table("fx_fut_ticks")
    d = t.groupBy("root", "symbol", "expiry", F.to_date("datetime").alias("date")).agg(
        F.sum("lastsize").cast("long").alias("volume"))
    return FU.roll_calendar_by_volume(d)


@register("continuous_contract_bars", dates=["expiry"], fixtures=FUT, sql=f"""
WITH RECURSIVE hb AS (SELECT root, symbol, expiry, time_bucket(INTERVAL '1 hour', datetime) AS datetime,
  arg_min(last, (datetime, event_id)) AS open, max(last) AS high, min(last) AS low, arg_max(last, (datetime, event_id)) AS close,
  CAST(coalesce(sum(lastsize), 0) AS BIGINT) AS volume FROM fx_fut_ticks WHERE last IS NOT NULL
  GROUP BY root, symbol, expiry, time_bucket(INTERVAL '1 hour', datetime)),
{DAILY_SQL.replace("(datetime, event_id)", "datetime").replace("fx_fut_ticks", "hb").replace("arg_max(last, datetime) FILTER (WHERE last IS NOT NULL) AS last", "arg_max(close, datetime) AS last")}
SELECT t.root, t.symbol, t.expiry, t.datetime, t.open + d.gap AS open, t.high + d.gap AS high, t.low + d.gap AS low,
  t.close + d.gap AS close, t.volume FROM hb t JOIN dense d ON t.root = d.root AND CAST(t.datetime AS DATE) = d.date
WHERE t.expiry = d.flag_expiry
""")
def continuous_contract_bars(spark):
    """W8 on hourly bars."""
    t = B.ticks_to_bars(spark.table("fx_fut_ticks"), "1H", keys=("root", "symbol", "expiry"), seq="event_id")
    return FU.continuous_contract(t, price_cols=("open", "high", "low", "close"))


@register("contract_tuples", fixtures=["fx_contracts"], nested=["fields"], sql="""
WITH t AS (SELECT list_slice([symbol, sec_type, coalesce(exchange, 'SMART'), coalesce(currency, 'EUR'), CASE WHEN id % 2 = 0 THEN '0202406' ELSE 'front' END,
  CASE WHEN id % 3 = 0 THEN 'high' ELSE CAST(id AS VARCHAR) END, 'C'], 1, CAST(2 + id % 6 AS INT)) AS fields FROM fx_contracts)
SELECT fields, fields[1] AS symbol, fields[2] AS sec_type, coalesce(fields[3], 'SMART') AS exchange, coalesce(fields[4], 'USD') AS currency,
  coalesce(CAST(TRY_CAST(fields[5] AS BIGINT) AS VARCHAR), fields[5], '') AS expiry, coalesce(TRY_CAST(fields[6] AS DOUBLE), 0.0) AS strike,
  coalesce(fields[7], '') AS opt_type FROM t
""")
def contract_tuples(spark):
    """J10 on short tuples: padding, integer expiry, text strike."""
    c = F.col
    full = F.array(c("symbol"), c("sec_type"), F.coalesce("exchange", F.lit("SMART")), F.coalesce("currency", F.lit("EUR")),
                   F.when(c("id") % 2 == 0, "0202406").otherwise("front"),
                   F.when(c("id") % 3 == 0, "high").otherwise(c("id").cast("string")), F.lit("C"))
    return FU.pad_contracts(spark.table("fx_contracts").select(F.slice(full, 1, (2 + c("id") % 6).cast("int")).alias("fields")))


@register("recorded_long", fixtures=["fx_ticks"], sql=f"""
WITH {EVENTS_SQL},
o AS (SELECT datetime, symbol, arg_min(open, id) FILTER (WHERE open IS NOT NULL) AS open FROM e GROUP BY datetime, symbol),
sh AS (SELECT symbol, g + 1 AS g, position AS p FROM f),
grid AS (SELECT symbol, g FROM f UNION SELECT symbol, g FROM sh),
ps AS (SELECT grid.symbol, nd.datetime, coalesce(sh.p, 0) AS position
  FROM grid LEFT JOIN sh ON grid.symbol = sh.symbol AND grid.g = sh.g JOIN nd ON nd.g = grid.g)
SELECT datetime, symbol, o.open, ps.position FROM o FULL JOIN ps USING (datetime, symbol)
""")
def recorded_long(spark):
    """A13 in long form, every instrument; the events recorded by X3."""
    ev = events(spark)
    rec = RC.record_events(ev, fields=["id", "symbol_group", "asset_class", "open", "position"])
    return RC.recorded_long(rec, seq="id")


@register("published_counts", fixtures=["fx_ticks"], sql=f"""
WITH {QUOTES_SQL} SELECT kind, symbol, count(*) AS messages FROM q GROUP BY kind, symbol
""")
def published_counts(spark):
    """Quote messages published per symbol."""
    return NO.published_counts(quotes(spark))


@register("book_history", fixtures=["fx_ticks"], nested=["bids", "asks"], sql="""
WITH lv AS (SELECT symbol, date_trunc('minute', datetime) AS datetime, bid, bidsize, ask, asksize FROM fx_ticks),
bk AS (SELECT symbol, 'ORDERBOOK' AS kind, datetime AS timestamp,
  list({'price': CAST(bid AS DOUBLE), 'size': CAST(bidsize AS DOUBLE), 'market_maker': ''} ORDER BY CAST(bid AS DOUBLE) DESC, CAST(bidsize AS DOUBLE) DESC) AS bids,
  list({'price': CAST(ask AS DOUBLE), 'size': CAST(asksize AS DOUBLE), 'market_maker': ''} ORDER BY CAST(ask AS DOUBLE), CAST(asksize AS DOUBLE) DESC) AS asks
  FROM lv GROUP BY symbol, datetime)
SELECT *, lag(bids[1].price) OVER (PARTITION BY symbol ORDER BY timestamp) AS prev_bid, lag(asks[1].price) OVER (PARTITION BY symbol ORDER BY timestamp) AS prev_ask,
  max(bids[1].price) OVER (PARTITION BY symbol, CAST(timestamp AS DATE) ORDER BY timestamp) AS daily_high,
  min(asks[1].price) OVER (PARTITION BY symbol, CAST(timestamp AS DATE) ORDER BY timestamp) AS daily_low FROM bk
""")
def book_history(spark):
    """P5 with its optional fields: previous best prices, the day's extremes."""
    t = spark.table("fx_ticks").withColumn("datetime", F.date_trunc("minute", "datetime").cast("timestamp_ntz"))
    side = lambda s, p, z: t.select("symbol", "datetime", F.lit(s).alias("side"), F.col(p).alias("price"),
                                    F.col(z).alias("size"), F.lit("").alias("market_maker"))
    return NO.book_history(NO.normalize_order_book(side("BID", "bid", "bidsize").unionByName(side("ASK", "ask", "asksize"))))


@register("stream_normalize_ticks", fixtures=["fx_ticks"], sql=f"""
SELECT symbol, {sg('symbol')} AS symbol_group, {ac('symbol')} AS asset_class, datetime AS timestamp, 'TICK' AS kind,
  last AS price, coalesce(CAST(lastsize AS DOUBLE), 0.0) AS size, CAST(0.0 AS DOUBLE) AS volume FROM fx_ticks WHERE last IS NOT NULL
""")
def stream_normalize_ticks(spark):
    """TS1: trade ticks on a stream."""
    return spark.read.parquet(SS.run_to_table(SS.stream_normalize(ticks_stream(spark))["TICK"], "normalize-ticks"))


@register("stream_normalize_bars", fixtures=["fx_bars", "fx_symbols"], sql="""
SELECT s.symbol, s.symbol AS symbol_group, CASE s.asset_class WHEN 'CASH' THEN 'CSH' ELSE s.asset_class END AS asset_class,
  b.datetime AS timestamp, 'BAR' AS kind, coalesce(b.open, 0.0) AS open, coalesce(b.high, 0.0) AS high,
  coalesce(b.low, 0.0) AS low, coalesce(b.close, 0.0) AS close, coalesce(CAST(b.volume AS DOUBLE), 0.0) AS volume
FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id
""")
def stream_normalize_bars(spark):
    """TS1: bars on a stream."""
    b = spark.table("fx_bars").join(spark.table("fx_symbols").select(
        F.col("id").alias("symbol_id"), "symbol", F.col("asset_class").alias("sec_type")), "symbol_id")
    out = SS.stream_normalize(SS.replay(ordered.kept(b), "datetime", wide=True))["BAR"].withColumn("symbol_group", F.col("symbol"))
    return spark.read.parquet(SS.run_to_table(out, "normalize-bars"))


TICK_MSG_SCHEMA = ("symbol string, symbol_group string, asset_class string, timestamp string, kind string, "
                   "price double, size double, volume double")


@register("route_messages", fixtures=["fx_ticks"], sql=f"""
WITH {QUOTES_SQL}
SELECT 'QUOTE' AS kind, symbol, count(*) AS messages, min(timestamp) AS first, sum(CAST(round(100 * coalesce(bid, 0)) AS BIGINT)) AS cents FROM q GROUP BY symbol
UNION ALL SELECT 'TICK', symbol, count(*), min(datetime), sum(CAST(round(100 * last) AS BIGINT)) FROM fx_ticks WHERE last IS NOT NULL GROUP BY symbol
""")
def route_messages(spark):
    """S6 + S7: quotes and ticks published to one topic, decoded and routed to a
    table per kind; what arrived, per symbol."""
    root = scratch_path(spark, "bus", f"run-{uuid.uuid4().hex}")
    raw = SS.stream_normalize(ticks_stream(spark))
    for kind in ("QUOTE", "TICK"):
        SS.publish_stream(raw[kind], f"{root}/topic/{kind}")
    tables = {}
    for kind, schema in (("QUOTE", QUOTE_MSG_SCHEMA), ("TICK", TICK_MSG_SCHEMA)):
        tables |= SS.route_messages(spark, f"{root}/topic/{kind}", {kind: schema}, f"{root}/out")

    def seen(kind, price):
        cents = F.round(100 * F.coalesce(F.col(price), F.lit(0.0))).cast("long")
        return spark.read.parquet(tables[kind]).groupBy("kind", "symbol").agg(
            F.count(F.lit(1)).alias("messages"), F.min("timestamp").alias("first"), F.sum(cents).alias("cents"))
    return seen("QUOTE", "bid").unionByName(seen("TICK", "price"))


@register("stream_strategy", fixtures=["fx_ticks"], sql="""
WITH t AS (SELECT * FROM fx_ticks WHERE last IS NOT NULL),
w AS (SELECT symbol, datetime, last, first_value(last) OVER (PARTITION BY symbol ORDER BY datetime, id) AS o,
  lag(last) OVER (PARTITION BY symbol ORDER BY datetime, id) AS prev FROM t)
SELECT symbol, datetime, CASE WHEN last > o THEN 'BUY' ELSE 'SELL' END AS signal, last AS price FROM w
WHERE (last > o AND prev <= o) OR (last < o AND prev >= o)
""")
def stream_strategy(spark):
    """X1 on a stream: the breakout callback with its state in the state store."""
    t = ticks_stream(spark).filter(F.col("last").isNotNull()).select("id", "datetime", "symbol", "last")
    out = SS.stream_strategy(t, SG.session_breakout, SG.SIGNAL_SCHEMA, ts=["datetime", "id"])
    return spark.read.parquet(SS.run_to_table(out, "strategy"))
