"""Queries over a store of whole batches (TS5 into it, T1 by point reads, A6-A8
from the statistics that ingest keeps), last books of a stream (TS3) and the
quote in force at every trade (J5)."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import functions as F

from barsmith.functions.scalars import asset_class
from barsmith.operators import asof as AS
from barsmith.operators import commits as CO
from barsmith.operators import normalize as NO
from barsmith.operators import partials as PA
from barsmith.operators import store as ST
from barsmith.plans.q_store import TICKS_SQL, tick_batch, tick_dim
from barsmith.plans.q_stream import QUOTES_SQL, _at_rest, _nz, normalize_bars, normalize_order_book, quotes, ticks_stream
from barsmith.plans.registry import register
from barsmith.plans.sqlparts import ac
from barsmith.session import scratch_path
from barsmith.streaming import books as BK
from barsmith.streaming import streams as SS
from barsmith.streaming import topics as TP

#: batches that a table is ingested in, by time
BATCHES = 3


def _bars(spark):
    s = spark.table("fx_symbols").select(F.col("id").alias("symbol_id"), "symbol", "asset_class")
    return spark.table("fx_bars_raw").join(s, "symbol_id").drop("symbol_id", "id")


def ingested(spark, kind: str) -> tuple[str, object]:
    """A fresh store that got its table in batches of time, the second twice
    and under two names; its path and symbols."""
    path = scratch_path(spark, "stores", f"{kind}-{uuid.uuid4().hex}")
    if kind == "ticks":
        rows, dim, seq, ingest = tick_batch(spark), tick_dim(spark).checkpoint(), "id", ST.ingest_ticks
    else:
        rows, dim, seq, ingest = _bars(spark), spark.table("fx_symbols"), ["seq1", "seq2", "seq3"], ST.ingest_bars
    low, high = rows.agg(F.min("datetime"), F.max("datetime")).first()
    step = (high - low) / BATCHES
    for epoch, (name, part) in enumerate([("feed", 0), ("feed", 1), ("feed", 2), ("again", 1)]):
        since, until = low + part * step, low + (part + 1) * step
        batch = rows.where((F.col("datetime") >= F.lit(since)) & ((F.col("datetime") < F.lit(until)) | F.lit(part == BATCHES - 1)))
        new = ingest(batch, CO.overlapping(batch, path, kind), dim, seq=seq)
        CO.commit(new, path, kind, name, epoch)
        if epoch == 1:
            CO.commit(new, path, kind, name, epoch)          # a replayed batch is skipped
    CO.compact(spark, path, kind, keep=3)
    return path, dim


def both_ingested(spark):
    """The stores of bars and of ticks, ingested side by side: a store's short
    stages leave cores to the other.  Paths of both and the ticks' symbols."""
    with ThreadPoolExecutor(2) as pool:
        bars, ticks = [pool.submit(inheritable_thread_target(spark)(ingested), spark, kind) for kind in ("bars", "ticks")]
        return bars.result()[0], *ticks.result()


def _stored(rows):
    return PA.doubles(rows.drop("period")).withColumn("date", F.to_date("datetime"))


def _rest(c):
    return f"CAST(CAST({c} AS DECIMAL(20, 8)) AS DOUBLE)"


@register("latest_tick_days", fixtures=["fx_ticks", "fx_symbols"], sql=f"""
WITH {TICKS_SQL},
l AS (SELECT symbol_id, arg_max((datetime, bid, bidsize, ask, asksize, last, lastsize), datetime) AS r FROM tstore GROUP BY symbol_id)
SELECT d.symbol, r[1] AS tick_datetime, nullif({_rest('r[2]')}, 0) AS tick_bid, r[3] AS tick_bidsize, nullif({_rest('r[4]')}, 0) AS tick_ask,
  r[5] AS tick_asksize, nullif({_rest('r[6]')}, 0) AS tick_last, r[7] AS tick_lastsize
FROM l JOIN dim d ON l.symbol_id = d.id
""")
def latest_tick_days(spark):
    """T1 over an ingested store: of every symbol the newest tick, read from
    the days that its statistics name."""
    path, dim = ingested(spark, "ticks")
    return PA.latest_rows(CO.read(spark, path, "ticks"), CO.read_partials(spark, path, "ticks"), dim, "ticks")


@register("latest_bar_newest_first", fixtures=["fx_bars", "fx_bars_raw", "fx_symbols"], sql=f"""
WITH l AS (SELECT symbol_id, arg_max((datetime, open, high, low, close, volume), datetime) AS r FROM fx_bars GROUP BY symbol_id)
SELECT s.symbol, r[1] AS bar_datetime, nullif({_rest('r[2]')}, 0) AS bar_open, nullif({_rest('r[3]')}, 0) AS bar_high,
  nullif({_rest('r[4]')}, 0) AS bar_low, nullif({_rest('r[5]')}, 0) AS bar_close, r[6] AS bar_volume
FROM l JOIN fx_symbols s ON l.symbol_id = s.id
""")
def latest_bar_newest_first(spark):
    """T1 over a store without statistics: the newest days first, until every
    symbol has a bar."""
    path, dim = ingested(spark, "bars")
    return PA.latest_by_scan(CO.read(spark, path, "bars"), dim, "bars")


@register("symbol_statistics_kept", fixtures=["fx_ticks", "fx_symbols", "fx_bars", "fx_bars_raw"], sql=f"""
WITH {TICKS_SQL},
b AS (SELECT symbol_id, count(*) AS bars_count, {_rest('min(open)')} AS min_price, {_rest('max(high)')} AS max_price, min(volume) AS min_volume,
  max(volume) AS max_volume, min(datetime) AS earliest, max(datetime) AS latest FROM fx_bars GROUP BY symbol_id),
t AS (SELECT symbol_id, count(*) AS ticks_count, min(datetime) AS ticks_earliest, max(datetime) AS ticks_latest FROM tstore GROUP BY symbol_id)
SELECT d.id AS symbol_id, d.symbol, d.symbol_group, d.asset_class, coalesce(b.bars_count, 0) AS bars_count, b.min_price, b.max_price,
  b.min_volume, b.max_volume, b.earliest, b.latest, coalesce(t.ticks_count, 0) AS ticks_count, t.ticks_earliest, t.ticks_latest
FROM dim d LEFT JOIN b ON b.symbol_id = d.id LEFT JOIN t ON t.symbol_id = d.id
""")
def symbol_statistics_kept(spark):
    """A6 from the statistics of the batches; no bar and no tick is read."""
    bars, ticks, dim = both_ingested(spark)
    return PA.symbol_statistics(CO.read_partials(spark, bars, "bars"), CO.read_partials(spark, ticks, "ticks"), dim)


@register("store_summary_kept", fixtures=["fx_ticks", "fx_symbols", "fx_bars", "fx_bars_raw"], sql=f"""
WITH {TICKS_SQL}
SELECT (SELECT count(*) FROM dim) AS total_symbols, count(*) AS total_bars, (SELECT count(*) FROM tstore) AS total_ticks,
  min(datetime) AS earliest_bar, max(datetime) AS latest_bar FROM fx_bars
""")
def store_summary_kept(spark):
    """A7 from the statistics of the batches."""
    bars, ticks, dim = both_ingested(spark)
    return PA.store_summary(dim, CO.read_partials(spark, bars, "bars"), CO.read_partials(spark, ticks, "ticks"))


@register("quality_report_kept", fixtures=["fx_ticks", "fx_symbols", "fx_bars", "fx_bars_raw"], sql=f"""
WITH {TICKS_SQL},
d AS (SELECT {_rest('open')} AS open, {_rest('high')} AS high, {_rest('low')} AS low, {_rest('close')} AS close, volume FROM fx_bars),
b AS (SELECT count(*) AS total_bars, count(*) FILTER (WHERE coalesce(high < open OR high < close OR low > open OR low > close OR volume < 0, false)) AS invalid_bars FROM d),
t AS (SELECT count(*) AS total_ticks, count(*) FILTER (WHERE (bid IS NOT NULL AND ask IS NOT NULL AND {_rest('bid')} > {_rest('ask')})
  OR bidsize < 0 OR asksize < 0 OR lastsize < 0 OR bid < 0 OR ask < 0 OR last < 0) AS ticks_failing_checks FROM tstore)
SELECT CASE WHEN invalid_bars = 0 THEN 'good' ELSE 'issues_found' END AS overall_status, total_bars, total_bars - invalid_bars AS valid_bars,
  invalid_bars, total_ticks, total_ticks AS valid_ticks, CAST(0 AS BIGINT) AS invalid_ticks, ticks_failing_checks FROM b, t
""")
def quality_report_kept(spark):
    """A8 from the statistics of the batches."""
    bars, ticks, _ = both_ingested(spark)
    return PA.quality_report(CO.read_partials(spark, bars, "bars"), CO.read_partials(spark, ticks, "ticks"))


@register("stream_ingest_committed", dates=["date"], fixtures=["fx_ticks"], sql=f"""
WITH tk AS (SELECT *, {ac('symbol')} AS asset_class FROM fx_ticks),
dim AS (SELECT symbol, asset_class, row_number() OVER (ORDER BY symbol, asset_class) AS symbol_id FROM (SELECT DISTINCT symbol, asset_class FROM tk) k)
SELECT tk.datetime, dim.symbol_id, {_at_rest('bid')} AS bid, {_nz('bidsize')} AS bidsize, {_at_rest('ask')} AS ask,
  {_nz('asksize')} AS asksize, {_at_rest('last')} AS last, {_nz('lastsize')} AS lastsize, CAST(tk.datetime AS DATE) AS date
FROM tk JOIN dim ON tk.symbol = dim.symbol AND tk.asset_class = dim.asset_class
""")
def stream_ingest_committed(spark):
    """TS5: quotes and ticks as they arrive, a commit a micro-batch, compacted
    on the way."""
    rows = ticks_stream(spark, wide=True).withColumn("asset_class", asset_class("symbol"))
    root = scratch_path(spark, "stores", f"ticks-{uuid.uuid4().hex}")
    SS.stream_to_store(rows, f"{root}/ticks", "ticks", f"{root}/symbols", seq="id", keep=2)
    return _stored(CO.read(spark, f"{root}/ticks", "ticks"))


@register("stream_ingest_bars", dates=["date"], fixtures=["fx_bars", "fx_bars_raw", "fx_symbols"], sql=f"""
SELECT datetime, symbol_id, {_rest('open')} AS open, {_rest('high')} AS high, {_rest('low')} AS low, {_rest('close')} AS close, volume,
  CAST(datetime AS DATE) AS date FROM fx_bars
""")
def stream_ingest_bars(spark):
    """TS5 for bars: the raw bars replayed in time order; the first of a key by
    its sequence stays, across batches the one stored first."""
    rows = SS.replay(_bars(spark).withColumn("day", F.to_date("datetime")), "day", wide=True)
    root = scratch_path(spark, "stores", f"bars-{uuid.uuid4().hex}")
    SS.stream_to_store(rows.drop("day"), f"{root}/bars", "bars", spark.table("fx_symbols"), seq=["seq1", "seq2", "seq3"], keep=2)
    return _stored(CO.read(spark, f"{root}/bars", "bars"))


#: depth updates from ticks: a side's level at whole prices; every seventh size deletes
UPDATES_SQL = """
SELECT id AS seq, symbol, datetime, side, price, CASE WHEN size % 7 = 0 THEN 0 ELSE size END AS size, '' AS market_maker FROM (
  SELECT id, symbol, datetime, 'BID' AS side, floor(bid) AS price, bidsize AS size FROM {ticks} WHERE bid IS NOT NULL
  UNION ALL SELECT id, symbol, datetime, 'ASK', ceil(ask), asksize FROM {ticks} WHERE ask IS NOT NULL) u"""


@register("stream_book", fixtures=["fx_ticks"], sql=f"""
WITH u AS ({UPDATES_SQL.format(ticks="fx_ticks")}),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, price ORDER BY datetime DESC, seq DESC) AS rn FROM u)
SELECT symbol, side, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'BID' THEN -price ELSE price END) AS INTEGER) AS place,
  CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size, market_maker
FROM l WHERE rn = 1 AND size > 0
""")
def stream_book(spark):
    """TS3: the last book of every symbol, kept in map state while updates
    arrive in several micro-batches."""
    view = f"ticks_stream_{uuid.uuid4().hex}"
    ticks_stream(spark, wide=True).createOrReplaceTempView(view)
    books = BK.stream_book(spark.sql(UPDATES_SQL.format(ticks=view)))
    return BK.book_levels(SS.read_latest_table(spark, SS.run_keyed_table(books, "books", "symbol")))


@register("last_book", fixtures=["fx_ticks"], sql=f"""
WITH u AS ({UPDATES_SQL.format(ticks="fx_ticks")}),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol, side, price ORDER BY datetime DESC, seq DESC) AS rn FROM u)
SELECT symbol, side, CAST(row_number() OVER (PARTITION BY symbol, side ORDER BY CASE WHEN side = 'BID' THEN -price ELSE price END) AS INTEGER) AS place,
  CAST(price AS DOUBLE) AS price, CAST(size AS DOUBLE) AS size, market_maker
FROM l WHERE rn = 1 AND size > 0
""")
def last_book(spark):
    """TS3's batch form."""
    return BK.book_levels(BK.last_books(spark.sql(UPDATES_SQL.format(ticks="fx_ticks"))))


@register("asof_quotes", fixtures=["fx_ticks"], sql="""
WITH e AS (
  SELECT symbol, datetime, 1 AS side, id, last, CAST(NULL AS TIMESTAMP) AS qts, NULL AS bid, NULL AS ask FROM fx_ticks WHERE last IS NOT NULL
  UNION ALL SELECT symbol, datetime, 0, id, NULL, datetime, bid, ask FROM fx_ticks WHERE bid <= ask),
f AS (SELECT *, last_value(CASE WHEN side = 0 THEN {'qts': qts, 'bid': bid, 'ask': ask} END IGNORE NULLS) OVER (
  PARTITION BY symbol ORDER BY datetime, side, id ROWS UNBOUNDED PRECEDING) AS q FROM e)
SELECT id, symbol, datetime, last, q.qts AS asof_ts, q.bid AS bid, q.ask AS ask FROM f WHERE side = 1
""")
def asof_quotes(spark):
    """J5 at full time resolution: every trade with the valid quote in force."""
    t = spark.table("fx_ticks")
    trades = t.where("last IS NOT NULL").select("id", "symbol", "datetime", "last")
    quotes = t.where("bid <= ask").select("id", "symbol", "datetime", "bid", "ask")
    return AS.asof_join(trades, quotes, "symbol", "datetime", ["bid", "ask"], right_seq="id")


def _cents(c):
    return f"sum(CAST(round(100 * coalesce({c}, 0)) AS BIGINT))"


@register("route_topic", fixtures=["fx_ticks", "fx_bars", "fx_symbols", "fx_book_levels"], sql=f"""
WITH {QUOTES_SQL}
SELECT 'QUOTE' AS kind, symbol, count(*) AS messages, min(timestamp) AS first, {_cents('bid')} AS cents FROM q GROUP BY symbol
UNION ALL SELECT 'TICK', symbol, count(*), min(datetime), {_cents('last')} FROM fx_ticks WHERE last IS NOT NULL GROUP BY symbol
UNION ALL SELECT 'BAR', s.symbol, count(*), min(b.datetime), {_cents('b.close')} FROM fx_bars b JOIN fx_symbols s ON b.symbol_id = s.id GROUP BY s.symbol
UNION ALL SELECT 'ORDERBOOK', symbol, count(*), min(datetime), {_cents('bid')} FROM (
  SELECT symbol, datetime, max(CASE WHEN side = 'BID' THEN price END) AS bid FROM fx_book_levels GROUP BY symbol, datetime) b GROUP BY symbol
UNION ALL SELECT 'QUARANTINE', r.reason, count(*), CAST(NULL AS TIMESTAMP), CAST(0 AS BIGINT)
  FROM fx_ticks, (SELECT unnest(['malformed', 'not_json', 'unknown_kind']) AS reason) r WHERE last IS NULL GROUP BY r.reason
""")
def route_topic(spark):
    """S6 + S7: quotes, ticks, bars and books on ONE topic, with lines that
    cannot be decoded between them, routed to a table per kind and a
    quarantine; what arrived, per symbol or reason."""
    root = scratch_path(spark, "bus", f"run-{uuid.uuid4().hex}")
    for messages in (quotes(spark), NO.normalize_ticks(spark.table("fx_ticks")), normalize_bars(spark), normalize_order_book(spark)):
        TP.publish(messages, f"{root}/topic")
    odd = spark.table("fx_ticks").where("last IS NULL").select(
        F.to_json(F.struct("symbol", F.lit("QUOTE").alias("kind"), F.lit("high").alias("bid"), F.col("datetime").alias("timestamp"))).alias("m"))
    lines = F.array("m", F.substring("m", 1, 20), F.replace("m", F.lit('"QUOTE"'), F.lit('"OTHER"')))
    TP.append(odd.select(F.explode(lines).alias("value")), f"{root}/topic")
    tables = TP.route_topic(spark, f"{root}/topic", f"{root}/out")

    def seen(kind, price):
        cents = F.sum(F.round(100 * F.coalesce(price, F.lit(0.0))).cast("long"))
        return spark.read.parquet(tables[kind]).groupBy(F.lit(kind).alias("kind"), "symbol").agg(
            F.count(F.lit(1)).alias("messages"), F.min("timestamp").alias("first"), cents.alias("cents"))
    bad = spark.read.parquet(tables["QUARANTINE"]).groupBy(F.lit("QUARANTINE").alias("kind"), F.col("reason").alias("symbol")).agg(
        F.count(F.lit(1)).alias("messages"), F.lit(None).cast("timestamp_ntz").alias("first"), F.lit(0).cast("long").alias("cents"))
    return seen("QUOTE", F.col("bid")).unionByName(seen("TICK", F.col("price"))).unionByName(seen("BAR", F.col("close"))) \
        .unionByName(seen("ORDERBOOK", F.get("bids", F.lit(0))["price"])).unionByName(bad)
