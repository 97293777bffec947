"""Fixture views: market-shaped inputs derived from the driver tables.

The driver ships TPC-H-like tables, not market data.  These views map them onto
the logical inputs of the library (ticks, bars, symbols, trades, ...).  The
same SQL text runs on Spark SQL and on DuckDB, so oracle queries can inline
the very same definitions as CTEs.  Each view is a lazy plan over the base
tables, so its size grows with the scale factor.

Fixed values: the view definitions below are the fixture specification
(FIXTURES.md section 2), but that ``fx_settlements`` reads all of ``part``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barsmith.sources.tables import _REGISTERED, _session_key, register_tables

# name -> (sql body, fixture views it reads)
FIXTURE_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_ticks": ("""
SELECT event_id AS id, ts AS datetime,
  CASE event_type
    WHEN 'click' THEN 'S' || lpad(CAST(user_id % 16 AS STRING), 2, '0')
    WHEN 'view' THEN 'S' || lpad(CAST(user_id % 16 AS STRING), 2, '0') || 'H2024_FUT'
    WHEN 'purchase' THEN 'S' || lpad(CAST(user_id % 16 AS STRING), 2, '0') || '20240119C00150000_OPT'
    WHEN 'signup' THEN 'S' || lpad(CAST(user_id % 16 AS STRING), 2, '0') || 'USD_CASH'
    ELSE 'S' || lpad(CAST(user_id % 16 AS STRING), 2, '0') || '20240119P00150000_FOP' END AS symbol,
  CASE WHEN event_id % 97 = 0 THEN value + 0.05 ELSE value - 0.01 * (event_id % 3) END AS bid,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS bidsize,
  value + 0.01 * (event_id % 4) AS ask,
  CAST(event_id % 50 AS INT) AS asksize,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE value END AS last,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS lastsize
FROM events""", ()),
    "fx_bars_raw": ("""
SELECT l_suppkey * 100000000 + year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS id,
  l_orderkey AS seq1, l_linenumber AS seq2, l_partkey AS seq3,
  l_shipdate AS datetime, l_suppkey AS symbol_id,
  l_extendedprice / l_quantity AS open,
  l_extendedprice / l_quantity * (1 + l_discount) AS high,
  l_extendedprice / l_quantity * (1 - l_tax) AS low,
  CASE WHEN (l_orderkey + l_linenumber) % 41 = 0 THEN l_extendedprice / l_quantity * 1.2 ELSE l_extendedprice / l_quantity * (1 + l_discount / 2) END AS close,
  CAST(CASE WHEN (l_orderkey + l_linenumber) % 67 = 0 THEN -l_quantity ELSE l_quantity END AS BIGINT) AS volume
FROM lineitem""", ()),
    "fx_symbols": ("""
SELECT s_suppkey AS id, s_name AS symbol, s_name AS symbol_group,
  CASE s_suppkey % 4 WHEN 0 THEN 'STK' WHEN 1 THEN 'FUT' WHEN 2 THEN 'OPT' ELSE 'CSH' END AS asset_class,
  CASE WHEN s_suppkey % 4 IN (1, 2) THEN DATE '2001-12-21' END AS expiry
FROM supplier""", ()),
    "fx_trades": ("""
SELECT l_orderkey AS seq1, l_linenumber AS seq2, o_orderpriority AS algo, s_name AS symbol,
  CASE WHEN l_returnflag = 'R' THEN 'SHORT' ELSE 'LONG' END AS direction,
  CAST(l_quantity AS INT) AS quantity, o_orderdate AS entry_time,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE greatest(l_shipdate, o_orderdate) END AS exit_time,
  CASE WHEN o_orderstatus = 'O' THEN NULL WHEN l_linestatus = 'F' THEN 'TARGET' ELSE 'STOP' END AS exit_reason,
  CASE l_orderkey % 3 WHEN 0 THEN 'MARKET' WHEN 1 THEN 'LIMIT' ELSE 'STOP' END AS order_type,
  p_retailprice AS market_price, p_retailprice * 1.1 AS target, p_retailprice * 0.9 AS stop,
  p_retailprice * (1 + l_discount - 0.05) AS entry_price,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE p_retailprice * (1 + l_tax - 0.04) END AS exit_price,
  CASE WHEN o_orderstatus = 'O' THEN 0 ELSE p_retailprice * (l_tax - l_discount + 0.01) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END END AS realized_pnl
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""", ()),
    "fx_fut_ticks": ("""
SELECT event_id, ts AS datetime, 'R' || CAST(user_id % 4 AS STRING) AS root,
  'R' || CAST(user_id % 4 AS STRING) || CASE event_id % 3 WHEN 0 THEN 'F2024' WHEN 1 THEN 'G2024' ELSE 'H2024' END AS symbol,
  CASE event_id % 3 WHEN 0 THEN DATE '2024-01-10' WHEN 1 THEN DATE '2024-01-20' ELSE DATE '2024-02-20' END AS expiry,
  value + 5 * (event_id % 3) AS last,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS lastsize
FROM events""", ()),
    "fx_contracts": ("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 19 = 0 THEN '#' ELSE '' END || p_brand || '-' || CAST(p_partkey AS STRING) AS symbol,
  CASE p_partkey % 5 WHEN 0 THEN 'STK' WHEN 1 THEN 'FUT' WHEN 2 THEN 'OPT' WHEN 3 THEN 'CASH' ELSE 'BAG' END AS sec_type,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'SMART' END AS exchange, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'USD' END AS currency,
  CASE p_partkey % 5 WHEN 1 THEN CAST(202400 + p_size % 12 + 1 AS DOUBLE) WHEN 2 THEN CAST(20240100 + p_size % 28 + 1 AS DOUBLE) END AS expiry,
  CASE p_partkey % 5 WHEN 2 THEN p_retailprice END AS strike,
  CASE p_partkey % 5 WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'P' END END AS opt_type
FROM part""", ()),
    "fx_account_values": ("""
SELECT c_name AS account, 'NetLiquidation' AS tag, CAST(c_acctbal AS STRING) AS value FROM customer
UNION ALL SELECT c_name, 'PreviousDayEquityWithLoanValue', CAST(c_acctbal - c_custkey % 7 AS STRING) FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT c_name, 'UnrealizedPnL', CAST(c_custkey % 11 AS STRING) FROM customer""", ()),
    "fx_messages": ("""
SELECT event_id, ts, CASE event_type WHEN 'click' THEN 'QUOTE' WHEN 'view' THEN 'TICK' WHEN 'purchase' THEN 'BAR' WHEN 'signup' THEN 'ORDERBOOK' ELSE 'ERROR' END AS kind,
  'S' || lpad(CAST(user_id % 16 AS STRING), 2, '0') AS symbol, value / 100 AS duration_s FROM events""", ()),
    "fx_greeks": ("""
SELECT l_orderkey AS seq1, l_linenumber AS seq2, CAST(NULL AS BIGINT) AS tick_id,
  l_suppkey * 100000000 + year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS bar_id,
  l_extendedprice / l_quantity / 10 AS price, l_extendedprice / l_quantity AS underlying, l_tax AS dividend, CAST(l_quantity AS INT) AS volume,
  0.1 + l_discount AS iv, l_quantity * 10 AS oi, l_discount * 10 AS delta, l_tax AS gamma, -l_discount AS theta, l_tax * 2 AS vega
FROM lineitem WHERE l_suppkey % 4 = 2""", ()),
    "fx_bars": ("""
SELECT id, datetime, symbol_id, open, high, low, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol_id, datetime ORDER BY seq1, seq2, seq3, close, volume) AS rn FROM fx_bars_raw) t
WHERE rn = 1""", ("fx_bars_raw",)),
    "fx_settlements": ("""
SELECT p_brand AS root, p_partkey AS listing_order, CAST(202401 + p_size % 12 AS STRING) AS expiry, CAST((p_partkey * 37) % 1500 AS BIGINT) AS volume
FROM part""", ()),
    "fx_futures_specs": ("""
SELECT s_suppkey AS listing_order, n_name AS exchange, 'F' || CAST(s_suppkey % 40 AS STRING) AS symbol, 'C' || CAST(s_suppkey % 25 AS STRING) AS class,
  CASE WHEN s_suppkey % 3 = 0 THEN 'n/a' ELSE CAST(round(abs(s_acctbal), 2) AS STRING) END AS intraday_initial,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(round(abs(s_acctbal) * 0.9, 2) AS STRING) END AS intraday_maintenance,
  CAST(round(abs(s_acctbal) * 2, 2) AS STRING) AS overnight_initial,
  CASE WHEN s_suppkey % 5 = 0 THEN '-' ELSE CAST(round(abs(s_acctbal) * 1.8, 2) AS STRING) END AS overnight_maintenance,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'EUR' END AS currency
FROM supplier JOIN nation ON s_nationkey = n_nationkey""", ()),
    "fx_book_levels": ("""
SELECT symbol, datetime, 'BID' AS side, bid AS price, bidsize AS size, '' AS market_maker FROM fx_ticks
UNION ALL SELECT symbol, datetime, 'ASK', ask, asksize, '' FROM fx_ticks""", ("fx_ticks",)),
    "fx_status": ("""
SELECT event_id, ts, CASE user_id % 3 WHEN 0 THEN 'gateway' WHEN 1 THEN 'store' ELSE 'bus' END AS component,
  CASE event_type WHEN 'error' THEN 'unhealthy' WHEN 'signup' THEN 'degraded' ELSE 'healthy' END AS status
FROM events""", ()),
    # Derived (not part of FIXTURES.md): a futures product catalogue keyed by
    # the spec symbols, one row per product; the group rule spreads products
    # over the eight catalogue groups.
    "fx_catalog": ("""
SELECT symbol, 'Futures on ' || min(class) AS product,
  CASE CAST(substring(symbol, 2) AS INT) % 8 WHEN 0 THEN 'agricultural' WHEN 1 THEN 'energy' WHEN 2 THEN 'equity'
    WHEN 3 THEN 'equity-index' WHEN 4 THEN 'fx' WHEN 5 THEN 'interest-rates' WHEN 6 THEN 'metals' ELSE 'products' END AS product_group,
  '/' || lower(min(exchange)) || '/' || lower(symbol) || '_{}.html' AS url
FROM fx_futures_specs GROUP BY symbol""", ("fx_futures_specs",)),
}


def _closure(names) -> list[str]:
    """Fixture names plus their dependencies, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in FIXTURE_SQL[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def register_fixtures(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register base tables and the requested fixture views (lazy)."""
    register_tables(spark, sf_dir)
    sk = _session_key(spark)
    for n in _closure(names or list(FIXTURE_SQL)):
        if _REGISTERED.get((sk, n)) == sf_dir and spark.catalog.tableExists(n):
            continue
        spark.sql(f"CREATE OR REPLACE TEMP VIEW {n} AS {FIXTURE_SQL[n][0]}")
        _REGISTERED[(sk, n)] = sf_dir


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_fixtures(spark, sf_dir, [name])
    return spark.table(name)


def with_fixtures(sql: str, names) -> str:
    """Prefix ``sql`` with CTEs defining the given fixture views (for DuckDB)."""
    ctes = [f"{n} AS ({FIXTURE_SQL[n][0]}\n)" for n in _closure(names)]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
