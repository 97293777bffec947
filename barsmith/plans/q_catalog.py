"""Catalogue queries."""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import functions as F

from barsmith.operators import catalog as CA
from barsmith.plans.registry import register
from barsmith.session import scratch_path
from barsmith.sources import instruments as IN

JAN15 = _dt.date(2024, 1, 15)
JUL1 = _dt.date(2024, 7, 1)
CONTRACT_COLS = "symbol, sec_type, exchange, currency, expiry, strike, opt_type"


def contracts(spark):
    return spark.table("fx_contracts").select(*IN.CANONICAL)


def _live_sql(src: str, ym: int, ymd: int, keep_comments: bool = False) -> str:
    where = "" if keep_comments else " AND NOT starts_with(coalesce(symbol, ''), '#')"
    return f"""SELECT coalesce(symbol, '') AS symbol, coalesce(sec_type, '') AS sec_type, coalesce(exchange, '') AS exchange,
  coalesce(currency, '') AS currency,
  CASE WHEN CAST(coalesce(expiry, 0.0) AS BIGINT) = 0 THEN '' ELSE CAST(CAST(coalesce(expiry, 0.0) AS BIGINT) AS VARCHAR) END AS expiry,
  coalesce(strike, 0.0) AS strike, coalesce(opt_type, '') AS opt_type
FROM {src}
WHERE (expiry IS NULL OR isnan(expiry) OR (expiry < 1000000 AND expiry >= {ym}) OR (expiry >= 1000000 AND expiry >= {ymd}))
  AND (sec_type IS NULL OR sec_type <> 'BAG'){where}"""


@register("scan_instruments", fixtures=["fx_contracts"], sql=f"SELECT {CONTRACT_COLS} FROM fx_contracts")
def scan_instruments(spark):
    """The contract list written as CSV with the sample-file header
    (secType, right) and read back into the canonical columns."""
    path = scratch_path(spark, "instruments", f"list-{uuid.uuid4().hex}")
    src = contracts(spark).withColumnRenamed("sec_type", "secType").withColumnRenamed("opt_type", "right")
    IN.write_instruments(src, path)
    return IN.scan_instruments(spark, path)


@register("live_instruments", fixtures=["fx_contracts"], sql=_live_sql("fx_contracts", 202407, 20240701))
def live_instruments(spark):
    """Live, cleaned instruments as of 2024-07-01."""
    return CA.live_instruments(contracts(spark), JUL1)


@register("rewrite_instruments", fixtures=["fx_contracts"], sql=f"""
WITH c AS ({_live_sql('fx_contracts', 202401, 20240115, keep_comments=True)})
SELECT symbol, sec_type, exchange, currency, CAST(NULLIF(expiry, '') AS DOUBLE) AS expiry, strike, opt_type FROM c
""")
def rewrite_instruments(spark):
    """The cleaned list (comments kept) written back as a new version and
    re-read through S1."""
    path = scratch_path(spark, "instruments", f"clean-{uuid.uuid4().hex}")
    IN.write_instruments(CA.clean_instruments(contracts(spark), JAN15), path)
    back = IN.scan_instruments(spark, path)
    return back.fillna("", subset=["symbol", "sec_type", "exchange", "currency", "opt_type"])


@register("register_instruments", fixtures=["fx_contracts"], sql=f"""
WITH ex AS ({_live_sql('fx_contracts', 202407, 20240701, keep_comments=True)}),
nw AS (SELECT symbol, sec_type, exchange, currency,
  CASE WHEN CAST(coalesce(expiry, 0.0) AS BIGINT) = 0 THEN '' ELSE CAST(CAST(coalesce(expiry, 0.0) AS BIGINT) AS VARCHAR) END AS expiry,
  strike, opt_type FROM fx_contracts),
u AS (SELECT *, 0 AS p FROM ex UNION ALL SELECT *, 1 FROM nw)
SELECT {CONTRACT_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, sec_type, exchange, currency, expiry
  ORDER BY p, strike NULLS FIRST, opt_type NULLS FIRST) AS rn FROM u) x WHERE rn = 1
""")
def register_instruments(spark):
    """Register every raw contract into the saved list; saved rows win."""
    existing = CA.clean_instruments(contracts(spark), JUL1)
    return CA.register_instruments(existing, CA.normalize_new(contracts(spark)))


@register("instrument_changes", fixtures=["fx_contracts"], sql=f"""
WITH o AS ({_live_sql('fx_contracts', 202401, 20240115)}),
n AS ({_live_sql("(SELECT * REPLACE (coalesce(exchange, 'IDEALPRO') AS exchange) FROM fx_contracts)", 202407, 20240701)})
SELECT *, 'ADDED' AS change FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.symbol IS NOT DISTINCT FROM n.symbol
  AND o.sec_type IS NOT DISTINCT FROM n.sec_type AND o.exchange IS NOT DISTINCT FROM n.exchange AND o.currency IS NOT DISTINCT FROM n.currency
  AND o.expiry IS NOT DISTINCT FROM n.expiry AND o.strike IS NOT DISTINCT FROM n.strike AND o.opt_type IS NOT DISTINCT FROM n.opt_type)
UNION ALL
SELECT *, 'REMOVED' AS change FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE o.symbol IS NOT DISTINCT FROM n.symbol
  AND o.sec_type IS NOT DISTINCT FROM n.sec_type AND o.exchange IS NOT DISTINCT FROM n.exchange AND o.currency IS NOT DISTINCT FROM n.currency
  AND o.expiry IS NOT DISTINCT FROM n.expiry AND o.strike IS NOT DISTINCT FROM n.strike AND o.opt_type IS NOT DISTINCT FROM n.opt_type)
""")
def instrument_changes(spark):
    """Changes between the list as of Jan 15 and an edited version (missing
    exchanges filled) as of Jul 1."""
    old = CA.live_instruments(contracts(spark), JAN15)
    edited = contracts(spark).withColumn("exchange", F.coalesce("exchange", F.lit("IDEALPRO")))
    return CA.instrument_changes(old, CA.live_instruments(edited, JUL1))
