"""Trade, position and account reports.

P12 closed_trades_report, A9 last_price, J3 open_positions, A10
distinct_algos, P13 account_summary, P14 report_view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.calendar import backdate_ts


def slippage(entry: str = "entry_price", market: str = "market_price",
             direction: str = "direction") -> Column:
    """|entry - market|, negative when a LONG entered above the market or a
    SHORT below it."""
    e, m, d = F.col(entry), F.col(market), F.col(direction)
    s = F.abs(e - m)
    bad = ((d == "LONG") & (e > m)) | ((d == "SHORT") & (e < m))
    return F.when(bad, -s).otherwise(s)


def closed_trades_report(trades: DataFrame, start=None, end=None, algo: str | None = None,
                         now=None) -> DataFrame:
    """Closed trades (exit_time set) with entry_time >= start (default
    7 days back, stepping over weekends), exit_time <= end, optional algo;
    adds slippage; newest exit first."""
    if start is None:
        start = backdate_ts("7D", now)
    out = trades.filter(F.col("exit_time").isNotNull())
    out = out.filter(F.col("entry_time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.filter(F.col("exit_time") <= F.lit(end).cast("timestamp_ntz"))
    if algo is not None:
        out = out.filter(F.col("algo") == algo.replace("/", ""))
    return out.withColumn("slippage", slippage()) \
              .orderBy(F.col("exit_time").desc(), F.col("entry_time").desc())


def last_price(ticks: DataFrame, mode: str = "max", key: str = "symbol",
               price: str = "last", ts: str = "datetime") -> DataFrame:
    """Per symbol price for valuation.  ``max`` = MAX(last) (what the
    positions report uses), ``latest`` = last at the greatest time."""
    if mode == "max":
        agg = F.max(price)
    elif mode == "latest":
        agg = F.max_by(F.col(price), F.when(F.col(price).isNotNull(), F.col(ts)))
    else:
        raise ValueError("mode must be 'max' or 'latest'")
    return ticks.groupBy(key).agg(agg.alias("last_price"))


def open_positions(trades: DataFrame, prices: DataFrame, algo: str | None = None) -> DataFrame:
    """Open trades (no exit_time) left-joined to a per-symbol price;
    unrealized = entry - last (SHORT) or last - entry, 0.0 without a price;
    last_price 0.0 without a price; slippage; newest entry first.  The price
    table is one row per symbol (AQE broadcasts it when it is small)."""
    t = trades.filter(F.col("exit_time").isNull())
    if algo is not None:
        t = t.filter(F.col("algo") == algo.replace("/", ""))
    j = t.join(prices.select("symbol", "last_price"), "symbol", "left")
    lp = F.col("last_price")
    upnl = F.when(lp.isNull(), F.lit(0.0)) \
            .when(F.col("direction") == "SHORT", F.col("entry_price") - lp) \
            .otherwise(lp - F.col("entry_price"))
    return j.withColumns({"unrealized_pnl": upnl, "slippage": slippage(),
                          "last_price": F.coalesce(lp, F.lit(0.0))}) \
            .orderBy(F.col("entry_time").desc())


def distinct_algos(trades: DataFrame) -> DataFrame:
    """A10: the algos that have trades."""
    return trades.select("algo").distinct()


# Account tags read by the account summary.
ACCOUNT_TAGS = ("NetLiquidation", "PreviousDayEquityWithLoanValue", "UnrealizedPnL",
                "RealizedPnL", "ExcessLiquidity", "MaintMarginReq", "SMA")


def account_summary(values: DataFrame) -> DataFrame:
    """Per account from tag/value rows: daily_pnl = NetLiquidation -
    PreviousDayEquityWithLoanValue and the other figures; missing tag -> 0."""
    v = values.withColumn("_v", F.col("value").cast("string").try_cast("double"))
    aggs = [F.max(F.when(F.col("tag") == t, F.col("_v"))).alias(t) for t in ACCOUNT_TAGS]
    p = v.groupBy("account").agg(*aggs)
    z = {t: F.coalesce(F.col(t), F.lit(0.0)) for t in ACCOUNT_TAGS}
    return p.select(
        "account",
        (z["NetLiquidation"] - z["PreviousDayEquityWithLoanValue"]).alias("daily_pnl"),
        z["UnrealizedPnL"].alias("unrealized_pnl"), z["RealizedPnL"].alias("realized_pnl"),
        z["NetLiquidation"].alias("net_liquidity"), z["ExcessLiquidity"].alias("excess_liquidity"),
        z["MaintMarginReq"].alias("maint_margin"), z["SMA"].alias("sma"))


# Dashboard code abbreviations, applied in this order, first
# occurrence only.
SHORT_CODES = (("MARKET", "MKT"), ("LIMIT", "LMT"), ("STOP", "STP"), ("TARGET", "TGT"),
               ("SIGNAL", "SGL"), ("LONG", "LNG"), ("SHORT", "SRT"))


def fin_short(df: DataFrame, columns: list[str]) -> DataFrame:
    """Abbreviates codes in these columns, in upper case.  Each code is a step
    of its own over the text of the step before, found without a pattern."""
    out = df.withColumns({c: F.upper(c) for c in columns})
    for long_, short in SHORT_CODES:
        out = out.withColumns({c: F.when(F.contains(F.col(c), F.lit(long_)), F.overlay(
            F.col(c), F.lit(short), F.instr(F.col(c), long_), F.lit(len(long_)))).otherwise(F.col(c))
            for c in columns})
    return out


def uncamel(c) -> Column:
    x = F.regexp_replace(F.col(c) if isinstance(c, str) else c, "([A-Z])", " $1")
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


def report_view(df: DataFrame) -> DataFrame:
    """Dashboard columns over a trades or positions report: position
    status, pnl status, short codes, readable algo name; zero target / stop /
    last price become NULL (shown as '-')."""
    pnl = F.coalesce(F.col("realized_pnl") if "realized_pnl" in df.columns else F.lit(0.0), F.lit(0.0))
    if "unrealized_pnl" in df.columns:
        pnl = F.coalesce(F.col("unrealized_pnl"), F.lit(0.0))
    cols = {
        "pos_status": F.when(F.coalesce(F.col("exit_reason"), F.lit("")) == "", "active").otherwise("completed"),
        "pnl_status": F.when(pnl == 0, "").when(pnl > 0, "positive").otherwise("negative"),
        "algo_name": uncamel("algo"),
        "direction_code": F.col("direction"),
        "order_type_code": F.col("order_type"),
        "exit_reason_code": F.coalesce(F.col("exit_reason"), F.lit("")),
    }
    for c in ("target", "stop", "last_price"):
        if c in df.columns:
            cols[f"{c}_shown"] = F.when(F.col(c) == 0, F.lit(None)).otherwise(F.col(c))
    return fin_short(df.withColumns(cols), ["direction_code", "order_type_code", "exit_reason_code"])
