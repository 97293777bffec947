"""Scalar Column expressions (F1-F5, F11-F13).  All JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["as_double", "round_to_tick", "to_decimal", "is_number", "symbol_group",
           "asset_class", "mid_price", "parse_thousands",
           "parse_contract_month", "book_top", "falsy_to_null", "nan_to_null"]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def as_double(df, c: str) -> Column:
    """Column ``c`` of ``df`` as double: numeric columns are cast directly,
    anything else is parsed from text (unparsable -> NULL)."""
    from pyspark.sql.types import NumericType
    if isinstance(df.schema[c].dataType, NumericType):
        return F.col(c).cast("double")
    return F.col(c).cast("string").try_cast("double")


def round_to_tick(val, res: float, decimals: int | None = None) -> Column:
    """nearest multiple of ``res`` (half-even), then ``decimals`` places;
    decimals default to the digits after the point in ``res`` (none -> whole
    number).  NULL -> 0.0."""
    if decimals is None:
        txt = repr(float(res)) if not isinstance(res, str) else res
        decimals = len(txt.split(".")[1]) if "." in txt and not txt.endswith(".0") else 0
    v = F.bround(F.bround(_col(val) / F.lit(res)) * F.lit(res), decimals)
    return F.coalesce(v, F.lit(0.0))


def is_number(s) -> Column:
    """the value parses as a number (incl. 'nan', 'inf')."""
    c = _col(s).cast("string")
    return c.try_cast("double").isNotNull()


def to_decimal(x, points: int | None = None) -> Column:
    """numeric-looking values to double (optionally half-even rounded);
    non-numeric values give NULL in a typed column."""
    d = _col(x).cast("string").try_cast("double")
    return F.bround(d, points) if points is not None else d


def symbol_group(sym) -> Column:
    """``ESU2025_FUT`` -> ``ES_F``; ``*_CASH`` -> ``CASH``;
    ``*_OPT``/``*_FOP`` -> symbol minus its last 12 characters; else as is."""
    s = F.trim(_col(sym))
    before_fut = F.substring_index(s, "_FUT", 1)
    fut = F.concat(F.substring(before_fut, 1, F.greatest(F.length(before_fut) - 5, F.lit(0))),
                   F.lit("_F"))
    opt = F.substring(s, 1, F.greatest(F.length(s) - 12, F.lit(0)))
    return (F.when(s.contains("_FUT"), fut)
             .when(s.contains("_CASH"), F.lit("CASH"))
             .when(s.contains("_FOP") | s.contains("_OPT"), opt)
             .otherwise(s))


def asset_class(sym) -> Column:
    """last ``_`` part (CASH -> CSH); no ``_`` -> STK."""
    s = _col(sym)
    return F.when(F.instr(s, "_") > 0,
                  F.replace(F.substring_index(s, "_", -1), F.lit("CASH"), F.lit("CSH"))) \
            .otherwise(F.lit("STK"))


def mid_price(last, bid, ask) -> Column:
    """last when present, else (bid+ask)/2 when both sides exist."""
    return F.coalesce(_col(last), (_col(bid) + _col(ask)) / 2)


def parse_thousands(s) -> Column:
    """'1,234' -> 1234 (NULL when unparsable)."""
    return F.regexp_replace(_col(s).cast("string"), ",", "").try_cast("double")


def parse_contract_month(s) -> Column:
    """'JLY 24' / 'Mar 24' / '202403' -> '202403'."""
    c = F.upper(F.trim(_col(s).cast("string")))
    c = F.regexp_replace(c, "JLY", "JUL")
    as_text = F.try_to_timestamp(c, F.lit("MMM yy"))
    as_text2 = F.try_to_timestamp(c, F.lit("MMM yyyy"))
    as_num = F.try_to_timestamp(c, F.lit("yyyyMM"))
    t = F.coalesce(as_num, as_text, as_text2)
    return F.date_format(t, "yyyyMM")


def book_top(bids, asks) -> Column:
    """struct(bid, bidsize, ask, asksize) from depth arrays ordered best
    first; zeros when there is no book."""
    b = F.element_at(_col(bids), 1)
    a = F.element_at(_col(asks), 1)
    return F.struct(F.coalesce(b["price"], F.lit(0.0)).alias("bid"),
                    F.coalesce(b["size"], F.lit(0.0)).alias("bidsize"),
                    F.coalesce(a["price"], F.lit(0.0)).alias("ask"),
                    F.coalesce(a["size"], F.lit(0.0)).alias("asksize"))


def falsy_to_null(c) -> Column:
    """0 / 0.0 / NaN -> NULL (the store keeps no falsy prices or sizes)."""
    x = _col(c)
    return F.when((x == 0) | F.isnan(x), F.lit(None)).otherwise(x)


def nan_to_null(c) -> Column:
    x = _col(c)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)
