"""Instrument catalogue maintenance.

P4 live_instruments, U1 register_instruments, U2 instrument_changes, and the
list normalisation they share.  Instrument lists are small relative to market
data, but nothing here assumes that: de-duplication is an aggregation, and
change detection is two null-safe anti joins.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.sources.instruments import CANONICAL

KEY_COLUMNS = ("symbol", "sec_type", "exchange", "currency", "expiry")


def _expiry_text(c) -> F.Column:
    """YYYYMM[DD] number -> text; NULL / 0 -> ''."""
    v = F.coalesce(c.cast("double"), F.lit(0.0)).cast("long")
    return F.when(v == 0, F.lit("")).otherwise(v.cast("string"))


def clean_instruments(df: DataFrame, as_of=None) -> DataFrame:
    """P4 without the final comment filter (what is written back): live
    expiries only, expiry as text, BAG rows dropped, NULL text -> '', NULL
    numbers -> 0."""
    as_of = as_of or _dt.date.today()
    ym = as_of.year * 100 + as_of.month
    ymd = ym * 100 + as_of.day
    e = F.col("expiry")
    live = e.isNull() | F.isnan(e) | ((e < 1000000) & (e >= ym)) | ((e >= 1000000) & (e >= ymd))
    out = df.filter(live)
    out = out.withColumn("expiry", _expiry_text(F.col("expiry")))
    out = out.filter(F.col("sec_type").isNull() | (F.col("sec_type") != "BAG"))
    fills = {c: F.coalesce(F.col(c), F.lit("")) for c in ("symbol", "sec_type", "exchange", "currency", "opt_type")}
    fills["strike"] = F.coalesce(F.col("strike"), F.lit(0.0))
    return out.withColumns(fills).select(*CANONICAL)


def live_instruments(df: DataFrame, as_of=None) -> DataFrame:
    """Cleaned list without commented-out symbols (leading ``#``)."""
    return clean_instruments(df, as_of).filter(~F.col("symbol").startswith("#"))


def normalize_new(df: DataFrame) -> DataFrame:
    """New registrations in list form: expiry as text, missing text ''."""
    return df.withColumn("expiry", _expiry_text(F.col("expiry")))


def register_instruments(existing: DataFrame, new: DataFrame, seq: str | None = None) -> DataFrame:
    """Existing list plus new instruments, one row per (symbol, sec_type,
    exchange, currency, expiry); the existing row wins, then list order
    (``seq`` when the frames carry it; else the remaining values decide)."""
    text = ("symbol", "sec_type", "exchange", "currency", "expiry", "opt_type")

    def prep(df, prio):
        s = F.col(seq) if seq and seq in df.columns else F.lit(0).cast("long")
        return df.select(*CANONICAL, s.cast("long").alias("_s")).withColumn("_p", F.lit(prio))

    ex = prep(existing, 0).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text})
    u = ex.unionByName(prep(new, 1))
    rest = [c for c in CANONICAL if c not in KEY_COLUMNS]
    order = F.struct("_p", "_s", *[F.col(c) for c in rest])
    packed = F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("_r")
    return u.groupBy(*KEY_COLUMNS).agg(packed).select(
        *KEY_COLUMNS, *[F.col("_r")[c].alias(c) for c in rest]).select(*CANONICAL)


def instrument_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """ADDED = rows of ``new`` absent from ``old``, REMOVED = rows of
    ``old`` absent from ``new``, compared on all columns, NULL-safe."""
    cols = list(CANONICAL)

    def anti(a, b):
        cond = [a[c].eqNullSafe(b[c]) for c in cols]
        return a.join(b, cond, "left_anti")

    o = old.select(*cols)
    n = new.select(*cols)
    return anti(n, o).withColumn("change", F.lit("ADDED")).unionByName(
        anti(o, n).withColumn("change", F.lit("REMOVED")))
