"""Trading-calendar expressions (F7) and the backfill duration label (F8).

All take a timestamp/date Column and stay in the JVM; :func:`trading_calendar`
applies them to every distinct date/time of a table.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["previous_weekday", "backdate", "backdate_ts", "is_third_friday",
           "after_third_friday", "week_start", "third_friday", "trading_calendar",
           "duration_label"]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _skip_weekend_back(ts: Column) -> Column:
    """Step back a day at a time until Monday-Friday (keeps the time)."""
    dow = F.dayofweek(ts)  # 1 = Sunday ... 7 = Saturday
    back = F.when(dow == 7, 1).when(dow == 1, 2).otherwise(0)
    return ts - F.make_dt_interval(back)


def previous_weekday(day) -> Column:
    """The business day before ``day`` (a date)."""
    d = F.date_sub(F.to_date(_col(day)), 1)
    dow = F.dayofweek(d)
    return F.date_sub(d, F.when(dow == 7, 1).when(dow == 1, 2).otherwise(0))


def _res_parts(res: str):
    digits = "".join(ch for ch in res if ch.isdigit())
    n = int(digits) if digits else 0
    if "K" in res:
        return n, "us"
    if "S" in res:
        return n, "s"
    if "T" in res:
        return n, "min"
    if "H" in res or "V" in res:
        return n, "h"
    if "W" in res:
        return n, "w"
    return n, "d"


def backdate(ts, res: str) -> Column:
    """``ts`` minus N units of ``res`` (K micro-seconds, S, T, H or V hours,
    W weeks, else days; tested in that order), then back over weekends.
    Zero periods leave the value unchanged."""
    c = _col(ts).cast("timestamp_ntz")
    n, unit = _res_parts(res)
    if n <= 0:
        return c
    if unit == "us":
        shifted = F.timestamp_micros(F.unix_micros(c.cast("timestamp")) - n).cast("timestamp_ntz")
    elif unit == "s":
        shifted = c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))
    elif unit == "min":
        shifted = c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(n))
    elif unit == "h":
        shifted = c - F.make_dt_interval(F.lit(0), F.lit(n))
    elif unit == "w":
        shifted = c - F.make_dt_interval(F.lit(7 * n))
    else:
        shifted = c - F.make_dt_interval(F.lit(n))
    return _skip_weekend_back(shifted)


def backdate_ts(res: str, now=None) -> _dt.datetime:
    """Driver-side twin of :func:`backdate` for one request parameter."""
    d = now or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    n, unit = _res_parts(res)
    if n > 0:
        delta = {"us": _dt.timedelta(microseconds=n), "s": _dt.timedelta(seconds=n),
                 "min": _dt.timedelta(minutes=n), "h": _dt.timedelta(hours=n),
                 "w": _dt.timedelta(weeks=n), "d": _dt.timedelta(days=n)}[unit]
        d = d - delta
        while d.weekday() > 4:
            d = d - _dt.timedelta(days=1)
    return d


def third_friday(ts) -> Column:
    """Date of the third Friday of the month of ``ts``."""
    first = F.trunc(F.to_date(_col(ts)), "MM")
    return F.next_day(F.date_add(first, 13), "Fri")


def is_third_friday(ts) -> Column:
    """A Friday, or a Thursday from 17:00, between the 15th and the 21st."""
    c = _col(ts)
    dow = F.dayofweek(c)
    friday = (dow == 6) | ((dow == 5) & (F.hour(c) >= 17))
    return friday & (F.dayofmonth(c) > 14) & (F.dayofmonth(c) < 22)


def after_third_friday(ts) -> Column:
    """Strictly after 16:00 of the month's third Friday."""
    c = _col(ts).cast("timestamp_ntz")
    cut = F.make_timestamp_ntz(F.year(third_friday(c)), F.month(third_friday(c)),
                               F.dayofmonth(third_friday(c)), F.lit(16), F.lit(0), F.lit(0))
    return c > cut


def week_start(ts) -> Column:
    """The Sunday that starts the week of ``ts`` (the day itself on Sundays)."""
    d = F.to_date(_col(ts))
    return F.date_sub(d, F.dayofweek(d) - 1)


def trading_calendar(df: DataFrame, ts: str = "datetime", res: str = "7D") -> DataFrame:
    """F7 job: calendar facts for every distinct time of ``df``."""
    t = df.select(F.col(ts).alias("ts")).distinct()
    return t.select("ts", previous_weekday("ts").alias("previous_weekday"),
                    backdate("ts", res).alias("backdate"),
                    is_third_friday("ts").alias("is_third_friday"),
                    after_third_friday("ts").alias("after_third_friday"),
                    week_start("ts").alias("week_start"))


def duration_label(start, now) -> Column:
    """F8: request duration from ``start`` to ``now``: NULL when negative or
    when the seconds part of the difference is below 60; same day -> 'n S';
    1-30 days -> 'n D'; 32-364 -> ceil(d/30) 'M'; else ceil(d/365) 'Y'
    (31 days gives '1 Y')."""
    us = F.unix_micros(_col(now).cast("timestamp")) - F.unix_micros(_col(start).cast("timestamp"))
    day_us = F.lit(86_400_000_000)
    days = F.floor(us / day_us)
    secs = F.floor((us - days * day_us) / F.lit(1_000_000))
    return (F.when((days < 0) | (secs < 60), F.lit(None).cast("string"))
             .when((days == 0) & (secs > 1), F.concat(secs.cast("string"), F.lit(" S")))
             .when((days > 0) & (days < 31), F.concat(days.cast("string"), F.lit(" D")))
             .when((days > 31) & (days < 365), F.concat(F.ceil(days / 30).cast("string"), F.lit(" M")))
             .otherwise(F.concat(F.ceil(days / 365).cast("string"), F.lit(" Y"))))
