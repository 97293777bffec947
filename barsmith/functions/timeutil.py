"""Resolution parsing (F6), time buckets and time-zone helpers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["Resolution", "parse_resolution", "bucket_start", "to_local",
           "to_utc", "parse_utc", "format_ts", "ALLOWED_API_RESOLUTIONS"]

# Resolutions the REST history endpoint accepts.
ALLOWED_API_RESOLUTIONS = ("1T", "5T", "15T", "30T", "1H", "4H", "1D")

# unit letter -> seconds for fixed-length units (pandas aliases)
_UNIT_SECONDS = {"S": 1, "T": 60, "MIN": 60, "H": 3600, "D": 86400}


@dataclass(frozen=True)
class Resolution:
    kind: str          # 'ticks' | 'volume' | 'time'
    n: int
    unit: str = ""     # for time: S, T, H, D, W, M

    @property
    def seconds(self) -> int | None:
        if self.kind != "time" or self.unit in ("W", "M"):
            return None
        return self.n * _UNIT_SECONDS[self.unit]

    @property
    def day_aligned(self) -> bool:
        """True when buckets from the epoch equal buckets from any midnight."""
        s = self.seconds
        return s is not None and 86400 % s == 0


def parse_resolution(res: str) -> Resolution:
    """``'500K'`` -> 500-tick bars, ``'1000V'`` -> volume bars, ``'5T'``,
    ``'1H'``, ``'1D'``, ``'1W'`` (week ending Sunday), ``'3M'`` (month ends),
    ``'30S'`` -> time bars.  Digits give the size; default 1."""
    s = str(res).strip().upper()
    digits = "".join(ch for ch in s if ch.isdigit())
    n = int(digits) if digits else 1
    letters = re.sub(r"[0-9]", "", s)
    if "K" in letters:
        return Resolution("ticks", n)
    if "V" in letters:
        return Resolution("volume", n)
    if letters in ("MIN",):
        letters = "T"
    if letters not in ("S", "T", "H", "D", "W", "M"):
        raise ValueError(f"unknown resolution {res!r}")
    if n < 1:
        raise ValueError(f"resolution {res!r} has no length")
    return Resolution("time", n, letters)


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _week_end(c: Column) -> Column:
    return F.when(F.dayofweek(c) == 1, F.to_date(c)).otherwise(F.next_day(F.to_date(c), "Sun"))


def bucket_start(ts, res: Resolution, origin: Column | None = None) -> Column:
    """Start (label) of the time bucket holding ``ts``.

    Fixed-size buckets are aligned to ``origin`` (a timestamp column; default
    the epoch, which equals any midnight when the size divides a day).
    ``W`` buckets are labelled by the Sunday ending the week, ``M`` by the
    month's last day (calendar anchored, as pandas 'W'/'M').  Of several weeks
    or months the first bucket ends with the week or month of ``origin``, the
    next ones every ``n`` after it."""
    c = _col(ts)
    if res.unit in ("W", "M") and res.n > 1 and origin is None:
        raise ValueError("buckets of several weeks or months need an origin")
    if res.unit == "W":
        end = _week_end(c)
        if res.n > 1:
            first = _week_end(origin)
            end = F.date_add(first, (F.ceil(F.datediff(end, first) / (7 * res.n)) * (7 * res.n)).cast("int"))
        return end.cast("timestamp_ntz")
    if res.unit == "M":
        day = F.to_date(c)
        if res.n > 1:
            first = F.to_date(origin)
            months = (F.year(day) - F.year(first)) * 12 + F.month(day) - F.month(first)
            day = F.add_months(F.trunc(first, "MM"), (F.ceil(months / res.n) * res.n).cast("int"))
        return F.last_day(day).cast("timestamp_ntz")
    us = res.seconds * 1_000_000
    t = F.unix_micros(c.cast("timestamp"))
    if origin is None:
        b = F.floor(t / F.lit(us)) * F.lit(us)
    else:
        o = F.unix_micros(origin.cast("timestamp"))
        b = o + F.floor((t - o) / F.lit(us)) * F.lit(us)
    return F.timestamp_micros(b).cast("timestamp_ntz")


def to_local(ts, tz: str) -> Column:
    """UTC wall-clock -> wall-clock in ``tz``."""
    return F.from_utc_timestamp(_col(ts).cast("timestamp"), tz).cast("timestamp_ntz")


def to_utc(ts, tz: str) -> Column:
    """Wall-clock in ``tz`` -> UTC wall-clock."""
    return F.to_utc_timestamp(_col(ts).cast("timestamp"), tz).cast("timestamp_ntz")


def parse_utc(s, fmt: str | None = None) -> Column:
    """String -> UTC timestamp; strings with an offset are converted, naive
    strings are taken as UTC; unparsable -> NULL (F9 convert_timezone)."""
    c = _col(s)
    t = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
    return t.cast("timestamp_ntz")


def format_ts(ts, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_col(ts), fmt)
