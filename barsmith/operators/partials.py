"""Mergeable statistics per (period, symbol): what A6 symbol_statistics, A7
store_summary, A8 quality_report and T1 latest rows need of a store, kept by
its ingest (``commits``), so that they are answered without reading it.

A partial is a count, a sum, a minimum or a maximum; partials of two batches
merge into that of both.  There is a row per period (the partition of the store:
a day of ticks, a month of bars) and symbol at most, whatever the rows in it.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from barsmith import schemas
from barsmith.operators import store as ST
from barsmith.session import checkpoint_dir

KEYS = ["period", "symbol_id"]


@dataclass(frozen=True)
class Kind:
    """A kind of store: its schema with ``period``, its values, the length of a
    period, what is kept of its rows."""

    stored: StructType
    values: tuple[str, ...]
    length: str
    kept: dict

    def period(self, ts: Column) -> Column:
        return F.date_trunc(self.length, ts).cast("date")

    def schema(self) -> str:
        types = {"n": "bigint", "failing": "bigint", "earliest": "timestamp_ntz", "latest": "timestamp_ntz"}
        at_rest = {f.name: f.dataType.simpleString() for f in self.stored.fields}
        return ", ".join(["period date", "symbol_id bigint",
                          *(f"{name} {types.get(name) or at_rest[source]}" for name, (source, _) in self.kept.items())])


def bar_fails() -> Column:
    """A8's rule for a bar; comparisons with NULL do not count."""
    bad = (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | \
          (F.col("low") > F.col("open")) | (F.col("low") > F.col("close")) | (F.col("volume") < 0)
    return F.coalesce(bad, F.lit(False))


def _stored(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("period", DateType())])


#: name of what is kept: (column, how it is merged)
KINDS = {
    "bars": Kind(_stored(schemas.BARS), ST.BAR_VALUES, "month", {
        "n": (None, "sum"), "failing": (None, "sum"), "earliest": ("datetime", "min"), "latest": ("datetime", "max"),
        "min_price": ("open", "min"), "max_price": ("high", "max"),
        "min_volume": ("volume", "min"), "max_volume": ("volume", "max")}),
    "ticks": Kind(_stored(schemas.TICKS), ST.TICK_VALUES, "day", {
        "n": (None, "sum"), "failing": (None, "sum"), "earliest": ("datetime", "min"), "latest": ("datetime", "max")}),
}


def partials(rows: DataFrame, kind: str) -> DataFrame:
    """The statistics of stored rows by (period, symbol_id)."""
    if kind == "bars":
        fails = bar_fails()
    else:
        rows = ST.validate_ticks(rows, require_symbol=False)
        fails = ~F.col("is_valid")
    aggs = {"n": F.count(F.lit(1)), "failing": F.count_if(fails)}
    for name, (source, how) in KINDS[kind].kept.items():
        if source:
            aggs[name] = getattr(F, how)(source)
    return rows.groupBy(*KEYS).agg(*(a.alias(n) for n, a in aggs.items()))


def merge(rows: DataFrame, kind: str, keys=KEYS) -> DataFrame:
    """Partials of several batches as one, or of a coarser key."""
    return rows.groupBy(*keys).agg(*(getattr(F, how)(name).alias(name) for name, (_, how) in KINDS[kind].kept.items()))


# --------------------------------------------------------------------- A6 / A7 / A8
def symbol_statistics(bars: DataFrame, ticks: DataFrame, symbols_dim: DataFrame) -> DataFrame:
    """A6 from the partials of both stores: as ``store.symbol_statistics``."""
    b = merge(bars, "bars", ["symbol_id"]).select(
        "symbol_id", F.col("n").alias("bars_count"), *(F.col(c).cast("double").alias(c) for c in ("min_price", "max_price")),
        "min_volume", "max_volume", "earliest", "latest")
    t = merge(ticks, "ticks", ["symbol_id"]).select(
        "symbol_id", F.col("n").alias("ticks_count"), F.col("earliest").alias("ticks_earliest"),
        F.col("latest").alias("ticks_latest"))
    dim = symbols_dim.select(F.col("id").alias("symbol_id"), "symbol", "symbol_group", "asset_class")
    out = dim.join(b, "symbol_id", "left").join(t, "symbol_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("bars_count", "ticks_count")})


def store_summary(symbols_dim: DataFrame, bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """A7 from partials: as ``store.store_summary``."""
    total = F.coalesce(F.sum("n"), F.lit(0))
    b = bars.agg(total.alias("total_bars"), F.min("earliest").alias("earliest_bar"), F.max("latest").alias("latest_bar"))
    return b.select(symbols_dim.agg(F.count(F.lit(1))).scalar().alias("total_symbols"), "total_bars",
                    ticks.agg(total).scalar().alias("total_ticks"), "earliest_bar", "latest_bar")


def quality_report(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """A8 from partials: as ``store.quality_report`` over the stored rows."""
    def total(c):
        return F.coalesce(F.sum(c), F.lit(0))
    b = bars.agg(total("n").alias("total_bars"), total("failing").alias("invalid_bars"))
    t = ticks.agg(total("n").alias("n"), total("failing").alias("failing"))
    n, failing = t.select("n").scalar(), t.select("failing").scalar()
    return b.select(
        F.when(F.col("invalid_bars") == 0, "good").otherwise("issues_found").alias("overall_status"),
        "total_bars", (F.col("total_bars") - F.col("invalid_bars")).alias("valid_bars"), "invalid_bars",
        n.alias("total_ticks"), n.alias("valid_ticks"), F.lit(0).cast("long").alias("invalid_ticks"),
        failing.alias("ticks_failing_checks"))


# --------------------------------------------------------------------- T1
def last_periods(partials_: DataFrame) -> DataFrame:
    """The last period in which each symbol has rows."""
    return partials_.groupBy("symbol_id").agg(F.max("period").alias("period"))


def latest_rows(store: DataFrame, partials_: DataFrame, symbols_dim: DataFrame, kind: str) -> DataFrame:
    """T1 by point reads: of every symbol the newest row, read from the periods
    that are some symbol's last.  These (a calendar's worth at most) become a
    partition filter, so a store whose symbols all traded on its newest day is
    read there alone, and a symbol last seen years ago costs its own day."""
    last = last_periods(partials_)
    periods = [r["period"] for r in last.select("period").distinct().collect()]
    rows = store.where(F.col("period").isin(periods)).join(last, ["symbol_id", "period"], "left_semi")
    return _named(rows, symbols_dim, kind)


def doubles(rows: DataFrame) -> DataFrame:
    """Decimals at rest as doubles."""
    return rows.withColumns({f.name: F.col(f.name).cast("double") for f in rows.schema.fields
                             if f.dataType.typeName() == "decimal"})


def _named(rows: DataFrame, symbols_dim: DataFrame, kind: str) -> DataFrame:
    rows = doubles(rows)
    return ST.latest_tick(rows, symbols_dim) if kind == "ticks" else ST.latest_bar(rows, symbols_dim)


def periods_of(store: DataFrame) -> list[str]:
    """The partitions of a store, newest first, from its file list: nothing is
    read."""
    return sorted({m.group(1) for f in store.inputFiles() if (m := re.search(r"/period=(\d{4}-\d\d-\d\d)/", f))}, reverse=True)


def newest_first(store: DataFrame, wanted: DataFrame, kind: str, periods: int = 1) -> DataFrame:
    """T1 without partials: the newest row of each ``wanted`` symbol_id.  The
    newest ``periods`` are read first, then twice as many and so on, each time
    for the symbols that were not found yet, until none is left or all are read
    (the logarithm of the periods in steps).  Stored columns."""
    checkpoint_dir(store.sparkSession)
    left = wanted.select("symbol_id").distinct().checkpoint()
    every, found = periods_of(store), []
    values = [*KINDS[kind].values, "period"]
    while every and not left.isEmpty():
        step, every, periods = every[:periods], every[periods:], 2 * periods
        rows = store.where(F.col("period").between(F.lit(step[-1]).cast("date"), F.lit(step[0]).cast("date")))
        rows = rows.join(left, "symbol_id", "left_semi").groupBy("symbol_id").agg(
            F.max_by(F.struct("datetime", *values), "datetime").alias("r"))
        found.append(rows.select("symbol_id", "r.*").checkpoint())
        left = left.join(found[-1].select("symbol_id"), "symbol_id", "left_anti").checkpoint()
    if not found:
        return store.select("symbol_id", "datetime", *values).limit(0)
    return functools.reduce(DataFrame.unionByName, found)


def latest_by_scan(store: DataFrame, symbols_dim: DataFrame, kind: str) -> DataFrame:
    """T1 over a store without partials, newest periods first."""
    return _named(newest_first(store, symbols_dim.select(F.col("id").alias("symbol_id")), kind), symbols_dim, kind)
