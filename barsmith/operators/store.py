"""The market store: idempotent ingest, validation, history and statistics.

S3 ingest_bars, S4 ingest_ticks, S5 assign_symbol_ids, P8 validate_bars,
P9 validate_ticks, P10 time_range_filter, P11 prepare_history,
J1 historical_bars, J2 historical_ticks, J4 greeks_join, J7 missing_rows,
J8 symbol_list_semi_join, T1 latest_tick / latest_bar, T2 symbols_list,
A6 symbol_statistics, A7 store_summary, A8 quality_report, S10 records_json.

Layout: ``bars``/``ticks`` are Parquet partitioned by ``date`` and sorted
within partitions by ``(symbol_id, datetime)``, so a time filter prunes
partitions and a symbol filter skips row groups by min/max statistics.
Uniqueness of ``(datetime, symbol_id)`` is kept by the anti-join in ingest,
which carries ``date`` so dynamic partition pruning limits the probe of the
existing store to the batch's days.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from barsmith import schemas
from barsmith.functions.scalars import as_double, falsy_to_null
from barsmith.functions.timeutil import to_local
from barsmith.operators import ordered

BAR_VALUES = ("open", "high", "low", "close", "volume")
#: characters of a symbol by which new ids are counted
ID_PREFIX = 6
TICK_VALUES = ("bid", "bidsize", "ask", "asksize", "last", "lastsize")


# --------------------------------------------------------------------- S5
def assign_symbol_ids(requests: DataFrame, symbols: DataFrame,
                      default_asset_class: str = "STK") -> DataFrame:
    """S5 get-or-create: the symbol dimension extended by every
    ``(symbol, asset_class)`` of ``requests`` it lacks.  New rows get
    ``symbol_group = symbol``, the request's expiry (earliest if several) and
    ids ``max(id) + 1, +2, ...`` in (symbol, asset_class) order.  Numbering
    counts the new keys by their first characters and orders them within those
    only, not in a global single-task window."""
    req = requests
    if "asset_class" not in req.columns:
        req = req.withColumn("asset_class", F.lit(default_asset_class))
    req = req.withColumn("asset_class", F.coalesce("asset_class", F.lit(default_asset_class)))
    exp = F.col("expiry") if "expiry" in req.columns else F.lit(None).cast("date")
    keys = req.select("symbol", "asset_class", exp.cast("date").alias("expiry")) \
              .groupBy("symbol", "asset_class").agg(F.min("expiry").alias("expiry"))
    new = keys.join(symbols.select("symbol", "asset_class"), ["symbol", "asset_class"], "left_anti")
    base = symbols.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    num = ordered.sequence(new.withColumn("_k", F.lit(0)), ["_k"], ["symbol", "asset_class"],
                           F.substring("symbol", 1, ID_PREFIX), rownum="_g")
    created = num.select((F.col("_g") + base).cast("long").alias("id"), "symbol",
                         F.col("symbol").alias("symbol_group"), "asset_class", "expiry")
    return symbols.select("id", "symbol", "symbol_group", "asset_class", "expiry") \
                  .unionByName(created)


def _with_symbol_id(batch: DataFrame, symbols: DataFrame, default_asset_class: str) -> DataFrame:
    b = batch
    if "asset_class" not in b.columns:
        b = b.withColumn("asset_class", F.lit(default_asset_class))
    b = b.withColumn("asset_class", F.coalesce("asset_class", F.lit(default_asset_class)))
    dim = symbols.select(F.col("id").alias("symbol_id"), "symbol", "asset_class")
    # several dimension rows may share (symbol, asset_class): the lookup takes the lowest id
    dim = dim.groupBy("symbol", "asset_class").agg(F.min("symbol_id").alias("symbol_id"))
    return b.join(dim, ["symbol", "asset_class"], "inner")


def _first_per_key(df: DataFrame, keys, seq, cols) -> DataFrame:
    """Within a batch the first row (by ``seq``) of a key wins."""
    order = [F.col(c).alias(f"_s{i}") for i, c in enumerate([seq] if isinstance(seq, str) else seq)]
    first = F.min(F.struct(*order, F.struct(*[F.col(c) for c in cols]).alias("_r"))).alias("_m")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col("_m")["_r"][c].alias(c) for c in cols])


def missing_rows(batch: DataFrame, existing: DataFrame, keys=("datetime", "symbol_id"),
                 dates_from: DataFrame | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``existing`` (left anti).

    When both sides carry the ``date`` partition column, the store is first
    bounded to the batch's date range (a scalar subquery in the partition
    filter, evaluated at run time), so an ingest batch reads only its own
    days of a store of any size.  Dynamic partition pruning does not apply
    to the build side of an anti join, hence the explicit bound.
    ``dates_from``: a cheaper frame with the same (or more) dates, e.g. the
    raw batch before de-duplication."""
    k = list(keys)
    ex = existing
    if "date" in batch.columns and "date" in existing.columns:
        if "date" not in k:
            k = [*k, "date"]                         # last: rows that are sorted by the keys stay so
        src = dates_from if dates_from is not None else batch
        r = src.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi")).alias("_r")) \
               .select("_r").scalar()
        ex = existing.filter(F.col("date").between(r["lo"], r["hi"]))
    return batch.join(ex.select(*k), k, "left_anti")


# --------------------------------------------------------------------- S3 / S4
def ingest_bars(batch: DataFrame, existing: DataFrame, symbols: DataFrame, seq,
                default_asset_class: str = "STK") -> DataFrame:
    """S3: rows to append to the bars store (insert-ignore semantics).

    Resolve ids (``symbols`` must already hold every key: see S5), volume to
    an integer (truncating), first row per ``(datetime, symbol_id)`` in the
    batch wins, keys already stored are skipped; never updates."""
    b = _with_symbol_id(batch, symbols, default_asset_class)
    b = b.withColumn("volume", F.col("volume").cast("double").cast("long"))
    for c in ("open", "high", "low", "close"):
        b = b.withColumn(c, F.col(c).cast("double"))
    seqs = [seq] if isinstance(seq, str) else list(seq)
    first = _first_per_key(b, ["datetime", "symbol_id"], seqs, list(BAR_VALUES))
    first = first.withColumn("date", F.to_date("datetime"))
    ex = existing.withColumn("date", F.to_date("datetime")) if "date" not in existing.columns else existing
    out = missing_rows(first, ex, dates_from=batch.select(F.to_date("datetime").alias("date")))
    return out.select("datetime", "symbol_id", *BAR_VALUES, "date")


def ingest_ticks(batch: DataFrame, existing: DataFrame, symbols: DataFrame, seq,
                 default_asset_class: str = "STK") -> DataFrame:
    """As S3 for ticks; falsy prices and sizes (0, NaN) are stored NULL."""
    b = batch
    for c in TICK_VALUES:
        if c in b.columns:
            b = b.withColumn(c, falsy_to_null(c))
    b = _with_symbol_id(b, symbols, default_asset_class)
    seqs = [seq] if isinstance(seq, str) else list(seq)
    first = _first_per_key(b, ["datetime", "symbol_id"], seqs, list(TICK_VALUES))
    first = first.withColumn("date", F.to_date("datetime"))
    ex = existing.withColumn("date", F.to_date("datetime")) if "date" not in existing.columns else existing
    return missing_rows(first, ex, dates_from=batch.select(F.to_date("datetime").alias("date"))) \
        .select("datetime", "symbol_id", *TICK_VALUES, "date")


def append_to_store(rows: DataFrame, path: str) -> None:
    """Write ingest output, prices as exact decimals: one commit per batch, partitioned by day, sorted
    within partitions for row-group skipping on (symbol_id, datetime).

    ``rebalance`` (not ``repartition``) groups rows by day but lets AQE split a
    day that holds a large share of the batch over several writer tasks and
    merge tiny ones, so one hot day never becomes one task."""
    at_rest = {f.name: f.dataType for f in (*schemas.BARS.fields, *schemas.TICKS.fields)}
    rows = rows.withColumns({c: F.col(c).cast(at_rest[c]) for c in rows.columns if c in at_rest})
    (rows.hint("rebalance", "date").sortWithinPartitions("date", "symbol_id", "datetime")
         .write.mode("append").partitionBy("date").parquet(path))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """A store for analytics: decimals as doubles, partitions pruned as usual."""
    df = spark.read.parquet(path)
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields
                           if isinstance(f.dataType, DecimalType)})


# --------------------------------------------------------------------- P8 / P9
def validate_bars(df: DataFrame, require_symbol: bool = True) -> DataFrame:
    """``is_valid`` and the first failing ``reason`` (NULL when valid).

    Order: missing field, non-numeric value, high < max(open, close),
    low > min(open, close), volume < 0."""
    req = (["symbol", "datetime"] if require_symbol else []) + list(BAR_VALUES)
    num = {c: as_double(df, c) for c in BAR_VALUES}
    reason = None
    for c in req:
        cond = F.col(c).isNull()
        reason = F.when(cond, F.lit(f"missing:{c}")) if reason is None else reason.when(cond, F.lit(f"missing:{c}"))
    not_num = F.lit(False)
    for c in BAR_VALUES:
        not_num = not_num | num[c].isNull()
    reason = reason.when(not_num, F.lit("not_numeric"))
    reason = reason.when(num["high"] < F.greatest(num["open"], num["close"]), F.lit("high_below_open_close"))
    reason = reason.when(num["low"] > F.least(num["open"], num["close"]), F.lit("low_above_open_close"))
    reason = reason.when(num["volume"] < 0, F.lit("negative_volume"))
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def validate_ticks(df: DataFrame, require_symbol: bool = True) -> DataFrame:
    """Bid <= ask when both present; sizes >= 0; prices >= 0; the store
    variant also requires symbol and datetime."""
    reason = F.when(F.lit(False), F.lit(None).cast("string"))
    if require_symbol:
        reason = reason.when(F.col("symbol").isNull(), F.lit("missing:symbol")) \
                       .when(F.col("datetime").isNull(), F.lit("missing:datetime"))
    cols = set(df.columns)
    if {"bid", "ask"} <= cols:
        reason = reason.when(F.col("bid").isNotNull() & F.col("ask").isNotNull()
                             & (F.col("bid") > F.col("ask")), F.lit("bid_above_ask"))
    for c in ("bidsize", "asksize", "lastsize"):
        if c in cols:
            reason = reason.when(F.col(c) < 0, F.lit(f"negative:{c}"))
    for c in ("bid", "ask", "last"):
        if c in cols:
            reason = reason.when(F.col(c) < 0, F.lit(f"negative:{c}"))
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


# --------------------------------------------------------------------- P10 / P11
def check_time_range(start, end=None, max_days: int = 365, now=None):
    """P10 argument check (driver side, constant work): returns naive-UTC
    (start, end); end defaults to ``now``; start < end and whole days <= max."""
    def parse(x):
        if isinstance(x, str):
            x = _dt.datetime.fromisoformat(x.replace("Z", "+00:00"))
        if isinstance(x, _dt.date) and not isinstance(x, _dt.datetime):
            x = _dt.datetime(x.year, x.month, x.day)
        if x.tzinfo is not None:
            x = x.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return x
    s = parse(start)
    e = parse(end) if end is not None else parse(now or _dt.datetime.now(_dt.timezone.utc))
    if s >= e:
        raise ValueError(f"empty range: {s} is not earlier than {e}")
    if max_days is not None and (e - s).days > max_days:
        raise ValueError(f"the range spans {(e - s).days} days; at most {max_days} may be asked for")
    return s, e


def time_range_filter(df: DataFrame, start, end=None, max_days: int | None = 365,
                      ts: str = "datetime", now=None) -> DataFrame:
    """P10: rows with start <= ts <= end (both inclusive); pushes down to the
    Parquet scan and prunes ``date`` partitions."""
    s, e = check_time_range(start, end, max_days, now)
    c = F.col(ts)
    out = df.filter(c.between(F.lit(s).cast("timestamp_ntz"), F.lit(e).cast("timestamp_ntz")))
    if "date" in df.columns:
        out = out.filter(F.col("date").between(F.lit(s.date()), F.lit(e.date())))
    return out


_PREP_COLS = {
    "bars": (("open", "high", "low", "close"), ("volume",)),
    "ticks": (("bid", "ask", "last"), ("bidsize", "asksize", "lastsize")),
    "greeks": (("price", "underlying", "dividend", "iv", "oi", "delta", "gamma", "theta", "vega"),
               ("volume",)),
}


def prepare_history(df: DataFrame, table_type: str = "bars", tz: str = "UTC",
                    ts: str = "datetime") -> DataFrame:
    """Typed, time-zoned, ordered history.  Prices to double and sizes
    to long (unparsable -> NULL), ``id``/``symbol_id`` dropped, times
    converted to ``tz`` (UTC when the zone is unknown), sorted by time."""
    if ts not in df.columns:
        raise ValueError(f"history needs the time column {ts!r}")
    prices, sizes = _PREP_COLS[table_type]
    out = df
    for c in prices:
        if c in out.columns:
            out = out.withColumn(c, as_double(out, c))
    for c in sizes:
        if c in out.columns:
            out = out.withColumn(c, as_double(out, c).cast("long"))
    if tz and tz.upper() != "UTC":
        try:
            import zoneinfo
            zoneinfo.ZoneInfo(tz)
            out = out.withColumn(ts, to_local(ts, tz))
        except Exception:  # unknown zone: stay in UTC
            pass
    out = out.drop(*[c for c in ("id", "symbol_id") if c in out.columns])
    sort = [ts] + (["symbol"] if "symbol" in out.columns else [])
    return out.orderBy(*sort)


# --------------------------------------------------------------------- J1 / J2 / J8
def symbol_list_semi_join(df: DataFrame, symbols, col: str = "symbol") -> DataFrame:
    """``symbol = ANY(list)``: ``isin`` for a short literal list, a left
    semi join for a DataFrame of symbols (AQE broadcasts it when small)."""
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select(F.col(symbols.columns[0]).alias(col)).distinct(), col, "left_semi")
    return df.filter(F.col(col).isin(list(symbols)))


def _history(store: DataFrame, symbols_dim: DataFrame, values, symbols, start, end,
             asset_class, max_days, order: bool) -> DataFrame:
    dim = symbols_dim.select(F.col("id").alias("symbol_id"), "symbol", "asset_class")
    if asset_class is not None:
        dim = dim.filter(F.col("asset_class") == asset_class)
    if symbols is not None:
        dim = symbol_list_semi_join(dim, symbols)
    rows = store
    if start is not None:
        rows = time_range_filter(rows, start, end, max_days)
    out = rows.join(dim, "symbol_id").select("symbol", "datetime", *values)
    return out.orderBy("symbol", "datetime") if order else out


def historical_bars(bars: DataFrame, symbols_dim: DataFrame, symbols=None, start=None,
                    end=None, asset_class: str | None = "STK", max_days: int | None = None,
                    order: bool = True, resolution: str | None = None, tz: str | None = None) -> DataFrame:
    """Bars joined to symbols, filtered by symbol list, asset class and
    inclusive time range (open-ended without ``end``), optionally resampled to
    ``resolution``, times shown in ``tz``; ordered by (symbol, datetime)."""
    out = _history(bars, symbols_dim, BAR_VALUES, symbols, start, end, asset_class, max_days, False)
    if resolution:
        from barsmith.operators.bars import resample
        out = resample(out, resolution, sync_last_timestamp=False, tz=tz).select("symbol", "datetime", *BAR_VALUES)
    elif tz and tz.upper() != "UTC":
        out = out.withColumn("datetime", to_local("datetime", tz))
    return out.orderBy("symbol", "datetime") if order else out


def historical_ticks(ticks: DataFrame, symbols_dim: DataFrame, symbols=None, start=None,
                     end=None, asset_class: str | None = "STK", max_days: int | None = None,
                     order: bool = True) -> DataFrame:
    """As J1 for ticks."""
    return _history(ticks, symbols_dim, TICK_VALUES, symbols, start, end, asset_class, max_days, order)


# --------------------------------------------------------------------- J4
def greeks_join(greeks: DataFrame, bars: DataFrame | None = None,
                ticks: DataFrame | None = None) -> DataFrame:
    """Greeks with their bar and/or tick through nullable foreign keys
    (left joins; NULL keys never match)."""
    out = greeks
    if bars is not None:
        b = bars.select(F.col("id").alias("bar_id"), *[F.col(c).alias(f"bar_{c}") for c in
                                                        ("datetime", "symbol_id", "close", "volume")])
        out = out.join(b, "bar_id", "left")
    if ticks is not None:
        t = ticks.select(F.col("id").alias("tick_id"), *[F.col(c).alias(f"tick_{c}") for c in
                                                          ("datetime", "symbol_id", "last")])
        out = out.join(t, "tick_id", "left")
    return out


# --------------------------------------------------------------------- T1 / T2
def _falsy_null_cols(cols):
    return {c: F.when(F.col(c) == 0, F.lit(None)).otherwise(F.col(c)) for c in cols}


def latest_rows(store: DataFrame, symbols_dim: DataFrame, values, prefix: str) -> DataFrame:
    values = list(values)
    packed = F.max_by(F.struct("datetime", *values), "datetime").alias("_r")
    last = store.groupBy("symbol_id").agg(packed)
    dim = symbols_dim.select(F.col("id").alias("symbol_id"), "symbol")
    return last.join(dim, "symbol_id").select(
        "symbol", F.col("_r.datetime").alias(f"{prefix}_datetime"),
        *[F.col(f"_r.{c}").alias(f"{prefix}_{c}") for c in values])


def latest_tick(ticks: DataFrame, symbols_dim: DataFrame) -> DataFrame:
    """Newest tick per symbol (all symbols in one job); zero prices NULL."""
    out = latest_rows(ticks, symbols_dim, TICK_VALUES, "tick")
    return out.withColumns(_falsy_null_cols(["tick_bid", "tick_ask", "tick_last"]))


def latest_bar(bars: DataFrame, symbols_dim: DataFrame) -> DataFrame:
    """Newest bar per symbol; zero prices NULL."""
    out = latest_rows(bars, symbols_dim, BAR_VALUES, "bar")
    return out.withColumns(_falsy_null_cols(["bar_open", "bar_high", "bar_low", "bar_close"]))


def realtime_snapshot(ticks: DataFrame, bars: DataFrame, symbols_dim: DataFrame) -> DataFrame:
    """T1 endpoint shape: per symbol, the latest tick and latest bar side by
    side (full outer on symbol: either may be missing)."""
    return latest_tick(ticks, symbols_dim).join(latest_bar(bars, symbols_dim), "symbol", "full")


def symbols_list(symbols_dim: DataFrame) -> DataFrame:
    """All symbols ordered by symbol, with the total count on each row."""
    n = symbols_dim.agg(F.count(F.lit(1))).scalar()
    return symbols_dim.select("id", "symbol", "symbol_group", "asset_class", "expiry",
                              n.alias("count")).orderBy("symbol")


# --------------------------------------------------------------------- A6 / A7 / A8
def symbol_statistics(bars: DataFrame, ticks: DataFrame, symbols_dim: DataFrame) -> DataFrame:
    """Per symbol bar count, min(open), max(high), min/max volume,
    earliest/latest bar; tick count and earliest/latest tick."""
    b = bars.groupBy("symbol_id").agg(
        F.count(F.lit(1)).alias("bars_count"), F.min("open").alias("min_price"),
        F.max("high").alias("max_price"), F.min("volume").alias("min_volume"),
        F.max("volume").alias("max_volume"), F.min("datetime").alias("earliest"),
        F.max("datetime").alias("latest"))
    t = ticks.groupBy("symbol_id").agg(
        F.count(F.lit(1)).alias("ticks_count"), F.min("datetime").alias("ticks_earliest"),
        F.max("datetime").alias("ticks_latest"))
    dim = symbols_dim.select(F.col("id").alias("symbol_id"), "symbol", "symbol_group", "asset_class")
    out = dim.join(b, "symbol_id", "left").join(t, "symbol_id", "left")
    return out.withColumns({"bars_count": F.coalesce("bars_count", F.lit(0)),
                            "ticks_count": F.coalesce("ticks_count", F.lit(0))})


def store_summary(symbols_dim: DataFrame, bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """One row: total symbols, bars, ticks, earliest and latest bar."""
    b = bars.agg(F.count(F.lit(1)).alias("total_bars"), F.min("datetime").alias("earliest_bar"),
                 F.max("datetime").alias("latest_bar"))
    n_sym = symbols_dim.agg(F.count(F.lit(1))).scalar()
    n_ticks = ticks.agg(F.count(F.lit(1))).scalar()
    return b.select(n_sym.alias("total_symbols"), "total_bars", n_ticks.alias("total_ticks"),
                    "earliest_bar", "latest_bar")


def quality_report(bars: DataFrame, ticks: DataFrame) -> DataFrame:
    """Bar quality in one pass: invalid = high<open or high<close or
    low>open or low>close or volume<0 (NULL comparisons do not count);
    status good / issues_found.  Ticks: total, plus P9 failures."""
    bad = (F.col("high") < F.col("open")) | (F.col("high") < F.col("close")) | \
          (F.col("low") > F.col("open")) | (F.col("low") > F.col("close")) | (F.col("volume") < 0)
    b = bars.agg(F.count(F.lit(1)).alias("total_bars"),
                 F.count_if(F.coalesce(bad, F.lit(False))).alias("invalid_bars"))
    tv = validate_ticks(ticks, require_symbol=False)
    t = tv.agg(F.count(F.lit(1)).alias("total_ticks"),
               F.count_if(~F.col("is_valid")).alias("ticks_failing_checks"))
    tt = t.select("total_ticks").scalar()
    tf = t.select("ticks_failing_checks").scalar()
    return b.select(
        F.when(F.col("invalid_bars") == 0, "good").otherwise("issues_found").alias("overall_status"),
        "total_bars", (F.col("total_bars") - F.col("invalid_bars")).alias("valid_bars"),
        "invalid_bars", tt.alias("total_ticks"), tt.alias("valid_ticks"),
        F.lit(0).cast("long").alias("invalid_ticks"), tf.alias("ticks_failing_checks"))


# --------------------------------------------------------------------- S10
def records_json(df: DataFrame, ts: str = "datetime", fmt: str = "yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    """One JSON record per row, time as ISO text."""
    cols = [F.date_format(ts, fmt).alias(ts) if c == ts else F.col(c) for c in df.columns]
    return df.select(*[c for c in df.columns if c != ts and c in ("symbol",)],
                     F.to_json(F.struct(*cols)).alias("record"))


def history_envelope(df: DataFrame, resolution: str, ts: str = "datetime",
                     fmt: str = "yyyy-MM-dd'T'HH:mm:ss", requested: DataFrame | None = None) -> DataFrame:
    """S10 response header per symbol: {status, message, symbol, start, end,
    resolution, count}; ``requested`` symbols without rows get status ``error``.  The data rows themselves are :func:`records_json` (one record
    per row, never gathered into one array)."""
    out = df.groupBy("symbol").agg(
        F.date_format(F.min(ts), fmt).alias("start"), F.date_format(F.max(ts), fmt).alias("end"),
        F.lit(resolution).alias("resolution"), F.count(F.lit(1)).alias("count"))
    if requested is not None:
        out = requested.select("symbol").distinct().join(out, "symbol", "left")
    return out.withColumns({
        "resolution": F.coalesce("resolution", F.lit(resolution)), "count": F.coalesce("count", F.lit(0)).cast("long"),
        "status": F.when(F.col("start").isNull(), "error").otherwise("success"),
        "message": F.when(F.col("start").isNull(), F.concat(F.lit("no rows for "), F.col("symbol")))})
