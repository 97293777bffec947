"""Bar building and per-instrument series operators.

A1 resample_ticks_time, A2 resample_bars_time, A3 resample_tick_count,
A4 resample_volume, A5 ticks_to_bars, A12 symbol_metadata, U3
dedupe_per_instrument, U4 sync_time_range, W1 lag_matrix, W5 forward_fill,
W13 recent_window, plus :func:`resample`, the dispatcher that chains them the
way the original ``resample`` call does.

Shape of every plan: one hash aggregation keyed by ``(symbol, bucket)`` with
map-side partial aggregation (a hot symbol spreads over its buckets), small
per-symbol side tables joined back (AQE broadcasts them after measuring), and
ordered scans through :mod:`barsmith.operators.ordered` (never one task per
symbol).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.scalars import asset_class as _asset_class
from barsmith.functions.scalars import symbol_group as _symbol_group
from barsmith.functions.timeutil import Resolution, bucket_start, parse_resolution, to_local
from barsmith.operators import ordered

# The ten option columns carried by ticks and bars.
OPT_COLUMNS = ("opt_price", "opt_underlying", "opt_dividend", "opt_volume",
               "opt_iv", "opt_oi", "opt_delta", "opt_gamma", "opt_theta",
               "opt_vega")
META = ("symbol_group", "asset_class")


def _order(df: DataFrame, ts: str, seq) -> list[str]:
    o = [ts]
    if seq:
        o += [seq] if isinstance(seq, str) else list(seq)
    return o


def _okey(order) -> Column:
    """Ordering key for first/last: the column itself when the order has one
    column (a fixed-width key lets numeric first/last use hash aggregation),
    else a struct compared field by field."""
    if len(order) == 1:
        return F.col(order[0])
    return F.struct(*[F.col(o) for o in order])


def first_nn(c: str, order) -> Column:
    """First non-null value of ``c`` in ``order`` (aggregate)."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), _okey(order)))


def last_nn(c: str, order) -> Column:
    """Last non-null value of ``c`` in ``order`` (aggregate)."""
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), _okey(order)))


def _present_opt(df: DataFrame) -> list[str]:
    return [c for c in OPT_COLUMNS if c in df.columns]


def _is_option_symbol(sym: Column) -> Column:
    return F.substring(sym, -3, 3).isin("OPT", "FOP")


def _drop_incomplete(df: DataFrame, required, all_cols) -> DataFrame:
    """dropna on OHLCV, and for OPT/FOP symbols on every column."""
    req = F.lit(True)
    for c in required:
        req = req & F.col(c).isNotNull()
    full = F.lit(True)
    for c in all_cols:
        full = full & F.col(c).isNotNull()
    return df.filter(req & (~_is_option_symbol(F.col("symbol")) | full))


# --------------------------------------------------------------------- A12
def symbol_metadata(df: DataFrame, ts: str = "datetime", seq=None,
                    cols=META) -> DataFrame:
    """Last non-null ``symbol_group``/``asset_class`` per symbol."""
    order = _order(df, ts, seq)
    return df.groupBy("symbol").agg(*[last_nn(c, order).alias(c) for c in cols])


def with_meta_columns(df: DataFrame) -> DataFrame:
    """Derive symbol_group/asset_class from the symbol name when absent."""
    out = df
    if "symbol_group" not in df.columns:
        out = out.withColumn("symbol_group", _symbol_group("symbol"))
    if "asset_class" not in df.columns:
        out = out.withColumn("asset_class", _asset_class("symbol"))
    return out


# --------------------------------------------------------------------- U3
def dedupe_per_instrument(df: DataFrame, keep: str = "last", ts: str = "datetime",
                          seq=None, keys=("symbol", "symbol_group", "asset_class")) -> DataFrame:
    """One row per (datetime, symbol, symbol_group, asset_class).

    The survivor is chosen by the explicit sequence ``seq`` (first or last),
    never by shuffle order.  Implemented as an aggregation (partial on the map
    side), not a window, so duplicate-heavy keys do not sort in one task."""
    cols = df.columns
    k = [ts, *keys]
    rest = [c for c in cols if c not in k]
    if not rest:
        return df.select(*k).distinct()
    if not seq:
        okey = F.struct(*[F.col(c) for c in rest])
    else:
        okey = _okey([seq] if isinstance(seq, str) else seq)
    pick = F.min_by if keep == "first" else F.max_by
    packed = pick(F.struct(*[F.col(c) for c in rest]), okey).alias("_r")
    return df.groupBy(*k).agg(packed).select(*k, *[F.col("_r")[c].alias(c) for c in rest]) \
             .select(*cols)


# --------------------------------------------------------------------- U4
def sync_time_range(df: DataFrame, ts: str = "datetime", key: str = "symbol") -> DataFrame:
    """U4: trim all symbols to their common time range.

    end = min over symbols of their last time, start = max of first times;
    rows after ``end`` always go; rows before ``start`` go only if something
    is left (i.e. start <= end).  The bounds are scalar subqueries over a
    per-symbol aggregate: no join, no driver round trip."""
    rng = df.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi")) \
            .agg(F.struct(F.max("_lo").alias("s"), F.min("_hi").alias("e")).alias("_r"))
    r = rng.select("_r").scalar()          # one subquery, evaluated once
    start, end = r["s"], r["e"]
    c = F.col(ts)
    return df.filter((c <= end) & ((start > end) | (c >= start)))


# --------------------------------------------------------------------- A1
def _bucket(df: DataFrame, ts: str, res: Resolution, keys=("symbol",)) -> DataFrame:
    """Add ``_bucket``.  Buckets whose size does not divide a day start at
    midnight of each key's first day (pandas 'start_day' origin); that needs
    a per-key minimum joined back (one row per key)."""
    if (res.unit in ("W", "M") and res.n == 1) or res.day_aligned:
        return df.withColumn("_bucket", bucket_start(ts, res))
    origin = df.groupBy(*keys).agg(F.to_date(F.min(ts)).cast("timestamp_ntz").alias("_origin"))
    return df.join(origin, list(keys)).withColumn(
        "_bucket", bucket_start(ts, res, F.col("_origin"))).drop("_origin")


def resample_ticks_time(df: DataFrame, resolution: str = "1T", ts: str = "datetime",
                        seq=None, tz: str | None = None,
                        price: str = "last", size: str = "lastsize",
                        meta: DataFrame | None = None) -> DataFrame:
    """A1: time bars from ticks, per symbol.

    open/high/low/close over non-null ``price``; volume = sum of ``size`` over
    every tick in the bucket; each present ``opt_*`` = last non-null.
    Buckets without a price are dropped; OPT/FOP symbols drop rows with any
    null.  symbol_group/asset_class = last seen for the symbol.  Buckets are
    those of the data's own (UTC) times; their labels are shown in ``tz``, so
    the hour that a clock change repeats stays two hours."""
    res = parse_resolution(resolution)
    if res.kind != "time":
        raise ValueError("resample_ticks_time needs a time resolution")
    d = with_meta_columns(df)
    order = _order(d, ts, seq)
    opts = _present_opt(d)
    d = _bucket(d, ts, res)
    bars = d.groupBy("symbol", "_bucket").agg(
        first_nn(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        last_nn(price, order).alias("close"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("volume"),
        *[last_nn(c, order).alias(c) for c in opts])
    # metadata: a separate pass over (symbol, time, group, class) only, partially
    # aggregated per symbol on the map side -- cheaper than widening the bar shuffle
    if meta is None:
        meta = symbol_metadata(d, ts, seq)
    label = to_local("_bucket", tz) if tz else F.col("_bucket")
    out = bars.join(meta, "symbol").select(
        label.alias(ts), "symbol", *META,
        "open", "high", "low", "close", "volume", *opts)
    return _drop_incomplete(out, ["open", "high", "low", "close", "volume"], out.columns)


# --------------------------------------------------------------------- A2
def _dense_count(res: Resolution, lo: Column, hi: Column) -> Column:
    if res.unit == "W":
        return F.datediff(hi, lo) / (7 * res.n) + 1
    if res.unit == "M":
        return F.round(F.months_between(F.trunc(hi, "MM"), F.trunc(lo, "MM"))).cast("long") / res.n + 1
    us = res.seconds * 1_000_000
    return (F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp"))) / us + 1


def _prev_bucket(res: Resolution, b: Column) -> Column:
    if res.unit == "W":
        return F.date_sub(F.to_date(b), 7 * res.n).cast("timestamp_ntz")
    if res.unit == "M":
        return F.last_day(F.add_months(F.to_date(b), -res.n)).cast("timestamp_ntz")
    return b - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(res.seconds))


def _grid(ranges: DataFrame, res: Resolution, carry=()) -> DataFrame:
    """All bucket starts between ``_lo`` and ``_hi`` (inclusive, on the
    bucket grid) per row, carrying ``carry`` columns along.

    Sub-day sizes explode in two levels (days, then buckets of each day) so
    no single row materialises a long gap's worth of buckets at once."""
    carry = list(carry)
    if res.unit == "W":
        return ranges.select("symbol", *carry, F.explode(F.sequence(
            F.to_date("_lo"), F.to_date("_hi"), F.expr(f"INTERVAL {7 * res.n} DAYS")))
            .cast("timestamp_ntz").alias("_bucket"))
    if res.unit == "M":
        months = F.sequence(F.trunc(F.to_date("_lo"), "MM"), F.trunc(F.to_date("_hi"), "MM"),
                            F.expr(f"INTERVAL {res.n} MONTH"))
        return ranges.select("symbol", *carry, F.explode(months).alias("_m")) \
                     .select("symbol", *carry, F.last_day("_m").cast("timestamp_ntz").alias("_bucket"))
    sec = res.seconds
    if sec >= 86400:
        step = F.expr(f"INTERVAL {sec} SECONDS")
        return ranges.select("symbol", *carry, F.explode(F.sequence("_lo", "_hi", step)).alias("_bucket"))
    days = ranges.select("symbol", *carry, "_lo", "_hi", F.explode(F.sequence(
        F.to_date("_lo"), F.to_date("_hi"))).alias("_day"))
    us = sec * 1_000_000
    lo_us = F.unix_micros(F.col("_lo").cast("timestamp"))
    day_us = F.unix_micros(F.col("_day").cast("timestamp"))
    first = F.greatest(lo_us, lo_us + F.ceil((day_us - lo_us) / us) * us)
    last = F.least(F.unix_micros(F.col("_hi").cast("timestamp")),
                   day_us + F.lit(86400 * 1_000_000 - 1))
    return days.repartition("symbol", "_day").select(
        "symbol", *carry, F.explode(F.sequence(first, last, F.lit(us))).alias("_b")) \
        .select("symbol", *carry, F.timestamp_micros("_b").cast("timestamp_ntz").alias("_bucket"))


def resample_bars_time(df: DataFrame, resolution: str = "1T", ts: str = "datetime",
                       seq=None, ffill: bool = True, dropna: bool = False) -> DataFrame:
    """A2: bars to coarser (or finer) bars per symbol.

    open first, high max, low min, close last, volume sum, opt_* last.  Only
    symbols whose bucket span exceeds their input row count (upsampling) are
    gap-filled: empty buckets get volume 0 and carry the previous values; then
    rows with volume <= 0 get O=H=L=close (``ffill``) or are dropped.
    Elsewhere empty buckets are simply absent."""
    res = parse_resolution(resolution)
    if res.kind != "time":
        raise ValueError("resample_bars_time needs a time resolution")
    d = with_meta_columns(df)
    order = _order(d, ts, seq)
    opts = _present_opt(d)
    d = _bucket(d, ts, res)
    vals = ["open", "high", "low", "close", "volume", *opts]
    agg = d.groupBy("symbol", "_bucket").agg(
        first_nn("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        last_nn("close", order).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0)).cast("long").alias("volume"),
        *[last_nn(c, order).alias(c) for c in opts],
        F.count(F.lit(1)).alias("_n"), *[last_nn(c, order).alias(c) for c in META])
    # written once, so that the input is read and shuffled once; per-symbol counts
    # and metadata follow from the buckets, which rise with the time
    agg = ordered.kept(agg)
    rises = F.col("_bucket") if len(order) == 1 else F.struct("_bucket")
    stats = agg.groupBy("symbol").agg(
        F.sum("_n").alias("_n"), F.min("_bucket").alias("_lo"), F.max("_bucket").alias("_hi"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rises)).alias(c) for c in META]) \
        .withColumn("_fill", _dense_count(res, F.col("_lo"), F.col("_hi")) > F.col("_n")) \
        .drop("_n", "_lo", "_hi")
    agg = agg.drop("_n", *META).join(stats, "symbol")
    if not ffill:
        # nothing is filled: empty buckets of upsampled symbols just go
        out = agg.filter(~F.col("_fill") | (F.col("volume") > 0)) \
                 .select(F.col("_bucket").alias(ts), "symbol", *META, *vals)
        if dropna:
            out = out.dropna()
        return _drop_incomplete(out, ["open", "high", "low", "close", "volume"], out.columns)
    plain = agg.filter(~F.col("_fill"))

    # Gap fill without a dense grid join: forward-fill the real buckets of the
    # symbols that need it and find each one's next real bucket (one two-phase
    # pass over the bucket aggregate); the empty buckets between two real ones
    # are then generated from the earlier one, carrying its filled values and the
    # metadata, so that the dense rows are not shuffled.
    fa = agg.filter("_fill").drop("_fill")
    chunk = F.trunc(F.to_date("_bucket"), "MM") if (res.seconds or 86400) >= 86400 \
        else F.to_date("_bucket")
    ff_cols = [c for c in vals if c != "volume"]
    s = ordered.sequence(fa, ["symbol"], ["_bucket"], chunk, rownum=None,
                         ffill={c: f"_ff_{c}" for c in ff_cols},
                         nxt={"_bucket": "_nb"})
    # one explode per real bucket over [bucket, next real bucket): the first
    # element is the real row, the rest are its gap rows (volume 0, all
    # prices = the carried close)
    rng = s.select("symbol", *META, F.col("_bucket").alias("_rb"), F.col("volume").alias("_vol"),
                   *[F.col(f"_ff_{c}").alias(f"_v_{c}") for c in ff_cols],
                   F.col("_bucket").alias("_lo"),
                   F.coalesce(_prev_bucket(res, F.col("_nb")), F.col("_bucket")).alias("_hi"))
    grid = _grid(rng, res, [*META, "_rb", "_vol", *[f"_v_{c}" for c in ff_cols]])
    real = F.col("_bucket") == F.col("_rb")
    flat = ~real | (F.col("_vol") <= 0)
    g = grid.select(
        "symbol", "_bucket", *META,
        F.when(real, F.col("_vol")).otherwise(F.lit(0)).cast("long").alias("volume"),
        *[(F.when(flat, F.col("_v_close")).otherwise(F.col(f"_v_{c}"))
           if c in ("open", "high", "low") else F.col(f"_v_{c}")).alias(c) for c in ff_cols])
    cols = [F.col("_bucket").alias(ts), "symbol", *META, *vals]
    out = plain.select(*cols).unionByName(g.select(*cols))
    if dropna:
        out = out.dropna()
    return _drop_incomplete(out, ["open", "high", "low", "close", "volume"], out.columns)


# --------------------------------------------------------------------- A3 / A4
def _count_bars(d: DataFrame, ts: str, order, grp: Column, price: str, size: str,
                vol_src: str, opts) -> DataFrame:
    bars = d.withColumn("_grp", grp).groupBy("symbol", "_grp").agg(
        F.min(ts).alias(ts),
        first_nn("_fp", order).alias("open"),
        F.max("_fp").alias("high"),
        F.min("_fp").alias("low"),
        last_nn("_fp", order).alias("close"),
        F.coalesce(F.sum(vol_src), F.lit(0)).cast("long").alias("volume"),
        *[last_nn(f"_ff_{c}", order).alias(c) for c in opts])
    return bars


def _last_at_each_time(bars: DataFrame, ts: str) -> DataFrame:
    """Of a symbol's bars that begin at one time the last one stays."""
    rest = [c for c in bars.columns if c not in ("symbol", ts)]
    return bars.groupBy("symbol", ts).agg(F.max_by(F.struct(*rest), "_grp").alias("_r")).select("symbol", ts, "_r.*")


def _tick_frame(df: DataFrame, price: str | None, size: str | None):
    if price is None:
        price = "last" if "last" in df.columns else "close"
    if size is None:
        size = "lastsize" if "lastsize" in df.columns else "volume"
    return price, size


def resample_tick_count(df: DataFrame, n: int, ts: str = "datetime", seq=None,
                        price: str | None = None, size: str | None = None,
                        fill_size: bool = True, meta: DataFrame | None = None,
                        keep_last: bool = False) -> DataFrame:
    """A3: N-tick bars per symbol.

    Values are forward-filled within the symbol first; group = (row-1) div N
    in time order; bar time = first tick's time; trailing partial bar kept;
    N <= 1 returns the input."""
    if n <= 1:
        return df
    d = with_meta_columns(df)
    price, size = _tick_frame(d, price, size)
    order = _order(d, ts, seq)
    opts = _present_opt(d)
    ff = {price: "_fp", size: "_fs", **{c: f"_ff_{c}" for c in opts}}
    s = ordered.sequence(d, ["symbol"], order, rownum="_g", ffill=ff)
    grp = F.floor((F.col("_g") - 1) / F.lit(n))
    bars = _count_bars(s, ts, order, grp, price, size, "_fs" if fill_size else size, opts)
    if keep_last:
        bars = _last_at_each_time(bars, ts)
    if meta is None:
        meta = symbol_metadata(d, ts, seq)
    out = bars.join(meta, "symbol").select(
        ts, "symbol", *META, "open", "high", "low", "close", "volume", *opts)
    return _drop_incomplete(out, ["open", "high", "low", "close", "volume"], out.columns)


def resample_volume(df: DataFrame, n: int, ts: str = "datetime", seq=None,
                    price: str | None = None, size: str | None = None,
                    fill_size: bool = True, meta: DataFrame | None = None,
                        keep_last: bool = False) -> DataFrame:
    """A4: N-volume bars per symbol.

    cumvol = running sum of size; mark = N * round_half_even(round(cumvol, 1) / N);
    a new bar starts whenever the mark moves; bar id = mark / N, except that
    rows sharing the first row's mark form bar 0.  Bars therefore cut at the
    nearest multiple of N.  ``fill_size`` sums forward-filled sizes (the
    original's volume), False sums raw sizes."""
    if n <= 1:
        return df
    d = with_meta_columns(df)
    price, size = _tick_frame(d, price, size)
    order = _order(d, ts, seq)
    opts = _present_opt(d)
    ff = {price: "_fp", size: "_fs", **{c: f"_ff_{c}" for c in opts}}
    s = ordered.sequence(d, ["symbol"], order, rownum=None, sums={size: "_cum"}, ffill=ff)
    mark = F.bround(F.bround(F.col("_cum").cast("double"), 1) / F.lit(float(n)), 0) * F.lit(n)
    s = s.withColumn("_mark", mark)
    # the first row's mark: its running sum is its own size
    size0 = d.groupBy("symbol").agg(F.min_by(F.coalesce(F.col(size), F.lit(0)), _okey(order)).alias("_cum0"))
    first = size0.select("symbol", (F.bround(F.bround(F.col("_cum0").cast("double"), 1) / F.lit(float(n)), 0)
                                    * F.lit(n)).alias("_mark0"))
    s = s.join(first, "symbol")
    grp = F.when(F.col("_mark") == F.col("_mark0"), F.lit(0.0)).otherwise(F.col("_mark") / F.lit(n))
    bars = _count_bars(s, ts, order, grp, price, size, "_fs" if fill_size else size, opts)
    if keep_last:
        bars = _last_at_each_time(bars, ts)
    if meta is None:
        meta = symbol_metadata(d, ts, seq)
    out = bars.join(meta, "symbol").select(
        ts, "symbol", *META, "open", "high", "low", "close", "volume", *opts)
    return _drop_incomplete(out, ["open", "high", "low", "close", "volume"], out.columns)


# --------------------------------------------------------------------- A5
def ticks_to_bars(df: DataFrame, resolution: str = "1T", keys=("symbol",),
                  ts: str = "datetime", seq=None, price: str = "last",
                  size: str = "lastsize") -> DataFrame:
    """A5: simple OHLCV bars: drop ticks without a price, fixed-length buckets
    (``1W`` = 7 x 24 h from the first day), empty buckets dropped.  ``1M`` is
    rejected (a month has no fixed length).  ``keys`` may be empty."""
    res = parse_resolution(resolution)
    if res.kind != "time" or res.unit == "M":
        raise ValueError(f"resolution {resolution!r} has no fixed duration")
    if res.unit == "W":
        res = Resolution("time", 7 * res.n, "D")
    if price not in df.columns:
        raise ValueError("tick data must contain a price column")
    keys = list(keys)
    order = _order(df, ts, seq)
    d = df.filter(F.col(price).isNotNull())
    if res.day_aligned:
        d = d.withColumn("_bucket", bucket_start(ts, res))
    elif keys:
        d = _bucket(d, ts, res, keys)
    else:
        o = d.agg(F.to_date(F.min(ts)).cast("timestamp_ntz")).scalar()
        d = d.withColumn("_bucket", bucket_start(ts, res, o))
    out = d.groupBy(*keys, "_bucket").agg(
        first_nn(price, order).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), last_nn(price, order).alias("close"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("volume"))
    return out.select(*keys, F.col("_bucket").alias(ts), "open", "high", "low", "close", "volume")


# --------------------------------------------------------------------- dispatcher
def resample(df: DataFrame, resolution: str = "1T", ts: str = "datetime", seq=None,
             tz: str | None = None, ffill: bool = True, dropna: bool = False,
             sync_last_timestamp: bool = True, dedupe: bool = True) -> DataFrame:
    """The whole ``resample`` call: range sync (+ keep-first de-duplication),
    then tick-count / volume / time bars, then keep-last de-duplication.
    Ticks are recognised by a ``last`` column.  ``dedupe=False`` skips the
    de-duplication shuffle for inputs whose (datetime, symbol) is known to be
    unique (e.g. read from the ingest store, which enforces it)."""
    d = with_meta_columns(df)
    meta = None
    if sync_last_timestamp:
        d = sync_time_range(d, ts)
        # exact duplicates share group and class, so the metadata of the synced
        # rows equals that of the de-duplicated ones: no second dedupe shuffle
        meta = symbol_metadata(d, ts, seq)
        if dedupe:
            d = dedupe_per_instrument(d, keep="first", ts=ts, seq=seq)
    res = parse_resolution(resolution)
    if res.kind == "time" and "last" in d.columns:
        return resample_ticks_time(d, resolution, ts, seq, tz, meta=meta)
    # time bars are unique by bucket; several count bars can begin at one time
    if res.kind == "ticks":
        out = resample_tick_count(d, res.n, ts, seq, meta=meta, keep_last=True)
    elif res.kind == "volume":
        out = resample_volume(d, res.n, ts, seq, meta=meta, keep_last=True)
    else:
        out = resample_bars_time(d, resolution, ts, seq, ffill, dropna)
    # times are shown in ``tz``, converted at the end
    return out.withColumn(ts, to_local(ts, tz)) if tz else out


# --------------------------------------------------------------------- F10
def regularize_index(df: DataFrame, freq: str, ts: str = "datetime", tz: str | None = None,
                     seq=None) -> DataFrame:
    """bars with text times.  Times carrying an offset are parsed and
    converted; naive ones are bucketed onto the regular ``freq`` grid
    without fill (A2 with ``ffill=False``: empty or zero-volume buckets
    vanish), then moved to ``tz``."""
    from barsmith.functions.timeutil import parse_utc
    d = df.withColumn(ts, parse_utc(F.col(ts)))
    out = resample_bars_time(d, freq, ts, seq, ffill=False)
    if tz:
        out = out.withColumn(ts, to_local(ts, tz))
    return out


# --------------------------------------------------------------------- W5 / W1 / W13
def forward_fill(df: DataFrame, cols, keys=("symbol",), order=("datetime",),
                 chunk: Column | None = None) -> DataFrame:
    """Carry the last non-null value down in ``order`` per key."""
    cols = list(cols)
    s = ordered.sequence(df, list(keys), list(order), chunk, rownum=None,
                         ffill={c: f"_ffw_{c}" for c in cols})
    return s.withColumns({c: F.col(f"_ffw_{c}") for c in cols}).drop(*[f"_ffw_{c}" for c in cols])


def lag_matrix(df: DataFrame, cols, window: int, keys=("symbol",),
               order=("datetime",)) -> DataFrame:
    """Beside each row, the values 1..window-1 rows back: ``c1, c2, ...``."""
    cols = list(cols)
    keys = list(keys)
    s = ordered.sequence(df, keys, list(order), rownum="_g")
    b = ordered.halo_blocks(s, "_g", max(window - 1, 0))
    w = Window.partitionBy(*keys, "_blk").orderBy("_g")
    lags = {f"{c}{i}": F.lag(c, i).over(w) for c in cols for i in range(1, window)}
    return b.withColumns(lags).filter(~F.col("_halo")).drop("_blk", "_halo", "_g")


def recent_window(df: DataFrame, n: int, keys=("symbol",), order=("datetime",)) -> DataFrame:
    """The last ``n`` rows per key (tick window 1000, bar window 100).

    Counts per (key, time slice) find the slices that can hold them; only
    their rows are shuffled and ordered."""
    keys, order = list(keys), list(order)
    d = df.withColumn("_chunk", ordered.seconds_chunk(order[0], ordered.CHUNK_SECONDS))
    later = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    need = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_c")) \
            .withColumn("_after", F.coalesce(F.sum("_c").over(later), F.lit(0))) \
            .filter(F.col("_after") < n).select(*keys, "_chunk")
    last = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return d.join(need, [*keys, "_chunk"], "left_semi").withColumn("_r", F.row_number().over(last)) \
            .filter(F.col("_r") <= n).drop("_r", "_chunk")
