"""Futures: continuous contracts, roll calendar, active contract, specs.

A11 daily_last, W2 daily_close_diff, W6 roll_calendar, W7 roll_gap,
J5 asof_contract_flags, J6 volume_crossover, W8 continuous_contract,
T3 active_contract, P15 clean_futures_specs, J9 futures_spec_lookup,
J10 resolve_contracts, S11 product_catalog / settlement_url,
A17 futures_catalog_counts.

Plan shape: tick-level data is touched twice — once by the daily
aggregation (hash aggregate keyed by (root, symbol, day), partial on the map
side) and once by the final equi-join on (root, day) to the dense daily flag
table.  Everything in between runs on *daily* tables whose size is bounded by
calendar days x listed contracts, never by tick volume; windows partitioned
by root are therefore over a few thousand rows at most.  No inequality join
touches tick rows.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators import ordered

from barsmith.functions.calendar import after_third_friday
from barsmith.functions.scalars import parse_contract_month, parse_thousands

UNB = Window.unboundedPreceding
UNF = Window.unboundedFollowing


# --------------------------------------------------------------------- A11 / W2
def daily_last(df: DataFrame, keys=("root", "symbol"), ts: str = "datetime",
               seq=None, cols=None) -> DataFrame:
    """Per key and day, the last non-null value of every column (days
    where everything is null are dropped)."""
    keys = list(keys)
    order = [ts] + ([seq] if isinstance(seq, str) else list(seq or []))
    okey = F.struct(*[F.col(o) for o in order])
    cols = [c for c in (cols or df.columns) if c not in keys and c != ts]
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(c) for c in cols]
    out = df.groupBy(*keys, F.to_date(ts).alias("date")).agg(*aggs)
    any_nn = F.lit(False)
    for c in cols:
        any_nn = any_nn | F.col(c).isNotNull()
    return out.filter(any_nn)


def daily_close_diff(daily: DataFrame, price: str = "last", key: str = "root") -> DataFrame:
    """Difference to the previous daily row of the same root, rows
    ordered by (date, expiry, symbol) — all contracts interleaved, so the
    second row of a day carries the same-day spread."""
    w = Window.partitionBy(key).orderBy("date", "expiry", "symbol")
    return daily.withColumn("diff", F.col(price) - F.lag(price).over(w))


# --------------------------------------------------------------------- W6
def roll_calendar(daily: DataFrame, key: str = "root") -> DataFrame:
    """The day range each contract owns, per root.

    Expiries E1 < E2 < ... ; contract k owns (start_k, E_k], the first from
    the beginning, the last without an upper bound; start_k is the expiry of
    the latest earlier contract that had rows after its own start (a contract
    with no rows in its slot leaves the previous roll date standing).  The
    sequential rule is a fold (``aggregate``) over the handful of contracts of
    a root.  Output: root, expiry, start (NULL = open), end (NULL = open),
    present."""
    c = daily.filter(F.col("expiry").isNotNull()).groupBy(key, "expiry") \
             .agg(F.max("date").alias("max_day"))
    lists = c.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("expiry", "max_day"))).alias("cs"))
    item_t = "struct<expiry:date,start:date,present:boolean>"
    init = F.struct(F.lit(None).cast("date").alias("roll"),
                    F.array().cast(f"array<{item_t}>").alias("out"))

    def step(acc, x):
        first = F.size(acc["out"]) == 0
        start = F.when(first, F.lit(None).cast("date")).otherwise(acc["roll"])
        present = first | (x["max_day"] > acc["roll"])
        roll = F.when(present, x["expiry"]).otherwise(acc["roll"])
        item = F.struct(x["expiry"].alias("expiry"), start.alias("start"), present.alias("present"))
        return F.struct(roll.alias("roll"), F.concat(acc["out"], F.array(item)).alias("out"))

    folded = lists.select(key, F.aggregate("cs", init, step)["out"].alias("out"))
    ex = folded.select(key, F.posexplode("out").alias("pos", "c"), F.size("out").alias("n"))
    return ex.select(key, F.col("c.expiry").alias("expiry"), F.col("c.start").alias("start_day"),
                     F.when(F.col("pos") == F.col("n") - 1, F.lit(None).cast("date"))
                      .otherwise(F.col("c.expiry")).alias("end_day"),
                     F.col("c.present").alias("present"))


def contract_flags(daily: DataFrame, calendar: DataFrame, key: str = "root") -> DataFrame:
    """Daily rows inside their contract's owned range: one flag row per day."""
    j = daily.join(calendar.select(key, "expiry", "start_day", "end_day"), [key, "expiry"])
    inside = (F.col("start_day").isNull() | (F.col("date") > F.col("start_day"))) & \
             (F.col("end_day").isNull() | (F.col("date") <= F.col("end_day")))
    return j.filter(inside).drop("start_day", "end_day")


# --------------------------------------------------------------------- W7
def roll_gap(daily_diff: DataFrame, flags: DataFrame, key: str = "root",
             mode: str = "last", rolls: DataFrame | None = None) -> DataFrame:
    """The price gap applied to each flag row.  ``rolls`` (root, date): the
    days E if they are not the expiries.

    For every expiry E: the new contract is the one flagged on the first flag
    day after E; gap_E = that contract's daily ``diff`` on day E (skipped
    when it has no row that day).  ``mode='last'``: every flag row dated on
    or before the last such E carries gap_E of that last E (later rolls
    overwrite earlier ones); ``'cumulative'``: sum of gap_E over the rolls
    E >= the row's date.  Rows after the last roll get 0."""
    exps = rolls if rolls is not None else \
        daily_diff.filter(F.col("expiry").isNotNull()).select(key, F.col("expiry").alias("date")).distinct()
    marks = exps.select(key, "date", F.lit(None).cast(flags.schema["expiry"].dataType).alias("fexp"), F.lit(1).alias("_m"))
    fl = flags.select(key, "date", F.col("expiry").alias("fexp"), F.lit(0).alias("_m"))
    w = Window.partitionBy(key).orderBy("date", "_m").rowsBetween(1, UNF)
    nxt = marks.unionByName(fl).withColumn("next_exp", F.first("fexp", ignorenulls=True).over(w)) \
               .filter(F.col("_m") == 1).select(key, F.col("date").alias("E"), "next_exp") \
               .filter(F.col("next_exp").isNotNull())
    d = daily_diff.select(key, F.col("date").alias("E"), F.col("expiry").alias("next_exp"), "symbol", "diff")
    d = d.groupBy(key, "E", "next_exp").agg(F.min_by("diff", "symbol").alias("gap"))
    gaps = nxt.join(d, [key, "E", "next_exp"])
    if mode == "last":
        per = gaps.groupBy(key).agg(F.max("E").alias("E"), F.max_by("gap", "E").alias("gap"))
        j = flags.join(per, key, "left")
        g = F.when(F.col("E").isNotNull() & (F.col("date") <= F.col("E")), F.col("gap")).otherwise(F.lit(0.0))
        return j.withColumn("gap", g).drop("E")
    if mode == "cumulative":
        w2 = Window.partitionBy(key).orderBy(F.col("E").desc()).rowsBetween(UNB, 0)
        cum = gaps.withColumn("cgap", F.sum(F.coalesce("gap", F.lit(0.0))).over(w2))
        # flag row: cumulative gap of the earliest roll on or after its date
        marks2 = cum.select(key, F.col("E").alias("date"), "cgap", F.lit(1).alias("_m"))
        fl2 = flags.withColumn("_m", F.lit(0)).withColumn("cgap", F.lit(None).cast("double"))
        u = fl2.unionByName(marks2, allowMissingColumns=True)
        w3 = Window.partitionBy(key).orderBy("date", "_m").rowsBetween(0, UNF)
        u = u.withColumn("gap", F.coalesce(F.first("cgap", ignorenulls=True).over(w3), F.lit(0.0)))
        return u.filter(F.col("_m") == 0).drop("_m", "cgap")
    raise ValueError("mode must be 'last' or 'cumulative'")


# --------------------------------------------------------------------- J5
def asof_contract_flags(flags: DataFrame, until: DataFrame, key: str = "root") -> DataFrame:
    """Dense daily flag table — for every calendar day from a root's first
    flag day to ``until`` (a (root, last_day) table), the flag in force (the
    latest flag row dated on or before that day).  An equi-join on
    (root, date) then gives ticks their flag; no inequality join."""
    rng = flags.groupBy(key).agg(F.min("date").alias("_lo")).join(until, key)
    days = rng.select(key, F.explode(F.sequence("_lo", F.greatest("_lo", "last_day"))).alias("date"))
    f = flags.select(key, "date", F.struct("symbol", "expiry", "gap").alias("_f"))
    j = days.join(f, [key, "date"], "left")
    w = Window.partitionBy(key).orderBy("date").rowsBetween(UNB, 0)
    j = j.withColumn("_f", F.last("_f", ignorenulls=True).over(w))
    return j.select(key, "date", F.col("_f.symbol").alias("flag_symbol"),
                    F.col("_f.expiry").alias("flag_expiry"), F.col("_f.gap").alias("gap"))


# --------------------------------------------------------------------- W8
def continuous_contract(ticks: DataFrame, key: str = "root", ts: str = "datetime",
                        price_cols=("last",), seq=None, gap_mode: str = "last") -> DataFrame:
    """Back-adjusted continuous series per root.

    daily last (A11) -> diff (W2) -> roll calendar (W6) -> gaps (W7) -> dense
    daily flags (J5) -> ticks whose own expiry is the flagged one that day,
    prices + gap.  Bars: pass ``price_cols=('open','high','low','close')``."""
    price = "close" if "close" in ticks.columns else price_cols[0]
    dcols = ["expiry", price] + (["volume"] if "volume" in ticks.columns else [])
    daily = daily_last(ticks, (key, "symbol"), ts, seq, dcols)
    dd = daily_close_diff(daily, price, key)
    cal = roll_calendar(daily, key)
    flags = contract_flags(dd, cal, key)
    flags = roll_gap(dd, flags, key, gap_mode)
    until = daily.groupBy(key).agg(F.max("date").alias("last_day"))
    dense = asof_contract_flags(flags, until, key)
    t = ticks.withColumn("date", F.to_date(ts))
    j = t.join(dense, [key, "date"]).filter(F.col("expiry") == F.col("flag_expiry"))
    return j.withColumns({c: F.col(c) + F.col("gap") for c in price_cols}) \
            .drop("date", "flag_symbol", "flag_expiry", "gap")


# --------------------------------------------------------------------- J6
def volume_crossover(daily: DataFrame, key: str = "root", order: str = "expiry") -> DataFrame:
    """Roll by volume when expiries are unusable: join each contract's
    daily rows with the next contract's on (root, date); the roll date is
    the last date where the next contract traded more.  No such date: no
    roll (the pair is absent)."""
    cs = daily.select(key, "symbol", order).distinct()
    cs = cs.withColumn("_k", F.dense_rank().over(Window.partitionBy(key).orderBy(order, "symbol")))
    d = daily.join(cs.select(key, "symbol", "_k"), [key, "symbol"])
    cur = d.select(key, "date", "_k", "symbol", F.col("volume").alias("v1"))
    nxt = d.select(key, "date", (F.col("_k") - 1).alias("_k"), F.col("symbol").alias("next_symbol"),
                   F.col("volume").alias("v2"))
    j = cur.join(nxt, [key, "date", "_k"]).filter(F.col("v2") > F.col("v1"))
    return j.groupBy(key, "symbol", "next_symbol").agg(F.max("date").alias("roll_date"))


def roll_calendar_by_volume(daily: DataFrame, key: str = "root", order: str = "expiry") -> DataFrame:
    """W6 where expiries cannot be used: contract k owns the days up to the
    last one on which the next contract traded more (J6); without such a day
    it stays.  ``daily`` has volume per contract and day.  Output: root, symbol,
    start_day (NULL = open), end_day (NULL = open); contracts that are never
    rolled into are absent."""
    cs = daily.select(key, "symbol", order).distinct()
    cs = cs.withColumn("_k", F.dense_rank().over(Window.partitionBy(key).orderBy(order, "symbol")))
    ends = cs.join(volume_crossover(daily, key, order).select(key, "symbol", "roll_date"), [key, "symbol"], "left")
    upto = Window.partitionBy(key).orderBy("_k")        # a root's handful of contracts
    ends = ends.withColumn("_open", F.sum(F.col("roll_date").isNull().cast("int")).over(
        upto.rowsBetween(UNB, -1))).filter(F.coalesce("_open", F.lit(0)) == 0)
    ends = ends.withColumn("end_day", F.when(F.col("roll_date").isNotNull(), F.max("roll_date").over(upto.rowsBetween(UNB, 0))))
    return ends.withColumn("start_day", F.lag("end_day").over(upto)).select(key, "symbol", "start_day", "end_day")


# --------------------------------------------------------------------- W8 with J6
def listed_contracts(daily: DataFrame, key: str = "root", order: str = "symbol") -> DataFrame:
    """The contracts of a root in listing order (``_k`` from 1): ``expiry``
    (NULL if no row has one), ``max_day`` and ``roll``, the day after which the
    next contract follows: the expiry, or else the last day on which the next
    one traded more (J6); NULL if there is neither."""
    cs = daily.groupBy(key, "symbol").agg(F.max("expiry").alias("expiry"), F.max("date").alias("max_day"),
                                          F.min(order).alias("_o"))
    cs = cs.withColumn("_k", F.dense_rank().over(Window.partitionBy(key).orderBy("_o", "symbol")))   # a root's handful
    by_volume = volume_crossover(daily.withColumn("_o", F.col(order)), key, "_o").select(key, "symbol", "roll_date")
    return cs.drop("_o").join(by_volume, [key, "symbol"], "left").withColumn("roll", F.coalesce("expiry", "roll_date")) \
             .drop("roll_date")


def mixed_roll_calendar(contracts: DataFrame, key: str = "root") -> DataFrame:
    """W6 where only some contracts have an expiry: a fold over a root's
    contracts as in :func:`roll_calendar`, each pair rolling on its ``roll``
    day.  A contract without one stays; those after it are absent.  Output:
    root, symbol, start_day, end_day (NULL = open), present."""
    lists = contracts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", "symbol", "max_day", "roll"))).alias("cs"))
    item_t = "struct<symbol:string,start:date,end:date,present:boolean>"
    init = F.struct(F.lit(None).cast("date").alias("roll"), F.lit(False).alias("stays"),
                    F.array().cast(f"array<{item_t}>").alias("out"))

    def step(acc, x):
        first = F.size(acc["out"]) == 0
        present = first | (x["max_day"] > acc["roll"])
        # never back before the roll that brought the contract in
        after = F.when(x["roll"].isNotNull(), F.greatest(acc["roll"], x["roll"]))
        item = F.struct(x["symbol"].alias("symbol"), acc["roll"].alias("start"), x["roll"].alias("end"), present.alias("present"))
        return F.struct(
            F.when(acc["stays"] | ~present, acc["roll"]).otherwise(after).alias("roll"),
            (acc["stays"] | (present & x["roll"].isNull())).alias("stays"),
            F.when(acc["stays"], acc["out"]).otherwise(F.concat(acc["out"], F.array(item))).alias("out"))

    folded = lists.select(key, F.size("cs").alias("n"), F.aggregate("cs", init, step)["out"].alias("out"))
    ex = folded.select(key, "n", F.posexplode("out").alias("pos", "c"))
    return ex.select(key, F.col("c.symbol").alias("symbol"), F.col("c.start").alias("start_day"),
                     F.when(F.col("pos") < F.col("n") - 1, F.col("c.end")).alias("end_day"), F.col("c.present").alias("present"))


def continuous_mixed(ticks: DataFrame, key: str = "root", ts: str = "datetime", price_cols=("last",), size: str = "lastsize",
                     seq=None, order: str = "symbol", gap_mode: str = "last") -> DataFrame:
    """W8 whose contracts roll by expiry where they have one and by volume where
    not (``order`` lists them).  With an expiry for every contract the result
    is that of :func:`continuous_contract`."""
    price = "close" if "close" in ticks.columns else price_cols[0]
    daily = daily_last(ticks, (key, "symbol"), ts, seq, ["expiry", price])
    traded = ticks.groupBy(key, "symbol", F.to_date(ts).alias("date")).agg(F.sum(size).alias("volume"))
    daily = ordered.materialize(daily.join(traded, [key, "symbol", "date"]))
    contracts = ordered.materialize(listed_contracts(daily, key, order))
    w = Window.partitionBy(key).orderBy("date", "_k")
    dd = daily.drop("expiry").join(contracts.select(key, "symbol", "_k"), [key, "symbol"])
    # the contract's place stands for its expiry from here on: a number per root
    dd = ordered.materialize(dd.withColumn("diff", F.col(price) - F.lag(price).over(w)).withColumnRenamed("_k", "contract"))
    cal = mixed_roll_calendar(contracts, key).join(contracts.select(key, "symbol", F.col("_k").alias("contract")), [key, "symbol"])
    flags = dd.join(cal.select(key, "contract", "start_day", "end_day"), [key, "contract"])
    flags = flags.filter((F.col("start_day").isNull() | (F.col("date") > F.col("start_day")))
                         & (F.col("end_day").isNull() | (F.col("date") <= F.col("end_day")))).drop("start_day", "end_day")
    rolls = contracts.join(cal.select(key, "symbol"), [key, "symbol"], "left_semi").filter(F.col("roll").isNotNull())
    rolls = rolls.select(key, F.col("roll").alias("date")).distinct()
    flags = roll_gap(dd.withColumnRenamed("contract", "expiry"), flags.withColumnRenamed("contract", "expiry"), key, gap_mode, rolls)
    until = daily.groupBy(key).agg(F.max("date").alias("last_day"))
    dense = asof_contract_flags(flags, until, key)
    t = ticks.withColumn("date", F.to_date(ts))
    j = t.join(dense, [key, "date"]).filter(F.col("symbol") == F.col("flag_symbol"))
    return j.withColumns({c: F.col(c) + F.col("gap") for c in price_cols}).drop("date", "flag_symbol", "flag_expiry", "gap")


# --------------------------------------------------------------------- T3
def active_contract(settlements: DataFrame, roots: DataFrame | None = None, as_of=None,
                    key: str = "root", min_volume: int = 100, keep: int = 13) -> DataFrame:
    """The most active contract month (YYYYMM) per root.

    Per root, in listing order: drop the trailing totals row, drop repeated
    (expiry, volume) keeping the last, keep the first 13 rows that remain,
    drop incomplete ones; after the month's third Friday drop the current
    month; then the greatest (volume, expiry) if any volume > 100, else the
    first listed.  Roots without rows: as_of + 365/12 days (twice that after
    the third Friday) as YYYYMM."""
    as_of = as_of or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    now = F.lit(as_of).cast("timestamp_ntz")
    s = settlements.select(key, "listing_order",
                           parse_contract_month(F.col("expiry")).alias("expiry"),
                           parse_thousands(F.col("volume")).alias("volume"))
    totals = s.groupBy(key).agg(F.max("listing_order").alias("_total"))
    s = s.join(totals, key).filter(F.col("listing_order") < F.col("_total"))
    s = s.groupBy(key, "expiry", "volume").agg(F.max("listing_order").alias("listing_order"))
    # a rank limit: each task keeps its first rows per root before the shuffle
    s = s.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("listing_order"))) \
         .filter(F.col("_r") <= keep).dropna(subset=["expiry", "volume"])
    s = s.filter(~after_third_friday(now) | (F.col("expiry") != F.date_format(now, "yyyyMM")))
    pick = s.groupBy(key).agg(
        F.max("volume").alias("_mv"),
        F.max_by("expiry", F.struct("volume", "expiry")).alias("_top"),
        F.min_by("expiry", "listing_order").alias("_first"))
    chosen = pick.select(key, F.when(F.col("_mv") > min_volume, F.col("_top"))
                         .otherwise(F.col("_first")).alias("expiry"))
    if roots is None:
        roots = settlements.select(key).distinct()
    month = 365.0 / 12 * 86400
    k = F.when(after_third_friday(now), 2).otherwise(1)
    fallback = F.date_format(F.timestamp_seconds(F.unix_seconds(now.cast("timestamp")) + k * F.lit(month)),
                             "yyyyMM")
    return roots.select(key).distinct().join(chosen, key, "left") \
                .select(key, F.coalesce("expiry", fallback).alias("expiry"),
                        F.col("expiry").isNull().alias("is_fallback"))


# --------------------------------------------------------------------- P15 / J9
MARGINS = ("intraday_initial", "intraday_maintenance", "overnight_initial", "overnight_maintenance")


def clean_futures_specs(specs: DataFrame, order: str = "listing_order") -> DataFrame:
    """First row per (exchange, symbol); margins to numbers (bad ->
    NULL); currency NULL -> USD; overnight_maintenance <- overnight_initial,
    intraday_initial <- overnight_initial, intraday_maintenance <-
    intraday_initial when missing (in that order)."""
    rest = [c for c in specs.columns if c not in ("exchange", "symbol")]
    s = specs.groupBy("exchange", "symbol").agg(F.min_by(F.struct(*rest), order).alias("_s")) \
             .select("exchange", "symbol", "_s.*").select(*specs.columns)
    s = s.withColumns({m: F.col(m).cast("string").try_cast("double") for m in MARGINS})
    s = s.withColumn("currency", F.coalesce("currency", F.lit("USD")))
    s = s.withColumn("overnight_maintenance", F.coalesce("overnight_maintenance", "overnight_initial"))
    s = s.withColumn("intraday_initial", F.coalesce("intraday_initial", "overnight_initial"))
    s = s.withColumn("intraday_maintenance", F.coalesce("intraday_maintenance", "intraday_initial"))
    return s


def futures_spec_lookup(specs: DataFrame, requests: DataFrame, order: str = "listing_order",
                        spec_cols=("exchange", "symbol", "class", "currency")) -> DataFrame:
    """J9 in bulk: for each request (req_id, symbol, exchange):
    without exchange the first spec (listing order) on symbol, else the first
    on class; with exchange only a *unique* match on (exchange, symbol), else
    a unique match on (exchange, class); else NULL."""
    r = requests.withColumn("_sym", F.upper("symbol"))
    sp = F.struct(*[F.col(c).alias(f"spec_{c}") for c in spec_cols])
    s = specs.select("symbol", "class", "exchange", order, sp.alias("_s"))

    def match(col):
        j = r.select("req_id", "_sym", F.col("exchange").alias("_rx")).join(
            s, F.col("_sym") == s[col], "inner")
        return j.groupBy("req_id").agg(
            F.min_by("_s", order).alias(f"_first_{col}"),
            F.count_if(F.col("_rx").isNotNull() & (F.col("_rx") == F.col("exchange"))).alias(f"_nx_{col}"),
            F.min_by("_s", F.when(F.col("_rx") == F.col("exchange"), F.col(order))).alias(f"_fx_{col}"))

    j = r.join(match("symbol"), "req_id", "left").join(match("class"), "req_id", "left")
    noex = F.coalesce("_first_symbol", "_first_class")
    withex = F.when(F.col("_nx_symbol") == 1, F.col("_fx_symbol")) \
              .when(F.col("_nx_class") == 1, F.col("_fx_class"))
    pick = F.when(F.col("exchange").isNull(), noex).otherwise(withex)
    return j.select("req_id", F.col("symbol").alias("request_symbol"),
                    F.col("exchange").alias("request_exchange"),
                    *[pick[f"spec_{c}"].alias(f"spec_{c}") for c in spec_cols])


# --------------------------------------------------------------------- S11 / A17
def settlement_url(requests: DataFrame, catalog: DataFrame, base_url: str,
                   page: str = "quotes_settlements_futures") -> DataFrame:
    """Product page URL per requested symbol: base_url + the catalogue
    url with '{}' replaced by the page name; unknown symbol -> NULL."""
    c = catalog.select(F.upper("symbol").alias("_k"), "url")
    r = requests.withColumn("_k", F.upper("symbol"))
    return r.join(c, "_k", "left").select(
        *requests.columns,
        F.when(F.col("url").isNotNull(),
               F.concat(F.lit(base_url), F.replace(F.col("url"), F.lit("{}"), F.lit(page)))).alias("url"))


def futures_catalog_counts(catalog: DataFrame) -> DataFrame:
    """Catalogue products per group."""
    return catalog.groupBy("product_group").agg(F.count(F.lit(1)).alias("products"))


# --------------------------------------------------------------------- J10
def resolve_contracts(instruments: DataFrame, catalog: DataFrame, specs: DataFrame,
                      active: DataFrame, col: str = "instrument") -> DataFrame:
    """Instrument names -> 7-field contracts.

    A bare name gives (NAME, STK, SMART, USD, '', 0.0, '').  ``X.FUT.E``
    style names: the second part must be a catalogue product; the spec is
    looked up by symbol (J9, no exchange); expiry = third part when given,
    else the active contract (T3).  Unresolvable rows carry ``error``."""
    n = instruments.withColumn("_name", F.upper(F.col(col)))
    is_fut = F.col("_name").contains("FUT.")
    parts = F.split(F.col("_name"), r"\.")
    n = n.withColumn("_prod", F.when(is_fut, F.element_at(parts, 2))) \
         .withColumn("_exp", F.when(is_fut & (F.size(parts) == 3) & (F.element_at(parts, 3) != ""),
                                    F.element_at(parts, 3)))
    n = n.withColumn("req_id", F.col("_name"))
    known = catalog.select(F.upper("symbol").alias("_prod"), F.lit(True).alias("_known"))
    n = n.join(known, "_prod", "left")
    req = n.filter(is_fut).select("req_id", F.col("_prod").alias("symbol"),
                                  F.lit(None).cast("string").alias("exchange")).distinct()
    spec = futures_spec_lookup(specs, req).select("req_id", "spec_symbol", "spec_exchange", "spec_currency")
    act = active.select(F.upper("root").alias("_prod"), F.col("expiry").alias("_active"))
    n = n.join(spec, "req_id", "left").join(act, "_prod", "left")
    exp_txt = F.coalesce("_exp", "_active")
    exp_num = exp_txt.try_cast("bigint")
    error = F.when(~is_fut, F.lit(None).cast("string")) \
             .when(F.col("_known").isNull(), F.lit("unsupported symbol")) \
             .when(F.col("spec_symbol").isNull(), F.lit("unparsable contract")) \
             .when(exp_num.isNull(), F.lit("unparsable contract"))
    return n.select(
        col,
        F.when(is_fut, F.upper("spec_symbol")).otherwise(F.col("_name")).alias("symbol"),
        F.when(is_fut, F.lit("FUT")).otherwise(F.lit("STK")).alias("sec_type"),
        F.when(is_fut, F.upper("spec_exchange")).otherwise(F.lit("SMART")).alias("exchange"),
        F.when(is_fut, F.upper("spec_currency")).otherwise(F.lit("USD")).alias("currency"),
        F.when(is_fut, exp_num.cast("string")).otherwise(F.lit("")).alias("expiry"),
        F.lit(0.0).alias("strike"), F.lit("").alias("opt_type"), error.alias("error"))


CONTRACT_FIELDS = ("symbol", "sec_type", "exchange", "currency", "expiry", "strike", "opt_type")


def pad_contracts(tuples: DataFrame, col: str = "fields") -> DataFrame:
    """J10 for contracts given as (short) lists of text fields: missing ones are
    SMART, USD, '', 0.0, ''; an integer expiry loses leading zeros and signs of
    text form, other text stays; a strike that is no number counts as 0."""
    n = F.size(col)

    def field(i, default):
        return F.when(n > i, F.get(F.col(col), F.lit(i))).otherwise(F.lit(default))
    expiry = field(4, "")
    return tuples.select(
        col, field(0, None).alias("symbol"), field(1, None).alias("sec_type"), field(2, "SMART").alias("exchange"),
        field(3, "USD").alias("currency"), F.coalesce(F.trim(expiry).try_cast("bigint").cast("string"), expiry).alias("expiry"),
        F.coalesce(field(5, "0").try_cast("double"), F.lit(0.0)).alias("strike"), field(6, "").alias("opt_type"))
