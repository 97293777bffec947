"""Message normalisation: the same functions serve batch tables and streams.

P1 normalize_quotes, P2 normalize_ticks, P3 normalize_bars,
P5 normalize_order_book, P6 prefix_option_columns, P7 ensure_option_columns,
F13 book_top (see functions.scalars), W4 price_change_ticks,
S6 publish_messages, S7 subscribe_messages (batch forms).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.scalars import asset_class, book_top, symbol_group
from barsmith.operators import ordered
from barsmith.operators.bars import OPT_COLUMNS
from barsmith.schemas import LEVEL

# Option field names as delivered -> stored names (before the
# opt_ prefix), and the ten stored option fields.
OPTION_SOURCE_NAMES = {"impliedVol": "iv", "undPrice": "underlying", "dividends": "dividend",
                       "optVolume": "volume", "optOpenInterest": "oi", "optPrice": "price"}
OPTION_FIELDS = tuple(c.removeprefix("opt_") for c in OPT_COLUMNS)


def _num(df: DataFrame, *names) -> Column:
    """First existing column among ``names`` as double, NaN -> NULL."""
    for n in names:
        if n in df.columns:
            c = F.col(n).cast("double")
            return F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return F.lit(None).cast("double")


def sec_type_of(df: DataFrame) -> Column:
    """Security type: the ``sec_type`` column when present, else derived from
    the symbol's asset class (CSH -> CASH)."""
    if "sec_type" in df.columns:
        return F.col("sec_type")
    a = asset_class("symbol")
    return F.when(a == "CSH", F.lit("CASH")).otherwise(a)


def _meta(df: DataFrame, ts: str) -> list[Column]:
    st = sec_type_of(df)
    ac = F.when(st == "CASH", F.lit("CSH")).otherwise(st) if "sec_type" in df.columns else asset_class("symbol")
    return [F.col("symbol"), symbol_group("symbol").alias("symbol_group"), ac.alias("asset_class"),
            F.col(ts).alias("timestamp")]


def prefix_option_columns(df: DataFrame) -> DataFrame:
    """Option fields (source names mapped: impliedVol->iv, undPrice->
    underlying, dividends->dividend, optVolume->volume, optOpenInterest->oi,
    optPrice->price) become ``opt_*`` columns, for OPT/FOP rows only
    (NULL elsewhere).  Missing fields give NULL instead of dropping the row."""
    st = sec_type_of(df)
    is_opt = st.isin("OPT", "FOP")
    cols = {}
    for f in OPTION_FIELDS:
        src = [s for s, t in OPTION_SOURCE_NAMES.items() if t == f] + [f]
        v = _num(df, *src)
        cols[f"opt_{f}"] = F.when(is_opt, v)
    return df.withColumns(cols)


def ensure_option_columns(df: DataFrame) -> DataFrame:
    """If any of the ten ``opt_*`` columns is missing, all ten become NULL
    (existing ones are overwritten), as the original does."""
    if all(c in df.columns for c in OPT_COLUMNS):
        return df
    return df.withColumns({c: F.lit(None).cast("double") for c in OPT_COLUMNS})


def normalize_quotes(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Quote messages.  bid/ask/last/bidSize/askSize/lastSize/volume with
    NaN -> NULL; CASH: last = (bid+ask)/2 when last is missing and both sides
    exist; if the input has option fields, OPT/FOP rows carry them as
    ``opt_*`` (P6)."""
    has_options = any(c in df.columns for c in (*OPTION_SOURCE_NAMES, "delta", "gamma", "vega", "theta"))
    if has_options:
        df = prefix_option_columns(df)
    st = sec_type_of(df)
    bid, ask, last = _num(df, "bid"), _num(df, "ask"), _num(df, "last")
    last = F.when((st == "CASH") & last.isNull() & bid.isNotNull() & ask.isNotNull(),
                  (bid + ask) / 2).otherwise(last)
    base = df.select(*_meta(df, ts), F.lit("QUOTE").alias("kind"), bid.alias("bid"), ask.alias("ask"),
                     last.alias("last"), _num(df, "bidSize", "bidsize").alias("bidSize"),
                     _num(df, "askSize", "asksize").alias("askSize"),
                     _num(df, "lastSize", "lastsize").alias("lastSize"),
                     _num(df, "volume").alias("volume"),
                     *([F.col(c) for c in OPT_COLUMNS] if has_options else []))
    return base


def normalize_ticks(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Trade ticks: price = last, size = lastSize (0 if absent), volume
    (0 if absent); rows without a price are dropped."""
    last = _num(df, "last")
    out = df.select(*_meta(df, ts), F.lit("TICK").alias("kind"), last.alias("price"),
                    F.coalesce(_num(df, "lastSize", "lastsize"), F.lit(0.0)).alias("size"),
                    F.coalesce(_num(df, "volume"), F.lit(0.0)).alias("volume"))
    return out.filter(F.col("price").isNotNull())


def normalize_bars(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Bar messages; missing OHLC / volume -> 0."""
    return df.select(*_meta(df, ts), F.lit("BAR").alias("kind"),
                     *[F.coalesce(_num(df, c), F.lit(0.0)).alias(c) for c in
                       ("open", "high", "low", "close", "volume")])


def normalize_order_book(levels: DataFrame, ts: str = "datetime") -> DataFrame:
    """P5: depth levels (symbol, time, side BID/ASK, price, size,
    market_maker) -> one snapshot per (symbol, time): ``bids`` best (highest)
    first, ``asks`` best (lowest) first, market maker '' when missing.  A
    group is one snapshot (bounded by the book depth)."""
    lv = F.struct(F.col("price").cast("double").alias("price"), F.col("size").cast("double").alias("size"),
                  F.coalesce(F.col("market_maker"), F.lit("")).alias("market_maker"))
    g = levels.groupBy("symbol", F.col(ts).alias("timestamp")).agg(
        F.collect_list(F.when(F.col("side") == "BID", lv)).alias("_b"),
        F.collect_list(F.when(F.col("side") == "ASK", lv)).alias("_a"))
    bids = F.array_sort("_b", lambda x, y: F.when(x["price"] > y["price"], -1)
                        .when(x["price"] < y["price"], 1)
                        .otherwise(F.when(x["size"] > y["size"], -1).when(x["size"] < y["size"], 1).otherwise(0)))
    asks = F.array_sort("_a", lambda x, y: F.when(x["price"] < y["price"], -1)
                        .when(x["price"] > y["price"], 1)
                        .otherwise(F.when(x["size"] > y["size"], -1).when(x["size"] < y["size"], 1).otherwise(0)))
    return g.select("symbol", F.lit("ORDERBOOK").alias("kind"), "timestamp",
                    bids.cast(f"array<{LEVEL.simpleString()}>").alias("bids"),
                    asks.cast(f"array<{LEVEL.simpleString()}>").alias("asks"))


def book_history(books: DataFrame) -> DataFrame:
    """P5's optional fields: the previous snapshot's best bid and ask
    (``prev_bid``, ``prev_ask``) and the day's highest bid and lowest ask so
    far (``daily_high``, ``daily_low``; a missing side does not count)."""
    b = books.withColumn("_bid", F.get("bids", F.lit(0))["price"]).withColumn("_ask", F.get("asks", F.lit(0))["price"]) \
             .withColumn("_day", F.to_date("timestamp"))
    b = ordered.sequence(b, ["symbol"], ["timestamp"], rownum=None, prev={"_bid": "prev_bid", "_ask": "prev_ask"})
    # running extremes: per time slice first, then within the slice
    b = b.withColumn("_slice", ordered.seconds_chunk("timestamp", ordered.CHUNK_SECONDS))
    keys = ["symbol", "_day", "_slice"]
    before = Window.partitionBy("symbol", "_day").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = b.groupBy(*keys).agg(F.max("_bid").alias("_h"), F.min("_ask").alias("_l")) \
              .select(*keys, F.max("_h").over(before).alias("_h0"), F.min("_l").over(before).alias("_l0"))
    upto = Window.partitionBy(*keys).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    b = b.join(slices, keys)
    return b.select(*books.columns, "prev_bid", "prev_ask",
                    F.greatest(F.max("_bid").over(upto), "_h0").alias("daily_high"),
                    F.least(F.min("_ask").over(upto), "_l0").alias("daily_low"))


def book_top_of_levels(levels: DataFrame, ts: str = "datetime") -> DataFrame:
    """F13 from depth levels: best bid and ask by aggregation, no book built."""
    price, size = F.col("price").cast("double"), F.col("size").cast("double")
    g = levels.groupBy("symbol", F.col(ts).alias("timestamp")).agg(
        F.max(F.when(F.col("side") == "BID", F.struct(price.alias("p"), size.alias("s")))).alias("_b"),
        F.min(F.when(F.col("side") == "ASK", F.struct(price.alias("p"), (-size).alias("s")))).alias("_a"))
    zero = F.lit(0.0)
    return g.select("symbol", "timestamp", F.coalesce("_b.p", zero).alias("bid"), F.coalesce("_b.s", zero).alias("bidsize"),
                    F.coalesce("_a.p", zero).alias("ask"), F.coalesce(-F.col("_a.s"), zero).alias("asksize"))


def book_summary(books: DataFrame) -> DataFrame:
    """F13 applied: best bid / ask and sizes per snapshot."""
    return books.select("symbol", "timestamp", book_top("bids", "asks").alias("_t")) \
                .select("symbol", "timestamp", "_t.*")


def price_change_ticks(quotes: DataFrame, key: str = "symbol", order=("timestamp",),
                       price: str = "last") -> DataFrame:
    """CASH quotes whose price differs (NULL-safe) from the previous quote
    of the symbol; the first quote of a symbol is remembered, not emitted."""
    cash = quotes.filter(F.col("asset_class") == "CSH")
    s = ordered.sequence(cash, [key], list(order), rownum="_g", prev={price: "prev_price"})
    return s.filter((F.col("_g") > 1) & ~F.col(price).eqNullSafe(F.col("prev_price"))).drop("_g")


def publish_messages(df: DataFrame, ts: str = "timestamp",
                     fmt: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") -> DataFrame:
    """S6 (batch form): one message per row, keyed by ``kind``; the value is
    the row as JSON with the time as text.  Write to a message bus with the
    Kafka sink, or to files partitioned by kind."""
    cols = [F.date_format(F.col(c), fmt).alias(c) if c == ts else F.col(c) for c in df.columns]
    return df.select(F.col("kind").alias("key"), F.to_json(F.struct(*cols)).alias("value"))


def published_counts(df: DataFrame) -> DataFrame:
    """Messages published per (kind, symbol)."""
    return df.groupBy("kind", "symbol").agg(F.count(F.lit(1)).alias("messages"))


def subscribe_messages(messages: DataFrame, schema, symbols: str | list | None = None,
                       kind: str | None = None, tz: str = "UTC", ts: str = "timestamp") -> DataFrame:
    """S7 (batch form): decode JSON messages, keep the subscribed symbols
    (comma separated, trimmed) and one kind, times converted to ``tz``."""
    m = messages.select(F.from_json(F.col("value"), schema).alias("m")).select("m.*")
    if kind is not None:
        m = m.filter(F.col("kind") == kind)
    if symbols:
        if isinstance(symbols, str):
            symbols = [s.strip() for s in symbols.split(",") if s.strip()]
        m = m.filter(F.col("symbol").isin(list(symbols)))
    t = F.to_timestamp(F.col(ts))
    if tz and tz.upper() != "UTC":
        t = F.from_utc_timestamp(t, tz)
    return m.withColumn(ts, t.cast("timestamp_ntz"))
