"""Table schemas (StructType) of the market store.

Prices and greeks are exact decimals at rest; analytics read them as doubles
(``operators.store.read_store``)."""

from pyspark.sql.types import (DateType, DecimalType, DoubleType, IntegerType, LongType,
                               StringType, StructField, StructType,
                               TimestampNTZType, ArrayType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


SYMBOLS = _s(("id", LongType()), ("symbol", StringType()), ("symbol_group", StringType()),
             ("asset_class", StringType()), ("expiry", DateType()))
PRICE = DecimalType(20, 8)
BARS = _s(("datetime", TimestampNTZType()), ("symbol_id", LongType()), ("open", PRICE),
          ("high", PRICE), ("low", PRICE), ("close", PRICE),
          ("volume", LongType()))
TICKS = _s(("datetime", TimestampNTZType()), ("symbol_id", LongType()), ("bid", PRICE),
           ("bidsize", IntegerType()), ("ask", PRICE), ("asksize", IntegerType()),
           ("last", PRICE), ("lastsize", IntegerType()))
GREEKS = _s(("id", LongType()), ("tick_id", LongType()), ("bar_id", LongType()),
            ("price", PRICE), ("underlying", PRICE), ("dividend", PRICE),
            ("volume", IntegerType()), ("iv", PRICE), ("oi", PRICE),
            ("delta", PRICE), ("gamma", PRICE), ("theta", PRICE),
            ("vega", PRICE))
TRADES = _s(("algo", StringType()), ("symbol", StringType()), ("direction", StringType()),
            ("quantity", IntegerType()), ("entry_time", TimestampNTZType()),
            ("exit_time", TimestampNTZType()), ("exit_reason", StringType()),
            ("order_type", StringType()), ("market_price", DoubleType()),
            ("target", DoubleType()), ("stop", DoubleType()), ("entry_price", DoubleType()),
            ("exit_price", DoubleType()), ("realized_pnl", DoubleType()))
INSTRUMENTS = _s(("symbol", StringType()), ("sec_type", StringType()), ("exchange", StringType()),
                 ("currency", StringType()), ("expiry", DoubleType()), ("strike", DoubleType()),
                 ("opt_type", StringType()))
LEVEL = _s(("price", DoubleType()), ("size", DoubleType()), ("market_maker", StringType()))
ORDER_BOOK = StructType([StructField("symbol", StringType()), StructField("kind", StringType()),
                         StructField("bids", ArrayType(LEVEL)), StructField("asks", ArrayType(LEVEL)),
                         StructField("prev_bid", DoubleType()), StructField("prev_ask", DoubleType()),
                         StructField("daily_high", DoubleType()), StructField("daily_low", DoubleType())])
MESSAGE = _s(("kind", StringType()), ("symbol", StringType()), ("symbol_group", StringType()),
             ("asset_class", StringType()), ("timestamp", StringType()), ("bid", DoubleType()),
             ("bidsize", DoubleType()), ("ask", DoubleType()), ("asksize", DoubleType()),
             ("last", DoubleType()), ("lastsize", DoubleType()), ("volume", DoubleType()),
             ("open", DoubleType()), ("high", DoubleType()), ("low", DoubleType()),
             ("close", DoubleType()), ("price", DoubleType()), ("size", DoubleType()))
