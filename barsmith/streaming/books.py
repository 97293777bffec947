"""TS3 stream_book: the last order book of every symbol while depth updates
arrive, in any order.

An update sets the size of a (side, price) level or, with size 0 or NULL,
deletes it.  Each level of a symbol is an entry of a map state (RocksDB) that
remembers the time of its last update, deletions too, so an update that comes
late changes nothing that is newer.  A micro-batch's rows of a symbol are taken
chunk by chunk; in memory are a chunk and the book.  ``ttl`` forgets levels and
deletions that were not touched for so long.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LEVEL = "struct<price:double,size:double,market_maker:string>"
BOOK = f"symbol string, timestamp timestamp_ntz, bids array<{LEVEL}>, asks array<{LEVEL}>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastBook(StatefulProcessor):
    """Levels of a symbol in state; a changed symbol's book as output."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, price double",
                                         "size double, market_maker string, at long, seq long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        book, changed = dict(self.levels.iterator()), set()
        for pdf in rows:
            pdf = pdf.sort_values(["at", "seq"], kind="mergesort").drop_duplicates(["side", "price"], keep="last")
            for side, price, size, maker, at, seq in zip(*(pdf[c].tolist() for c in (
                    "side", "price", "size", "market_maker", "at", "seq"))):
                known = book.get((side, price))
                if known is None or tuple(known[2:]) < (at, seq):
                    book[side, price] = (size, maker, at, seq)
                    changed.add((side, price))
        for level in changed:
            self.levels.updateValue(level, book[level])
        if changed:
            live = {s: sorted((p, *v[:2]) for (side, p), v in book.items() if side == s and v[0] > 0) for s in ("BID", "ASK")}
            newest = max(v[2] for v in book.values())

            def shown(levels):
                return [{"price": p, "size": s, "market_maker": m} for p, s, m in levels]
            yield pd.DataFrame({"symbol": [key[0]], "timestamp": [pd.Timestamp(newest, unit="us")],
                                "bids": [shown(reversed(live["BID"]))], "asks": [shown(live["ASK"])]})

    def close(self) -> None:
        pass


def level_updates(updates: DataFrame, ts: str = "datetime", seq: str = "seq") -> DataFrame:
    """Updates as both forms take them; rows without symbol, side, price or
    time are none."""
    out = updates.select(
        "symbol", F.upper("side").alias("side"), F.col("price").cast("double").alias("price"),
        F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size"),
        F.coalesce("market_maker", F.lit("")).alias("market_maker"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(seq).cast("long").alias("seq"))
    return out.where(F.col("side").isin("BID", "ASK") & F.col("symbol").isNotNull() & F.col("price").isNotNull()
                     & ~F.isnan("price") & F.col("at").isNotNull())


def stream_book(updates: DataFrame, ts: str = "datetime", seq: str = "seq", ttl_ms: int | None = None) -> DataFrame:
    """The books that a micro-batch changed (update mode)."""
    updates.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return level_updates(updates, ts, seq).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=LastBook(ttl_ms), outputStructType=BOOK, outputMode="Update",
        timeMode="ProcessingTime" if ttl_ms else "None")


def last_books(updates: DataFrame, ts: str = "datetime", seq: str = "seq") -> DataFrame:
    """The batch form: of every level the newest update, without deletions."""
    newest = level_updates(updates, ts, seq).groupBy("symbol", "side", "price").agg(
        F.max_by(F.struct("size", "market_maker", "at"), F.struct("at", "seq")).alias("r"))
    level = F.struct(F.col("price"), F.col("r.size").alias("size"), F.col("r.market_maker").alias("market_maker"))
    live = F.col("r.size") > 0

    def side(name):
        return F.collect_list(F.when(live & (F.col("side") == name), level))
    return newest.groupBy("symbol").agg(
        F.max("r.at").alias("at"), side("BID").alias("b"), side("ASK").alias("a")).select(
        "symbol", F.timestamp_micros("at").cast("timestamp_ntz").alias("timestamp"),
        F.sort_array("b", asc=False).alias("bids"), F.sort_array("a").alias("asks"))


def book_levels(books: DataFrame) -> DataFrame:
    """A row per level: ``place`` 1 is the best of its side."""
    def side(name, column):
        return books.select("symbol", F.lit(name).alias("side"), F.posexplode(column).alias("i", "l")).select(
            "symbol", "side", (F.col("i") + 1).alias("place"), "l.price", "l.size", "l.market_maker")
    return side("BID", "bids").unionByName(side("ASK", "asks"))
