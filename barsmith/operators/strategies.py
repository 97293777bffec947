"""Strategy callbacks (X1) and the documented SMA example.

X2 is pure window arithmetic.  X1 runs user code over each instrument's
time-ordered rows.  Rows are sorted within partitions and handed to the
callback a chunk at a time with the state it left behind, so a session of any
size is streamed through bounded memory and the answer depends neither on
partitioning nor on batch sizes.  The same callback and state run on a stream
(``barsmith.streaming.streams.stream_strategy``), where Spark's state store
carries the state between micro-batches.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators import ordered

SIGNAL_SCHEMA = "symbol string, datetime timestamp_ntz, signal string, price double"


def session_breakout(pdf: pd.DataFrame, state: dict, price: str = "last") -> tuple[pd.DataFrame, dict]:
    """Example callback: BUY when the price crosses above the session's first
    price, SELL when it crosses below."""
    p = pdf[price].astype("float64")
    first = state.get("open", None if pd.isna(p.iloc[0]) else float(p.iloc[0]))
    o = np.nan if first is None else first
    prev = p.shift(1)
    prev.iloc[0] = np.nan if state.get("prev") is None else state["prev"]
    up = (p > o) & (prev <= o)
    down = (p < o) & (prev >= o)
    hit = (up | down).to_numpy()
    out = pd.DataFrame({"symbol": pdf["symbol"].to_numpy()[hit],
                        "datetime": pdf["datetime"].to_numpy()[hit],
                        "signal": np.where(up.to_numpy()[hit], "BUY", "SELL").astype(object),
                        "price": p.to_numpy()[hit]})
    return out, {"open": first, "prev": None if pd.isna(p.iloc[-1]) else float(p.iloc[-1])}


class Instrument:
    """What a strategy knows of its instrument: the last message of each kind
    and the position that its fills add up to."""

    KINDS = ("quote", "tick", "bar", "orderbook")

    def __init__(self, symbol: str, state: dict | None = None):
        self.symbol = symbol
        self.last = dict((state or {}).get("last", {}))
        self.position = (state or {}).get("position", 0)
        self.avg_price = (state or {}).get("avg_price", 0.0)
        self.signals: list[tuple] = []

    def __getattr__(self, name: str):
        if name in Instrument.KINDS:
            return self.__dict__.get("last", {}).get(name)
        raise AttributeError(name)

    def signal(self, time, name: str, price) -> None:
        """Report a signal at the time of the event at hand."""
        self.signals.append((self.symbol, time, name, None if price is None else float(price)))

    def fill(self, quantity: int, price: float) -> None:
        """Book a fill: the average price moves when the position grows."""
        new = self.position + quantity
        if self.position == 0 or (self.position > 0) != (new > 0):
            self.avg_price = float(price) if new else 0.0
        elif abs(new) > abs(self.position):
            self.avg_price = (self.avg_price * abs(self.position) + price * abs(quantity)) / abs(new)
        self.position = new

    def state(self) -> dict:
        return {"last": self.last, "position": self.position, "avg_price": self.avg_price}


class Strategy:
    """Base of event strategies: override the callbacks that matter.  ``memo``
    is a dict of plain values that outlives chunks, sessions and micro-batches."""

    def on_start(self, instrument: Instrument, memo: dict) -> None:
        pass

    def on_quote(self, instrument: Instrument, memo: dict) -> None:
        pass

    def on_tick(self, instrument: Instrument, memo: dict) -> None:
        pass

    def on_bar(self, instrument: Instrument, memo: dict) -> None:
        pass

    def on_orderbook(self, instrument: Instrument, memo: dict) -> None:
        pass

    def on_fill(self, instrument: Instrument, memo: dict) -> None:
        pass

    def rows(self, ts: str = "datetime") -> Callable:
        """The row callback of :func:`apply_strategy` that plays the events: a
        row's ``kind`` names its callback, its other columns are the message; a
        FILL row carries ``quantity`` and ``price``."""
        def on_rows(pdf: pd.DataFrame, state: dict) -> tuple[pd.DataFrame, dict]:
            instrument = Instrument(pdf["symbol"].iloc[0], state.get("instrument"))
            memo = dict(state.get("memo", {}))
            if not state:
                self.on_start(instrument, memo)
            plain = pdf.astype(object).where(pdf.notna(), None)
            for row in plain.to_dict("records"):
                kind = str(row.get("kind") or "TICK").lower()
                message = {k: str(v) if k == ts else v for k, v in row.items() if v is not None}
                instrument.time = row[ts]
                if kind == "fill":
                    instrument.fill(int(row["quantity"]), float(row["price"]))
                    self.on_fill(instrument, memo)
                elif kind in Instrument.KINDS:
                    instrument.last[kind] = message
                    getattr(self, f"on_{kind}")(instrument, memo)
            out = pd.DataFrame(instrument.signals, columns=["symbol", ts, "signal", "price"])
            out = out.astype({"symbol": object, ts: "datetime64[us]", "signal": object, "price": "float64"})
            return out, {"instrument": instrument.state(), "memo": memo}
        return on_rows


def apply_strategy(df: DataFrame, on_rows: Callable[[pd.DataFrame, dict], tuple[pd.DataFrame, dict]],
                   schema: str = SIGNAL_SCHEMA, order=("datetime",), session="day") -> DataFrame:
    """``on_rows(pdf, state) -> (signals, state)`` over each symbol's rows
    in ``order``, a chunk at a time.  The state starts empty with every session:
    ``"day"``, a Column, or None for one session per symbol."""
    order = list(order)
    day = F.to_date(order[0]) if isinstance(session, str) and session == "day" else session
    d = df.withColumn("_session", F.lit("") if day is None else F.coalesce(day.cast("string"), F.lit("")))
    keys = ["symbol", "_session"]

    def run(frames):
        key, state = None, {}
        for pdf in frames:
            if not len(pdf):
                continue
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1)
            for _, part in pdf.groupby(new.cumsum(), sort=False):
                mine = tuple(part[keys].iloc[0])
                if mine != key:
                    key, state = mine, {}
                out, state = on_rows(part.drop(columns=["_session"]).reset_index(drop=True), state)
                if len(out):
                    yield out

    return d.filter(F.col("symbol").isNotNull()).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(
        run, schema)


def sma_crossover(bars: DataFrame, fast: int = 10, slow: int = 20, price: str = "close",
                  keys=("symbol",), order=("datetime",)) -> DataFrame:
    """Fast / slow simple moving averages of ``price`` per symbol and the
    crossover signal (BUY when fast moves above slow, SELL when below).
    Prices are summed as integer micro-units, so the averages are exact and
    independent of summation order.  Averages need a full window (NULL
    before)."""
    keys = list(keys)
    s = ordered.sequence(bars, keys, list(order), rownum="_g")
    b = ordered.halo_blocks(s, "_g", slow)
    micro = F.round(F.col(price) * F.lit(1e6)).cast("long")

    def sma(n):
        w = ordered.block_window(keys, "_g", -(n - 1), 0)
        full = F.count(F.lit(1)).over(w) == n
        return F.when(full, F.sum(micro).over(w) / F.lit(float(n)) / F.lit(1e6))

    b = b.withColumn("sma_fast", sma(fast)).withColumn("sma_slow", sma(slow))
    b = b.withColumn("_d", F.col("sma_fast") - F.col("sma_slow"))
    prev = F.lag("_d").over(Window.partitionBy(*keys, "_blk").orderBy("_g"))
    sig = F.when((prev <= 0) & (F.col("_d") > 0), F.lit("BUY")) \
           .when((prev >= 0) & (F.col("_d") < 0), F.lit("SELL"))
    b = b.withColumn("signal", sig).filter(~F.col("_halo"))
    return b.drop("_g", "_blk", "_halo", "_d")
