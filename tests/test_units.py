"""Hand-written edge cases per operator (FIXTURES.md section 5)."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith.functions import calendar as C
from barsmith.functions import scalars as S
from barsmith.operators import bars as B
from barsmith.operators import futures as FU
from barsmith.operators import ordered
from barsmith.operators import store as ST
from barsmith import schemas

T0 = dt.datetime(2024, 1, 2, 10, 0)


def h(n, m=0):
    return T0 + dt.timedelta(hours=n, minutes=m)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols[:2]).collect()]


# ----------------------------------------------------------------- A2
@pytest.fixture()
def three_bars(spark):
    data = [("X", h(0), 1.0, 2.0, 0.5, 1.5, 10), ("X", h(1), 1.5, 1.8, 1.2, 1.6, 0),
            ("X", h(3), 1.6, 2.5, 1.6, 2.4, 5)]
    return spark.createDataFrame(data, "symbol string, datetime timestamp_ntz, open double, high double, "
                                       "low double, close double, volume long")


def test_upsample_fills(three_bars):
    out = B.resample_bars_time(three_bars, "30T", ffill=True)
    r = rows(out, "datetime", "open", "high", "low", "close", "volume")
    assert len(r) == 7
    assert r[1] == (h(0, 30), 1.5, 1.5, 1.5, 1.5, 0)        # empty bucket: O=H=L=C=previous close
    assert r[2] == (h(1), 1.6, 1.6, 1.6, 1.6, 0)             # real zero-volume bar flattened too
    assert r[6] == (h(3), 1.6, 2.5, 1.6, 2.4, 5)


def test_upsample_no_ffill_drops_empty(three_bars):
    out = B.resample_bars_time(three_bars, "30T", ffill=False)
    assert [r[0] for r in rows(out, "datetime", "volume")] == [h(0), h(3)]


def test_downsample_does_not_fill(three_bars):
    out = B.resample_bars_time(three_bars, "2H")
    assert rows(out, "datetime", "open", "high", "low", "close", "volume") == [
        (h(0), 1.0, 2.0, 0.5, 1.6, 10), (h(2), 1.6, 2.5, 1.6, 2.4, 5)]


# ----------------------------------------------------------------- A3 / A4
@pytest.fixture()
def seven_ticks(spark):
    data = [("X", h(0, i), float(i + 1), s) for i, s in enumerate([5, 1, 1, 1, 1, 1, 1])]
    return spark.createDataFrame(data, "symbol string, datetime timestamp_ntz, last double, lastsize int")


def test_tick_count_bars(seven_ticks):
    out = B.resample_tick_count(seven_ticks, 3)
    assert rows(out, "datetime", "open", "close", "volume") == [
        (h(0), 1.0, 3.0, 7), (h(0, 3), 4.0, 6.0, 3), (h(0, 6), 7.0, 7.0, 1)]


def test_tick_count_n1_is_identity(seven_ticks):
    assert B.resample_tick_count(seven_ticks, 1) is seven_ticks


def test_volume_bars_nearest_multiple(seven_ticks):
    # cum 5,6,7,8,9,10,11 -> marks 6,6,6,9,9,9,12 -> groups 0,0,0,3,3,3,4
    out = B.resample_volume(seven_ticks, 3)
    assert rows(out, "datetime", "open", "close", "volume") == [
        (h(0), 1.0, 3.0, 7), (h(0, 3), 4.0, 6.0, 3), (h(0, 6), 7.0, 7.0, 1)]


# ----------------------------------------------------------------- U4
def test_sync_without_overlap_trims_only_end(spark):
    data = [("A", h(1)), ("A", h(2)), ("B", h(5)), ("B", h(6)), ("C", h(9)), ("C", h(10))]
    df = spark.createDataFrame(data, "symbol string, datetime timestamp_ntz")
    assert sorted(r[0] for r in B.sync_time_range(df).select("datetime").collect()) == [h(1), h(2)]


# ----------------------------------------------------------------- W6 / W7 / W8
def test_roll_calendar_and_gap(spark):
    d = dt.date
    data = []
    # contract E1 = Jan 3 trades Jan 1..4; E2 = Jan 5 trades only Jan 1..3 (no rows in its slot);
    # E3 = Jan 8 trades Jan 1..8
    for day in range(1, 5):
        data.append(("R", "R1", d(2024, 1, 3), d(2024, 1, day), 100.0 + day))
    for day in range(1, 4):
        data.append(("R", "R2", d(2024, 1, 5), d(2024, 1, day), 110.0 + day))
    for day in range(1, 9):
        data.append(("R", "R3", d(2024, 1, 8), d(2024, 1, day), 120.0 + day))
    daily = spark.createDataFrame(data, "root string, symbol string, expiry date, date date, last double")
    cal = {r["expiry"]: (r["start_day"], r["end_day"], r["present"])
           for r in FU.roll_calendar(daily).collect()}
    assert cal[d(2024, 1, 3)] == (None, d(2024, 1, 3), True)
    assert cal[d(2024, 1, 5)] == (d(2024, 1, 3), d(2024, 1, 5), False)   # no rows after Jan 3
    assert cal[d(2024, 1, 8)] == (d(2024, 1, 3), None, True)             # previous roll stands
    dd = FU.daily_close_diff(daily, "last")
    flags = FU.contract_flags(dd, FU.roll_calendar(daily))
    owner = {r["date"]: r["symbol"] for r in flags.collect()}
    assert owner[d(2024, 1, 3)] == "R1" and owner[d(2024, 1, 4)] == "R3"
    g = {r["date"]: r["gap"] for r in FU.roll_gap(dd, flags).collect()}
    # the last roll with a found row is Jan 5 -> R3's diff on Jan 5 (spread to the previous row)
    assert g[d(2024, 1, 8)] == 0.0
    assert g[d(2024, 1, 1)] == g[d(2024, 1, 5)] == 1.0     # R3 on Jan 5: 125 - 124
    # cumulative: rolls Jan 3 (R3 - R2 spread = 10) and Jan 5 (1) add up
    c = {r["date"]: r["gap"] for r in FU.roll_gap(dd, flags, mode="cumulative").collect()}
    assert (c[d(2024, 1, 2)], c[d(2024, 1, 4)], c[d(2024, 1, 6)]) == (11.0, 1.0, 0.0)


# ----------------------------------------------------------------- P8
def test_validate_bars_equalities(spark):
    data = [("X", T0, "1.0", "1.5", "0.5", "1.5", 3.0),     # high == close: valid
            ("X", T0, "1.0", "1.5", "0.5", "1.2", None),    # missing volume
            ("X", T0, "abc", "1.5", "0.5", "1.2", 1.0),     # text price
            ("X", T0, "1.0", "0.9", "0.5", "1.2", 1.0)]     # high below close
    df = spark.createDataFrame(data, "symbol string, datetime timestamp_ntz, open string, high string, "
                                     "low string, close string, volume double")
    got = [r["reason"] for r in ST.validate_bars(df).collect()]
    assert got == [None, "missing:volume", "not_numeric", "high_below_open_close"]


# ----------------------------------------------------------------- F1 / F4 / F5
def test_scalars(spark):
    df = spark.createDataFrame([(2.5, "ESU2025_FUT"), (3.5, "EURUSD_CASH"), (None, "AAPL")],
                               "v double, s string")
    r = df.select(S.round_to_tick("v", 1).alias("r"), S.symbol_group("s").alias("g"),
                  S.asset_class("s").alias("a")).collect()
    assert [tuple(x) for x in r] == [(2.0, "ES_F", "FUT"), (4.0, "CASH", "CSH"), (0.0, "AAPL", "STK")]


# ----------------------------------------------------------------- F7
def test_calendar(spark):
    ts = [dt.datetime(2024, 1, 20, 9), dt.datetime(2024, 1, 21, 9), dt.datetime(2024, 1, 19, 15, 59),
          dt.datetime(2024, 1, 19, 16, 1), dt.datetime(2024, 1, 18, 17, 0), dt.datetime(2024, 1, 22, 10)]
    df = spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    r = df.select(C.previous_weekday("ts").alias("pw"), C.is_third_friday("ts").alias("tf"),
                  C.after_third_friday("ts").alias("af"), C.backdate("ts", "1D").alias("bd"),
                  C.week_start("ts").alias("ws")).collect()
    assert r[0]["pw"] == dt.date(2024, 1, 19) and r[1]["pw"] == dt.date(2024, 1, 19)
    assert (r[2]["tf"], r[2]["af"]) == (True, False)
    assert (r[3]["tf"], r[3]["af"]) == (True, True)
    assert r[4]["tf"] is True                                 # Thursday from 17:00
    assert r[5]["bd"] == dt.datetime(2024, 1, 19, 10)         # Monday - 1 day -> Friday
    assert r[5]["ws"] == dt.date(2024, 1, 21)


# ----------------------------------------------------------------- S3
def test_ingest_is_idempotent(spark):
    sym = spark.createDataFrame([(1, "X", "X", "STK", None)], schemas.SYMBOLS)
    batch = spark.createDataFrame(
        [("X", T0, 1.0, 2.0, 0.5, 1.5, 10.7, 1), ("X", T0, 9.0, 9.0, 9.0, 9.0, 1.0, 2),
         ("X", h(1), 1.0, 2.0, 0.5, 1.5, 3.0, 3)],
        "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, "
        "volume double, seq int")
    empty = spark.createDataFrame([], schemas.BARS)
    first = ST.ingest_bars(batch, empty, sym, "seq")
    r = rows(first, "datetime", "open", "volume")
    assert r == [(T0, 1.0, 10), (h(1), 1.0, 3)]               # first row wins, volume truncated
    again = ST.ingest_bars(batch, first.drop("date"), sym, "seq")
    assert again.count() == 0


# ----------------------------------------------------------------- ordered helpers
def test_sequence_and_halo_match_pandas(spark):
    import random
    random.seed(7)
    data = []
    for k in ("a", "b", "c"):
        t = T0
        for i in range(60):
            t = t + dt.timedelta(minutes=random.randint(1, 400))
            v = None if random.random() < 0.3 else float(random.randint(0, 9))
            data.append((k, t, i, v, random.randint(0, 5)))
    df = spark.createDataFrame(data, "k string, t timestamp_ntz, i int, v double, s int").repartition(7)
    seq = ordered.sequence(df, ["k"], ["t", "i"], ordered.seconds_chunk("t", 3600), rownum="g",
                           total="n", sums={"s": "cs"}, ffill={"v": "fv"}, prev={"v": "pv"},
                           nxt={"v": "nv"})
    got = seq.toPandas().sort_values(["k", "t", "i"]).reset_index(drop=True)
    pdf = pd.DataFrame(data, columns=["k", "t", "i", "v", "s"]).sort_values(["k", "t", "i"]).reset_index(drop=True)
    gb = pdf.groupby("k")
    assert (got["g"].values == (gb.cumcount() + 1).values).all()
    assert (got["cs"].values == gb["s"].cumsum().values).all()
    assert got["fv"].fillna(-1).tolist() == gb["v"].ffill().fillna(-1).tolist()
    assert got["pv"].fillna(-1).tolist() == gb["v"].shift(1).fillna(-1).tolist()
    assert got["nv"].fillna(-1).tolist() == gb["v"].shift(-1).fillna(-1).tolist()
    b = ordered.halo_blocks(seq, "g", 2, block_rows=5)
    w = ordered.block_window(["k"], "g", -2, 0)
    lag = b.withColumn("l2", F.lag("i", 2).over(
        __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("k", "_blk").orderBy("g"))) \
        .withColumn("cnt", F.count(F.lit(1)).over(w)).filter(~F.col("_halo")).toPandas() \
        .sort_values(["k", "g"]).reset_index(drop=True)
    assert lag["l2"].fillna(-1).tolist() == gb["i"].shift(2).fillna(-1).tolist()
    assert lag["cnt"].tolist() == [min(x, 3) for x in (gb.cumcount() + 1).tolist()]


def test_partition_independence(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/events.parquet") \
        .select(F.col("ts").alias("datetime"), F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
                F.col("value").alias("last"), (F.col("event_id") % 7).cast("int").alias("lastsize"),
                F.col("event_id"))
    a = B.resample_volume(t.repartition(1), 50, seq="event_id").collect()
    b = B.resample_volume(t.repartition(7), 50, seq="event_id").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


# ----------------------------------------------------------------- streaming
def test_late_row_beyond_watermark_is_dropped(spark):
    """Spark filters late rows against the previous batch's watermark, so the
    late row arrives in the third micro-batch (after the watermark moved)."""
    import time
    import uuid
    from barsmith.session import scratch_path
    from barsmith.streaming import streams as SS
    root = scratch_path(spark, "tests", f"late-{uuid.uuid4().hex}")
    schema = "symbol string, datetime timestamp_ntz, last double, lastsize int, id long"
    files = [[("X", T0 + dt.timedelta(seconds=s), 1.0 + s, 1, s) for s in range(0, 61, 3)],
             [("X", T0 + dt.timedelta(seconds=70), 71.0, 1, 70)],
             [("X", T0 + dt.timedelta(seconds=1), 99.0, 100, 1000)]]
    for i, rows_ in enumerate(files):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{root}/in/a={i}")
        time.sleep(1.1)
    stream = SS.file_stream(spark, f"{root}/in", schema + ", a int")
    bars = SS.stream_bars(stream.drop("a"), "5 seconds", "10 seconds", seq="id")
    out = spark.read.parquet(SS.run_to_table(bars, "late-test"))
    first = out.filter(F.col("datetime") == T0).first()
    assert first["high"] == 4.0 and first["volume"] == 2      # the late tick is not in [0 s, 5 s)
    assert out.count() == 12                                   # windows ending by the 60 s watermark


def test_stream_strategy_keeps_state_across_batches(spark):
    """A callback counting quotes per symbol sees the count carried over
    micro-batches by the state store."""
    import time
    import uuid
    from barsmith.session import scratch_path
    from barsmith.streaming import streams as SS
    root = scratch_path(spark, "tests", f"strat-{uuid.uuid4().hex}")
    schema = "symbol string, timestamp timestamp_ntz, last double"
    for i in range(3):
        rows_ = [("A", T0 + dt.timedelta(seconds=10 * i + j), float(j), ) for j in range(2)]
        spark.createDataFrame(rows_, schema).write.parquet(f"{root}/in/b={i}")
        time.sleep(1.1)
    stream = SS.file_stream(spark, f"{root}/in", schema + ", b int").drop("b")

    def count_rows(pdf, state):
        n = state.get("n", 0) + len(pdf)
        out = pd.DataFrame({"symbol": pdf["symbol"].iloc[:1], "n": [n]})
        return out, {"n": n}

    out = SS.stream_strategy(stream, count_rows, "symbol string, n long")
    got = sorted(r["n"] for r in spark.read.parquet(SS.run_to_table(out, "strategy")).collect())
    # one output row per micro-batch, each carrying the running count
    assert got[-1] == 6 and got == sorted(set(got)) and len(got) >= 3


def test_strategy_state_spans_chunks_and_partitions(spark, tmp_path):
    """Signals do not depend on partitioning, batch size or storage codec."""
    from barsmith.operators import strategies as SG
    rows_ = [("A", T0 + dt.timedelta(seconds=i // 3), i, float((i * 37) % 11)) for i in range(400)] + \
            [("B", T0 + dt.timedelta(hours=5 * i), i, float(i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows_, "symbol string, datetime timestamp_ntz, id int, last double")
    seen = []
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, parts, codec in (("10000", 1, "snappy"), ("7", 5, "zstd"), ("3", 2, "none")):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            path = f"{tmp_path}/{codec}"
            df.repartition(parts).write.option("compression", codec).parquet(path)
            out = SG.apply_strategy(spark.read.parquet(path), SG.session_breakout, order=("datetime", "id"))
            seen.append(sorted(map(tuple, out.collect())))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 40


def test_event_strategy_callbacks_know_quote_book_and_position(spark):
    from barsmith.operators import strategies as SG

    class Follow(SG.Strategy):
        def on_start(self, instrument, memo):
            memo["starts"] = memo.get("starts", 0) + 1

        def on_tick(self, instrument, memo):
            if instrument.quote and instrument.tick["price"] > instrument.quote["ask"]:
                instrument.signal(instrument.time, f"BUY{memo['starts']}", instrument.tick["price"])

        def on_fill(self, instrument, memo):
            instrument.signal(instrument.time, f"HAS{instrument.position}", instrument.avg_price)

        def on_bar(self, instrument, memo):
            instrument.signal(instrument.time, f"BOOK{instrument.orderbook['ask']:g}", instrument.bar["price"])

    def at(i):
        return T0 + dt.timedelta(days=i)
    rows_ = [("A", at(0), "QUOTE", None, 10.0, None), ("A", at(1), "TICK", 11.0, None, None), ("A", at(2), "TICK", 9.0, None, None),
             ("A", at(3), "FILL", 10.0, None, 2), ("A", at(4), "FILL", 13.0, None, 1), ("A", at(5), "FILL", 12.0, None, -3),
             ("A", at(6), "ORDERBOOK", None, 7.0, None), ("A", at(7), "BAR", 5.0, None, None), ("B", at(0), "TICK", 11.0, None, None)]
    df = spark.createDataFrame(rows_, "symbol string, datetime timestamp_ntz, kind string, price double, ask double, quantity int")
    out = SG.apply_strategy(df, Follow().rows(), session=None)
    assert [(r.signal, r.price) for r in out.orderBy("datetime").collect()] == [
        ("BUY1", 11.0), ("HAS2", 10.0), ("HAS3", 11.0), ("HAS0", 0.0), ("BOOK7", 5.0)]


def _ticks(spark, rows_):
    return spark.createDataFrame(rows_, "id long, datetime timestamp_ntz, symbol string, asset_class string, bid double, "
                                        "bidsize int, ask double, asksize int, last double, lastsize int")


def _tick(i, symbol="AAA", minute=None):
    return (i, T0 + dt.timedelta(minutes=i if minute is None else minute), symbol, "STK", 1.0, 1, 2.0, 1, float(i), 1)


def _feed(spark, root, batches):
    for i, b in enumerate(batches):
        _ticks(spark, b).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return _ticks(spark, []).schema


def test_ingest_first_by_seq_wins_within_and_across_batches(spark, tmp_path):
    from barsmith.streaming import streams as SS
    root = str(tmp_path)
    schema = _feed(spark, root, [[_tick(2, minute=0), _tick(1, minute=0), _tick(5)], [_tick(0, minute=0), _tick(6)]])
    s = SS.file_stream(spark, f"{root}/in", schema)
    SS.stream_ingest(s, f"{root}/store", f"{root}/dim", checkpoint=f"{root}/ck")
    from barsmith.operators import store as ST
    got = sorted(r["last"] for r in ST.read_store(spark, f"{root}/store").collect())
    assert got == [1.0, 5.0, 6.0]
    assert dict(spark.read.parquet(f"{root}/store").dtypes)["last"] == "decimal(20,8)"


def test_ingest_fails_on_an_unreadable_dimension(spark, tmp_path):
    import glob

    from barsmith.streaming import streams as SS
    root = str(tmp_path)
    schema = _feed(spark, root, [[_tick(1)]])
    SS.stream_ingest(SS.file_stream(spark, f"{root}/in", schema), f"{root}/store", f"{root}/dim", checkpoint=f"{root}/ck")
    for f in glob.glob(f"{root}/dim/epoch=*/*.parquet"):
        with open(f, "wb") as out:
            out.write(b"damaged")
    for f in glob.glob(f"{root}/dim/epoch=*/.*.crc"):
        open(f, "wb").close()
    _feed(spark, root, [[_tick(2, "BBB")]])
    before = spark.read.parquet(f"{root}/store").count()
    with pytest.raises(Exception):
        SS.stream_ingest(SS.file_stream(spark, f"{root}/in", schema), f"{root}/store", f"{root}/dim", checkpoint=f"{root}/ck")
    assert spark.read.parquet(f"{root}/store").count() == before


def test_list_versions_of_many_files_stay_whole_and_resume(spark, tmp_path):
    from barsmith import schemas
    from barsmith.streaming import streams as SS
    root = str(tmp_path)

    def version(n, keep):
        rows_ = [(f"S{i}", "STK", "SMART", "USD", None, None, None) for i in keep]
        SS.publish_version(spark.createDataFrame(rows_, schemas.INSTRUMENTS).repartition(4), root, n)

    def run():
        SS.stream_instrument_changes(spark, root, f"{root}/kept", as_of=dt.date(2024, 7, 1), path=f"{root}/changes",
                                     checkpoint=f"{root}/ck")
        return sorted((r["version"], r["change"], r["symbol"]) for r in spark.read.parquet(f"{root}/changes").collect())
    version(1, range(10))
    assert len(run()) == 10
    version(2, range(1, 11))
    assert run()[10:] == [(2, "ADDED", "S10"), (2, "REMOVED", "S0")]
    assert spark.read.parquet(f"{root}/kept").groupBy("version").count().filter("count = 10").count() == 2


def test_latest_table_and_publisher_resume(spark, tmp_path):
    from barsmith.operators import normalize as NO
    from barsmith.streaming import streams as SS
    root = str(tmp_path)
    for batch in ([_tick(1), _tick(2, "BBB")], [_tick(3)]):
        schema = _feed(spark, root, [batch])
        q = NO.normalize_quotes(SS.file_stream(spark, f"{root}/in", schema))
        SS.run_latest_table(SS.stream_latest(q), "latest", path=f"{root}/table", checkpoint=f"{root}/ck1")
        SS.publish_stream(q, f"{root}/topic", checkpoint=f"{root}/ck2")
    got = sorted((r["symbol"], r["last"]) for r in SS.read_latest_table(spark, f"{root}/table").collect())
    assert got == [("AAA", 3.0), ("BBB", 2.0)]
    assert spark.read.json(f"{root}/topic").count() == 3


def test_streams_read_tables_of_one_and_of_many_files(spark, tmp_path):
    from barsmith.plans import load_all
    from barsmith.sources.tables import DRIVER_TABLES, read_table
    from tests.conftest import SF_SMALL
    root = str(tmp_path)
    for t in DRIVER_TABLES:
        df = read_table(spark, SF_SMALL, t)
        (df.repartition(4) if t == "events" else df).write.parquet(f"{root}/{t}.parquet")
    reg = load_all()
    for name in ("stream_price_changes", "stream_bars", "stream_latest", "stream_message_rate", "stream_ingest",
                 "stream_publish_subscribe", "stream_normalize", "stream_message_rate_exact"):
        a, b = (sorted(map(str, reg[name].run(spark, d).collect())) for d in (SF_SMALL, root))
        assert a == b and a, name


@pytest.mark.parametrize("spread", [5000, 1])
def test_replay_slices_have_bounded_rows_and_come_in_order(spark, tmp_path, monkeypatch, spread):
    from barsmith.streaming import streams as SS
    monkeypatch.setattr(SS, "SLICE_ROWS", 500, raising=False)
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=i % spread), i) for i in range(5000)],
                               "t timestamp_ntz, i int").repartition(7)
    stream, seen = SS.replay(df, "t", path=f"{tmp_path}/feed", seq="i"), []
    SS.run_foreach_batch(stream, "replayed", lambda b, e: seen.append(sorted(r.i for r in b.collect())))
    assert len(seen) >= 9 and max(map(len, seen)) <= 1000
    assert [i for s in seen for i in s] == list(range(5000))


@pytest.mark.parametrize("spread", [500, 1])
def test_sequence_splits_hot_chunks(spark, spread):
    """A burst inside one chunk, or at one timestamp, is split by the full
    order key; numbering and carried values stay exact."""
    from barsmith.operators import ordered as O
    rows_ = [("a", T0 + dt.timedelta(seconds=i % spread), i, i if i % 7 == 0 else None) for i in range(3000)]
    df = spark.createDataFrame(rows_, "k string, t timestamp_ntz, i int, v int").repartition(5)
    out = O.sequence(df, ["k"], ["t", "i"], rownum="g", max_chunk_rows=100, ffill={"v": "f"}, prev={"i": "p"})
    got = out.toPandas().sort_values(["t", "i"]).reset_index(drop=True)
    assert got["g"].tolist() == list(range(1, 3001))
    assert got["f"].fillna(-1).tolist() == got["v"].ffill().fillna(-1).tolist()
    assert got["p"].fillna(-1).tolist() == got["i"].shift(1).fillna(-1).tolist()
    # the burst is sorted apart by range; without one nothing of that is planned
    plain = O.sequence(df, ["k"], ["t", "i"], rownum="g", max_chunk_rows=100_000, ffill={"v": "f"}, prev={"i": "p"})
    split, whole = (d._jdf.queryExecution().optimizedPlan().toString().count("LeftAnti") for d in (out, plain))
    assert split > 0 and whole == 0
    assert sorted(map(str, plain.collect())) == sorted(map(str, out.collect()))


def test_ingest_stream_resumes_from_checkpoint(spark):
    """A restarted ingest stream with the same checkpoint only processes new
    files, and replays never duplicate stored keys."""
    import time
    import uuid
    from barsmith.functions.scalars import asset_class
    from barsmith.session import scratch_path
    from barsmith.streaming import streams as SS
    root = scratch_path(spark, "tests", f"resume-{uuid.uuid4().hex}")
    schema = ("symbol string, datetime timestamp_ntz, bid double, bidsize int, ask double, asksize int, "
              "last double, lastsize int, id long")

    def drop(i, n):
        rows_ = [("X", T0 + dt.timedelta(minutes=10 * i + j), 1.0, 1, 1.1, 1, 1.05, 1, 100 * i + j)
                 for j in range(n)]
        spark.createDataFrame(rows_, schema).write.parquet(f"{root}/in/b={i}")
        time.sleep(1.1)

    def run():
        s = SS.file_stream(spark, f"{root}/in", schema + ", b int").drop("b") \
              .withColumn("asset_class", asset_class("symbol"))
        SS.stream_ingest(s, f"{root}/store", f"{root}/dim", checkpoint=f"{root}/ckpt")

    drop(0, 3)
    run()
    drop(1, 2)
    run()                                            # resumes: only the new folder
    store = spark.read.parquet(f"{root}/store")
    assert store.count() == 5 and store.select("datetime").distinct().count() == 5
    assert spark.read.parquet(f"{root}/dim").count() == 1   # the symbol was created once


def test_stream_bars_reject_sizes_not_dividing_a_day(spark):
    from barsmith.streaming import streams as SS
    df = spark.createDataFrame([("X", T0, 1.0, 1)], "symbol string, datetime timestamp_ntz, last double, lastsize int")
    with pytest.raises(ValueError):
        SS.stream_bars(df, "7 minutes")
    assert SS.window_seconds("15 minutes") == 900


def test_ticks_to_bars_without_keys_matches_pandas(spark):
    """A5 over the whole frame (no key), 7-minute bars from the first day's
    midnight, ticks without a price ignored."""
    rows_ = [(T0 + dt.timedelta(minutes=3 * i), None if i % 5 == 0 else float(i), i) for i in range(40)]
    df = spark.createDataFrame(rows_, "datetime timestamp_ntz, last double, lastsize int")
    pdf = pd.DataFrame(rows_, columns=["datetime", "last", "lastsize"]).dropna(subset=["last"]).set_index("datetime")
    exp = pdf.resample("7min").agg({"last": ["first", "max", "min", "last"], "lastsize": "sum"}).dropna()
    exp = {(ix.to_pydatetime(), r.iloc[0], r.iloc[1], r.iloc[2], r.iloc[3], int(r.iloc[4])) for ix, r in exp.iterrows()}
    got = {tuple(r) for r in B.ticks_to_bars(df, "7T", keys=[]).collect()}
    assert got == exp


def test_resample_reports_times_in_tz(seven_ticks):
    out = B.resample(seven_ticks, "3K", tz="Asia/Tokyo", sync_last_timestamp=False)
    assert min(r["datetime"] for r in out.collect()) == h(9)     # 10:00 UTC -> 19:00 Tokyo


def test_continuous_contract_on_bars_adjusts_all_prices(spark):
    d = dt.date
    rows_ = []
    for day in range(1, 7):
        t = dt.datetime(2024, 1, day, 12)
        rows_.append(("R", "R1", d(2024, 1, 3), t, 100.0 + day, 101.0 + day, 99.0 + day, 100.5 + day, 10))
        rows_.append(("R", "R2", d(2024, 1, 8), t, 110.0 + day, 111.0 + day, 109.0 + day, 110.5 + day, 20))
    bars = spark.createDataFrame(rows_, "root string, symbol string, expiry date, datetime timestamp_ntz, "
                                        "open double, high double, low double, close double, volume long")
    out = FU.continuous_contract(bars, price_cols=("open", "high", "low", "close"))
    got = {(r["datetime"].day, r["symbol"]): (r["open"], r["close"]) for r in out.collect()}
    # R1 owns Jan 1-3, R2 from Jan 4; gap on Jan 3 = R2 close - R1 close = 10
    assert set(got) == {(1, "R1"), (2, "R1"), (3, "R1"), (4, "R2"), (5, "R2"), (6, "R2")}
    assert got[(2, "R1")] == (112.0, 112.5)          # 102 + 10, 102.5 + 10
    assert got[(5, "R2")] == (115.0, 115.5)          # after the last roll: unadjusted


def test_exact_rate_stream_carries_state_across_batches(spark):
    """The last-N rate stream equals the batch rolling rate when the messages
    arrive in two micro-batches."""
    import time
    import uuid
    from barsmith.operators import monitoring as MO
    from barsmith.session import scratch_path
    from barsmith.streaming import streams as SS
    root = scratch_path(spark, "tests", f"rate-{uuid.uuid4().hex}")
    schema = "event_id long, ts timestamp_ntz, kind string, symbol string"
    times = [0, 1, 1, 3, 6, 7, 7, 12]
    rows_ = [(i, T0 + dt.timedelta(seconds=t), "TICK", "A") for i, t in enumerate(times)]
    for b, part in enumerate((rows_[:4], rows_[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{root}/in/b={b}")
        time.sleep(1.1)
    stream = SS.file_stream(spark, f"{root}/in", schema + ", b int").drop("b")
    got = spark.read.parquet(SS.run_to_table(SS.stream_message_rate_exact(stream, window=3, seq="event_id"),
                                             "rate-test"))
    got = {r["event_id"]: r["rate"] for r in got.collect()}
    batch = MO.rolling_message_rate(spark.createDataFrame(rows_, schema), seq="event_id", window=3)
    exp = {r["event_id"]: r["rate"] for r in batch.collect()}
    assert got == exp and exp[2] == 3.0 and exp[7] is not None
