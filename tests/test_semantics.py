"""Clause-level checks of catalogue, futures and store semantics."""

import datetime as dt

from pyspark.sql import functions as F

from barsmith import schemas
from barsmith.operators import catalog as CA
from barsmith.operators import futures as FU
from barsmith.operators import monitoring as MO
from barsmith.operators import store as ST


def test_spec_lookup_rules(spark):
    specs = spark.createDataFrame(
        [(1, "CME", "ES", "ESC", "USD"), (2, "GLOBEX", "ES", "ESC", "USD"), (3, "CME", "NQ", "NQC", "USD"),
         (4, "ICE", "CL", "ENERGY", "USD"), (5, "NYMEX", "QM", "ENERGY", "USD")],
        "listing_order int, exchange string, symbol string, class string, currency string")
    req = spark.createDataFrame(
        [("a", "es", None), ("b", "ENERGY", None), ("c", "ES", "CME"), ("d", "ENERGY", "ICE"),
         ("e", "ZZ", None), ("f", "ES", "EUREX")], "req_id string, symbol string, exchange string")
    got = {r["req_id"]: (r["spec_exchange"], r["spec_symbol"])
           for r in FU.futures_spec_lookup(specs, req).collect()}
    assert got["a"] == ("CME", "ES")          # first on symbol (listing order)
    assert got["b"] == ("ICE", "CL")          # first on class
    assert got["c"] == ("CME", "ES")          # unique (exchange, symbol)
    assert got["d"] == ("ICE", "CL")          # unique (exchange, class)
    assert got["e"] == (None, None) and got["f"] == (None, None)


def test_active_contract_rules(spark):
    rows = [("A", 1, "202401", 500), ("A", 2, "202402", 900), ("A", 3, "202403", 900), ("A", 4, "TOTAL", 99999),
            ("B", 1, "202402", 10), ("B", 2, "202403", 50), ("B", 3, "TOTAL", 60),
            ("C", 1, "TOTAL", 1)]
    s = spark.createDataFrame(rows, "root string, listing_order int, expiry string, volume long")
    before = {r["root"]: (r["expiry"], r["is_fallback"]) for r in
              FU.active_contract(s, as_of=dt.datetime(2024, 1, 10)).collect()}
    assert before["A"] == ("202403", False)   # greatest (volume, expiry); totals row dropped
    assert before["B"] == ("202402", False)   # no volume > 100: first listed
    assert before["C"] == ("202402", True)    # nothing left: one month ahead
    after = {r["root"]: r["expiry"] for r in
             FU.active_contract(s, as_of=dt.datetime(2024, 1, 25)).collect()}
    assert after["C"] == "202403"             # two months ahead after the third Friday


def test_live_instruments_rules(spark):
    rows = [("AAPL", "STK", None, None, None, None, None), ("ESZ3", "FUT", "CME", "USD", 202312.0, None, None),
            ("ESH4", "FUT", "CME", "USD", 202403.0, None, None), ("OPT1", "OPT", "SMART", "USD", 20240105.0, 100.0, "C"),
            ("OPT2", "OPT", "SMART", "USD", 20240125.0, 100.0, "P"), ("SPREAD", "BAG", "SMART", "USD", None, None, None),
            ("#MSFT", "STK", "SMART", "USD", None, None, None)]
    df = spark.createDataFrame(rows, schemas.INSTRUMENTS)
    got = {r["symbol"]: r for r in CA.live_instruments(df, dt.date(2024, 1, 15)).collect()}
    assert set(got) == {"AAPL", "ESH4", "OPT2"}
    assert got["AAPL"]["expiry"] == "" and got["AAPL"]["exchange"] == "" and got["AAPL"]["strike"] == 0.0
    assert got["ESH4"]["expiry"] == "202403"
    kept = {r["symbol"] for r in CA.clean_instruments(df, dt.date(2024, 1, 15)).collect()}
    assert "#MSFT" in kept                    # comments stay in the saved list


def test_register_and_changes(spark):
    old = spark.createDataFrame([("AAPL", "STK", "SMART", "USD", None, 0.0, "")], schemas.INSTRUMENTS)
    new = spark.createDataFrame([("AAPL", "STK", "SMART", "USD", None, 1.0, "X"),
                                 ("MSFT", "STK", "SMART", "USD", None, None, None)], schemas.INSTRUMENTS)
    reg = {r["symbol"]: r for r in CA.register_instruments(CA.clean_instruments(old), CA.normalize_new(new)).collect()}
    assert reg["AAPL"]["strike"] == 0.0       # the saved row wins
    assert set(reg) == {"AAPL", "MSFT"}
    ch = {(r["symbol"], r["change"]) for r in CA.instrument_changes(
        CA.live_instruments(old), CA.live_instruments(new)).collect()}
    assert ch == {("AAPL", "ADDED"), ("MSFT", "ADDED"), ("AAPL", "REMOVED")}


def test_symbol_ids_get_or_create(spark):
    dim = spark.createDataFrame([(7, "AAPL", "AAPL", "STK", None)], schemas.SYMBOLS)
    req = spark.createDataFrame([("AAPL", "STK"), ("MSFT", None), ("ES", "FUT"), ("AAPL", "OPT")],
                                "symbol string, asset_class string")
    got = {(r["symbol"], r["asset_class"]): r["id"] for r in ST.assign_symbol_ids(req, dim).collect()}
    assert got == {("AAPL", "STK"): 7, ("AAPL", "OPT"): 8, ("ES", "FUT"): 9, ("MSFT", "STK"): 10}


def test_health_rollup_statuses(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(t, "db", "unhealthy"), (t + dt.timedelta(seconds=1), "db", "healthy"),
                                 (t, "bus", "degraded")], "ts timestamp_ntz, component string, status string")
    r = MO.health_rollup(log).first()
    assert (r["status"], r["message"], r["healthy"], r["degraded"]) == ("degraded", "1 component(s) degraded", 1, 1)
    empty = spark.createDataFrame([], "ts timestamp_ntz, component string, status string")
    assert MO.health_rollup(empty).first()["status"] == "unknown"


def test_rolling_rate_needs_two_messages_and_a_span(spark):
    t = dt.datetime(2024, 1, 1)
    msgs = spark.createDataFrame([("TICK", "A", t), ("TICK", "A", t), ("TICK", "A", t + dt.timedelta(seconds=2))],
                                 "kind string, symbol string, ts timestamp_ntz")
    rates = [r["rate"] for r in MO.rolling_message_rate(msgs).orderBy("ts").collect()]
    assert rates[0] is None and rates[1] is None and rates[2] == 1.5
