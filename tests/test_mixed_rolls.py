"""Continuous contracts whose pairs roll by expiry or by volume."""

import datetime as dt

from pyspark.sql import functions as F

from barsmith.operators import futures as FU
from barsmith.sources.fixtures import register_fixtures
from tests.conftest import SF_ORACLE

D = dt.date(2024, 1, 1)
DAY = dt.timedelta(days=1)


def ticks(spark, contracts, days=10):
    """contracts: {symbol: (expiry or None, [volume a day], price)}"""
    rows = [("R", s, dt.datetime.combine(D + i * DAY, dt.time(10)), e, p + i, v, i)
            for s, (e, vs, p) in contracts.items() for i, v in enumerate(vs[:days]) if v is not None]
    return spark.createDataFrame(rows, "root string, symbol string, datetime timestamp_ntz, expiry date, last double, lastsize int, id long")


def owners(df):
    return {r.datetime.date().day: (r.symbol, r.last) for r in df.collect()}


def test_all_expiries_are_as_before(spark):
    register_fixtures(spark, SF_ORACLE, ["fx_fut_ticks"])
    t = spark.table("fx_fut_ticks")
    for mode in ("last", "cumulative"):
        a, b = (sorted(map(str, f(t, seq="event_id", gap_mode=mode).select("event_id", "symbol", "last").collect()))
                for f in (FU.continuous_contract, FU.continuous_mixed))
        assert a == b and a


def test_pairs_roll_by_expiry_or_by_volume(spark):
    t = ticks(spark, {"A": (D + 2 * DAY, [9] * 10, 100.0), "B": (None, [5, 5, 5, 5, 5, 4, 3, 5, 5, 5], 200.0),
                      "C": (None, [1, 1, 1, 1, 4, 9, 9, 1, 1, 1], 300.0)})
    # A until its expiry (day 3), B until the last day C traded more (day 7), then C
    got = owners(FU.continuous_mixed(t, seq="id"))
    assert [got[d][0] for d in range(1, 11)] == ["A"] * 3 + ["B"] * 4 + ["C"] * 3
    cal = {r.symbol: (r.start_day, r.end_day) for r in FU.mixed_roll_calendar(FU.listed_contracts(
        FU.daily_last(t, ("root", "symbol"), "datetime", "id", ["expiry", "last"]).join(
            t.select("root", "symbol", F.to_date("datetime").alias("date"), F.col("lastsize").alias("volume")), ["root", "symbol", "date"]))).collect()}
    assert cal == {"A": (None, D + 2 * DAY), "B": (D + 2 * DAY, D + 6 * DAY), "C": (D + 6 * DAY, None)}
    # the last roll's gap (C less B on day 7) moves all before it, up to and with that day
    assert got[8][1] == 307.0 and got[1][1] == 100.0 + 100.0 and got[7][1] == 206.0 + 100.0


def test_a_contract_that_nothing_follows_stays(spark):
    t = ticks(spark, {"A": (None, [9] * 10, 100.0), "B": (D + 5 * DAY, [1] * 10, 200.0), "C": (None, [1] * 10, 300.0)})
    got = owners(FU.continuous_mixed(t, seq="id"))
    assert {s for s, _ in got.values()} == {"A"} and [got[d][1] for d in (1, 10)] == [100.0, 109.0]


def test_a_volume_roll_before_the_start_is_an_empty_slot(spark):
    t = ticks(spark, {"A": (D + 5 * DAY, [9] * 10, 100.0), "B": (None, [1, 9, 9, 9, 9, 9, 9, 9, 9, 9], 200.0),
                      "C": (None, [2, 1, 1, 1, 1, 1, 1, 1, 1, 1], 300.0)})
    got = owners(FU.continuous_mixed(t, seq="id"))            # C traded more than B on the first day only
    assert [got[d][0] for d in range(1, 11)] == ["A"] * 6 + ["C"] * 4
    assert FU.continuous_mixed(t.limit(0), seq="id").count() == 0
