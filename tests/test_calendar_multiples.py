"""Bars of several weeks or months against pandas, order of ordered results."""

import datetime as dt
import random

import pandas as pd
import pytest

from barsmith.functions.timeutil import bucket_start, parse_resolution
from barsmith.operators import bars as B
from barsmith.plans import load_all
from barsmith.plans.q_recording import listed
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("resolution,alias", [("2W", "2W-SUN"), ("3W", "3W-SUN"), ("3M", "3ME"), ("2M", "2ME"), ("12M", "12ME"), ("1W", "W-SUN")])
def test_labels_are_those_of_pandas(spark, resolution, alias):
    rnd = random.Random(resolution)
    for first in (dt.datetime(2024, 1, 31, 5), dt.datetime(2023, 10, 1), dt.datetime(2024, 2, 29, 23)):
        times = sorted({first} | {first + dt.timedelta(days=rnd.randint(0, 700), minutes=rnd.randint(0, 1439)) for _ in range(150)})
        pdf = pd.DataFrame({"symbol": "A", "datetime": times, "open": [float(i) for i in range(len(times))]})
        pdf = pdf.assign(high=pdf.open, low=pdf.open, close=pdf.open, volume=1)
        want = pdf.set_index("datetime").resample(alias).agg({"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum"})
        want = want[want.volume > 0]
        got = B.resample_bars_time(spark.createDataFrame(pdf), resolution, ffill=False).orderBy("datetime").toPandas()
        assert [str(t) for t in got.datetime] == [str(t) for t in want.index]
        assert got[["open", "high", "low", "close", "volume"]].to_numpy().tolist() == want.to_numpy().tolist()


def test_gaps_of_several_months_are_filled_on_the_grid(spark):
    rows = [("A", dt.datetime(2020, 1, 15), 1.0, 2.0, 1.0, 1.5, 5), ("A", dt.datetime(2021, 2, 3), 2.0, 2.0, 2.0, 2.0, 7)]
    df = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume long")
    got = B.resample_bars_time(df, "3M").orderBy("datetime").collect()
    assert [str(r.datetime.date()) for r in got] == ["2020-01-31", "2020-04-30", "2020-07-31", "2020-10-31", "2021-01-31", "2021-04-30"]
    assert [r.volume for r in got] == [5, 0, 0, 0, 0, 7] and [r.close for r in got] == [1.5] * 5 + [2.0]


def test_an_origin_is_needed_and_lengths_are_positive():
    with pytest.raises(ValueError):
        bucket_start("t", parse_resolution("2M"))
    with pytest.raises(ValueError):
        parse_resolution("0W")


@pytest.mark.parametrize("name,by", [("closed_trades_report", [("exit_time", True)]), ("historical_bars", [("symbol", False), ("datetime", False)]),
                                     ("historical_ticks", [("symbol", False), ("datetime", False)])])
def test_ordered_results_come_in_order(spark, name, by):
    """T4: reports newest first, histories by symbol and time."""
    rows = load_all()[name].run(spark, SF_SMALL).select(*[c for c, _ in by]).collect()
    assert len(rows) > 1
    for a, b in zip(rows, rows[1:]):
        for c, down in by:
            if a[c] != b[c]:
                assert (a[c] > b[c]) == down
                break


def test_an_instrument_that_is_not_listed_fails(spark):
    df = spark.createDataFrame([("S00",), (None,)], "symbol string")
    assert listed(df).count() == 2
    with pytest.raises(Exception, match="instrument is not listed: S99"):
        listed(spark.createDataFrame([("S99",)], "symbol string")).collect()


@pytest.mark.parametrize("how", [{"resolution": "1M"}, {"resolution": "1D"}, {"resolution": "3M", "ffill": False}])
def test_bars_are_read_and_shuffled_once(spark, how):
    rows = [(s, dt.datetime(2024, 1, 1 + d), g if d < 3 else None, "STK", float(d), 9.0, 0.5, 1.0 + d, 1)
            for s, g in (("A", "x"), ("B", "y")) for d in (0, 2, 5)]
    bars = spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, symbol_group string, asset_class string, "
                                       "open double, high double, low double, close double, volume long")
    out = B.resample_bars_time(bars, **how)
    assert "ExistingRDD" not in out._jdf.queryExecution().executedPlan().toString()     # the bars themselves
    got = out.where("symbol = 'A'").orderBy("datetime").collect()
    assert {r.symbol_group for r in got} == {"x"} and [r.volume for r in got] == ([1, 0, 1, 0, 0, 1] if how["resolution"] == "1D" else [3])
