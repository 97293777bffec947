"""Recorded table (A13, W3): sizes per task, odd rows, a plain version beside it."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barsmith.operators import recording as RC

SCHEMA = "id long, datetime timestamp_ntz, symbol string, asset_class string, open double, max_position int, position int"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


ROWS = [
    (1, at(0), "A", "x", 1.0, 5, 1),
    (2, at(0), "A", "x", 2.0, None, 9),
    (3, at(0), "B_FUT_X", "x", None, None, None),
    (4, at(1), "B_FUT_X", "x", 3.0, None, -1),
    (5, at(40), "A", "x", 4.0, None, 2),
    (6, at(40), None, "x", 7.0, 7, 7),
    (7, at(50), None, "x", 7.0, 7, 7),
    (8, at(90), "B_FUT_X", "x", 5.0, 6, None),
]


def plain(rows):
    """Wide rows by hand: datetime -> (A open, max, shifted, B open, max, shifted)."""
    first = {}
    for _, t, s, _, *values in sorted(r for r in rows if r[2]):
        held = first.setdefault(t, {}).setdefault(s, [None] * 3)
        held[:] = [v if h is None else h for h, v in zip(held, values)]
    out, before = {}, {}
    for t in sorted(first):
        cells = []
        for s in ("A", "B_FUT_X"):
            own, last = first[t].get(s, [None] * 3), before.get(s, [None] * 3)
            cells += [own[0], own[1], last[2] or 0]
        out[t], before = tuple(cells), first[t]
    return out


@pytest.mark.parametrize("symbols", [["A", "B_FUT_X"], None])
def test_pivot_against_plain(spark, symbols):
    """A field whose name only ends in "position" keeps its nulls."""
    wide = RC.recorded_pivot(spark.createDataFrame(ROWS, SCHEMA), symbols, seq="id")
    assert wide.columns == ["datetime", "A_OPEN", "A_MAX_POSITION", "A_POSITION", "B_X_OPEN", "B_X_MAX_POSITION", "B_X_POSITION"]
    assert {r[0]: tuple(r[1:]) for r in wide.collect()} == plain(ROWS)


def test_only_chosen_symbols(spark):
    wide = RC.recorded_pivot(spark.createDataFrame(ROWS, SCHEMA), ["A", "C"], seq="id")
    got = {r["datetime"]: r for r in wide.collect()}
    assert set(got) == set(plain(ROWS)) and wide.columns[4:] == ["C_OPEN", "C_MAX_POSITION", "C_POSITION"]
    assert got[at(90)]["A_POSITION"] == 2 and got[at(90)]["C_OPEN"] is None and got[at(90)]["C_POSITION"] == 0


def test_one_field(spark):
    events = spark.createDataFrame(ROWS, SCHEMA).select("id", "datetime", "symbol", "open")
    wide = RC.recorded_pivot(events, ["A"], seq="id")
    assert {r["datetime"]: r["A_OPEN"] for r in wide.collect()} == {at(0): 1.0, at(1): None, at(40): 4.0, at(90): None}


def test_a_task_takes_few_wide_rows(spark, monkeypatch):
    """Tasks follow the number of rows; no aggregate holds whole wide rows."""
    monkeypatch.setattr(RC, "TASK_ROWS", 100)
    n = 4000
    events = spark.range(n).select(
        "id", (F.lit(at(0)) + F.make_dt_interval(secs=F.col("id") * 60)).cast("timestamp_ntz").alias("datetime"),
        F.concat(F.lit("S"), F.col("id") % 80).alias("symbol"), F.col("id").cast("double").alias("open"),
        (F.col("id") % 3 - 1).cast("int").alias("position"))
    wide = RC.recorded_pivot(events, [f"S{i}" for i in range(80)], seq="id")
    assert "pivotfirst" not in wide._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r[0] for r in wide.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == n and max(sizes) <= 200


def test_symbols_beyond_the_bound(spark):
    spark.conf.set("spark.sql.pivotMaxValues", "1")
    try:
        with pytest.raises(ValueError, match="pivotMaxValues"):
            RC.recorded_pivot(spark.createDataFrame(ROWS, SCHEMA), seq="id")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_export_is_written_in_parts(spark, monkeypatch, tmp_path):
    """The files hold the whole wide table, in parts that follow its rows."""
    monkeypatch.setattr(RC, "TASK_ROWS", 2)
    wide = RC.recorded_pivot(spark.createDataFrame(ROWS * 3, SCHEMA), ["A", "B_FUT_X"], seq="id")
    RC.export_recorded(wide, str(tmp_path / "rec"))
    back = spark.read.parquet(str(tmp_path / "rec"))
    assert back.columns == wide.columns and {r[0]: tuple(r[1:]) for r in back.collect()} == plain(ROWS)
    assert wide.rdd.getNumPartitions() == 5
