"""As-of join and last order books against plain versions."""

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from barsmith.operators.asof import asof_join
from barsmith.session import scratch_path
from barsmith.streaming import books as BK
from barsmith.streaming import streams as SS

T0 = dt.datetime(2024, 1, 5, 9)


@pytest.mark.parametrize("max_age,chunk", [(None, 20_000_000), ("90 seconds", 20_000_000), (None, 50)])
def test_asof_matches_brute(spark, max_age, chunk):
    rnd = random.Random(3)
    keys = ["HOT"] * 5 + list("abcde")                         # one key with half of all rows
    left = [(i, rnd.choice(keys + [None]), None if rnd.random() < .02 else T0 + dt.timedelta(seconds=rnd.choice([0, 0, rnd.randint(0, 4000)])))
            for i in range(600)]
    right = [(rnd.choice(keys + [None]), None if rnd.random() < .02 else T0 + dt.timedelta(seconds=rnd.randint(-50, 4000)), i, rnd.choice([None, 1.5, 2.5]))
             for i in range(500)]
    right += [("HOT", T0, 1000 + i, float(i)) for i in range(300)]          # many at one time: the largest seq is in force
    lf = spark.createDataFrame(left + left[:5], "i long, k string, t timestamp_ntz").withColumn("_side", F.lit("own")).repartition(3)
    rf = spark.createDataFrame(right, "k string, t timestamp_ntz, s long, bid double").repartition(3)
    out = asof_join(lf, rf, "k", "t", ["bid", "s"], right_seq="s", max_age=max_age, max_chunk_rows=chunk)
    assert out.columns == ["i", "k", "t", "_side", "asof_ts", "bid", "s"]
    got = sorted(str(tuple(r)) for r in out.collect())
    want = []
    for i, k, t in left + left[:5]:
        known = [(rt, s, b) for rk, rt, s, b in right if rk == k and rt is not None and t is not None and rt <= t] if k is not None else []
        best = max(known, key=lambda r: r[:2], default=None)
        if best and max_age and best[0] < t - dt.timedelta(seconds=90):
            best = None
        want.append(str((i, k, t, "own", *((best[0], best[2], best[1]) if best else (None, None, None)))))
    assert got == sorted(want)
    assert asof_join(lf.limit(0), rf, "k", "t", ["bid"]).count() == 0
    assert asof_join(lf, rf.limit(0), "k", "t", ["bid"]).where("bid IS NULL").count() == len(left) + 5


UPDATE = "seq long, symbol string, datetime timestamp_ntz, side string, price double, size double, market_maker string"


def updates(n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["A", "B", "C"]), T0 + dt.timedelta(seconds=rnd.randint(0, 60)), rnd.choice(["BID", "ask"]), float(rnd.randint(1, 8)),
             rnd.choice([0.0, None, 1.0, 2.0, 5.0]), rnd.choice([None, "MM"])) for i in range(n)]
    return rows + [(n, None, T0, "BID", 1.0, 1.0, ""), (n + 1, "A", T0, "BID", None, 1.0, ""), (n + 2, "A", None, "BID", 1.0, 1.0, ""),
                   (n + 3, "A", T0, "BID", float("nan"), 1.0, ""), (n + 4, "D", T0, "BID", 1.0, 0.0, "")]


def brute_book(rows):
    newest = {}
    for seq, symbol, at, side, price, size, maker in rows:
        if None not in (symbol, price, at) and price == price:
            k = (symbol, side.upper(), price)
            newest[k] = max(newest.get(k, ((dt.datetime.min, -1),)), ((at, seq), size or 0.0, maker or ""), key=lambda v: v[0])
    return sorted((s, side, p, v[1], v[2]) for (s, side, p), v in newest.items() if v[1] > 0)


def levels(books):
    rows = BK.book_levels(books).collect()
    for side, down in (("BID", True), ("ASK", False)):
        for s in {r.symbol for r in rows}:
            mine = [r.price for r in sorted((r for r in rows if (r.symbol, r.side) == (s, side)), key=lambda r: r.place)]
            assert mine == sorted(mine, reverse=down)
    return sorted((r.symbol, r.side, r.price, r.size, r.market_maker) for r in rows)


def test_streamed_book_equals_batch_in_any_order_and_after_a_restart(spark):
    rows = updates()
    want = brute_book(rows)
    assert levels(BK.last_books(spark.createDataFrame(rows, UPDATE))) == want
    root = scratch_path(spark, "books", uuid.uuid4().hex)
    shuffled = random.Random(5).sample(rows, len(rows))
    size = len(rows) // 4 + 1
    for i in range(0, len(rows), size):                        # a restart between the parts
        spark.createDataFrame(shuffled[i:i + size], UPDATE).repartition(2).write.mode("append").parquet(f"{root}/in")
        src = SS.file_stream(spark, f"{root}/in", spark.createDataFrame([], UPDATE).schema)
        path = SS.run_keyed_table(BK.stream_book(src), "books", "symbol", path=f"{root}/out", checkpoint=f"{root}/ck")
    assert levels(SS.read_latest_table(spark, path)) == want
    last = {r.symbol: r.timestamp for r in SS.read_latest_table(spark, path).collect()}
    assert last == {s: max(r[2] for r in rows if r[1] == s and r[2] and r[4] and r[4] == r[4]) for s in "ABCD"}


def test_book_with_expiring_levels_runs(spark):
    root = scratch_path(spark, "books", uuid.uuid4().hex)
    spark.createDataFrame(updates(50), UPDATE).write.parquet(f"{root}/in")
    src = SS.file_stream(spark, f"{root}/in", spark.createDataFrame([], UPDATE).schema, max_files=100)
    path = SS.run_keyed_table(BK.stream_book(src, ttl_ms=3_600_000), "books", "symbol")
    assert levels(SS.read_latest_table(spark, path)) == brute_book(updates(50))
