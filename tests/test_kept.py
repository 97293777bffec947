"""The store of whole batches, its statistics and point reads."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from barsmith.operators import commits as CO
from barsmith.operators import partials as PA
from barsmith.operators import store as ST
from barsmith.session import scratch_path
from barsmith.streaming import streams as SS

BAR = "datetime timestamp_ntz, symbol_id long, open double, high double, low double, close double, volume long"
START = dt.datetime(2020, 1, 1)


def bars(spark, n=400, seed=1, symbols=6, days=900):
    rnd = random.Random(seed)
    keys = rnd.sample([(d, s) for d in range(days) for s in range(symbols)], n)
    rows = [(START + dt.timedelta(days=d, minutes=s), s, *(round(rnd.uniform(1, 9), 3) for _ in range(4)), rnd.randint(-2, 99))
            for d, s in keys]
    return spark.createDataFrame(rows, BAR)


def fresh(spark):
    return scratch_path(spark, "kept", uuid.uuid4().hex)


def stored(spark, path):
    return sorted(map(str, PA.doubles(CO.read(spark, path, "bars").drop("period")).collect()))


def test_a_batch_that_was_stopped_leaves_nothing(spark, monkeypatch):
    path, b = fresh(spark), bars(spark)
    one, two = b.where("symbol_id < 3"), b.where("symbol_id >= 3")
    assert CO.commit(one, path, "bars", "feed", 0)
    before = stored(spark, path)

    def stop(*_):
        raise RuntimeError("stopped")
    monkeypatch.setattr(CO, "_enter", stop)
    with pytest.raises(RuntimeError):
        CO.commit(b, path, "bars", "feed", 1)              # all its files are there, but no commit
    assert stored(spark, path) == before
    assert CO.read_partials(spark, path, "bars").agg(F.sum("n")).first()[0] == one.count()
    monkeypatch.undo()
    assert CO.commit(two, path, "bars", "feed", 1)         # the replay overwrites
    assert stored(spark, path) == sorted(map(str, b.collect()))
    assert not CO.commit(two, path, "bars", "feed", 1) and not CO.commit(two, path, "bars", "feed", 0)
    assert CO.read(spark, path, "bars").count() == b.count()


def test_a_compaction_that_was_stopped_changes_nothing(spark, monkeypatch):
    path, b = fresh(spark), bars(spark)
    for i in range(3):
        CO.commit(b.where(F.col("symbol_id") % 3 == i), path, "bars", "feed", i)
    want = stored(spark, path)
    enter = CO._enter
    monkeypatch.setattr(CO, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        CO.compact(spark, path, "bars", keep=2)
    assert stored(spark, path) == want
    monkeypatch.setattr(CO, "_enter", enter)
    reader = CO.read(spark, path, "bars")                   # planned before the compaction
    assert CO.compact(spark, path, "bars", keep=2) and not CO.compact(spark, path, "bars", keep=2)
    assert stored(spark, path) == want and reader.count() == b.count()
    assert [r["batch"][:7] for r in CO.commits(spark, path)] == ["compact"]
    assert not CO.commit(b, path, "bars", "feed", 2)        # its epoch is remembered
    assert CO.commit(b.limit(0), path, "bars", "feed", 3) and stored(spark, path) == want


def test_files_stay_bounded_over_many_batches(spark):
    path, b = fresh(spark), bars(spark, 60, symbols=3, days=20)
    for i in range(12):
        CO.commit(b.where(F.pmod(F.xxhash64("datetime"), F.lit(12)) == i), path, "bars", "feed", i)
        CO.compact(spark, path, "bars", keep=3)
    assert CO.read(spark, path, "bars").count() == 60 and len(CO.commits(spark, path)) <= 4
    files = [f for top, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet") and os.path.getsize(f"{top}/{f}") > 0]
    # live batches, those that the last compaction replaced, an empty file for each older one
    months = CO.read(spark, path, "bars").select("period").distinct().count()
    assert len(files) <= months * (1 + 2 * 4) + 16
    assert len(CO.read(spark, path, "bars").inputFiles()) <= 4 * months


def test_statistics_equal_a_full_scan_after_ingests_and_a_replay(spark):
    dim = spark.createDataFrame([(i, f"S{i}", f"S{i}", "STK") for i in range(8)], "id long, symbol string, symbol_group string, asset_class string")
    path, tpath = fresh(spark), fresh(spark)
    for epoch, seed in enumerate((1, 2, 3, 2)):            # keys overlap; the last is a batch again
        b = bars(spark, 250, seed).withColumn("symbol", F.concat(F.lit("S"), "symbol_id")).drop("symbol_id") \
            .withColumn("asset_class", F.lit("STK"))
        new = ST.ingest_bars(b, CO.overlapping(b, path, "bars"), dim, seq="volume")
        CO.commit(new, path, "bars", "feed", epoch)
        t = b.select("datetime", "symbol", "asset_class", F.col("open").alias("bid"), F.col("close").alias("ask"), F.col("high").alias("last"),
                     *(F.lit(v).alias(c) for c, v in (("bidsize", 1), ("asksize", -1), ("lastsize", 2))), F.col("volume").alias("id"))
        CO.commit(ST.ingest_ticks(t, CO.overlapping(t, tpath, "ticks"), dim, seq="id"), tpath, "ticks", "feed", epoch)
    CO.compact(spark, path, "bars", keep=2)
    rows, ticks = (PA.doubles(CO.read(spark, p, k).drop("period")) for p, k in ((path, "bars"), (tpath, "ticks")))
    assert rows.groupBy("datetime", "symbol_id").count().where("count > 1").count() == 0
    kb, kt = CO.read_partials(spark, path, "bars"), CO.read_partials(spark, tpath, "ticks")
    key = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert key(PA.symbol_statistics(kb, kt, dim)) == key(ST.symbol_statistics(rows, ticks, dim))
    assert key(PA.store_summary(dim, kb, kt)) == key(ST.store_summary(dim, rows, ticks))
    assert key(PA.quality_report(kb, kt)) == key(ST.quality_report(rows, ticks))
    for a in (PA.latest_rows(CO.read(spark, path, "bars"), kb, dim, "bars"), PA.latest_by_scan(CO.read(spark, path, "bars"), dim, "bars")):
        assert key(a) == key(ST.latest_bar(rows, dim))
    plan = PA.symbol_statistics(kb, kt, dim)._jdf.queryExecution().executedPlan().toString()
    assert "/data/" not in plan and "/partials/" in plan   # neither bars nor ticks are read




def test_latest_rows_read_the_newest_periods_only(spark):
    path = fresh(spark)
    everyday = [(START + dt.timedelta(days=31 * m, minutes=s), s, 1.0 + m, 2.0, 1.0, 1.5, m) for m in range(24) for s in range(5)]
    CO.commit(spark.createDataFrame(everyday, BAR), path, "bars", "feed", 0)
    dim = spark.createDataFrame([(i, f"S{i}") for i in range(9)], "id long, symbol string")
    store, kept = CO.read(spark, path, "bars"), CO.read_partials(spark, path, "bars")
    plan = PA.latest_rows(store, kept, dim, "bars")._jdf.queryExecution().executedPlan().toString()
    newest = max(PA.periods_of(store))
    assert f"PartitionFilters: [isnotnull(period" in plan and newest in plan and PA.periods_of(store)[1] not in plan

    read = []
    where = type(store).where

    def spied(self, cond):
        if "period >=" in str(cond) or "period" in str(cond):
            read.append(str(cond))
        return where(self, cond)
    wanted = spark.range(5).withColumnRenamed("id", "symbol_id")
    type(store).where = spied
    try:
        found = PA.newest_first(store, wanted, "bars").collect()
    finally:
        type(store).where = where
    assert len(read) == 1 and newest in read[0]            # all symbols traded in the newest period
    assert {r["volume"] for r in found} == {23}

    old = [(START - dt.timedelta(days=4000), 7, 5.0, 5.0, 5.0, 5.0, 777)]
    CO.commit(spark.createDataFrame(old, BAR), path, "bars", "feed", 1)
    store, kept = CO.read(spark, path, "bars"), CO.read_partials(spark, path, "bars")
    for got in (PA.latest_rows(store, kept, dim, "bars"), PA.latest_by_scan(store, dim, "bars")):
        assert {r["symbol"]: r["bar_volume"] for r in got.collect()} == {**{f"S{i}": 23 for i in range(5)}, "S7": 777}
    assert PA.newest_first(store.limit(0), wanted, "bars").count() == 0


def test_streamed_bars_commit_once_and_resume(spark):
    root = fresh(spark)
    dim = spark.createDataFrame([(i, f"S{i}", "STK") for i in range(8)], "id long, symbol string, asset_class string")
    raw = bars(spark, 120, days=60).withColumn("symbol", F.concat(F.lit("S"), "symbol_id")).drop("symbol_id") \
        .withColumn("asset_class", F.lit("STK")).withColumn("seq", F.col("volume"))

    def run(slow=False):
        SS.stream_to_store(SS.file_stream(spark, f"{root}/in", raw.schema), f"{root}/store", "bars", dim, "seq", checkpoint=f"{root}/ck", keep=2)
    for i in range(4):
        raw.where(F.pmod(F.xxhash64("datetime"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(f"{root}/in")
        run()
    raw.limit(50).coalesce(1).write.mode("append").parquet(f"{root}/in")        # seen before
    run()
    got = CO.read(spark, f"{root}/store", "bars")
    assert got.count() == 120 and got.select("datetime", "symbol_id").distinct().count() == 120
    assert CO.last_epoch(spark, f"{root}/store", "ingest") == 4
    assert CO.read_partials(spark, f"{root}/store", "bars").agg(F.sum("n")).first()[0] == 120


def test_compactions_rewrite_a_row_once_a_level():
    live, rewritten = [], 0
    for i in range(243):
        live.append({"batch": f"feed-{i:03d}", "epoch": i, "rows": 1, "replaces": []})
        merged, level = CO._overfull(live, 2)
        if merged:
            rows = sum(r["rows"] for r in merged)
            rewritten += rows
            live = [r for r in live if r not in merged] + [{"batch": f"compact-{i}", "epoch": level, "rows": rows, "replaces": [r["batch"] for r in merged]}]
        assert len(live) <= 2 * 5 + 1
    assert sum(r["rows"] for r in live) == 243 and rewritten <= 5 * 243


def test_levels_keep_rows_statistics_and_epochs(spark):
    path, b = fresh(spark), bars(spark, 60, symbols=3, days=20)
    for i in range(5):
        CO.commit(b.where(F.pmod(F.xxhash64("datetime"), F.lit(5)) == i), path, "bars", "feed", i)
        CO.compact(spark, path, "bars", keep=1)
    levels = [r["epoch"] for r in CO.commits(spark, path) if r["replaces"]]
    assert sorted(levels) == [2] and len(CO.commits(spark, path)) == 2
    assert stored(spark, path) == sorted(map(str, b.collect()))
    assert CO.read_partials(spark, path, "bars").agg(F.sum("n")).first()[0] == 60 and CO.last_epoch(spark, path, "feed") == 4


def test_a_compaction_merges_statistics_and_counts_no_rows(spark, monkeypatch):
    path, b = fresh(spark), bars(spark)
    for i in range(3):
        CO.commit(b.where(F.col("symbol_id") % 3 == i), path, "bars", "feed", i)
    want = sorted(map(str, CO.read_partials(spark, path, "bars").collect()))
    monkeypatch.setattr(PA, "partials", lambda *_: (_ for _ in ()).throw(RuntimeError("rows were counted again")))
    assert CO.compact(spark, path, "bars", keep=2)
    assert sorted(map(str, CO.read_partials(spark, path, "bars").collect())) == want
