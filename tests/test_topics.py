"""One topic of every kind, routed once, with a quarantine."""

import collections
import glob
import json
import os
import time
import uuid

from pyspark.sql import functions as F

from barsmith.session import scratch_path
from barsmith.streaming import topics as TP
from tests.conftest import SF_SMALL

META = {"symbol": "S1", "symbol_group": "S", "asset_class": "STK", "timestamp": "2024-01-05T10:00:00.250000"}


def lines():
    good = [{**META, "kind": "QUOTE", "bid": 1.5, "ask": 2}, {**META, "kind": "TICK", "price": 3.25, "size": None},
            {**META, "kind": "BAR", "open": 1, "close": 2.5, "volume": 7}, {**META, "kind": "TICK", "symbol": "S2", "price": 4.0},
            {"symbol": "S1", "timestamp": META["timestamp"], "kind": "ORDERBOOK", "bids": [{"price": 1.0, "size": 2.0, "market_maker": ""}], "asks": []}]
    bad = [("not_json", "{\"symbol\": \"S1\", \"ki"), ("not_json", "plain text"), ("unknown_kind", json.dumps({**META, "kind": "NEWS"})),
           ("unknown_kind", json.dumps(META)), ("malformed", json.dumps({**META, "kind": "QUOTE", "bid": "much"})),
           ("missing:symbol", json.dumps({"kind": "BAR", "timestamp": META["timestamp"]})),
           ("missing:timestamp", json.dumps({"kind": "TICK", "symbol": "S1", "price": 1.0})),
           ("missing:timestamp", json.dumps({**META, "kind": "TICK", "timestamp": "soon"})), ("not_json", "")]
    return good, bad


def test_every_line_is_routed_or_quarantined_once(spark, monkeypatch):
    good, bad = lines()
    root = scratch_path(spark, "topics", uuid.uuid4().hex)
    rows = [json.dumps(g) for g in good] * 3 + [b for _, b in bad]
    run = lambda **how: TP.route_topic(spark, f"{root}/topic", f"{root}/out", checkpoint=f"{root}/ck", max_files=1, **how)
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    df.repartition(3).write.mode("append").text(f"{root}/topic")

    calls, write = [], TP.subscribed

    def stop_in_the_middle(rows, kind, *a):
        calls.append(kind)
        if len(calls) == 6:
            raise RuntimeError("stopped")
        return write(rows, kind, *a)
    monkeypatch.setattr(TP, "subscribed", stop_in_the_middle)
    try:
        run()
    except Exception as e:  # noqa: BLE001
        assert "stopped" in str(e)
    monkeypatch.setattr(TP, "subscribed", write)
    df.limit(0).write.mode("append").text(f"{root}/topic")
    tables = run()                                             # replays the batch that was stopped
    df.write.mode("append").text(f"{root}/topic")
    tables = run()
    got = {k: [r.asDict(recursive=True) for r in spark.read.parquet(p).drop("epoch").collect()] for k, p in tables.items()}
    assert {k: len(v) for k, v in got.items()} == {"QUOTE": 6, "TICK": 12, "BAR": 6, "ORDERBOOK": 6, "QUARANTINE": 2 * len(bad)}
    assert collections.Counter((r["reason"], r["value"]) for r in got["QUARANTINE"]) == collections.Counter(bad * 2)
    assert got["ORDERBOOK"][0]["bids"] == [{"price": 1.0, "size": 2.0, "market_maker": ""}]
    assert {r["price"] for r in got["TICK"]} == {3.25, 4.0} and {str(r["timestamp"]) for r in got["BAR"]} == {"2024-01-05 10:00:00.250000"}


def test_symbols_and_zone(spark):
    root = scratch_path(spark, "topics", uuid.uuid4().hex)
    good, _ = lines()
    spark.createDataFrame([(json.dumps(g),) for g in good], "value string").write.text(f"{root}/topic")
    tables = TP.route_topic(spark, f"{root}/topic", f"{root}/out", symbols=" S2 ,S9", tz="America/New_York")
    assert {k: spark.read.parquet(p).count() for k, p in tables.items()} == {
        "QUOTE": 0, "TICK": 1, "BAR": 0, "ORDERBOOK": 0, "QUARANTINE": 0}
    assert str(spark.read.parquet(tables["TICK"]).first().timestamp) == "2024-01-05 05:00:00.250000"
    assert os.path.isdir(f"{root}/out/TICK/epoch=0")


def test_a_batch_waits_on_disk_and_keeps_bad_lines_only(spark, monkeypatch):
    good, bad = lines()
    root = scratch_path(spark, "topics", uuid.uuid4().hex)
    spark.createDataFrame([(json.dumps(g),) for g in good] + [(b,) for _, b in bad], "value string").write.text(f"{root}/topic")
    seen, write = [], TP.subscribed

    def spied(rows, kind, *a):
        seen.append((rows.storageLevel.useMemory, rows.storageLevel.useDisk, rows.where("reason IS NULL AND value IS NOT NULL").count()))
        return write(rows, kind, *a)
    monkeypatch.setattr(TP, "subscribed", spied)
    tables = TP.route_topic(spark, f"{root}/topic", f"{root}/out")
    assert seen == [(False, True, 0)] * 4
    assert sorted(r["value"] for r in spark.read.parquet(tables["QUARANTINE"]).collect()) == sorted(b for _, b in bad)


def test_a_topic_takes_less_than_its_text_and_is_read_whole(spark, monkeypatch):
    monkeypatch.setattr(TP, "FILE_LINES", 500, raising=False)
    root = scratch_path(spark, "topics", uuid.uuid4().hex)
    ticks = spark.range(3000).select(F.lit("S1").alias("symbol"), F.timestamp_seconds(F.col("id") + 1.7e9).alias("timestamp"),
                                     F.lit("TICK").alias("kind"), (F.col("id") + 0.25).alias("price"))
    TP.publish(ticks.coalesce(2), f"{root}/topic")
    names = glob.glob(f"{root}/topic/part-*")
    text = spark.read.text(f"{root}/topic").agg(F.sum(F.length("value") + 1)).first()[0]
    assert sum(os.path.getsize(n) for n in names) < text / 2
    assert len(names) == 6 and all(spark.read.text(n).count() == 500 for n in names)
    good, bad = lines()
    plain = spark.createDataFrame([(json.dumps(g),) for g in good] + [(b,) for _, b in bad], "value string")
    plain.write.mode("append").text(f"{root}/topic")           # others may write it as plain text
    TP.append(plain, f"{root}/topic")
    tables = TP.route_topic(spark, f"{root}/topic", f"{root}/out", max_files=3)
    got = {k: spark.read.parquet(p) for k, p in tables.items()}
    assert {k: v.count() for k, v in got.items()} == {"QUOTE": 2, "TICK": 3004, "BAR": 2, "ORDERBOOK": 2, "QUARANTINE": 2 * len(bad)}
    assert sorted(r.price for r in got["TICK"].collect()) == sorted([i + 0.25 for i in range(3000)] + [3.25, 4.0] * 2)


def test_the_query_writes_its_whole_topic_compressed(spark, monkeypatch):
    from barsmith.plans import load_all
    topics, run = [], TP.route_topic
    monkeypatch.setattr(TP, "route_topic", lambda spark, topic, *a, **how: (topics.append(topic), run(spark, topic, *a, **how))[1])
    load_all()["route_topic"].run(spark, SF_SMALL)
    names = glob.glob(f"{topics[0]}/part-*")
    assert len(names) >= 5 and all(n.endswith(".txt.lz4") for n in names)


def test_what_was_shuffled_for_a_topic_goes_when_it_is_written(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {n for d in manager.localDirsString() for n in glob.glob(f"{d}/*/shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    root, setting = scratch_path(spark, "topics", uuid.uuid4().hex), spark.conf.get(key, None)
    before = shuffled()
    good, _ = lines()
    plain = spark.createDataFrame([(json.dumps(g),) for g in good], "value string").repartition(3)
    plain.write.text(f"{root}/other")
    kept = shuffled() - before
    TP.publish(spark.read.json(f"{root}/other").where("kind = 'TICK'").withColumn("timestamp", F.to_timestamp("timestamp")).repartition(3), f"{root}/topic")
    until = time.time() + 20
    while shuffled() - before - kept and time.time() < until:
        time.sleep(0.2)
    assert kept and not shuffled() - before - kept
    assert spark.conf.get(key, None) == setting and spark.read.text(f"{root}/topic").count() == 2
