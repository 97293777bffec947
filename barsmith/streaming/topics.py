"""S7 over one topic: messages of every kind on one feed, decoded and routed to
a table per kind, and those that cannot be decoded to a quarantine."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from barsmith.operators import normalize as NO
from barsmith.schemas import LEVEL
from barsmith.streaming import streams as SS

_META = "symbol string, symbol_group string, asset_class string, timestamp string, kind string, "
_LEVELS = f"array<{LEVEL.simpleString()}>"
#: what a message of each kind holds
KINDS = {
    "QUOTE": _META + "bid double, ask double, last double, bidSize double, askSize double, lastSize double, volume double",
    "TICK": _META + "price double, size double, volume double",
    "BAR": _META + "open double, high double, low double, close double, volume double",
    "ORDERBOOK": f"symbol string, timestamp string, kind string, bids {_LEVELS}, asks {_LEVELS}",
}
#: why a message is in quarantine
REASONS = ("not_json", "unknown_kind", "malformed", "missing:symbol", "missing:timestamp")
#: lines of a file that is appended to a topic, the most that a task reads of it:
#: compressed files are not split
FILE_LINES = 1_000_000
#: whether the shuffle files of a job go when it ends, not when the driver next collects garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def append(lines: DataFrame, topic: str) -> None:
    """Append lines (one text column) to a topic, in compressed files: as plain
    text a topic is many times larger than the tables that it carries.  What was
    shuffled to make the lines does not stay beside them."""
    spark = lines.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        lines.write.mode("append").option("compression", "lz4").option("maxRecordsPerFile", FILE_LINES).text(topic)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def publish(messages: DataFrame, topic: str, ts: str = "timestamp") -> None:
    """Append messages of any kind to a topic: a line of JSON each."""
    append(NO.publish_messages(messages, ts).select("value"), topic)


def _schema(ddl: str) -> StructType:
    return StructType([*StructType.fromDDL(ddl).fields, StructField("_bad", StringType())])


def decoded(lines: DataFrame) -> DataFrame:
    """``value, kind, reason`` and a struct per kind: every line decoded once,
    by the schema of the kind that it names.  ``reason`` is NULL for the good
    ones."""
    head = F.from_json("value", "kind string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("value", head.alias("_h")).withColumn("kind", F.col("_h.kind"))
    for kind, ddl in KINDS.items():
        body = F.from_json("value", _schema(ddl), {"columnNameOfCorruptRecord": "_bad"})
        rows = rows.withColumn(kind, F.when(F.col("kind") == kind, body))

    def of(field):
        return F.coalesce(*(F.col(f"{k}.{field}") for k in KINDS))
    reason = F.when(F.col("_h._bad").isNotNull() | F.col("_h").isNull(), REASONS[0]) \
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), REASONS[1]) \
        .when(of("_bad").isNotNull(), REASONS[2]) \
        .when(of("symbol").isNull(), REASONS[3]) \
        .when(F.try_to_timestamp(of("timestamp")).isNull(), REASONS[4])
    return rows.withColumn("reason", reason).drop("_h")


def subscribed(rows: DataFrame, kind: str, symbols: list[str] | None, tz: str) -> DataFrame:
    """The good messages of a kind as typed rows, in the zone asked for."""
    good = rows.where(F.col("reason").isNull() & (F.col("kind") == kind)).select(f"{kind}.*").drop("_bad")
    if symbols:
        good = good.where(F.col("symbol").isin(symbols))
    at = F.to_timestamp("timestamp")
    at = at if tz.upper() == "UTC" else F.from_utc_timestamp(at, tz)
    return good.withColumn("timestamp", at.cast("timestamp_ntz"))


def route_topic(spark: SparkSession, topic: str, out: str, symbols: str | list | None = None, tz: str = "UTC",
                name: str = "route-topic", checkpoint: str | None = None, trigger: dict | None = None,
                max_files: int = 64) -> dict[str, str]:
    """Follow a topic: each micro-batch is decoded once and its messages
    appended to ``<out>/<kind>``, what cannot be decoded to ``<out>/QUARANTINE``
    (line, reason).  ``symbols`` (comma separated or a list) are the ones
    subscribed to; messages of others are dropped, not quarantined.  Every table
    is partitioned by epoch and a replayed batch rewrites its own, so a message
    arrives once.  The decoded rows of a batch wait on disk, not in memory, for
    the tables to be written from them (a batch is as large as its files are);
    only lines for the quarantine are kept beside what they decode to."""
    if isinstance(symbols, str):
        symbols = [s.strip() for s in symbols.split(",") if s.strip()]
    lines = SS.file_stream(spark, topic, StructType([StructField("value", StringType())]), fmt="text", max_files=max_files)
    paths = {kind: f"{out}/{kind}" for kind in (*KINDS, "QUARANTINE")}

    def batch_fn(batch: DataFrame, epoch: int):
        rows = decoded(batch)
        line = F.when(F.col("reason").isNotNull(), F.col("value"))
        rows = rows.withColumn("value", line).persist(StorageLevel.DISK_ONLY)
        try:
            for kind, path in paths.items():
                part = subscribed(rows, kind, symbols, tz) if kind in KINDS else \
                    rows.where(F.col("reason").isNotNull()).select("value", "reason")
                part.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        finally:
            rows.unpersist(blocking=True)                   # off the disk before the next batch waits there

    SS.run_foreach_batch(lines, name, batch_fn, checkpoint=checkpoint, trigger=trigger)
    return paths
