"""Structured Streaming forms of the operators.

TS1 stream_normalize, TS2 stream_bars, TS3 stream_latest, TS4
stream_message_rate, TS5 stream_ingest, TS6 stream_price_changes,
TS7 stream_instrument_changes, plus the sources / sinks they run on.

Event time: parquet timestamps are TIMESTAMP_NTZ; ``withWatermark`` needs a
TIMESTAMP, so :func:`event_time` casts (session zone UTC) before any
watermark.  Every runner takes ``checkpoint``, ``path`` and ``trigger``: with
a stable checkpoint and path a stream resumes where it stopped, without them a
one-off run gets fresh folders below ``spark.checkpoint.dir``.  Sinks are
idempotent (file sink commit log, or foreachBatch writes keyed by epoch or
version / anti-joined on keys).
"""

from __future__ import annotations

import time
import uuid

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from barsmith import schemas
from barsmith.operators import catalog as CA
from barsmith.operators import commits as CO
from barsmith.operators import normalize as NO
from barsmith.operators import store as ST
from barsmith.session import scratch_path
from barsmith.sources.instruments import CANONICAL


# --------------------------------------------------------------------- sources / sinks
def file_stream(spark: SparkSession, directory: str, schema, fmt: str = "parquet",
                glob: str | None = None, max_files: int = 1, max_bytes: str | None = None, **options) -> DataFrame:
    """A file source: new files in ``directory`` become micro-batches of at
    most ``max_files`` files, or of ``max_bytes`` (the bound on what a stateful
    callback can get of one key at once)."""
    r = spark.readStream.format(fmt).schema(schema)
    r = r.option("maxBytesPerTrigger", max_bytes) if max_bytes else r.option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load(directory)


NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"

#: rows of a replayed file, the most that a micro-batch of a replay takes
SLICE_ROWS = 500_000
#: files that a micro-batch of a wide replay takes side by side
WIDE_FILES = 12


def replay(df: DataFrame, ts: str, slices: int = 3, path: str | None = None, seq: str | None = None,
           wide: bool = False) -> DataFrame:
    """A recorded table as the feed it came from: its rows are written again in
    consecutive time ranges of about ``SLICE_ROWS`` rows (``slices`` of them at
    least), a file each and side by side, and streamed a file at a time, oldest
    first.  ``seq`` orders rows of one time, which may then be split.  Reads the
    whole table, however many files it has.

    ``wide``: for streams that never hold a key's rows of a micro-batch at once.
    Up to ``WIDE_FILES`` consecutive files are streamed at a time, read by a task
    each (still ``slices`` micro-batches at least)."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "replays", uuid.uuid4().hex)
    batches, slices = slices, max(slices, -(-df.count() // SLICE_ROWS))
    order = [F.col(ts), *([F.col(seq)] if seq else [])]
    parts = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    parts.write.option("maxRecordsPerFile", 0).parquet(path)
    if not _in_order(spark, path):
        # the store keeps no times that are set: files written one after the other
        spare, path = path, scratch_path(spark, "replays", uuid.uuid4().hex)
        for name in _files(spark, spare):
            spark.read.schema(df.schema).parquet(name).coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, df.schema, max_files=min(WIDE_FILES, slices // batches) if wide else 1)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files of a folder by name, which is the order of their ranges."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-"))


def _in_order(spark: SparkSession, path: str) -> bool:
    """Set the files' times, by which a file stream takes them, in the order of
    their names; whether the store has kept them."""
    to_path, names = spark._jvm.org.apache.hadoop.fs.Path, _files(spark, path)
    fs = to_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    first = int(time.time() * 1000) - 10 * len(names)
    for i, name in enumerate(names):
        fs.setTimes(to_path(name), first + 10 * i, -1)
    times = {f.getPath().toString(): f.getModificationTime() for f in fs.listStatus(to_path(path))}
    return all(times[a] < times[b] for a, b in zip(names, names[1:]))


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not have been written yet.  Only a path that does not
    exist is empty; every other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def event_time(df: DataFrame, ts: str, out: str | None = None) -> DataFrame:
    """Cast an event-time column to TIMESTAMP (required by watermarks)."""
    return df.withColumn(out or ts, F.col(ts).cast("timestamp"))


def _folders(spark: SparkSession, name: str, path: str | None, checkpoint: str | None) -> tuple[str, str]:
    run = f"{name}-{uuid.uuid4().hex}"
    return (path or scratch_path(spark, "streams", run, "out"),
            checkpoint or scratch_path(spark, "streams", run, "checkpoint"))


def _finish(q, trigger: dict | None):
    """Wait for a stream that ends by itself; hand back one that does not."""
    if (trigger or {"availableNow": True}).get("availableNow"):
        q.awaitTermination()
    return q


def run_to_table(df: DataFrame, name: str, mode: str = "append", fmt: str = "parquet",
                 path: str | None = None, partition_by=None, checkpoint: str | None = None,
                 trigger: dict | None = None) -> str:
    """Run a stream into a file table and return the table's path.  ``trigger``
    is that of ``writeStream`` (default: all that is available now)."""
    path, ckpt = _folders(df.sparkSession, name, path, checkpoint)
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", ckpt) \
          .option("path", path).trigger(**(trigger or {"availableNow": True}))
    if partition_by:
        w = w.partitionBy(*partition_by)
    _finish(w.start(), trigger)
    return path


def run_foreach_batch(df: DataFrame, name: str, fn, mode: str = "append",
                      checkpoint: str | None = None, trigger: dict | None = None, persist: bool = False):
    """Run a stream through ``fn(batch, epoch)``; returns the query.  With
    ``persist`` a batch is kept while ``fn`` works on it, so that several
    actions on it read the source once."""
    _, ckpt = _folders(df.sparkSession, name, None, checkpoint)

    def once(batch: DataFrame, epoch: int):
        if not persist:
            return fn(batch, epoch)
        batch.persist()
        try:
            fn(batch, epoch)
        finally:
            batch.unpersist()
    return _finish(df.writeStream.outputMode(mode).option("checkpointLocation", ckpt).foreachBatch(once)
                   .trigger(**(trigger or {"availableNow": True})).start(), trigger)


# --------------------------------------------------------------------- TS1
def stream_normalize(raw: DataFrame, ts: str = "datetime") -> dict[str, DataFrame]:
    """TS1: quote and tick streams from a raw tick stream, the bar stream from
    a raw bar stream, book snapshots from depth levels (the batch normalisers
    applied unchanged; which apply is told by the columns)."""
    out = {}
    if "side" in raw.columns:
        out["ORDERBOOK"] = stream_order_books(raw, ts=ts)
    elif "open" in raw.columns:
        out["BAR"] = NO.normalize_bars(raw, ts)
    else:
        out["QUOTE"], out["TICK"] = NO.normalize_quotes(raw, ts), NO.normalize_ticks(raw, ts)
    return out


def stream_order_books(levels: DataFrame, watermark: str = "0 seconds", ts: str = "datetime") -> DataFrame:
    """Book snapshots from a stream of depth levels: a snapshot is complete
    once the watermark has passed its time."""
    lv = event_time(levels, ts, ts).withWatermark(ts, watermark)
    return NO.normalize_order_book(lv, ts).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


# --------------------------------------------------------------------- TS2
_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def window_seconds(window: str) -> int:
    """'5 seconds' / '1 hour' / '15 minutes' -> seconds."""
    n, unit = window.strip().split()
    unit = unit.lower().rstrip("s")
    if unit not in _UNITS:
        raise ValueError(f"unsupported window {window!r}")
    return int(n) * _UNITS[unit]


def stream_bars(ticks: DataFrame, window: str = "5 seconds", watermark: str = "10 seconds",
                ts: str = "datetime", price: str = "last", size: str = "lastsize",
                seq: str | None = None) -> DataFrame:
    """TS2: completed time bars per symbol: a window is emitted (append mode)
    once the watermark passes its end; rows later than the watermark are
    dropped.  Stream windows are aligned to the epoch, which equals the batch
    bars' midnight alignment only when the size divides a day; other sizes
    are rejected."""
    if 86400 % window_seconds(window) != 0:
        raise ValueError(f"stream bar size {window!r} must divide a day")
    t = event_time(ticks, ts, "_et").withWatermark("_et", watermark)
    okey = F.struct("_et", *([seq] if seq else []))
    nn = F.col(price).isNotNull()
    bars = t.groupBy("symbol", F.window("_et", window).alias("w")).agg(
        F.min_by(price, F.when(nn, okey)).alias("open"), F.max(price).alias("high"),
        F.min(price).alias("low"), F.max_by(price, F.when(nn, okey)).alias("close"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("volume"))
    return bars.select("symbol", F.col("w.start").cast("timestamp_ntz").alias(ts),
                       F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                       "open", "high", "low", "close", "volume").filter(F.col("open").isNotNull())


# --------------------------------------------------------------------- TS3
def stream_latest(quotes: DataFrame, ts: str = "timestamp", key: str = "symbol") -> DataFrame:
    """TS3: latest message per symbol (``kind`` removed), as an update /
    complete mode aggregation; state is one row per symbol."""
    cols = [c for c in quotes.columns if c not in (key, "kind")]
    return quotes.groupBy(key).agg(F.max_by(F.struct(*cols), ts).alias("_l")).select(key, "_l.*")


def run_latest_table(latest: DataFrame, name: str, path: str | None = None,
                     checkpoint: str | None = None, trigger: dict | None = None) -> str:
    """Keep the latest-per-symbol table in two slots: epoch ``n`` overwrites
    ``slot=<n mod 2>`` and carries an ``epoch`` column.  Readers take the
    rows of the greatest epoch, so the slot being rewritten only ever holds
    a stale version; storage stays at two versions, nothing is deleted."""
    base, ckpt = _folders(latest.sparkSession, name, path, checkpoint)

    def write(batch: DataFrame, epoch: int):
        batch.withColumn("epoch", F.lit(epoch).cast("long")) \
             .write.mode("overwrite").parquet(f"{base}/slot={epoch % 2}")

    run_foreach_batch(latest, name, write, mode="complete", checkpoint=ckpt, trigger=trigger)
    return base


def run_keyed_table(changed: DataFrame, name: str, key: str, path: str | None = None, checkpoint: str | None = None,
                    trigger: dict | None = None) -> str:
    """Keep the newest row per ``key`` of an update-mode stream in two slots, as
    :func:`run_latest_table` does: epoch ``n`` writes the version before it with
    the keys of its batch replaced.  A replayed epoch starts from the version
    before it again."""
    base, ckpt = _folders(changed.sparkSession, name, path, checkpoint)
    schema = StructType([*changed.schema.fields, StructField("epoch", LongType())])

    def write(batch: DataFrame, epoch: int):
        spark = batch.sparkSession
        old = read_or_empty(spark, f"{base}/slot={(epoch + 1) % 2}", schema).where(F.col("epoch") < epoch)
        kept = old.join(batch.select(key), key, "left_anti")
        batch.withColumn("epoch", F.lit(epoch).cast("long")).unionByName(kept.withColumn("epoch", F.lit(epoch).cast("long"))) \
             .write.mode("overwrite").parquet(f"{base}/slot={epoch % 2}")

    # Spark asks for one more batch without data for as long as a state has a ttl,
    # so that a stream of what is available would never end; a batch without data
    # changes no row of an update
    spark = changed.sparkSession
    before = spark.conf.get(NO_DATA, None)
    spark.conf.set(NO_DATA, "false")
    try:
        run_foreach_batch(changed, name, write, mode="update", checkpoint=ckpt, trigger=trigger, persist=True)
    finally:
        spark.conf.unset(NO_DATA) if before is None else spark.conf.set(NO_DATA, before)
    return base


def read_latest_table(spark: SparkSession, base: str) -> DataFrame:
    """The newest version of a table kept by :func:`run_latest_table`."""
    t = spark.read.parquet(base)
    return t.filter(F.col("epoch") == t.agg(F.max("epoch")).scalar()).drop("epoch", "slot")


# --------------------------------------------------------------------- TS4
def stream_message_rate(messages: DataFrame, window: str = "1 hour", watermark: str = "10 minutes",
                        ts: str = "ts") -> DataFrame:
    """TS4: messages per (kind, symbol) per tumbling window and the rate
    (messages / window seconds); closed windows only."""
    m = event_time(messages, ts, "_et").withWatermark("_et", watermark)
    g = m.groupBy("kind", "symbol", F.window("_et", window).alias("w")).agg(F.count(F.lit(1)).alias("messages"))
    secs = F.unix_seconds(F.col("w.end")) - F.unix_seconds(F.col("w.start"))
    return g.select("kind", "symbol", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    "messages", (F.col("messages") / secs).alias("rate"))


# --------------------------------------------------------------------- TS5
def stream_ingest(ticks: DataFrame, store_path: str, dim_path: str, name: str = "ingest",
                  ts: str = "datetime", seq: str = "id", checkpoint: str | None = None,
                  trigger: dict | None = None) -> str:
    """TS5: idempotent tick ingest as data arrives.  Each micro-batch resolves
    or creates symbol ids (append-only dimension, one partition per epoch) and
    appends the keys that are not yet stored: within a batch the first row by
    ``seq`` wins, across batches the one stored first.  A replayed batch finds
    its rows stored and appends nothing.  A dimension or store that cannot be
    read fails the batch before anything is written."""
    spark = ticks.sparkSession

    def batch_fn(batch: DataFrame, epoch: int):
        existing = read_or_empty(spark, store_path, schemas.TICKS)
        known = extended_dim(batch, dim_path, epoch)
        ST.append_to_store(ST.ingest_ticks(batch, existing, known, seq=seq), store_path)

    run_foreach_batch(ticks, name, batch_fn, checkpoint=checkpoint, trigger=trigger, persist=True)
    return store_path


def extended_dim(batch: DataFrame, dim_path: str, epoch: int) -> DataFrame:
    """The symbol dimension at a path with the symbols of a batch; a replayed
    batch finds its symbols there and adds none."""
    spark = batch.sparkSession
    dim_schema = StructType([*schemas.SYMBOLS.fields, StructField("epoch", LongType())])
    dim = read_or_empty(spark, dim_path, dim_schema).drop("epoch")
    full = ST.assign_symbol_ids(batch.select("symbol", "asset_class"), dim)
    new = full.join(dim.select("id"), "id", "left_anti")
    new.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("append").partitionBy("epoch").parquet(dim_path)
    return read_or_empty(spark, dim_path, dim_schema).drop("epoch")


def stream_to_store(rows: DataFrame, path: str, kind: str, symbols: DataFrame | str, seq, name: str = "ingest",
                    checkpoint: str | None = None, trigger: dict | None = None, keep: int = CO.KEEP) -> str:
    """TS5 into a store of whole batches (``operators.commits``): ticks, quotes
    (the tick store holds them: bid, ask and sizes) or bars.  Each micro-batch
    commits the keys that are not stored yet as one batch, known by its epoch; a
    batch that was stopped half-way is overwritten by its replay, one that was
    committed is not written again.  Batches are compacted beyond ``keep``, so
    the number of files stays bounded.  ``symbols``: the symbol dimension, or
    the path of one that is extended as symbols appear."""
    spark = rows.sparkSession
    ingest = {"ticks": ST.ingest_ticks, "bars": ST.ingest_bars}[kind]

    def batch_fn(batch: DataFrame, epoch: int):
        if epoch <= CO.last_epoch(spark, path, name):
            return
        known = extended_dim(batch, symbols, epoch) if isinstance(symbols, str) else symbols
        CO.commit(ingest(batch, CO.overlapping(batch, path, kind), known, seq=seq), path, kind, name, epoch)
        CO.compact(spark, path, kind, keep)

    run_foreach_batch(rows, name, batch_fn, checkpoint=checkpoint, trigger=trigger, persist=True)
    return path


# --------------------------------------------------------------------- TS6
PRICE_CHANGE_STATE = "last double, seen boolean"


def stream_price_changes(quotes: DataFrame, ts: str = "timestamp", price: str = "last",
                         out_schema: str = "symbol string, timestamp timestamp_ntz, last double, prev_price double"
                         ) -> DataFrame:
    """TS6: CASH quotes whose price changed versus the symbol's remembered
    price (value state per symbol; the first price is only remembered).
    Rows of a key inside a micro-batch are ordered by time."""
    cash = quotes.filter(F.col("asset_class") == "CSH").select("symbol", ts, price)

    def fn(key, pdfs, state):
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(ts, kind="mergesort")
        last, seen = state.get if state.exists else (None, False)
        p = pdf[price].astype("float64").reset_index(drop=True)
        prev = p.shift(1)
        prev.iloc[0] = np.nan if last is None else last        # the remembered price
        same = (p == prev) | (p.isna() & prev.isna())           # NULL-safe equality
        emit = ~same
        if not seen:
            emit.iloc[0] = False                                # first price: remember only
        state.update((None if pd.isna(p.iloc[-1]) else float(p.iloc[-1]), True))
        if emit.any():
            res = pd.DataFrame({"symbol": key[0], ts: pdf[ts].to_numpy()[emit.to_numpy()],
                                price: p[emit].to_numpy(), "prev_price": prev[emit].to_numpy()})
            yield res.astype({"symbol": object, ts: "datetime64[us]", price: "float64",
                              "prev_price": "float64"})

    return cash.groupBy("symbol").applyInPandasWithState(
        fn, out_schema, PRICE_CHANGE_STATE, "append", GroupStateTimeout.NoTimeout)


# --------------------------------------------------------------------- TS7
MANIFEST = "version long, path string"


def publish_version(df: DataFrame, folder: str, version: int) -> None:
    """Publish a list version: its files first, then a manifest that names
    them.  Watchers see the manifest, so they never see half a list."""
    path = f"{folder}/lists/version={version}"
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(version, path)], MANIFEST).coalesce(1).write.mode("append").json(
        f"{folder}/manifests")


def stream_instrument_changes(spark: SparkSession, folder: str, versions_path: str, name: str = "instruments",
                              as_of=None, path: str | None = None, checkpoint: str | None = None,
                              trigger: dict | None = None, max_files: int = 1) -> str:
    """TS7: every list version published into ``folder`` is read whole, cleaned
    (P4, as of ``as_of``; default today) and compared with the version before
    it (U2); the first version is all ADDED.  The stream follows the manifests:
    a version is complete when its manifest is there, however many files it
    has.  Cleaned versions are kept under ``versions_path``; the changes' path
    is returned."""
    out, ckpt = _folders(spark, name, path, checkpoint)
    manifests = file_stream(spark, f"{folder}/manifests", MANIFEST, fmt="json", max_files=max_files)

    def batch_fn(batch: DataFrame, epoch: int):
        # the manifests of this micro-batch (a handful): driver-side loop
        for v, where in sorted((r["version"], r["path"]) for r in batch.collect()):
            cur = CA.live_instruments(spark.read.parquet(where).select(*CANONICAL), as_of)
            kept = StructType([*cur.schema.fields, StructField("version", LongType())])
            hist = read_or_empty(spark, versions_path, kept)
            prev_v = hist.filter(F.col("version") < v).agg(F.max("version")).first()[0]
            if prev_v is None:
                ch = cur.withColumn("change", F.lit("ADDED"))
            else:
                ch = CA.instrument_changes(hist.filter(F.col("version") == prev_v).select(*CANONICAL), cur)
            # keyed by version: a replayed batch rewrites the same partitions
            for rows, to in ((ch, out), (cur, versions_path)):
                rows.withColumn("version", F.lit(v)).write.mode("overwrite") \
                    .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(to)

    run_foreach_batch(manifests, name, batch_fn, checkpoint=ckpt, trigger=trigger)
    return out


# --------------------------------------------------------------------- S6 / S7 on streams
def publish_stream(df: DataFrame, path: str, name: str = "publish", ts: str = "timestamp",
                   checkpoint: str | None = None, trigger: dict | None = None) -> str:
    """Publish a stream of messages as JSON text, one folder per ``kind``
    (the file form of a topic; a Kafka sink takes the same key/value
    columns).  Returns the folder."""
    msgs = NO.publish_messages(df, ts)
    return run_to_table(msgs.withColumnRenamed("key", "kind"), name, fmt="json", path=path,
                        partition_by=["kind"], checkpoint=checkpoint, trigger=trigger)


def route_messages(spark: SparkSession, path: str, schemas: dict, out: str, symbols=None, tz: str = "UTC",
                   name: str = "route", ts: str = "timestamp", checkpoint: str | None = None,
                   trigger: dict | None = None) -> dict[str, str]:
    """Every published message decoded with its kind's schema and appended
    to its kind's table ``<out>/<kind>``; one pass over the topic.  A replayed
    batch rewrites its own epoch."""
    src = spark.readStream.schema("value string, kind string").json(path)

    def batch_fn(batch: DataFrame, epoch: int):
        for kind, schema in schemas.items():
            rows = NO.subscribe_messages(batch.filter(F.col("kind") == kind).select("value"), schema, symbols,
                                         kind, tz, ts)
            rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite") \
                .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{out}/{kind}")

    run_foreach_batch(src, name, batch_fn, checkpoint=checkpoint, trigger=trigger, persist=True)
    return {kind: f"{out}/{kind}" for kind in schemas}


def subscribe_stream(spark: SparkSession, path: str, schema, symbols=None, kind: str | None = None,
                     tz: str = "UTC", ts: str = "timestamp") -> DataFrame:
    """A stream of decoded messages from a published folder: only the
    requested kind (its folder) and symbols, times converted to ``tz``."""
    src = spark.readStream.schema("value string, kind string").json(path)
    if kind is not None:
        src = src.filter(F.col("kind") == kind)
    return NO.subscribe_messages(src.select("value"), schema, symbols, None, tz, ts)


# --------------------------------------------------------------------- X1 on streams
def stream_strategy(quotes: DataFrame, on_rows, out_schema: str, ts: str | list = "timestamp",
                    key: str = "symbol") -> DataFrame:
    """X1 on a stream: ``on_rows(pdf, state: dict) -> (signals_pdf, state)``
    per symbol and micro-batch, rows in the order of ``ts`` (a column or
    several); the callback's state is kept (as JSON) in Spark's state store
    between micro-batches.  What a callback gets at once is bounded by the
    source's ``max_files`` / ``max_bytes``."""
    import json

    def fn(k, pdfs, state):
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(ts, kind="mergesort")
        st = json.loads(state.get[0]) if state.exists else {}
        out, st = on_rows(pdf.reset_index(drop=True), st)
        state.update((json.dumps(st),))
        yield out

    return quotes.groupBy(key).applyInPandasWithState(
        fn, out_schema, "state string", "append", GroupStateTimeout.NoTimeout)


def publish_kafka(df: DataFrame, servers: str, topic: str, name: str = "publish-kafka",
                  ts: str = "timestamp", checkpoint: str | None = None, trigger: dict | None = None):
    """S6 to a message bus: key = kind, value = JSON message.  Needs the
    Spark Kafka connector on the classpath (not bundled with pyspark)."""
    spark = df.sparkSession
    msgs = NO.publish_messages(df, ts)
    _, ckpt = _folders(spark, name, None, checkpoint)
    try:
        return msgs.writeStream.format("kafka").option("kafka.bootstrap.servers", servers) \
                   .option("topic", topic).option("checkpointLocation", ckpt) \
                   .trigger(**(trigger or {"processingTime": "0 seconds"})).start()
    except Exception as e:  # noqa: BLE001
        if "kafka" in str(e).lower() and "data source" in str(e).lower():
            raise RuntimeError("the Kafka connector (spark-sql-kafka) is not on the classpath") from e
        raise


# --------------------------------------------------------------------- TS4 (exact form)
def stream_message_rate_exact(messages: DataFrame, window: int = 100, ts: str = "ts",
                              seq: str | None = None) -> DataFrame:
    """TS4, exact form of W9 on a stream: per key (``kind_symbol``) the state
    holds the times of its last ``window`` messages and the last rate; every
    message emits messages / seconds spanned (>= 2 messages and a span > 0,
    else the previous rate stands).  Rows of a key inside a micro-batch are
    taken in time order."""
    import json

    from barsmith.operators.monitoring import message_key
    order = [ts] + ([seq] if seq else [])
    m = messages.withColumn("key", message_key()) \
                .withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    cols = ["key", "_us", *([seq] if seq else [])]
    out_schema = "key string, ts_us long, " + (f"{seq} long, " if seq else "") + "rate double"

    def fn(k, pdfs, state):
        pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(
            ["_us"] + ([seq] if seq else []), kind="mergesort")
        times, rate = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], None)
        new = pdf["_us"].to_numpy(dtype="int64")
        allt = np.concatenate([np.asarray(times, dtype="int64"), new])
        idx = np.arange(len(times), len(allt))                 # positions of the new rows
        lo = np.maximum(idx - (window - 1), 0)                  # first row of each frame
        cnt = idx - lo + 1
        span = (allt[idx] - allt[lo]) / 1e6
        raw = np.where((cnt >= 2) & (span > 0), cnt / np.where(span > 0, span, 1.0), np.nan)
        rates = pd.Series(raw).ffill()
        if rate is not None:
            rates = rates.fillna(rate)
        last = rates.iloc[-1] if len(rates) else rate
        state.update((json.dumps(allt[-window:].tolist()), None if pd.isna(last) else float(last)))
        out = pd.DataFrame({"key": k[0], "ts_us": new})
        if seq:
            out[seq] = pdf[seq].astype("int64").to_numpy()
        out["rate"] = rates.to_numpy(dtype="float64")
        yield out

    return m.select(*cols).groupBy("key").applyInPandasWithState(
        fn, out_schema, "times string, rate double", "append", GroupStateTimeout.NoTimeout) \
        .select("key", F.timestamp_micros("ts_us").cast("timestamp_ntz").alias(ts),
                *([seq] if seq else []), "rate")
