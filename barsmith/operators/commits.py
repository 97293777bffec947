"""A store that is written a batch at a time and read whole batches only.

Layout below ``path``::

    data/batch=<id>/period=<day or month>/...    the rows of a batch
    partials/batch=<id>/...           their mergeable statistics (A6-A8, T1)
    commits/batch=<id>/...            one row, written last

* Readers take the batches that have a commit row, so they never see half of
  one.  A batch that was stopped before its commit is invisible, and its replay
  overwrites what it had left.
* A batch is known by its stream and epoch.  Epochs of a stream rise, so one
  that is not above the stream's last committed epoch has been committed
  already and is skipped.
* ``compact`` rewrites batches as one of the next level and commits that with
  the list of those it replaces: a row is rewritten once a level, so as often as
  the logarithm of the batches says.  The files of replaced batches are emptied
  by the next compaction, so readers that planned before this one still find
  them.

One writer at a time, any number of readers.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.operators import partials as PA

COMMIT = "stream string, epoch long, rows long, replaces array<string>, covers map<string,bigint>"

#: batches of a level that a store may have before they are compacted
KEEP = 16


def _batch_id(stream: str, epoch: int) -> str:
    return f"{stream}-{epoch:012d}"


def _entered(spark: SparkSession, path: str) -> tuple[list, list]:
    """Rows of the live commits and of the replaced ones that are still there."""
    try:
        found = spark.read.schema(f"{COMMIT}, batch string").parquet(f"{path}/commits").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return [], []
    gone = {b for r in found for b in r["replaces"] or ()}
    found.sort(key=lambda r: r["batch"])
    return [r for r in found if r["batch"] not in gone], [r for r in found if r["batch"] in gone]


def commits(spark: SparkSession, path: str) -> list:
    """Rows of the live commits (``batch`` and those of ``COMMIT``): few, as
    compaction replaces them."""
    return _entered(spark, path)[0]


def last_epoch(spark: SparkSession, path: str, stream: str) -> int:
    """The stream's last committed epoch, -1 if there is none."""
    return max((r["covers"].get(stream, -1) for r in commits(spark, path)), default=-1)


def _read(spark: SparkSession, path: str, what: str, schema, batches: list[str]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], schema)
    # the folders of live batches only: what is not committed is not even listed
    return spark.read.schema(schema).option("basePath", f"{path}/{what}").parquet(
        *[f"{path}/{what}/batch={b}" for b in batches]).drop("batch")


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The committed rows of a store of ``kind`` (``PA.KINDS``), with the
    ``period`` (day of ticks, month of bars) that the store is partitioned by."""
    return _read(spark, path, "data", PA.KINDS[kind].stored, [r["batch"] for r in commits(spark, path)])


def overlapping(batch: DataFrame, path: str, kind: str, ts: str = "datetime") -> DataFrame:
    """The committed rows of the periods of a batch, to be told from it: the
    bounds are a scalar subquery in the partition filter."""
    period = PA.KINDS[kind].period(F.col(ts))
    span = batch.agg(F.struct(F.min(period).alias("lo"), F.max(period).alias("hi")).alias("r")).select("r").scalar()
    rows = read(batch.sparkSession, path, kind)
    return rows.where(F.col("period").between(span["lo"], span["hi"])).drop("period")


def read_partials(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per (period, symbol_id) of the committed rows: the statistics of
    all batches, merged."""
    rows = _read(spark, path, "partials", PA.KINDS[kind].schema(), [r["batch"] for r in commits(spark, path)])
    return PA.merge(rows, kind)


def _write(rows: DataFrame, path: str, kind: str, batch: str, partials: DataFrame | None = None) -> None:
    """The rows of a batch and their statistics: those given, else counted from
    what was written."""
    spark = rows.sparkSession
    stored = PA.KINDS[kind].stored
    rows = rows.withColumn("period", PA.KINDS[kind].period(F.col("datetime")))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in stored.fields])
    (rows.hint("rebalance", "period").sortWithinPartitions("period", "symbol_id", "datetime")
         .write.mode("overwrite").partitionBy("period").parquet(f"{path}/data/batch={batch}"))
    if partials is None:
        partials = PA.partials(_read(spark, path, "data", stored, [batch]), kind)
    partials.write.mode("overwrite").parquet(f"{path}/partials/batch={batch}")


def _enter(spark: SparkSession, path: str, batch: str, stream: str, epoch: int, rows: int, replaces, covers) -> None:
    row = spark.createDataFrame([(stream, epoch, rows, list(replaces), covers)], COMMIT)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")


def commit(rows: DataFrame, path: str, kind: str, stream: str, epoch: int) -> bool:
    """Write ``rows`` as a batch; False if that epoch has been committed."""
    spark = rows.sparkSession
    if epoch <= last_epoch(spark, path, stream):
        return False
    batch = _batch_id(stream, epoch)
    _write(rows, path, kind, batch)
    n = _read(spark, path, "partials", PA.KINDS[kind].schema(), [batch]).agg(F.sum("n")).first()[0] or 0
    _enter(spark, path, batch, stream, epoch, n, [], {stream: epoch})
    return True


def _level(row) -> int:
    """0 for a batch as it came; a compaction has its level as its epoch."""
    return row["epoch"] if row["replaces"] else 0


def _overfull(live: list, keep: int) -> tuple[list, int]:
    """The batches to merge and the level of what comes of them: those of level
    0 if they are more than ``keep``, and of each next level that would have more
    with the merged one."""
    merged, level = [], 0
    while True:
        here = [r for r in live if _level(r) == level]
        if len(here) + bool(merged) <= keep:
            return merged, level
        merged, level = merged + here, level + 1


def compact(spark: SparkSession, path: str, kind: str, keep: int = KEEP) -> bool:
    """Merge batches into one where a level has more than ``keep``, and empty
    the files of those that the compactions before have replaced."""
    live, replaced = _entered(spark, path)
    merged, level = _overfull(live, keep)
    if not merged:
        return False
    names = sorted(r["batch"] for r in merged)
    # the commit last: while it is there, the files are emptied again by the next compaction
    for old in [r["batch"] for r in replaced]:
        for what, schema in (("data", PA.KINDS[kind].stored), ("partials", PA.KINDS[kind].schema()), ("commits", COMMIT)):
            spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{what}/batch={old}")
    # the same batches give the same name, so a compaction that was stopped is overwritten
    batch = "compact-" + hashlib.sha256("\n".join(names).encode()).hexdigest()[:32]
    counted = PA.merge(_read(spark, path, "partials", PA.KINDS[kind].schema(), names), kind)
    _write(_read(spark, path, "data", PA.KINDS[kind].stored, names), path, kind, batch, counted)
    covers = {}
    for r in merged:
        for s, e in r["covers"].items():
            covers[s] = max(e, covers.get(s, -1))
    _enter(spark, path, batch, "compact", level, sum(r["rows"] for r in merged), names, covers)
    return True
