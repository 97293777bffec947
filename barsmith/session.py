"""Session defaults.

Only settings that change *results* are forced (UTC session zone).  Everything
else is a default that a cluster configuration may override.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: wall-clock independence (UTC) and runtime
# re-planning (AQE turns small joins into broadcasts only after measuring
# them, splits skewed shuffle partitions and coalesces tiny ones).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of intermediates are removed once no plan refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "barsmith",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only applied when given (a cluster submit sets it itself).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for lineage cuts and streaming checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; that value always wins.
    Where it is unset a cluster session is refused (a folder of one machine is
    not seen by the others); only a ``local`` session, as in tests, falls back
    to the caller's folder or one under the warehouse directory.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not _is_local(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        d = fallback or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_barsmith_checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (never a machine-local temp)."""
    return os.path.join(checkpoint_dir(spark), *parts)


def scratch_table(spark: SparkSession, writer_of, name: str) -> str:
    """Write a managed table in a database below the shared checkpoint folder
    and return its name; ``DROP TABLE`` removes the files again.

    ``writer_of`` is a DataFrame or a DataFrameWriter (already bucketed or
    partitioned as wanted)."""
    db = "barsmith_scratch"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{scratch_path(spark, db)}'")
    table = f"{db}.{name}_{uuid.uuid4().hex}"
    writer = writer_of.write if isinstance(writer_of, DataFrame) else writer_of
    writer.format("parquet").saveAsTable(table)
    return table
