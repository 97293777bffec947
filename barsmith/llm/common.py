"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.session import checkpoint_dir, scratch_table

#: What separates words (space, tab, line feed, vertical tab,
#: form feed, carriage return), as a set of characters and as a word pattern.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: rows up to which a side that was written and counted may be broadcast
BROADCAST_ROWS = 100_000

#: bytes of rows that go to a Python worker at a time.  Spark's own bounds, 64 MB
#: and 10,000 rows, are held by both sides for every task of an executor.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "2m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of ``BATCH`` bytes, unless the session has a
    bound of its own."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, BATCH)


def cut(df: DataFrame) -> DataFrame:
    """Evaluate once into the shared checkpoint folder and go on from there:
    later readers neither recompute it nor depend on an executor's disk."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_fresh(df: DataFrame) -> DataFrame:
    """As :func:`cut`, with the size that was written as its size.  A checkpoint
    keeps the estimate of its plan, which grows with a power of the rounds where
    a loop joins a table with itself."""
    name = scratch_table(df.sparkSession, df, "fresh")
    out = cut(df.sparkSession.table(name))
    df.sparkSession.sql(f"DROP TABLE {name}")
    return out


def passes_columns(operator):
    """For operators that pass the columns of their first table on: columns that
    begin with two underscores, as helper columns do, have other names within."""
    @functools.wraps(operator)
    def run(df: DataFrame, *args, **how):
        apart, used = {}, {c.lower() for c in df.columns}
        for c in df.columns:
            if c.startswith("__") and c not in how.values():
                new = "own" + c
                while new.lower() in used:
                    new = "own_" + new
                used.add(new.lower())
                apart[c] = new
        out = operator(df.withColumnsRenamed(apart) if apart else df, *args, **how)
        return out.withColumnsRenamed({new: c for c, new in apart.items()}) if apart else out
    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written side for broadcast if it was counted to be small; larger
    ones stay plain and the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def words_in(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: buckets of :func:`sieve`; at most so many rows are ever broadcast by it
ID_BUCKETS = 1 << 20


def sieve(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key falls in a hash bucket of some id, and the others: a
    sieve of fixed size before a join by the ids themselves, so that most texts
    that the join does not need are never shuffled."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ID_BUCKETS))
    there = F.broadcast(cut(ids.select(bucket(F.col(id_col)).alias("__bucket")).distinct()))
    rows = rows.withColumn("__bucket", bucket(F.col(key)))
    return (rows.join(there, "__bucket", "left_semi").drop("__bucket"),
            rows.join(there, "__bucket", "left_anti").drop("__bucket"))


def may_have(rows: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The inner half of :func:`sieve`."""
    return sieve(rows, key, ids, id_col)[0]
