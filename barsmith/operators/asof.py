"""J5 at full time resolution: as-of join without an inequality join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.operators import ordered


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], *, right_ts: str | None = None,
              right_seq: str | None = None, max_age: str | None = None, matched_ts: str = "asof_ts",
              max_chunk_rows: int = ordered.MAX_CHUNK_ROWS) -> DataFrame:
    """Every row of ``left`` with ``values`` of the row of ``right`` in force at
    its time: the last one of its key at or before it (of equal times the
    largest ``right_seq``), NULL if there is none or it is older than
    ``max_age`` (an interval such as ``5 minutes``).

    Both sides are one sequence in which the right rows are carried forward
    (``ordered.sequence``): a key is many tasks, however large, and the rows are
    shuffled once.  Left rows without key or time are kept without a match."""
    right_ts = right_ts or ts
    own = left.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"),
                      F.lit(0).cast("long").alias("_seq"), F.xxhash64("*").alias("_tie"))
    found = F.struct(F.col(right_ts).alias("_at"), *values)
    state = right.where(F.col(key).isNotNull() & F.col(right_ts).isNotNull()).select(
        F.col(key).alias("_key"), F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"),
        (F.col(right_seq) if right_seq else F.lit(0)).cast("long").alias("_seq"), F.lit(0).cast("long").alias("_tie"),
        found.alias("_found"))
    known = F.col("_key").isNotNull() & F.col("_ts").isNotNull()
    both = own.where(known).unionByName(state, allowMissingColumns=True)
    both = ordered.sequence(both, ["_key"], ["_ts", "_side", "_seq", "_tie"], rownum=None, ffill={"_found": "_last"},
                            max_chunk_rows=max_chunk_rows)
    rows = both.where("_side = 1").select("_row", "_ts", "_last")
    if max_age:
        rows = rows.withColumn("_last", F.when(F.col("_last._at") >= F.col("_ts") - F.expr(f"INTERVAL {max_age}"), F.col("_last")))
    rest = own.where(~known).select("_row", "_ts")
    rows = rows.unionByName(rest, allowMissingColumns=True)
    return rows.select("_row.*", F.col("_last._at").alias(matched_ts), *(F.col(f"_last.{v}").alias(v) for v in values))
