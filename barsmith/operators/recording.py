"""Recorded strategy data and backtest positions.

X3 record_events (long form), W3 position_shift, A13 recorded_pivot,
W12 backtest_position, S8 export_recorded.

The original appends one frame per event and re-concatenates everything on
every call (quadratic).  Here events stay a long table
``(datetime, symbol, <fields>)``; the wide table is one pivot at the end.
The "previous row" of the wide table is the previous *distinct datetime over
all symbols*; every datetime gets its predecessor from the distributed sequence
helper (no global single-task window) and the shift is an equi-join on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.operators import ordered

DROP_FIELDS = ("symbol_group", "asset_class")

#: rows (datetime, symbol) of the recorded table that a task takes
TASK_ROWS = 250_000


def record_events(df: DataFrame, ts: str = "datetime", fields=None) -> DataFrame:
    """Any DataFrame with a time and a symbol column becomes recorded
    events; the user's extra columns are the recorded fields."""
    fields = [c for c in (fields or df.columns) if c not in (ts, "symbol")]
    return df.select(F.col(ts).alias("datetime"), "symbol", *fields)


def number_datetimes(events: DataFrame, ts: str = "datetime") -> DataFrame:
    """Distinct datetimes with their 1-based global order ``_g``."""
    d = events.select(ts).distinct().withColumn("_one", F.lit(1))
    return ordered.sequence(d, ["_one"], [ts], rownum="_g").drop("_one")


def _fields(events: DataFrame, seq) -> list[str]:
    skip = {"datetime", "symbol", *DROP_FIELDS, *([seq] if seq else [])}
    return [c for c in events.columns if c not in skip]


def previous_datetimes(events: DataFrame, ts: str = "datetime") -> DataFrame:
    """Distinct datetimes with the one before (``_prev``, null at the first)."""
    d = events.select(ts).distinct().withColumn("_one", F.lit(1))
    return ordered.sequence(d, ["_one"], [ts], rownum=None, prev={ts: "_prev"}).drop("_one")


def position_shift(events: DataFrame, position: str = "position", seq=None) -> DataFrame:
    """For every (symbol, datetime) of the wide table's row grid where a
    value exists, the symbol's position on the previous wide row (first 0,
    missing 0).  Long form: symbol, datetime, ``<position>`` shifted."""
    first = ordered.kept(_first_values(events, [position], seq))
    return _shifted(first, position).select("symbol", "datetime", position)


def _shifted(first: DataFrame, position: str) -> DataFrame:
    """First values (stored) with the position moved to the next wide row: a
    row per (datetime, symbol) of the grid.  The rows of a datetime come in one
    task and a task takes ``TASK_ROWS`` of them, however many there are."""
    other = [c for c in first.columns if c not in ("datetime", "symbol", position)]
    kinds = dict(first.dtypes)
    own = first.select("datetime", "symbol", *other, F.lit(None).cast(kinds[position]).alias(position),
                       F.lit(1).alias("_own"))
    moved = first.withColumnRenamed("datetime", "_prev").join(previous_datetimes(first), "_prev").select(
        "datetime", "symbol", *[F.lit(None).cast(kinds[c]).alias(c) for c in other],
        F.when(F.col("symbol").isNotNull(), F.col(position)).alias(position), F.lit(0).alias("_own"))
    rows = own.unionByName(moved).repartition(_tasks(first), "datetime")
    # at most one own row and one moved row each
    cells = rows.groupBy("datetime", "symbol").agg(
        *[F.max_by(F.col(c), F.col("_own")).alias(c) for c in other],
        F.min_by(F.col(position), F.col("_own")).alias(position))
    return cells.withColumn(position, F.coalesce(F.col(position), F.lit(0)))


def _tasks(stored: DataFrame) -> int:
    """Partitions for the rows of a stored table and as many moved ones."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-2 * stored.count() // TASK_ROWS))


def _first_values(events: DataFrame, fields, seq) -> DataFrame:
    """First non-null value per (datetime, symbol) and field, in record order."""
    order = F.col(seq) if seq else F.lit(0)
    aggs = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    return events.groupBy("datetime", "symbol").agg(*aggs)


def recorded_long(events: DataFrame, position: str = "position", seq=None) -> DataFrame:
    """A13, long form (the default at scale): one row per (datetime, symbol)
    with the first non-null value of every field and the shifted position (W3),
    for every instrument there is."""
    ev = events.filter(F.col("symbol").isNotNull())
    fields = _fields(ev, seq)
    first = _first_values(ev, fields, seq)
    return _shifted(ordered.kept(first), position) if position in fields else first


def recorded_pivot(events: DataFrame, symbols=None, position: str = "position",
                   seq=None) -> DataFrame:
    """A13, wide form: an export of the chosen ``symbols`` (else a distinct pass
    finds all; Spark bounds the number of columns).  One row per datetime,
    columns ``<SYMBOL>_<FIELD>`` (upper case) holding the first non-null value;
    symbol_group / asset_class dropped; ``<SYMBOL>_POSITION`` shifted one row
    (W3); names with ``_FUT_`` -> ``_`` and ``_OPT_OPT_`` -> ``_OPT_``."""
    fields = _fields(events, seq)
    syms = list(symbols) if symbols is not None else _symbols(events)
    # A datetime holds few of the cells, so they are gathered as they are and
    # spread over the columns row by row: an aggregate per column would hold a
    # whole wide row for every datetime of a task.
    cells = recorded_long(events, position, seq).groupBy("datetime").agg(F.map_from_entries(F.collect_list(
        F.struct("symbol", F.struct(*fields).alias("values")))).alias("_cells"))
    out = []
    for s in syms:
        for f in fields:
            value = F.col("_cells")[s][f]
            name = f"{s}_{f.upper()}".replace("_FUT_", "_").replace("_OPT_OPT_", "_OPT_")
            out.append((F.coalesce(value, F.lit(0)) if f == position else value).alias(name))
    return cells.select("datetime", *out)


def _symbols(events: DataFrame) -> list[str]:
    """All symbols, in order; refused beyond Spark's bound on pivot columns."""
    most = int(events.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    rows = events.select("symbol").distinct().filter(F.col("symbol").isNotNull()).sort("symbol").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} symbols (spark.sql.pivotMaxValues): name those to export")
    return [r[0] for r in rows]


def backtest_position(events: DataFrame, position: str = "position", price: str = "open",
                      seq=None) -> DataFrame:
    """Per symbol the latest position of the recorded table (the shifted
    column on the last wide row) and, when non-zero, ``avg_cost`` = the
    symbol's ``price`` on the last wide row where that position changed."""
    ev = events.filter(F.col("symbol").isNotNull())
    nd = number_datetimes(ev)
    n_rows = nd.agg(F.max("_g")).scalar()
    first = _first_values(ev, [position, price], seq).join(nd, "datetime")
    q = first.select("symbol", "_g", F.coalesce(F.col(position), F.lit(0)).alias("_q"))
    prev = q.select("symbol", (F.col("_g") + 1).alias("_g"), F.col("_q").alias("_qp"))
    j = q.join(prev, ["symbol", "_g"], "left")
    # change of q at row k (k = this row) or at k + 1 (symbol absent there)
    own = j.filter((F.col("_q") != F.coalesce("_qp", F.lit(0))) & (F.col("_g") <= n_rows - 1)) \
           .select("symbol", F.col("_g").alias("_k"))
    nxt_present = q.select("symbol", (F.col("_g") - 1).alias("_g"), F.lit(True).alias("_np"))
    after = q.join(nxt_present, ["symbol", "_g"], "left") \
             .filter(F.col("_np").isNull() & (F.col("_q") != 0) & ((F.col("_g") + 1) <= n_rows - 1)) \
             .select("symbol", (F.col("_g") + 1).alias("_k"))
    last_k = own.unionByName(after).groupBy("symbol").agg(F.max("_k").alias("_k"))
    syms = ev.select("symbol").distinct()
    latest_q = q.filter(F.col("_g") == n_rows - 1).select("symbol", F.col("_q").alias("position"))
    res = syms.join(latest_q, "symbol", "left").join(last_k, "symbol", "left") \
              .withColumn("position", F.coalesce("position", F.lit(0))) \
              .withColumn("_gstar", F.coalesce(F.col("_k") + 1, F.lit(1)))
    px = first.select("symbol", F.col("_g").alias("_gstar"), F.col(price).alias("_px"))
    res = res.join(px, ["symbol", "_gstar"], "left")
    return res.select("symbol", "position",
                      F.when(F.col("position") != 0, F.col("_px")).otherwise(F.lit(0.0)).alias("avg_cost"))


def export_recorded(wide: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write the recorded table (csv or parquet; single-machine formats
    such as h5/pickle are replaced by parquet)."""
    w = wide.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
