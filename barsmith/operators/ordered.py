"""Skew-safe building blocks for per-key ordered computations.

A plain ``Window.partitionBy(symbol).orderBy(datetime)`` puts the whole history
of a symbol into one task; a symbol holding a third of all ticks then decides
the job's run time and memory.  The helpers here never do that:

* :func:`sequence` numbers rows per key and carries running sums and
  forward-fills across the whole history in two phases.  Phase 1 aggregates
  per ``(key, chunk)`` (chunk = a coarse, order-monotone bucket such as the
  day); a window over that *small* summary yields each chunk's offset and
  carried values; phase 2 windows inside ``(key, chunk)`` only.  Join and
  window share the ``(key, chunk)`` hash partitioning, so the big side is
  shuffled once.
* :func:`halo_blocks` cuts each key's row sequence into fixed-size blocks and
  copies the last ``halo`` rows of every block into the next one, so a frame of
  ``rowsBetween(-halo, 0)`` can be evaluated per ``(key, block)``.
* :func:`row_offset` fetches the value ``k`` rows back with an equi-join on
  ``(key, row_number)`` (unique keys, so no skew).

Ties in the order are broken by the caller's explicit sequence columns; bare
``first``/``last`` (shuffle-order dependent) are never used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding

#: rows per block for bounded-frame windows (a block is one task's work)
BLOCK_ROWS = 1 << 17

#: default chunk length of :func:`sequence` in seconds of the order column.
#: A chunk is one phase-2 task per key: 15 minutes keeps even a key with a
#: third of 100 TB of ticks at a few hundred MB per task, while the phase-1
#: summary stays ~35k rows per key and year.
CHUNK_SECONDS = 900

#: a (key, chunk) with more rows than this (a burst inside one slice) is split
#: further by its full order key
MAX_CHUNK_ROWS = 20_000_000
#: numbers that a split chunk takes up
SPLIT = 1 << 20


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def day_chunk(ts: str | Column) -> Column:
    """Default chunk: the calendar day of the order column (UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.to_date(c)


def seconds_chunk(ts: str | Column, seconds: int) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(c.cast("timestamp")) / F.lit(seconds))


def sequence(df: DataFrame, keys, order, chunk: Column | None = None, *,
             rownum: str | None = "_g", total: str | None = None,
             sums: dict[str, str] | None = None,
             ffill: dict[str, str] | None = None,
             prev: dict[str, str] | None = None,
             nxt: dict[str, str] | None = None,
             max_chunk_rows: int | None = MAX_CHUNK_ROWS, split: bool = False) -> DataFrame:
    """Add per-key ordered columns without a per-key task.

    ``keys``   partition columns (names).
    ``order``  order columns (names); must make the order total.
    ``chunk``  coarse bucket monotone in ``order`` (default: CHUNK_SECONDS
               slices of order[0], a timestamp or date).
    ``rownum`` name for the 1-based row number per key (None: skip).
    ``total``  name for the row count of the key (None: skip).
    ``sums``   {source: target} inclusive running sums (nulls count as 0,
               null row values give the running total up to that row).
    ``ffill``  {source: target} last non-null value up to and including the row.
    ``prev``   {source: target} value of the previous row (lag 1), null first.
    ``nxt``    {source: target} value of the next row (lead 1), null last.
    ``max_chunk_rows`` default time chunks holding more rows are split by the
               full order key (a burst at one timestamp included, if ``order``
               tells its rows apart), so one bucket never becomes one task.
    ``split``  the same for a ``chunk`` of the caller's (a number, e.g. 0).
    """
    keys = list(keys)
    order = list(order)
    sums = sums or {}
    ffill = ffill or {}
    prev = prev or {}
    nxt = nxt or {}
    ch = chunk if chunk is not None else seconds_chunk(order[0], CHUNK_SECONDS)
    d = df.withColumn("_chunk", ch)
    okey = F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(o) for o in order])

    def summarise(frame):
        aggs = [F.count(F.lit(1)).alias("_cn")]
        aggs += [F.sum(s_).alias(f"_cs_{i}") for i, s_ in enumerate(sums)]
        aggs += [F.max_by(s_, F.when(F.col(s_).isNotNull(), okey)).alias(f"_cf_{i}")
                 for i, s_ in enumerate(ffill)]
        aggs += [F.max_by(s_, okey).alias(f"_cp_{i}") for i, s_ in enumerate(prev)]
        aggs += [F.min_by(s_, okey).alias(f"_cn_{i}") for i, s_ in enumerate(nxt)]
        return frame.groupBy(*keys, "_chunk").agg(*aggs)

    summ = summarise(d)
    if (chunk is None or split) and max_chunk_rows:
        # A burst inside one slice.  The summary is written once and names the
        # oversized (key, chunk); only if there is one, its rows are sorted by
        # range of their full order key into parts of half that size at most
        # (about), and the part tells the sub-chunk: it rises with the order.
        summ = materialize(summ)
        hot = summ.filter(F.col("_cn") > max_chunk_rows).select(*keys, "_chunk", "_cn")
        burst_rows = hot.agg(F.sum("_cn")).first()[0]
        if burst_rows:
            hot = hot.drop("_cn")
            parts = min(SPLIT - 1, -(-2 * burst_rows // max_chunk_rows))
            burst = d.join(hot, [*keys, "_chunk"], "left_semi").repartitionByRange(parts, *keys, "_chunk", *order)
            burst = materialize(burst.withColumn("_chunk", F.col("_chunk") * F.lit(SPLIT) + F.spark_partition_id()))

            def apart(frame):
                cold = frame.join(hot, [*keys, "_chunk"], "left_anti")
                return cold.withColumn("_chunk", F.col("_chunk") * F.lit(SPLIT))
            d = apart(d).unionByName(burst)
            summ = apart(summ).unionByName(summarise(burst))

    wb = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(UNB, -1)
    sel = [*keys, "_chunk",
           F.coalesce(F.sum("_cn").over(wb), F.lit(0)).alias("_off")]
    if total:
        sel.append(F.sum("_cn").over(Window.partitionBy(*keys)).alias(total))
    sel += [F.coalesce(F.sum(f"_cs_{i}").over(wb), F.lit(0)).alias(f"_os_{i}")
            for i in range(len(sums))]
    sel += [F.last(f"_cf_{i}", ignorenulls=True).over(wb).alias(f"_of_{i}")
            for i in range(len(ffill))]
    sel += [F.lag(f"_cp_{i}").over(Window.partitionBy(*keys).orderBy("_chunk"))
            .alias(f"_op_{i}") for i in range(len(prev))]
    sel += [F.lead(f"_cn_{i}").over(Window.partitionBy(*keys).orderBy("_chunk"))
            .alias(f"_on_{i}") for i in range(len(nxt))]
    summ = summ.select(*sel)

    j = d.join(summ, on=[*keys, "_chunk"], how="inner")
    wl = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    wr = wl.rowsBetween(UNB, 0)
    out = {}
    if rownum:
        out[rownum] = F.row_number().over(wl) + F.col("_off")
    for i, (s, t) in enumerate(sums.items()):
        out[t] = F.coalesce(F.sum(s).over(wr), F.lit(0)) + F.col(f"_os_{i}")
    for i, (s, t) in enumerate(ffill.items()):
        out[t] = F.coalesce(F.last(s, ignorenulls=True).over(wr), F.col(f"_of_{i}"))
    for i, (s, t) in enumerate(prev.items()):
        out[t] = F.when(F.row_number().over(wl) == 1, F.col(f"_op_{i}")) \
                  .otherwise(F.lag(s).over(wl))
    wd = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(o).desc() for o in order])
    for i, (s, t) in enumerate(nxt.items()):
        out[t] = F.when(F.row_number().over(wd) == 1, F.col(f"_on_{i}")) \
                  .otherwise(F.lead(s).over(wl))
    j = j.withColumns(out)
    drop = ["_chunk", "_off"] + [f"_os_{i}" for i in range(len(sums))] \
        + [f"_of_{i}" for i in range(len(ffill))] + [f"_op_{i}" for i in range(len(prev))] \
        + [f"_on_{i}" for i in range(len(nxt))]
    return j.drop(*drop)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of an intermediate that several branches consume:
    reliable checkpoint into the shared ``spark.checkpoint.dir`` (survives
    executor loss; never a local checkpoint)."""
    from barsmith.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    # Dataset.checkpoint computes its input once (checked: one evaluation
    # per row), so no persist is needed around it
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As :func:`materialize` for wide or many rows: as Parquet, of which every
    branch reads the columns that it needs."""
    from barsmith.session import scratch_path
    path = scratch_path(df.sparkSession, "kept", uuid.uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def halo_blocks(df: DataFrame, rownum: str, halo: int,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Assign ``_blk`` by row number and duplicate each block's last ``halo``
    rows into the next block (flag ``_halo``).  Evaluate
    ``Window.partitionBy(*keys, '_blk').orderBy(rownum).rowsBetween(-halo, 0)``
    and then keep ``~_halo``.  Overhead is halo/block_rows extra rows."""
    if halo >= block_rows:
        raise ValueError("halo must be smaller than the block")
    g0 = F.col(rownum) - 1
    blk = F.floor(g0 / F.lit(block_rows))
    in_tail = (g0 % F.lit(block_rows)) >= F.lit(block_rows - halo)
    copies = F.when(in_tail & F.lit(halo > 0),
                    F.array(F.struct(blk.alias("b"), F.lit(False).alias("h")),
                            F.struct((blk + 1).alias("b"), F.lit(True).alias("h")))) \
              .otherwise(F.array(F.struct(blk.alias("b"), F.lit(False).alias("h"))))
    return (df.withColumn("_cp", F.explode(copies))
              .withColumn("_blk", F.col("_cp.b"))
              .withColumn("_halo", F.col("_cp.h"))
              .drop("_cp"))


def block_window(keys, rownum: str, lo: int, hi: int = 0):
    """Frame ``rowsBetween(lo, hi)`` evaluated per (key, block)."""
    return Window.partitionBy(*keys, "_blk").orderBy(rownum).rowsBetween(lo, hi)


def row_offset(df: DataFrame, keys, rownum: str, k: int, cols: dict[str, str]) -> DataFrame:
    """Attach columns of the row ``k`` positions earlier (same key) via an
    equi-join on (key, row number).  ``cols`` maps source -> target name."""
    keys = list(keys)
    other = df.select(*keys, (F.col(rownum) + F.lit(k)).alias("_tg"),
                      *[F.col(s).alias(t) for s, t in cols.items()])
    return df.join(other, on=[*[df[x] == other[x] for x in keys],
                              df[rownum] == other["_tg"]], how="left") \
             .drop(*[other[x] for x in keys]).drop("_tg")
