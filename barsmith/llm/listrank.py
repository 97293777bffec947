"""List ranking: how far every element of a linked list is from its end.

Ids are dealt by ranges into blocks, and each block contracts the chains it
holds to their heads.  What is left is contracted by random mates (an element
whose coin shows one is spliced out behind a neighbour whose coin shows zero,
a quarter of the list a round) until it fits a task of ``held`` elements, which
jumps pointers there.  Spliced elements come back in reverse order.  Every step
is cut to shared storage; only counts reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import cut
from barsmith.llm.shingles import grouped

#: ids of a block; elements of the list that one task ranks at the end
BLOCK, HELD = 1 << 16, 1 << 18
#: no element
NONE = -1


def to_heads(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Head of each element's chain and the steps from it; ``after`` is the
    position of the next element or ``NONE``."""
    n = len(after)
    head, steps = np.arange(n), np.zeros(n, np.int64)
    linked = after != NONE
    head[after[linked]] = np.flatnonzero(linked)
    steps[after[linked]] = 1
    while True:
        further = head[head]
        if (further == head).all():
            return head, steps
        steps += steps[head]
        head = further


def _block_task(batches):
    """Chains within a block: every element with its head, heads with what
    follows their chain and its length."""
    for _, rows in grouped(batches, ["block"]):
        ids = rows.column("id").to_numpy()
        follow = rows.column("next").fill_null(NONE).to_numpy()
        at = np.minimum(np.searchsorted(ids, follow), len(ids) - 1)
        after = np.where(ids[at] == follow, at, NONE)
        head, steps = to_heads(after)
        tail = after == NONE
        w, out = np.ones(len(ids), np.int64), np.full(len(ids), NONE, np.int64)
        w[head[tail]], out[head[tail]] = steps[tail] + 1, follow[tail]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(ids[head]), pa.array(steps), pa.array(out, mask=out == NONE), pa.array(w)],
            names=["id", "head", "steps", "next", "w"])


def _rank_task(batches):
    """The whole list, of at most ``HELD`` elements: steps to the end by
    pointer jumping."""
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held)
        by = np.argsort(rows.column("id").to_numpy())
        ids, w = rows.column("id").to_numpy()[by], rows.column("w").to_numpy()[by].copy()
        follow = rows.column("next").fill_null(NONE).to_numpy()[by]
        after = np.append(np.where(follow == NONE, len(ids), np.searchsorted(ids, follow)), len(ids))
        w = np.append(w, 0)
        while (after != len(ids)).any():
            w = w + w[after]
            after = after[after]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(w[:-1])], names=["id", "to_end"])


def _coin(c, turn: int):
    return F.coalesce(F.xxhash64(c, F.lit(turn)).bitwiseAND(F.lit(1)), F.lit(0))


def _met(rows: DataFrame, *messages: DataFrame) -> DataFrame:
    """Rows together with the messages to them, one shuffle for all: every
    column is null but in the row or the message that carries it."""
    for m in messages:
        rows = rows.unionByName(m, allowMissingColumns=True)
    return rows.groupBy("id").agg(*(F.max(c).alias(c) for c in rows.columns if c != "id"))


def rank_list(links: DataFrame, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """``id, to_end`` of ``links (id, next)``: the elements from each to the end
    of its list, itself included.  The last has a null ``next``.  Ids are not
    negative and occur once, as does every ``next`` but null."""
    chains = links.select(F.col("id").cast("long"), F.col("next").cast("long"))
    chains = chains.withColumn("block", F.floor(F.col("id") / F.lit(block)).cast("long"))
    chains = cut(chains.repartition("block").sortWithinPartitions("block", "id").mapInArrow(
        _block_task, "id long, head long, steps long, next long, w long"))
    left = chains.where("id = head").select("id", "next", "w")
    gone, turn, many = [], 0, left.count()
    if many > held:
        left = cut(_met(left, left.where("next IS NOT NULL").select(F.col("next").alias("id"), F.col("id").alias("before"))))
    while many > held:
        out = (_coin(F.col("id"), turn) == 1) & F.col("before").isNotNull() & (_coin(F.col("before"), turn) == 0)
        spliced = left.where(out)
        ahead = spliced.select(F.col("before").alias("id"), F.col("next").alias("next2"), F.col("w").alias("w2"))
        back = spliced.where("next IS NOT NULL").select(F.col("next").alias("id"), F.col("before").alias("before2"))
        stay = cut(_met(left.where(~out), ahead, back))
        has = F.col("w2").isNotNull()
        gone.append(stay.where(has).select(F.col("id").alias("mate"), F.col("next").alias("child"), F.col("w").alias("own")))
        left = stay.select("id", F.when(has, F.col("next2")).otherwise(F.col("next")).alias("next"),
                           (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.coalesce("before2", "before").alias("before"))
        many, turn = left.count(), turn + 1
    ranks = cut(left.select("id", "next", "w").repartition(1).mapInArrow(_rank_task, "id long, to_end long"))
    for spliced in reversed(gone):       # each stood right behind its mate
        both = _met(ranks, spliced.withColumnRenamed("mate", "id"))
        child = F.struct(F.col("child").alias("id"), (F.col("to_end") - F.col("own")).alias("to_end"))
        kept = F.when(F.col("child").isNull(), F.array(F.struct("id", "to_end"))).otherwise(F.array(F.struct("id", "to_end"), child))
        ranks = cut(both.select(F.inline(kept)))
    return chains.join(ranks.withColumnRenamed("id", "head"), "head").select(
        "id", (F.col("to_end") - F.col("steps")).alias("to_end"))
