"""Connected components by alternating large and small stars.

Tasks first contract the edges they hold to stars around local minima.  Then,
in rounds, every edge's smaller end is replaced by that node's own smallest
neighbour (large star), and every node's smaller neighbours are pointed at the
smallest of them (small star); the edges left at the end are stars around the
smallest node of each component.  What a round joins is written first, so a hub
with a third of all edges is split like any skewed join.  Nothing goes to the
driver but whether the edges are stars already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import cut, cut_fresh

#: edges that a task contracts at a time
HELD = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each is connected to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contract(by: bool):
    def run(batches):
        held, size = [], 0

        def stars():
            cols = [np.concatenate([np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for b in held])
                    for i in range(held[0].num_columns)]
            *group, a, b = cols
            for g in np.unique(group[0]) if by else (None,):
                mine = group[0] == g if by else slice(None)
                node, root = local_roots(a[mine], b[mine])
                out = node != root
                if out.any():
                    head = [pa.array(np.full(int(out.sum()), g), held[0].schema.field(0).type)] if by else []
                    yield pa.RecordBatch.from_arrays([*head, pa.array(node[out]), pa.array(root[out])],
                                                     names=[*(["g"] if by else []), "u", "v"])
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= HELD:
                yield from stars()
                held, size = [], 0
        if held:
            yield from stars()
    return run


def components(edges: DataFrame, by: str | None = None) -> DataFrame:
    """``(by, node, root)`` for all nodes of edges ``(by, a, b)`` but the roots
    themselves; ``by`` (an int column) keeps several graphs apart.  Goes on until
    every component is a star."""
    keys = [by] if by else []
    e = edges.where("a <> b").select(*keys, F.col("a").cast("long"), F.col("b").cast("long"))
    e = e.mapInArrow(_contract(bool(by)), ("g int, " if by else "") + "u long, v long")
    e = e.withColumnRenamed("g", by) if by else e

    e = cut(e.distinct())
    turn = 0
    while True:
        low = cut(e.groupBy(*keys, F.col("u").alias("v")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c")))
        # done when every node has one root and no root is a node
        open_ = low.where("c > 1").select(F.lit(1)).unionAll(e.join(low, [*keys, "v"]).select(F.lit(1)))
        if not open_.take(1):
            break
        large = e.join(low.drop("c"), [*keys, "v"], "left").select(*keys, "u", F.coalesce("m", "v").alias("v"))
        large = cut(large.distinct())
        least = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*keys, "u"]).where("v > m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        turn += 1
        e = small.unionByName(least.withColumnRenamed("m", "v")).distinct()
        e = cut(e) if turn % 3 else cut_fresh(e)
    return e.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
