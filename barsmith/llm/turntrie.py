"""Prefix trie of conversations, measured by an Euler tour.

Conversations that begin with the same turns share a path of the trie.  A node
is a distinct sequence of first turns; it is known by its depth and the XOR of
128-bit hashes of its (position, role, text), so a conversation's prefixes come
from a running XOR (kept in chunks, a long conversation is many tasks) and the
parent's name from one more XOR.

Nodes are numbered so that siblings are neighbours.  Every node has an arc that
enters it and one that leaves it; an arc's successor follows from the numbers
of the first child, the next sibling and the parent.  The tour is list-ranked
(``listrank``), and sums over subtrees (leaves, repeated words) are differences
of prefix sums at the positions of a node's two arcs.  No step walks the trie
level by level, so its depth costs nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import cut, words_in
from barsmith.llm.listrank import BLOCK, HELD, rank_list

#: turns of a chunk of a conversation, positions of a chunk of the tour, ids of
#: a piece of the list that a node's hash covers
TURNS, POSITIONS, IDS = 4096, 1 << 16, 4096


def numbered(rows: DataFrame, order: list[Column], name: str, *drop: str) -> DataFrame:
    """Rows numbered from 0 in an order over all of them: a range sort, and one
    count a partition.  The result is written, without the columns ``drop``."""
    at = F.monotonically_increasing_id()
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, at).drop(*drop))
    part = F.shiftright(F.col(name), 33)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))          # one row a partition
    rows = rows.withColumn("__part", part).join(F.broadcast(starts.drop("__n")), "__part")
    return rows.withColumn(name, F.col("__start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__start")


def turns(table: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
          text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(conv, pos, h1, h2, words)`` for every turn, its position counted from
    1, and ``(conv, first, n)`` for every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = table.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2"), words_in(text).alias("words"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = numbered(rows, order, "at", "turn", "role", "text")
    convs = cut(rows.groupBy("conv").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")))
    return rows, convs


def regrouped(rows: DataFrame, convs: DataFrame, share: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with turns of another: conversation c takes the
    first h turns of c - c % share and then its own after its first h, h being
    the CRC-32 of its decimal number modulo ``most``."""
    base = F.col("conv") - F.col("conv") % share
    convs = convs.withColumn("base", base).withColumn("h", F.crc32(F.col("conv").cast("string")) % most)
    lent = convs.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = cut(convs.withColumn("total", F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    rows = cut(rows.join(convs.select("conv", "first", "h", "lent", "total"), "conv").withColumn(
        "pos", F.col("at") - F.col("first") + 1))
    own = rows.where("pos > h").select("conv", "total", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"),
                                       "h1", "h2", "words")
    heads = rows.where(F.col("pos") < most).select(F.col("conv").alias("base"), "pos", "h1", "h2", "words")
    taken = convs.select("conv", "base", "lent", "total").join(heads, "base").where("pos <= lent")
    return own.unionByName(taken.select(own.columns)), convs.select("conv", "total")


def prefixes(rows: DataFrame) -> DataFrame:
    """``conv, depth, p1, p2, q1, q2, words, last``: every prefix of every
    conversation by its hash (p), its parent's (q) and the words of its last
    turn; ``last`` marks the whole conversation."""
    rows = rows.select("conv", "pos", "words", (F.col("pos") == F.col("total")).alias("last"),
                       F.floor((F.col("pos") - 1) / F.lit(TURNS)).cast("long").alias("chunk"),
                       F.xxhash64("pos", "h1", "h2").alias("a1"), F.xxhash64(F.lit(2), "h2", "pos", "h1").alias("a2"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("conv", "chunk").agg(F.bit_xor("a1").alias("s1"), F.bit_xor("a2").alias("s2"),
                                                F.max("last").alias("ends"))
    carried = carried.where(~(F.col("ends") & (F.col("chunk") == 0)))        # a single chunk carries nothing
    carried = carried.select("conv", "chunk", *(F.bit_xor(c).over(before).alias(c) for c in ("s1", "s2")))
    within = Window.partitionBy("conv", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried, ["conv", "chunk"], "left")
    for p, a, s in (("p1", "a1", "s1"), ("p2", "a2", "s2")):
        rows = rows.withColumn(p, F.bit_xor(a).over(within).bitwiseXOR(F.coalesce(s, F.lit(0))))
    return rows.select("conv", F.col("pos").alias("depth"), "p1", "p2", F.col("p1").bitwiseXOR(F.col("a1")).alias("q1"),
                       F.col("p2").bitwiseXOR(F.col("a2")).alias("q2"), "words", "last")


NODE = ["depth", "p1", "p2"]


def _pieces_task(batches):
    """Sorted ends of conversations as comma-joined ids, ``IDS`` at most."""
    key, ids = None, []

    def piece():
        return pa.RecordBatch.from_pydict({
            "depth": pa.array([key[0]]), "p1": pa.array([key[1]]), "p2": pa.array([key[2]]),
            "first": pa.array([ids[0]]), "ids": pa.array([",".join(map(str, ids))])})
    for batch in batches:
        for *k, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv"))):
            if ids and (k != key or len(ids) >= IDS):
                yield piece()
                ids = []
            key = k
            ids.append(conv)
    if ids:
        yield piece()


def _digest_task(batches):
    """SHA-256 over a node's pieces in order, a piece at a time."""
    key, sha = None, None

    def done():
        return pa.RecordBatch.from_pydict({"depth": pa.array([key[0]]), "p1": pa.array([key[1]]),
                                           "p2": pa.array([key[2]]), "ends_sha256": pa.array([sha.hexdigest()])})
    for batch in batches:
        for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if k != key:
                if sha:
                    yield done()
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
    if sha:
        yield done()


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node the digest of the ids of the conversations that end there.
    Hashing is sequential by its nature; a node's ids come as long strings made
    in parallel, and the task that hashes them holds one of these at a time."""
    order = [*NODE, "conv"]
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _rebatched(_pieces_task), "depth long, p1 long, p2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        _rebatched(_digest_task), "depth long, p1 long, p2 long, ends_sha256 string")


def _rebatched(task, rows: int = 4096):
    """The small batches of a task, many at a time."""
    def run(batches):
        held, size = [], 0
        for b in task(batches):
            held.append(b)
            size += b.num_rows
            if size >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run


def tour(nodes: DataFrame) -> DataFrame:
    """Arcs ``(id, next)`` of the Euler tour of numbered nodes: arc 2k enters
    node k, arc 2k + 1 leaves it."""
    k, enter = F.col("number"), F.col("arc") == 0
    after_enter = F.when(F.col("n_children") > 0, 2 * F.col("first_child")).otherwise(2 * k + 1)
    after_leave = F.when(k < F.col("last_sibling"), 2 * (k + 1)).otherwise(2 * F.col("parent") + 1)
    return nodes.withColumn("arc", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        (2 * k + F.col("arc")).alias("id"), F.when(enter, after_enter).otherwise(after_leave).alias("next"))


def subtree_sums(nodes: DataFrame, arcs: DataFrame, sums: dict[str, Column], block: int = BLOCK,
                 held: int = HELD) -> DataFrame:
    """``number`` and, for each of ``sums`` (a value per node), its sum over the
    node's subtree: prefix sums over the ranked tour, where an arc that enters
    carries its node's value, taken at the node's two arcs."""
    ranks = rank_list(arcs, block, held)
    at = ranks.select(F.floor(F.col("id") / 2).cast("long").alias("number"), (F.col("id") % 2 == 0).alias("enters"),
                      (-F.col("to_end")).alias("at"))                 # only the order of positions counts
    at = at.withColumn("chunk", F.floor(F.col("at") / F.lit(POSITIONS)).cast("long"))
    at = at.join(nodes.select("number", *(v.alias(n) for n, v in sums.items())), "number")
    at = cut(at.withColumns({n: F.when(F.col("enters"), F.col(n)).otherwise(F.lit(0)) for n in sums}))
    over = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)      # one row a chunk
    chunks = at.groupBy("chunk").agg(*(F.sum(n).alias(n) for n in sums)).select(
        "chunk", *(F.coalesce(F.sum(n).over(over), F.lit(0)).alias(f"{n}_before") for n in sums))
    within = Window.partitionBy("chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    at = at.join(chunks, "chunk").select("number", "enters", *(
        (F.sum(n).over(within) + F.col(f"{n}_before") - F.when(F.col("enters"), F.col(n)).otherwise(0)).alias(n) for n in sums))
    signed = {n: F.when(F.col("enters"), -F.col(n)).otherwise(F.col(n)) for n in sums}
    return at.groupBy("number").agg(*(F.sum(v).alias(n) for n, v in signed.items()))


def prefix_trie(rows: DataFrame, convs: DataFrame, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """The trie of conversations ``convs (conv, total)`` with turns ``rows
    (conv, pos, total, h1, h2, words)``, one row a node: ``conv_id`` (smallest
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.  No conversations, no nodes, not even a root."""
    steps = cut(prefixes(rows))
    nodes = steps.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"),
                                     *(F.min(c).alias(c) for c in ("words", "q1", "q2")))
    root = convs.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv", "n_convs",
                       zero.alias("words"), none.alias("q1"), none.alias("q2"))
    nodes = cut(nodes.unionByName(root))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("conv").alias("parent_conv"))
    nodes = nodes.join(parents, ["depth", "q1", "q2"], "left")
    nodes = cut(numbered(nodes, [F.col("parent_conv").asc_nulls_first(), F.col("depth"), F.col("conv")], "number"))

    families = nodes.where("depth > 0").groupBy("parent_conv", "depth").agg(
        F.min("number").alias("first_child"), F.max("number").alias("last_sibling"), F.count(F.lit(1)).alias("n_children"))
    up = (F.col("depth") - 1).alias("depth")
    below = families.select(F.col("parent_conv").alias("conv"), up, "first_child", "last_sibling", "n_children")
    nodes = cut(nodes.join(below.drop("last_sibling"), ["conv", "depth"], "left"))
    above = below.join(nodes.select("conv", "depth", F.col("number").alias("parent")), ["conv", "depth"]).select(
        F.col("conv").alias("parent_conv"), (F.col("depth") + 1).alias("depth"), "parent", "last_sibling")
    nodes = cut(nodes.join(above, ["parent_conv", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))))

    sums = subtree_sums(nodes, tour(nodes), {
        "n_leaves": (F.col("n_children") == 0).cast("long"),
        "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}, block, held)
    ends = steps.where("last").select(*NODE, "conv").unionByName(
        convs.where("total = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv"))
    out = nodes.join(sums, "number").join(end_digests(ends), NODE, "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs",
                      "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(table: DataFrame, *, share: int = 20, most: int = 4, block: int = BLOCK, held: int = HELD,
                      **columns: str) -> DataFrame:
    """The trie of the conversations of a table, each begun with turns of its
    group's first (``regrouped``; ``most=1`` leaves them as they are).

    A null role or text is the empty string; a null turn comes first; turns of
    equal number are in the order of role and text, so repeated rows are turns
    of their own; rows without a conversation id are no conversation's.  An
    empty table has no nodes.  Other columns are not read."""
    return prefix_trie(*regrouped(*turns(table, **columns), share, most), block, held)


def trie_sql(table: str = "conversations", share: int = 20, most: int = 4) -> str:
    """The same by joining every node with all its ancestors."""
    crc = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(c AS VARCHAR), ''),
      lambda x: CAST(ascii(x) AS BIGINT))), lambda acc, b: list_reduce(list_concat([xor(acc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda e, z: xor(e >> 1, 3988292384 * (e & 1)))), 4294967295)"""
    return f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM {table} WHERE conv_id IS NOT NULL),
c AS (SELECT c, c - c % {share} AS base, {crc} % {most} AS h FROM (SELECT DISTINCT c FROM t)),
taken AS (
  SELECT c.c, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.base AND t.pos <= c.h
  UNION ALL SELECT c.c, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.c AND t.pos > c.h),
r AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY pos) AS pos, role, text FROM taken),
p AS (
  SELECT c, pos AS depth, text, string_agg(sha256(concat(length(role), ' ', role, text)), '')
    OVER (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING) AS key FROM r
  UNION ALL SELECT c, 0, '', '' FROM c),
n AS (
  SELECT depth, key, min(c) AS c, count(*) AS n_convs,
    (count(*) - 1) * len(regexp_extract_all(min(text), '[^\\x20\\x09-\\x0D]+')) AS saved FROM p GROUP BY depth, key),
k AS (
  SELECT n.*, m.c AS parent FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.key = left(n.key, 64 * (n.depth - 1))),
f AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY ALL),
w AS (SELECT k.*, coalesce(f.n_children, 0) AS n_children FROM k LEFT JOIN f ON f.parent = k.c AND f.depth = k.depth),
s AS (
  SELECT a.depth, a.key, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved_tokens
  FROM w JOIN p a ON a.c = w.c AND a.depth <= w.depth GROUP BY a.depth, a.key),
e AS (
  SELECT depth, key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
  FROM (SELECT c, max(depth) AS depth, max(key) AS key FROM p GROUP BY c) GROUP BY depth, key)
SELECT w.c AS conv_id, CAST(w.depth AS BIGINT) AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM w JOIN s USING (depth, key) LEFT JOIN e USING (depth, key)"""
