"""Approximate nearest neighbours by a hash-prefix forest.

Every tree gives a vector a string of 64 bits (signs against random planes that
halve a sample) and is the sorted array of these strings, dealt into blocks by
a range sort.  Vectors whose string shares a long prefix with a query's lie
side by side in that array.

* Descent: in each tree a query counts, in the block its own string belongs to
  and over whole blocks beyond it, how many strings share its first b bits, for
  every b: from its longest match up to the root.
* Synchronous ascent: all trees climb together, from the longest matches
  upwards, until they hold as many candidates as the budget asks for.
* The vectors below the level reached are compared with the query exactly,
  block by block, and each block returns the best of them, as far as they
  reach the k-th best score of those in a sample.

The budget is fitted: a fixed sample of queries is compared with all rows, and
the budget is the least with which they find ``recall`` of their true
neighbours.  Data without structure need many candidates, clustered data few;
nothing is cut off.  Vectors of other lengths than the longest get one
more coordinate that makes all equally long, so the largest inner product is the
smallest angle; queries have zero there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barsmith.llm.common import cut
from barsmith.llm.shingles import grouped

BITS, TREES, SEED = 64, 6, 20
#: strings of a block; entries of the table of all blocks
BLOCK, MOST_BLOCKS = 1 << 16, 1 << 20
#: vectors that the planes are fitted to, queries that the budget is fitted to
SAMPLE, ASKED, RECALL = 4096, 256, 0.95
#: scores that a task holds at a time
HELD = 1 << 22
TOP = np.uint64(1 << 63)


def usable(vector: Column) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


class Planes:
    """The hash functions of all trees: planes through the medians of a sample."""

    def __init__(self, sample: np.ndarray, longest: float, trees: int, seed: int):
        self.trees, self.longest = trees, longest
        self.normals = np.random.default_rng(seed).normal(size=(sample.shape[1] + 1, trees * BITS))
        self.offsets = np.zeros(trees * BITS)
        if len(sample):
            self.offsets = np.median(self.equal(sample, False) @ self.normals, axis=0)

    def equal(self, x: np.ndarray, asks: bool) -> np.ndarray:
        """Vectors made equally long."""
        length = np.linalg.norm(x, axis=1)
        if asks:
            return np.column_stack([x / length[:, None], np.zeros(len(x))])
        share = np.minimum(length / self.longest, 1.0)
        return np.column_stack([x / self.longest, np.sqrt((1 - share) * (1 + share))])

    def strings(self, x: np.ndarray, asks: bool) -> np.ndarray:
        """A string per vector (rows) and tree, the first bit highest."""
        bits = (self.equal(x, asks) @ self.normals > self.offsets).reshape(len(x), self.trees, BITS)
        packed = np.packbits(bits, axis=2)
        return packed.view(">u8").reshape(len(x), self.trees).astype(np.uint64)


def as_long(strings: np.ndarray) -> np.ndarray:
    """Strings as whole numbers in the same order."""
    return (strings ^ TOP).view(np.int64)


def as_string(longs: np.ndarray) -> np.ndarray:
    return np.asarray(longs, np.int64).view(np.uint64) ^ TOP


def prefix_range(strings: np.ndarray, bits) -> tuple[np.ndarray, np.ndarray]:
    """First and last string with the same first ``bits`` bits."""
    rest = np.uint64(BITS) - np.asarray(bits, np.uint64)
    mask = np.where(rest >= BITS, ~np.uint64(0), (np.uint64(1) << np.minimum(rest, np.uint64(BITS - 1))) - np.uint64(1))
    return strings & ~mask, strings | mask


def shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix."""
    diff = a ^ b
    out = np.full(diff.shape, BITS, np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = diff >> np.uint64(step)
        big = high != 0
        out[big] -= step
        diff = np.where(big, high, diff)
    return out - (diff != 0)


class Blocks:
    """The blocks of every tree: number, first and last string, strings before."""

    def __init__(self, of: list[tuple[np.ndarray, ...]]):
        self.of = of

    @staticmethod
    def arrays(rows, trees: int) -> list[tuple[np.ndarray, ...]]:
        by_tree = [sorted((r["block"], r["first"], r["last"], r["n"]) for r in rows if r["tree"] == t) for t in range(trees)]
        cols = [[np.array(v, np.int64) for v in zip(*mine)] for mine in by_tree]
        return [(block, as_string(first), as_string(last), np.append(0, np.cumsum(n))) for block, first, last, n in cols]

    def home(self, tree: int, strings: np.ndarray) -> np.ndarray:
        """The block that a string belongs to."""
        block, first, _, _ = self.of[tree]
        return block[np.maximum(np.searchsorted(first, strings, "right") - 1, 0)]

    def met(self, tree: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first block that reaches ``low`` and behind the last
        that begins by ``high``."""
        _, first, last, _ = self.of[tree]
        return np.searchsorted(last, low, "left"), np.searchsorted(first, high, "right")

    def inside(self, tree: int, low: np.ndarray, high: np.ndarray, but: int) -> np.ndarray:
        """Strings of whole blocks within a range, without block ``but``."""
        block, first, last, total = self.of[tree]
        a, b = np.searchsorted(first, low, "left"), np.searchsorted(last, high, "right")
        b = np.maximum(a, b)
        at = np.searchsorted(block, but)
        return total[b] - total[a] - np.where((a <= at) & (at < b), total[at + 1] - total[at], 0)


def _strings_task(planes: Planes, dim: int, asks: bool):
    def run(batches):
        for batch in batches:
            s = as_long(planes.strings(matrix(batch.column(1), dim), asks))
            m = len(s)
            slot = np.repeat(batch.column(0).to_numpy(), planes.trees)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.tile(np.arange(planes.trees, dtype=np.int32), m)),
                                              pa.array(s.ravel())], names=["slot", "tree", "string"])
    return run


def _descend_task(shared):
    """How many strings share each query's first b bits in this tree."""
    def run(batches):
        blocks = Blocks(shared.value)
        bits = np.arange(BITS + 1)
        for (tree, block), rows in grouped(batches, ["tree", "block"]):
            asks = rows.column("asks").to_numpy()
            strings = as_string(rows.column("string").to_numpy())
            mine = np.sort(strings[~asks])
            slots, strings = rows.column("slot").to_numpy()[asks], strings[asks]
            for at in range(0, len(slots), 4096):
                part = strings[at:at + 4096]
                low, high = prefix_range(part[:, None], bits[None, :])
                count = np.searchsorted(mine, high, "right") - np.searchsorted(mine, low, "left")
                count = count + blocks.inside(tree, low, high, block)
                yield pa.RecordBatch.from_arrays([pa.array(slots[at:at + 4096]), pa.array([c.tobytes() for c in count], pa.binary())],
                                                 names=["slot", "counts"])
    return run


def _sum_task(batches):
    """Counts of all trees together."""
    for (slot,), rows in grouped(batches, ["slot"]):
        total = sum(np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist())
        yield pa.RecordBatch.from_pydict({"slot": pa.array([slot]), "counts": pa.array([total.tobytes()], pa.binary())})


def level(counts: np.ndarray, budget: int) -> np.ndarray:
    """The longest prefix at which enough strings are below, else the root."""
    return np.maximum((counts >= budget).sum(axis=1) - 1, 0)       # counts fall with the bits


def floors(x: np.ndarray, ranges: list[tuple[np.ndarray, np.ndarray]], sample: np.ndarray, strings: np.ndarray,
           k: int) -> np.ndarray:
    """A score that k candidates of each query reach: the k-th best of those in
    a sample of the rows (one more, as the query may be in it itself)."""
    if len(sample) <= k:
        return np.full(len(x), -np.inf)
    found = np.zeros((len(x), len(sample)), bool)
    for t, (low, high) in enumerate(ranges):
        found |= (strings[:, t] >= low[:, None]) & (strings[:, t] <= high[:, None])
    score = np.where(found, x @ sample.T, -np.inf)
    slack = 1e-9 * np.linalg.norm(x, axis=1) * np.linalg.norm(sample, axis=1).max()
    return np.partition(score, score.shape[1] - k - 1, axis=1)[:, -k - 1] - slack


def _ascend_task(shared, sampled, planes: Planes, dim: int, budget: int, k: int):
    """Blocks in which a query has candidates, the prefix they share, and the
    score from which they may be results."""
    def run(batches):
        blocks, sample = Blocks(shared.value), sampled.value
        sample_strings = planes.strings(sample, False)
        for batch in batches:
            x = matrix(batch.column(1), dim)
            bits = level(np.stack([np.frombuffer(c, np.int64) for c in batch.column(2).to_pylist()]), budget)
            strings = planes.strings(x, True)
            ranges = [prefix_range(strings[:, t], bits) for t in range(planes.trees)]
            step = max(1, HELD // max(1, len(sample)))
            floor = np.concatenate([floors(x[i:i + step], [(a[i:i + step], b[i:i + step]) for a, b in ranges], sample,
                                           sample_strings, k) for i in range(0, len(x), step)] or [np.zeros(0)])
            who, tree, block, low, high = [], [], [], [], []
            for t, (a, b) in enumerate(ranges):
                first, last = blocks.met(t, a, b)
                size = np.maximum(last - first, 0)
                if t:
                    size = np.where(bits == 0, 0, size)             # the roots hold the same
                at = np.repeat(np.arange(len(x)), size)
                place = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + first[at]
                who, tree = who + [at], tree + [np.full(len(at), t, np.int32)]
                block, low, high = block + [blocks.of[t][0][place]], low + [as_long(a[at])], high + [as_long(b[at])]
            at = np.concatenate(who)
            if len(at):
                vectors = batch.column(1).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), *(pa.array(np.concatenate(v)) for v in (tree, block, low, high)),
                     pa.array(floor[at]), vectors], names=["slot", "tree", "block", "low", "high", "floor", "x"])
    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, components added in their order."""
    return np.add.accumulate(q * x, axis=1)[:, -1]


def best(score: np.ndarray, k: int, slack: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all that may be among the k largest of a row and reach
    its floor."""
    if score.shape[1] > k:
        floor = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, -k] - slack)
    return np.nonzero(score >= floor[:, None])


def _compare(q, qslot, floor, x, xslot, k: int):
    """Best rows of x for each row of q as (query slot, slot, score), by blocks
    of bounded size; the candidates of every part are cut to the k best."""
    step = max(1, HELD // max(1, len(x)))
    size = np.linalg.norm(x, axis=1).max(initial=0.0)
    for at in range(0, len(q), step):
        part = q[at:at + step]
        i, j = best(part @ x.T, k, 1e-9 * np.linalg.norm(part, axis=1) * size, floor[at:at + step])
        yield qslot[at:at + step][i], xslot[j], exact(part[i], x[j])


FOUND = "ask long, slot long, score double"


def _found(parts) -> pa.RecordBatch:
    ask, slot, score = (np.concatenate(p) for p in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(ask), pa.array(slot), pa.array(score)], names=["ask", "slot", "score"])


def _compare_task(dim: int, k: int):
    """Within a block: every query with the rows in its range."""
    def run(batches):
        for _, rows in grouped(batches, ["tree", "block"]):
            asks = rows.column("asks").to_numpy()
            slot, x = rows.column("slot").to_numpy(), matrix(rows.column("x"), dim)
            low, high = as_string(rows.column("low").to_numpy()), as_string(rows.column("high").to_numpy())
            q, qslot, low_q, high_q = x[asks], slot[asks], low[asks], high[asks]
            floor = rows.column("floor").to_numpy()[asks]
            if not len(q):
                continue
            by = np.argsort(low[~asks], kind="stable")                 # rows have their string as low
            x, slot, string = x[~asks][by], slot[~asks][by], low[~asks][by]
            a, b = np.searchsorted(string, low_q, "left"), np.searchsorted(string, high_q, "right")
            order = np.lexsort((b, a))
            edge = np.flatnonzero(np.append(True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)))
            for i, j in zip(edge, np.append(edge[1:], len(order))):
                same, (m, n) = order[i:j], (a[order[i]], b[order[i]])
                if n > m:
                    parts = list(_compare(q[same], qslot[same], floor[same], x[m:n], slot[m:n], k))
                    yield _found(parts)
    return run


def _truth_task(sample: np.ndarray, slots: np.ndarray, dim: int, k: int):
    """Sampled queries against all rows, a batch at a time."""
    def run(batches):
        for batch in batches:
            none = np.full(len(slots), -np.inf)
            parts = list(_compare(sample, slots, none, matrix(batch.column(1), dim), batch.column(0).to_numpy(), k)) if len(slots) else []
            if parts:
                yield _found(parts)
    return run


def fitted_budget(counts: np.ndarray, need: np.ndarray, ask: np.ndarray, recall: float) -> int:
    """The least budget with which ``recall`` of the true neighbours (one each
    of ``need``: the longest prefix a tree shares with query ``ask``) are found:
    a neighbour is, once one bit more holds less than the budget."""
    if not len(need):
        return 1
    beyond = np.where(need < BITS, counts[ask, np.minimum(need + 1, BITS)], 0) + 1
    return int(np.sort(beyond)[min(len(beyond) - 1, int(np.ceil(recall * len(beyond))) - 1)])


def nearest(table: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20,
            trees: int = TREES, recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k rows found with
    the largest inner products in double precision, ties to the smaller id.

    Vectors that are null, zero or hold a null or non-finite component take no
    part; shorter ones are filled with zeros.  A query's own id is no candidate.
    Equal vectors are one in the forest and come back each (with ties beyond k
    to smaller ids).  A null id is never a query and sorts last.  One id with
    two vectors is two queries, told apart by ``slot``."""
    spark: SparkSession = table.sparkSession
    rows = table.where(usable(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.transform(F.col(embedding), lambda x: x.cast("double") + F.lit(0.0)).alias("x"))
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, slot long")
    filled = F.concat("x", F.array_repeat(F.lit(0.0), dim - F.size("x")))
    rows = rows.withColumn("x", F.when(F.size("x") < dim, filled).otherwise(F.col("x"))).dropDuplicates(["x", "vec_id"])
    # of equal vectors only the k + 1 smallest ids can be results
    rows = cut(rows.withColumn("place", F.row_number().over(Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last()))))
    ids = rows.where(F.col("place") <= k + 1).groupBy("x").agg(F.collect_list("vec_id").alias("ids"), F.max(F.col("vec_id").isNull()).alias("nameless"))
    asked = rows.where(F.col("asks") & F.col("vec_id").isNotNull()).select("x", "vec_id")
    slots = cut(ids.join(asked.groupBy("x").agg(F.lit(True).alias("asks")), "x", "left").select(
        F.monotonically_increasing_id().alias("slot"), "x", F.sort_array("ids").alias("ids"), "nameless",
        F.coalesce("asks", F.lit(False)).alias("asks")))

    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    stats = slots.agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("longest")).first()
    picked = slots.orderBy(F.xxhash64("x"), "slot").limit(SAMPLE).select("x").collect()
    sampled = np.array([r["x"] for r in picked], np.float64).reshape(-1, dim)
    planes = Planes(sampled, stats["longest"], trees, seed)
    block = max(block, -(-stats["n"] * trees // MOST_BLOCKS))
    arrays = slots.select("slot", "x").mapInArrow(_strings_task(planes, dim, False), "slot long, tree int, string long")
    order = ["tree", "string", "slot"]
    arrays = cut(arrays.repartitionByRange(max(1, -(-stats["n"] * trees // block)), *order).sortWithinPartitions(*order)
                 .withColumn("block", F.spark_partition_id().cast("long")))
    edges = arrays.groupBy("tree", "block").agg(F.min("string").alias("first"), F.max("string").alias("last"),
                                                F.count(F.lit(1)).alias("n")).collect()
    shared = spark.sparkContext.broadcast(Blocks.arrays(edges, trees))

    queries = slots.where("asks").select("slot", "x")
    homes = queries.mapInArrow(_strings_task(planes, dim, True), "slot long, tree int, string long")
    homes = homes.mapInArrow(_home_task(shared), "slot long, tree int, string long, block long")
    both = homes.withColumn("asks", F.lit(True)).unionByName(arrays.withColumn("asks", F.lit(False)))
    counts = both.repartition("tree", "block").sortWithinPartitions("tree", "block").mapInArrow(
        _descend_task(shared), "slot long, counts binary")
    counts = cut(counts.repartition("slot").sortWithinPartitions("slot").mapInArrow(_sum_task, "slot long, counts binary"))

    sample = queries.orderBy(F.xxhash64("x"), "slot").limit(ASKED).collect()
    sample_slots = np.array([r["slot"] for r in sample], np.int64)
    sample_x = np.array([r["x"] for r in sample], np.float64).reshape(-1, dim)
    truth = slots.select("slot", "x").mapInArrow(_truth_task(sample_x, sample_slots, dim, k + 1), FOUND)
    of_query = Window.partitionBy("ask").orderBy(F.col("score").desc(), "slot")
    truth = truth.where("ask <> slot").withColumn("r", F.row_number().over(of_query)).where(F.col("r") <= k)
    known = {r["slot"]: np.frombuffer(r["counts"], np.int64)
             for r in counts.where(F.col("slot").isin(sample_slots.tolist())).collect()}
    true = truth.join(slots.select("slot", "x"), "slot").select("ask", "x").collect()       # at most ASKED * k
    at = np.searchsorted(np.sort(sample_slots), np.array([r["ask"] for r in true], np.int64))
    by = np.argsort(sample_slots)
    need = np.zeros(0, np.int64)
    if true:
        ours = planes.strings(sample_x[by], True)[at]
        need = shared_bits(ours, planes.strings(np.array([r["x"] for r in true], np.float64), False)).max(axis=1)
    budget = fitted_budget(np.array([known[s] for s in sample_slots[by].tolist()]).reshape(-1, BITS + 1), need, at, recall)

    sent = queries.join(counts, "slot").mapInArrow(
        _ascend_task(shared, spark.sparkContext.broadcast(sampled), planes, dim, max(budget, k + 1), k + 1),
        "slot long, tree int, block long, low long, high long, floor double, x array<double>")
    have = arrays.join(slots.select("slot", "x"), "slot").select(
        "slot", "tree", "block", F.col("string").alias("low"), F.col("string").alias("high"),
        F.lit(None).cast("double").alias("floor"), "x", F.lit(False).alias("asks"))
    found = sent.withColumn("asks", F.lit(True)).unionByName(have).repartition("tree", "block").sortWithinPartitions(
        "tree", "block").mapInArrow(_compare_task(dim, k + 1), FOUND)
    found = found.groupBy("ask", "slot").agg(F.max("score").alias("score"))
    found = found.withColumn("r", F.row_number().over(of_query)).where(F.col("r") <= 2 * k + 2)
    return _results(rows, slots, asked, found, k)


def _home_task(shared):
    def run(batches):
        blocks = Blocks(shared.value)
        for batch in batches:
            tree, strings = batch.column(1).to_numpy(), as_string(batch.column(2).to_numpy())
            home = np.zeros(len(tree), np.int64)
            for t in np.unique(tree):
                home[tree == t] = blocks.home(t, strings[tree == t])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], names=["slot", "tree", "string", "block"])
    return run


def _results(rows: DataFrame, slots: DataFrame, asked: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Neighbours of equal queries found once: their ids in order, and each
    query's list without itself."""
    named = F.when(F.col("nameless"), F.concat("ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("ids"))
    ids = found.join(slots.select("slot", named.alias("ids")), "slot").select(
        "ask", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ids = ids.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    lists = ids.groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    lists = cut(slots.select(F.col("slot").alias("ask"), "x").join(lists, "ask"))
    out = asked.join(lists, "x").select(F.col("vec_id").alias("query_id"), F.col("ask").alias("slot"), "near")
    own = F.filter("near", lambda e: ~e["vec_id"].eqNullSafe(F.col("query_id")))
    out = out.select("query_id", "slot", F.posexplode(F.slice(own, 1, k)).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"),
                      F.col("e.score").alias("score"), "slot")
