"""Exact top-k inner products over norm-sorted blocks.

Vectors of whole numbers are dealt by range into blocks of descending length.
An orthogonal rotation from the SVD of all vectors (eigenvectors of their Gram
matrix, summed in the tasks) puts most of the energy into the first
coordinates.  Then

* every query meets the longest vectors first, which gives it a k-th score t;
  blocks whose longest vector x has |q| |x| < t are never paired with it;
* in a pair of blocks the partial sum over the first coordinates plus the
  product of the residual lengths bounds the score (Cauchy-Schwarz); what the
  bound cannot rule out is scored exactly, and t rises as the block is read.

Queries are a stated share of the rows, dealt into blocks of their own, so a
task holds two blocks of bounded size.  Bounds are widened by the rounding
error of the rotation; scores themselves are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import cut
from barsmith.llm.shingles import grouped

BLOCK, QUERIES, FIRST, CHUNK = 8192, 2048, 2048, 1024
#: share of the coordinates in the partial sums
HEAD = 4
NO_ID = np.iinfo(np.int64).max


def whole(embedding: Column, scale: float) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    rows = column.to_pylist()
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _gram_task(dim: int):
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % 32], pa.int32()),
                                          "gram": pa.array([total.tobytes()], pa.binary())})
    return run


def _gram_sum(batches):
    for (part,), rows in grouped(batches, ["part"]):
        total = sum(np.frombuffer(g) for g in rows.column("gram").to_pylist())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                          "gram": pa.array([total.tobytes()], pa.binary())})


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal columns by falling energy.  A dim x dim matrix is all that
    reaches the driver."""
    g = vectors.select("x").mapInArrow(_gram_task(dim), "part int, gram binary")
    for part in (F.col("part"), F.lit(0)):
        g = g.withColumn("part", part.cast("int")).repartition("part").sortWithinPartitions("part").mapInArrow(
            _gram_sum, "part int, gram binary")
    rows = g.collect()
    if not rows or not dim:
        return np.eye(dim)
    values, basis = np.linalg.eigh(np.frombuffer(bytes(rows[0]["gram"])).reshape(dim, dim))
    return np.ascontiguousarray(basis[:, np.argsort(-values)])


def _ids(column) -> np.ndarray:
    return np.array([NO_ID if v is None else v for v in column.to_pylist()], np.int64)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products; whole numbers in doubles as long as they fit."""
    size = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if size < 2.0 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    out = q.astype(object) @ x.astype(object).T
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.q, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.n = n

    def add(self, q, score, ids) -> None:
        if not len(q):
            return
        q, score, ids = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.id, ids)))
        by = np.lexsort((ids, -score.astype(np.float64), q)) if np.abs(score).max() < 2 ** 53 else \
            np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(score[i]), ids[i])))
        q, score, ids = q[by], score[by], ids[by]
        start = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - start[q]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last].astype(np.float64))
        keep = rank < self.k
        self.q, self.score, self.id = q[keep], score[keep], ids[keep]


def search(qid, q, floor, xid, x, basis: np.ndarray, k: int) -> Best:
    """The k best rows of x for each query, of those that reach its floor."""
    best = Best(len(q), k, floor)
    head = max(1, q.shape[1] // HEAD)
    length = np.linalg.norm(x.astype(np.float64), axis=1)
    by = np.argsort(-length, kind="stable")
    x, xid, length = x[by], xid[by], length[by]
    rq, qlen = q.astype(np.float64) @ basis, np.linalg.norm(q.astype(np.float64), axis=1)
    rest_q = np.linalg.norm(rq[:, head:], axis=1)
    for at in range(0, len(x), CHUNK):
        part, ids, size = x[at:at + CHUNK], xid[at:at + CHUNK], length[at:at + CHUNK]
        slack = 1e-9 * qlen * size[0] + 1e-6
        open_ = np.flatnonzero(qlen * size[0] + slack >= best.floor)
        if not len(open_):
            break                    # all further vectors are shorter
        rx = part.astype(np.float64) @ basis
        bound = rq[open_, :head] @ rx[:, :head].T + np.outer(rest_q[open_], np.linalg.norm(rx[:, head:], axis=1))
        may = bound + slack[open_, None] >= best.floor[open_, None]
        may &= ids[None, :] != qid[open_, None]
        i, j = np.nonzero(may)
        if not len(i):
            continue
        cols = np.unique(j)
        score = _products(q[open_], part[cols])[i, np.searchsorted(cols, j)]
        over = score >= best.floor[open_[i]]
        best.add(open_[i[over]], score[over], ids[j[over]])
    return best


def _seed_task(shared, k: int, dim: int):
    """Each query's k-th score among the longest vectors, and the last block
    whose longest vector can still reach it."""
    def run(batches):
        xid, x, basis, tops = shared.value
        for batch in batches:
            qid, q = _ids(batch.column(0)), _matrix(batch.column(1), dim)
            best = search(qid, q, np.full(len(q), -np.inf), xid, x, basis, k)
            qlen = np.linalg.norm(q.astype(np.float64), axis=1)
            reach = qlen[:, None] * tops[None, :] * (1 + 1e-9) + 1e-6 >= best.floor[:, None]
            last = np.where(reach.any(axis=1), tops.size - 1 - np.argmax(reach[:, ::-1], axis=1), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.floor), pa.array(last.astype(np.int32))],
                                             names=[*batch.schema.names, "floor", "last"])
    return run


def _pair_task(shared, k: int, dim: int):
    def run(batches):
        basis = shared.value
        for _, rows in grouped(batches, ["block", "part"]):
            asks = np.array(rows.column("asks").to_pylist(), bool)
            ids, vecs = _ids(rows.column("vec_id")), _matrix(rows.column("x"), dim)
            qid, q, xid, x = ids[asks], vecs[asks], ids[~asks], vecs[~asks]
            floor = np.array(rows.column("floor").to_pylist(), np.float64)[asks]
            keys = np.array(rows.column("ask").to_pylist(), object)[asks]
            best = search(qid, q, floor, xid, x, basis, k)
            if len(best.q):
                yield pa.RecordBatch.from_pydict({
                    "ask": pa.array(keys[best.q].tolist(), pa.int64()), "query_id": pa.array(qid[best.q]),
                    "vec_id": pa.array([None if v == NO_ID else v for v in best.id.tolist()], pa.int64()),
                    "score": pa.array(best.score)})
    return run


def top_products(table: DataFrame, is_query: Column, *, vec_id: str = "vec_id", embedding: str = "embedding",
                 k: int = 20, scale: float = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k largest inner products.

    Vectors that are null or hold a null or non-finite component take no part;
    shorter ones are filled with zeros.  A query's own id is no candidate.
    Rows with equal id and vector count once; one id with two vectors is two
    queries, whose results have the same ``query_id``.  A null id is never a
    query and sorts last among ties.  Scores beyond 64 bits are cut to them."""
    spark = table.sparkSession
    rows = table.where(usable(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(embedding), scale).alias("x"),
        F.coalesce(is_query, F.lit(False)).alias("asks")).dropDuplicates(["vec_id", "x"])
    rows = cut(rows.withColumn("size2", F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v)))
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dim"),
                     F.sum(F.col("asks").cast("long")).alias("asks")).first()
    dim = stats["dim"] or 0
    sorted_ = cut(rows.repartitionByRange(max(1, -(-stats["n"] // BLOCK)), F.col("size2").desc(), "vec_id")
                  .withColumn("block", F.spark_partition_id()))
    tops = sorted(sorted_.groupBy("block").agg(F.max("size2").alias("top")).collect())
    tops = np.sqrt(np.array([0.0] * ((tops[-1][0] + 1) if tops else 0)) if not tops else
                   np.array([dict(map(tuple, tops)).get(b, 0.0) for b in range(tops[-1][0] + 1)]))
    basis = rotation(sorted_, dim)
    longest = sorted_.orderBy(F.col("size2").desc(), "vec_id").limit(FIRST).select("vec_id", "x").collect()
    first = (np.array([NO_ID if r["vec_id"] is None else r["vec_id"] for r in longest], np.int64),
             np.array([list(r["x"]) + [0] * (dim - len(r["x"])) for r in longest], np.int64).reshape(len(longest), dim))
    shared = spark.sparkContext.broadcast((*first, basis, tops))
    only = spark.sparkContext.broadcast(basis)

    asked = sorted_.where("asks").select("vec_id", "x", F.xxhash64("vec_id", "x").alias("ask"))
    asked = asked.mapInArrow(_seed_task(shared, k, dim), "vec_id long, x array<long>, ask long, floor double, last int")
    parts = max(1, -(-(stats["asks"] or 0) // QUERIES))
    asked = cut(asked.withColumn("part", F.pmod("ask", F.lit(parts)).cast("int")))
    ask = asked.where("last >= 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("last"))))
    ask = ask.select("block", "part", F.lit(True).alias("asks"), "vec_id", "x", "floor", "ask")
    met = ask.select("block", "part").distinct()
    have = sorted_.join(met, "block").select("block", "part", F.lit(False).alias("asks"), "vec_id", "x",
                                             F.lit(None).cast("double").alias("floor"), F.lit(None).cast("long").alias("ask"))
    found = ask.unionByName(have).repartition("block", "part").sortWithinPartitions("block", "part").mapInArrow(
        _pair_task(only, k, dim), "ask long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id", "ask").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def top_sql(table: str = "embeddings", every: int = 20, k: int = 20, scale: int = 64) -> str:
    return f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM {table} WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""
