"""Whitening by polarisation.

Components become whole numbers, and every distinct vector counts once.  With n
of them and sums S per dimension, n * x - S is a whole number too, centred
without rounding.  Tasks add up the squares of these centred values for every
dimension and for the sum of every two dimensions; since
var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of these variances are
all covariances.  The squares are summed exactly (in halves of 24 bits, or as
Python integers where those do not suffice), so the covariance is rounded once,
when it is assembled for the eigensolver.

What reaches the driver, and what is sent back, has a size given by the number
of dimensions: their sums, their pairs, the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import cut

#: bits of a half of a centred value; bits of a limb of an exact total
HALF, LIMB = 24, 60
#: centred pair sums that a task holds at a time
HELD = 1 << 21
#: components beyond are cut to it, so that whole numbers are exact in doubles
LARGEST = float(1 << 52)
LONG = (1 << 63) - 1
#: share of the largest eigenvalue, by dimension, below which one is none
NO_VARIANCE = 2.0 ** -72


def usable(vector: Column) -> Column:
    """Neither null nor with null or non-finite entries."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def whole(vector: Column, scale: float, shift: int) -> Column:
    def entry(x):
        scaled = F.floor(x.cast("double") * F.lit(float(scale)))
        return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), scaled.cast("double"))).cast("long") + F.lit(shift)
    return F.transform(vector, entry)


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.int64).reshape(len(column), dim)


def _limbs(total: int):
    """A whole number as limbs of ``LIMB`` bits, the last with the sign."""
    k = 0
    while not -(1 << LIMB) < total < 1 << LIMB:
        yield k, total & ((1 << LIMB) - 1)
        total, k = total >> LIMB, k + 1
    yield k, total


def _send(totals: dict) -> pa.RecordBatch:
    rows = [(*at, k, v) for at, total in totals.items() for k, v in _limbs(int(total))]
    i, j, k, v = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(k, pa.int32()),
                                       pa.array(v, pa.int64())], names=["i", "j", "limb", "v"])


SENT = "i int, j int, limb int, v long"


def collected(sent: DataFrame) -> dict[tuple[int, int], int]:
    """Exact totals by (i, j): added by limbs, then put together."""
    out = {}
    for r in sent.groupBy("i", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (int(r["v"]) << (LIMB * r["limb"]))
    return out


def _sums_task(dim: int):
    def run(batches):
        high, low = np.zeros(dim, object), np.zeros(dim, object)
        for batch in batches:
            x = rows_of(batch.column(0), dim)
            high, low = high + (x >> HALF).sum(0).astype(object), low + (x & ((1 << HALF) - 1)).sum(0).astype(object)
        yield _send({(i, i): (int(h) << HALF) + int(v) for i, (h, v) in enumerate(zip(high, low))})
    return run


class Centred:
    """n * x - S of vectors as whole numbers."""

    def __init__(self, n: int, sums: list[int], spread: int):
        self.n, self.dim = n, len(sums)
        self.base = np.array([s // n for s in sums], np.int64)           # near the mean, so products stay small
        self.rest = [s - n * int(b) for s, b in zip(sums, self.base)]
        #: no centred value is larger, nor half the sum of two
        self.bound = n * (spread + 2)
        self.narrow = 2 * self.bound < 1 << (2 * HALF)

    def values(self, x: np.ndarray) -> np.ndarray:
        kind = np.int64 if self.bound < 1 << 62 else object
        return (x - self.base).astype(kind) * self.n - np.array(self.rest, kind)

    def doubles(self, z: np.ndarray) -> np.ndarray:
        return (z / self.n).astype(np.float64)


def _squares_task(centred: Centred):
    """Sums of squares of every dimension (i, i) and pair sum (i, j)."""
    def run(batches):
        i, j = np.triu_indices(centred.dim)
        single = i == j
        step = max(1, min(HELD // len(i), 1 << (62 - 2 * HALF)))         # sums of halves stay below 2^63
        totals = np.zeros(len(i), object)
        for batch in batches:
            z = centred.values(rows_of(batch.column(0), centred.dim))
            for at in range(0, len(z), step):
                part = z[at:at + step]
                pair = part[:, i] + np.where(single, 0, part[:, j])
                if centred.narrow:
                    h, v = pair >> HALF, pair & ((1 << HALF) - 1)
                    hh, hv, vv = ((a * b).sum(0).astype(object) for a, b in ((h, h), (h, v), (v, v)))
                    totals = totals + hh * (1 << 2 * HALF) + hv * (2 << HALF) + vv
                else:
                    whole_ = pair.astype(object)
                    totals = totals + (whole_ * whole_).sum(0)
        yield _send(dict(zip(zip(i.tolist(), j.tolist()), totals)))
    return run


def covariance(squares: dict, dim: int) -> list[list[int]]:
    """2 n^3 times the covariance matrix, from the variances of dimensions and
    of their pair sums."""
    out = [[0] * dim for _ in range(dim)]
    for (i, j), total in squares.items():
        out[i][j] = out[j][i] = 2 * total if i == j else total - squares[i, i] - squares[j, j]
    return out


def principal(cov: list[list[int]], unit: int, count: int) -> tuple[np.ndarray, list[float], float]:
    """Unit eigenvectors of ``cov / unit`` (columns, by falling eigenvalue), their
    eigenvalues as exact Rayleigh quotients, and the trace."""
    dim = len(cov)
    v = np.array([[c / unit for c in row] for row in cov], np.float64).reshape(dim, dim)
    _, basis = np.linalg.eigh(v)
    basis = basis[:, ::-1][:, :count]
    values = []
    for k in range(basis.shape[1]):
        if basis[np.argmax(np.abs(basis[:, k])), k] < 0:
            basis[:, k] = -basis[:, k]
        w = [int(x) for x in np.rint(basis[:, k] * 2.0 ** 53)]
        quotient = sum(a * sum(c * b for c, b in zip(row, w)) for a, row in zip(w, cov))
        values.append(quotient / (unit * sum(a * a for a in w)))
    return np.ascontiguousarray(basis), values, sum(cov[i][i] for i in range(dim)) / unit


def _moments_task(centred: Centred, project: np.ndarray):
    """Sums of the whitened values (i, -1) and of their products (i, j)."""
    def run(batches):
        r = project.shape[1]
        one, two = np.zeros(r), np.zeros((r, r))
        for batch in batches:
            z = centred.doubles(centred.values(rows_of(batch.column(0), centred.dim))) @ project
            one, two = one + z.sum(0), two + z.T @ z
        at = [(i, -1, one[i]) for i in range(r)] + [(i, j, two[i, j]) for i in range(r) for j in range(r)]
        i, j, v = zip(*at) if at else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64())],
                                         names=["i", "j", "v"])
    return run


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten_task(centred: Centred, project: np.ndarray, known: np.ndarray, explained: list, error):
    def run(batches):
        r = len(known)
        for batch in batches:
            z = centred.values(rows_of(batch.column(1), centred.dim))
            m = len(z)
            if centred.dim * centred.bound ** 2 <= LONG:
                deviation = (z * z).sum(1)
            else:
                deviation = [min(LONG, int(d)) for d in (z.astype(object) ** 2).sum(1)]
            white = centred.doubles(z) @ project
            rows = np.repeat(np.arange(m), r)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * r, centred.n)), pa.array(deviation, pa.int64()).take(pa.array(rows)),
                 pa.array(white.ravel(), mask=~np.tile(known, m)), pa.array(explained * m, pa.float64()),
                 pa.array([error] * (m * r), pa.float64())], names=[c.split()[0] for c in OUT.split(", ")])
    return run


def whiten(table: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64,
           shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``:
    a row for each usable vector and each of the first ``components``.

    Vectors that are null or hold null or non-finite entries are left out; so
    are empty ones if all are.  Shorter vectors are filled with zeros; entries
    beyond 2^52 are cut to it.  Repeated rows come back each and count once in
    the fit.  A component without variance has a null ``whitened`` and is no
    part of ``identity_error`` (null if none is left); ``explained`` is null if
    nothing varies.  A ``deviation`` of more than 63 bits is cut to them."""
    spark = table.sparkSession
    rows = table.where(usable(F.col(embedding))).select(
        F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(embedding), scale, shift).alias("x"))
    dim = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(shift).cast("long"), dim - F.size("x")))
    rows = rows.withColumn("x", F.when(F.size("x") < dim, filled).otherwise(F.col("x")))
    if not dim:
        return spark.createDataFrame([], OUT)
    fit = cut(rows.select("x").distinct())
    size = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high")).first()
    n = size["n"]
    sums = collected(fit.mapInArrow(_sums_task(dim), SENT))
    centred = Centred(n, [sums[i, i] for i in range(dim)], size["high"] - size["low"])
    squares = collected(fit.mapInArrow(_squares_task(centred), SENT))
    basis, values, trace = principal(covariance(squares, dim), 2 * n ** 3, components)
    known = np.array([v > max(values) * dim * NO_VARIANCE for v in values])
    project = basis / np.sqrt(np.where(known, values, 1.0))

    moments = fit.mapInArrow(_moments_task(centred, project), "i int, j int, v double")
    m = {(r["i"], r["j"]): r["v"] / n for r in moments.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    errors = [abs(m[i, j] - m[i, -1] * m[j, -1] - (i == j)) for i in range(len(known)) for j in range(len(known))
              if known[i] and known[j]]
    explained = [v / trace if trace else None for v in values]
    return rows.mapInArrow(_whiten_task(centred, project, known, explained, max(errors, default=None)), OUT)
