"""Whitening and the hash-prefix forest against plain versions."""

import collections
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.llm import forest, whitening

VEC = "vec_id long, embedding array<double>"


def brute_whiten(rows, components=16):
    """Exact deviations and covariance in fractions; eigenvectors by numpy."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max(len(v) for _, v in good)
    whole = [tuple(int(np.floor(64 * x)) + 1000000 for x in list(v) + [0.0] * (dim - len(v))) for _, v in good]
    fit = sorted(set(whole))
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n ** 3) for b in range(dim)] for a in range(dim)]
    v = np.array([[float(c) for c in r] for r in cov])
    e, basis = np.linalg.eigh(v)
    e, basis = e[::-1][:components], basis[:, ::-1][:, :components]
    z = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for x in whole])
    dev = [sum((n * c - t) ** 2 for c, t in zip(x, s)) for x in whole]
    return n, [i for i, _ in good], dev, z @ basis / np.sqrt(e), e / np.trace(v)


def vectors(seed=3, n=150, dim=9, far=1.0):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, dim)) * np.linspace(5, 1, dim) * far
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    return rows + [(500 + i, rows[3][1]) for i in range(60)] + [(3, rows[3][1]), (None, rows[4][1]), (600, None),
                                                                (601, [None] * dim), (602, [float("nan")] * dim),
                                                                (603, [float("inf")] + [0.0] * (dim - 1)), (604, rows[5][1][:4])]


@pytest.mark.parametrize("far", [1.0, 1e6, 1e9])
def test_whitening_matches_exact_covariance(spark, far):
    rows = vectors(far=far)
    out = whitening.whiten(spark.createDataFrame(rows, VEC).repartition(4), components=6).collect()
    n, ids, dev, white, explained = brute_whiten(rows, 6)
    assert len(out) == 6 * len(ids) and {r["n"] for r in out} == {n}
    by = collections.defaultdict(list)
    for r in out:
        by[r["vec_id"], r["component"]].append(r)
    for k in range(1, 7):
        sign = np.sign(white[0, k - 1] * by[0, k][0]["whitened"])
        want = collections.defaultdict(list)
        for i, w, d in zip(ids, white[:, k - 1], dev):
            want[i].append((w * sign, d))
        for i in want:
            assert len(by[i, k]) == len(want[i])
            for r, (w, d) in zip(by[i, k], want[i]):
                assert r["whitened"] == pytest.approx(w, abs=1e-6) and r["deviation"] == min(d, 2 ** 63 - 1)
                assert r["explained"] == pytest.approx(explained[k - 1], rel=1e-9) and r["identity_error"] < 1e-9


def test_whole_numbers_stay_exact_in_every_width():
    rnd = np.random.default_rng(1)
    for scale in (3, 1 << 20, 1 << 40):
        x = rnd.integers(-scale, scale, (50, 4))
        sums = [int(v) for v in x.astype(object).sum(0)]
        c = whitening.Centred(50, sums, int(x.max() - x.min()))
        z = c.values(x)
        assert (z.astype(object) == 50 * x.astype(object) - np.array(sums, object)).all()
        import pyarrow as pa
        batch = pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.int64()))], names=["x"])
        got = collections.Counter()
        for b in whitening._squares_task(c)([batch]):
            for r in b.to_pylist():
                got[r["i"], r["j"]] += r["v"] << (whitening.LIMB * r["limb"])
        for i in range(4):
            for j in range(i, 4):
                p = z[:, i].astype(object) + (0 if i == j else z[:, j].astype(object))
                assert got[i, j] == (p * p).sum()


def test_whitening_without_variance_and_empty(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VEC).withColumn("n", F.lit("own")).withColumn("x", F.lit(1))
    out = whitening.whiten(same).collect()
    assert len(out) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None
                                 and r["deviation"] == 0 and r["n"] == 1 for r in out)
    line = [(i, [float(i), 2.0 * i]) for i in range(10)]         # one direction only
    out = whitening.whiten(spark.createDataFrame(line, VEC)).where("component = 2").collect()
    assert all(r["whitened"] is None for r in out)
    assert whitening.whiten(same.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, None)], VEC)).count() == 0


# -- nearest neighbours --------------------------------------------------------

def brute_nearest(rows, k):
    good = {(i, tuple(v)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    dim = max(len(v) for _, v in good)
    good = sorted(((i, tuple(v) + (0.0,) * (dim - len(v))) for i, v in good), key=str)
    out = {}
    for i, q in good:
        if i is not None and i % 20 == 0:
            near = sorted(((-sum(a * b for a, b in zip(q, v)), float("inf") if j is None else j) for j, v in good if j != i))
            out[i, q] = [(None if j == float("inf") else int(j), -s) for s, j in near[:k]]
    return out


def clustered(seed=1, n=2500, dim=24):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(40, dim))
    x = centres[rnd.integers(0, 40, n)] + .35 * rnd.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, r.tolist()) for i, r in enumerate(x)]


@pytest.mark.parametrize("lengths", ["equal", "mixed"])
def test_forest_recall_and_scores(spark, lengths):
    rows = clustered()
    if lengths == "mixed":
        rnd = np.random.default_rng(2)
        rows = [(i, (np.array(v) * s).tolist()) for (i, v), s in zip(rows, np.exp(rnd.normal(size=len(rows))))]
    out = forest.nearest(spark.createDataFrame(rows, VEC).repartition(3), F.col("vec_id") % 20 == 0, k=10, block=300).collect()
    want = {i: r for (i, _), r in brute_nearest(rows, 10).items()}
    by = collections.defaultdict(list)
    for r in out:
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert by.keys() == want.keys()
    x = dict(rows)
    caught = 0
    for q, near in by.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, 11))
        assert near == sorted(near, key=lambda t: (-t[2], t[1]))
        for _, i, s in near:
            assert s == pytest.approx(sum(a * b for a, b in zip(x[q], x[i])), rel=1e-12)
        caught += len({i for _, i, _ in near} & {i for i, _ in want[q]})
    assert caught >= .9 * 10 * len(want)


def test_forest_edges_match_brute(spark):
    """So few rows that all are candidates: results are exact."""
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.integers(-3, 4, 4).astype(float).tolist()) for i in range(70)]
    rows += [(100 + i, [1.0, 0.0, -0.0, 2.0]) for i in range(0, 120)] + [(100, [1.0, 0.0, 0.0, 2.0])]
    rows += [(40, [9.0, 1.0, 1.0, 1.0]), (None, [2.0, 2.0, 2.0, 2.0]), (None, [1.0, 0.0, 0.0, 2.0]), (300, None), (320, [0.0] * 4),
             (340, [float("nan"), 1.0, 1.0, 1.0]), (360, [float("inf"), 1.0, 1.0, 1.0]), (380, [None, 1.0, 1.0, 1.0]), (400, [5.0]), (420, [])]
    df = spark.createDataFrame(rows, VEC).withColumn("x", F.lit("own")).withColumn("slot", F.lit("own")).repartition(3)
    out = forest.nearest(df, F.col("vec_id") % 20 == 0, k=15, recall=1.0, block=16)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["query_id"], r["slot"]].append((r["rank"], r["vec_id"], r["score"]))
    got = sorted((q, [(i, s) for _, i, s in sorted(near)]) for (q, _), near in got.items())
    want = sorted((q, near) for (q, _), near in brute_nearest([(i, None if v is None else [x if x is None else x + 0.0 for x in v])
                                                               for i, v in rows], 15).items())
    key = lambda r: (r[0], str(r[1]))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_forest_small_tables(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (5, [2.0, 1.0])], VEC)
    assert [tuple(r)[:4] for r in forest.nearest(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 5, 4.0)]
    for none in (two.limit(0), two.where("vec_id = 5"), spark.createDataFrame([(0, [0.0])], VEC), two.where("vec_id = 0")):
        assert forest.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_shared_bits_and_ranges():
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    flip = rnd.integers(0, 64, 200)
    b = a ^ (np.uint64(1) << (63 - flip).astype(np.uint64))
    assert (forest.shared_bits(a, b) == flip).all() and (forest.shared_bits(a, a) == 64).all()
    low, high = forest.prefix_range(a, flip)
    assert ((low <= a) & (a <= high) & (low <= b) & (b <= high)).all()
    low, high = forest.prefix_range(a, flip + 1)
    assert ((b < low) | (b > high)).all()
    assert (forest.as_string(forest.as_long(a)) == a).all() and (np.argsort(forest.as_long(a)) == np.argsort(a)).all()
