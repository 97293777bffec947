"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words.  A document's expected number of copies is
its propensity times a per-source factor, at most ``max_copies``; the whole
part of it is taken for certain, and the fraction pi is its inclusion
probability for one copy more.  Documents are ranked by

    [U / (1 - U)] / [pi / (1 - pi)]

(Rosen's Pareto order sampling: random odds over inclusion odds) and the
sample is the prefix of that order whose words come nearest to what the
certain copies leave of the target, so its size is fixed rather than random.

U is a hash of (seed, document id): reruns and retried tasks agree.  Nothing is
sorted per source.  The order is cut by counting words in 1024 bins of the
rank, then in 1024 bins of the bin that holds the cut, and only the rows of
that last bin (a millionth of the source) are ordered one by one.  The answer
is one threshold per source, so applying it is a map over the documents.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import cut, passes_columns, small, words_in

#: bins per level of the search for the cut
BINS = 1024
INF = float("inf")


def source_key(source: Column) -> Column:
    """Sources as non-null keys in code point order, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed only."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    high = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (high.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def size_class(size: Column) -> Column:
    """Binary digits of the size: 1, 1, 2, 2, 3, ..."""
    return F.length(F.bin(size))


def propensity(cls: Column) -> Column:
    """Relative rate at which documents of a size class are taken: longer ones
    a little less often, so that a few long documents do not make the mix."""
    return F.lit(1.0) / (F.lit(7.0) + cls.cast("double"))


def _targets(sizes: DataFrame, weights, share: float, max_copies: int) -> DataFrame:
    """One row per source: words, weight and target.  Shares go by weight; a
    target stops at ``max_copies`` times its source and the excess is reshared
    among the others.  Sorted by size over weight the sources that stop are a
    prefix, so two running sums give the level at which the rest settles."""
    every = Window.orderBy("__src")
    w = F.lit(None)
    for i, x in enumerate(weights):
        w = F.when((F.row_number().over(every) - 1) % len(weights) == i, F.lit(float(x))).otherwise(w)
    s = sizes.groupBy("__src").agg(F.sum("__words").alias("__src_words"))
    s = s.withColumn("__weight", w).withColumn("__top", F.col("__src_words").cast("double") * max_copies)
    asc = Window.orderBy(F.col("__top") / F.col("__weight"), "__src")
    upto = asc.rowsBetween(Window.unboundedPreceding, -1)
    onward = asc.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    goal = F.sum("__src_words").over(whole).cast("double") * F.lit(share)
    level = (goal - F.coalesce(F.sum("__top").over(upto), F.lit(0.0))) / F.sum("__weight").over(onward)
    s = s.withColumn("__level", level)
    free = F.when(F.col("__top") > F.col("__level") * F.col("__weight"), F.struct("__place", "__level"))
    s = s.withColumn("__place", F.row_number().over(asc))
    s = s.withColumn("__level", F.min(free).over(whole)["__level"])
    aim = F.coalesce(F.col("__level") * F.col("__weight"), F.col("__top"))
    return s.select("__src", "__src_words", F.least("__top", aim).alias("__target"))


def _factors(sizes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """Per source the factor on the propensities that meets the target when
    expected copies stop at ``max_copies``, and the words left to sample."""
    p = propensity(F.col("__cls"))
    c = sizes.join(targets, "__src").withColumn("__p", p)
    order = Window.partitionBy("__src").orderBy(F.col("__p").desc())   # one row per size class
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("__words").over(upto), F.lit(0)).cast("double")
    rest = F.sum(F.col("__words").cast("double") * F.col("__p")).over(onward)
    c = c.withColumn("__f", F.when(rest > 0, (F.col("__target") - F.lit(float(max_copies)) * full) / rest))
    fits = F.when(F.col("__f") * F.col("__p") <= max_copies, F.struct(F.lit(0.0) - F.col("__p"), F.col("__f")))
    c = c.withColumn("__factor", F.coalesce(F.min(fits).over(Window.partitionBy("__src"))["__f"], F.lit(INF)))
    certain = F.floor(F.least(F.lit(float(max_copies)), F.col("__factor") * F.col("__p"))).cast("long")
    return c.groupBy("__src").agg(
        F.first("__src_words").alias("__src_words"), F.first("__target").alias("__target"),
        F.first("__factor").alias("__factor"),
        (F.first("__target") - F.sum(F.col("__words") * certain)).alias("__left"))


def _expected(max_copies: int) -> Column:
    return F.least(F.lit(float(max_copies)), F.col("__factor") * propensity(size_class(F.col("__size"))))


def _odds(doc_id: Column, seed: str, max_copies: int) -> Column:
    """The Pareto rank; null where no copy is left to chance."""
    u, e = uniform(doc_id, seed), _expected(max_copies)
    pi = e - F.floor(e)
    return F.when(pi > 0, (u / (F.lit(1.0) - u)) * ((F.lit(1.0) - pi) / pi))


def _boundary(rows: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Per source the first key at which the running words pass what is left
    to sample, with the words before it.  At most BINS keys a source."""
    run = rows.groupBy("__src", key).agg(F.sum("__size").alias("__w"))
    run = run.join(state.select("__src", "__left", "__before"), "__src")
    upto = Window.partitionBy("__src").orderBy(key)
    run = run.withColumn("__to", F.col("__before") + F.sum("__w").over(upto))
    return run.where(F.col("__to") > F.col("__left")).groupBy("__src").agg(
        F.min(F.struct(F.col(key), (F.col("__to") - F.col("__w")).alias("__before"))).alias("__hit"))


def plan_mix(docs: DataFrame, doc_id: str, source: str, size: Column, *, weights=(5, 2, 1),
             share: float = 1.5, max_copies: int = 2, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """``(digest, plan)``: the digest has ``__id, __src, __size`` per document;
    the plan has one row per source with its target, factor and threshold."""
    digest = cut(docs.select(F.col(doc_id).alias("__id"), source_key(F.col(source)).alias("__src"),
                             F.coalesce(size, F.lit(0)).cast("long").alias("__size")))
    sizes = cut(digest.groupBy("__src", size_class(F.col("__size")).alias("__cls"))
                .agg(F.sum("__size").alias("__words")))
    targets = _targets(sizes, weights, share, max_copies)
    plan = cut(_factors(sizes, targets, max_copies))

    ranked = digest.join(small(plan), "__src").select(
        "__src", "__size", _odds(F.col("__id"), seed, max_copies).alias("__q")).where("__q IS NOT NULL")
    ranked = ranked.withColumn("__b1", F.floor(_bin() / BINS)).withColumn("__b2", _bin() % BINS)
    state, rows = plan.withColumn("__before", F.lit(0).cast("long")), ranked
    for key in ("__b1", "__b2"):
        kept = ["__src", "__left"] + ["__b1"] * (key == "__b2")
        hit = cut(_boundary(rows, state, key))
        state = hit.join(state.select(*kept), "__src").select(
            *kept, F.col("__hit")[key].alias(key), F.col("__hit")["__before"].alias("__before"))
        rows = rows.join(small(state.select("__src", key)), ["__src", key], "left_semi")
    # the rows of the last bin, one by one; equal ranks go together
    last = rows.groupBy("__src", "__q").agg(F.sum("__size").alias("__w"))
    last = last.join(state.select("__src", "__left", "__before"), "__src")
    to = F.col("__before") + F.sum("__w").over(Window.partitionBy("__src").orderBy("__q"))
    last = last.withColumn("__to", to).where(F.lit(2) * F.col("__to") - F.col("__w") <= F.lit(2) * F.col("__left"))
    ends = last.groupBy("__src").agg(F.max("__q").alias("__last"))
    at = state.select("__src", (F.col("__b1") * BINS + F.col("__b2")).alias("__cut"))
    return digest, cut(plan.join(at, "__src", "left").join(ends, "__src", "left"))


def _bin() -> Column:
    return F.floor(F.col("__q") / (F.lit(1.0) + F.col("__q")) * (BINS * BINS)).cast("long")


def apply_mix(rows: DataFrame, plan: DataFrame, *, max_copies: int = 2, seed: str = "mix") -> DataFrame:
    """Adds ``__copies`` (and the plan's columns) to rows with ``__id, __src,
    __size``: certain copies, and one more up to the source's threshold."""
    q = _odds(F.col("__id"), seed, max_copies)
    chosen = F.col("__cut").isNull() | (_bin() < F.col("__cut")) | (
        (_bin() == F.col("__cut")) & (F.col("__q") <= F.col("__last")))
    more = F.when(F.col("__q").isNotNull() & F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    return (rows.join(small(plan), "__src").withColumn("__q", q)
            .withColumn("__copies", F.floor(_expected(max_copies)).cast("long") + more))


@passes_columns
def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
        **how) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (at least 1) each.

    Null and empty texts have no words: they cost nothing, and go by the same
    ranks.  A null source is a source of its own.  Rows with one document id
    share their random number, so equal rows are taken or left together.  An
    empty table gives an empty mix.  A column named ``copies`` is replaced; all
    others are passed on."""
    size = words_in(F.col(text))
    _, plan = plan_mix(docs, doc_id, source, size, **how)
    names = [c for c in docs.columns if c != "copies"]
    keep = {k: v for k, v in how.items() if k in ("max_copies", "seed")}
    rows = docs.withColumns({"__id": F.col(doc_id), "__src": source_key(F.col(source)), "__size": size})
    return (apply_mix(rows, plan, **keep).where("__copies > 0")
            .select(*names, F.col("__copies").alias("copies")))


def mix_report(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text",
               **how) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken, copies``: the
    digest alone is read again, not the texts."""
    digest, plan = plan_mix(docs, doc_id, source, words_in(F.col(text)), **how)
    keep = {k: v for k, v in how.items() if k in ("max_copies", "seed")}
    return apply_mix(digest, plan, **keep).select(
        F.col("__id").alias("doc_id"), F.col("__size").alias("size"),
        F.col("__src_words").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"), F.col("__copies").alias("copies"))


def mix_sql(table: str = "documents", seed: str = "mix") -> str:
    """The same mix in DuckDB SQL, without the bins."""
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    (CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)
      + CAST(0.5 AS DOUBLE)) / CAST({1 << 52} AS DOUBLE) AS u
  FROM {table}),
dc AS (SELECT *, CAST(1 AS DOUBLE) / (CAST(7 AS DOUBLE) + length(bin(size))) AS p FROM d),
s0 AS (SELECT src, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY src),
s1 AS (SELECT *, [CAST(5 AS DOUBLE), 2, 1][1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS w,
         CAST(words AS DOUBLE) * 2 AS top FROM s0),
s2 AS (SELECT *, row_number() OVER o AS place,
         ((SELECT CAST(sum(words) AS DOUBLE) FROM s0) * CAST(1.5 AS DOUBLE)
           - coalesce(sum(top) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM s1 WINDOW o AS (ORDER BY top / w, src)),
s3 AS (SELECT *, (SELECT arg_min(level, place) FROM s2 WHERE top > level * w) AS lv FROM s2),
t AS (SELECT src, words, least(top, coalesce(lv * w, top)) AS target FROM s3),
c0 AS (SELECT src, p, CAST(sum(size) AS BIGINT) AS cw FROM dc GROUP BY src, p),
c1 AS (SELECT c0.*, target,
         coalesce(sum(cw) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fullw,
         sum(CAST(cw AS DOUBLE) * p) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
       FROM c0 JOIN t USING (src) WINDOW o AS (PARTITION BY src ORDER BY p DESC)),
c2 AS (SELECT *, CASE WHEN rest > 0 THEN (target - CAST(2 AS DOUBLE) * CAST(fullw AS DOUBLE)) / rest END AS f FROM c1),
f0 AS (SELECT src, arg_max(f, p) AS factor FROM c2 WHERE f * p <= 2 GROUP BY src),
e AS (SELECT dc.*, words, target,
        least(CAST(2 AS DOUBLE), coalesce(factor, CAST('inf' AS DOUBLE)) * p) AS e
      FROM dc JOIN t USING (src) LEFT JOIN f0 USING (src)),
q AS (SELECT *, CASE WHEN e - floor(e) > 0
        THEN (u / (1 - u)) * ((1 - (e - floor(e))) / (e - floor(e))) END AS q FROM e),
l AS (SELECT src, any_value(target) - sum(size * CAST(floor(e) AS BIGINT)) AS lft FROM q GROUP BY src),
g AS (SELECT src, q, sum(size) AS w FROM q WHERE q IS NOT NULL GROUP BY src, q),
r AS (SELECT g.*, lft, sum(w) OVER (PARTITION BY src ORDER BY q) AS upto FROM g JOIN l USING (src)),
k AS (SELECT src, q, 2 * upto - w <= 2 * lft AS inside FROM r)
SELECT doc_id, size, words AS source_size, target,
  CAST(size * (CAST(floor(e) AS BIGINT) + CASE WHEN inside THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(floor(e) AS BIGINT) + CASE WHEN inside THEN 1 ELSE 0 END AS copies
FROM q LEFT JOIN k USING (src, q)"""
