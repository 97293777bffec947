"""Line dedup over levelled sorted runs of line hashes.

The runs hold every line key once, as a 128-bit hash with the document that
keeps the line and the number of documents of its own batch that have it.  They
are tables bucketed and sorted by hash.  Batches come in descending order of
document id, so a key that no run has yet is kept by a document of this batch:

* a new batch is written as a sorted run of its own keys and merged against
  the runs there are: the anti-join leaves the keys that are new, which become
  a run of level 0; the rest only counts the documents that repeat them;
* ``fan_in`` runs of a level are compacted into one of the next, so a batch
  meets a logarithmic number of runs and a key is rewritten as often.

Runs share their bucketing, so merging shuffles neither side.  A line that a
third of all documents share is one row per batch: documents are counted with
map-side aggregation before anything moves.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm.common import SPACE, cut, passes_columns, small
from barsmith.session import scratch_table

HASH = ["__h1", "__h2"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else.  Pure ASCII takes the fast function."""
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, UPPER, UPPER.lower())))


def _strip(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("__h1"), F.xxhash64(F.lit("line"), key).alias("__h2"))


def line_keys(text: Column, min_chars: int) -> Column:
    """Distinct hashes of the keys of a text that are long enough."""
    lines = F.split(lower_ascii(F.coalesce(text, F.lit(""))), "\n", -1)
    long = F.filter(F.transform(lines, _strip), lambda k: F.char_length(k) >= min_chars)
    return F.array_distinct(F.transform(long, _hash))


class SortedRuns:
    """Levels of runs with the columns ``__h1, __h2, __docs, __top``."""

    def __init__(self, spark: SparkSession, buckets: int, fan_in: int = 3):
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.levels: list[list[str]] = [[]]

    def write(self, keys: DataFrame) -> str:
        return scratch_table(self.spark, keys.write.bucketBy(self.buckets, *HASH).sortBy(*HASH), "line_run")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def _place(self, name: str, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fan_in:
            merged = self.write(reduce(DataFrame.unionByName, map(self.spark.table, self.levels[level])))
            self.drop(*self.levels[level])
            self.levels[level] = []
            self._place(merged, level + 1)

    def add(self, keys: DataFrame) -> str | None:
        """Add a batch of distinct keys.  Returns the table of those that the
        runs had already (nothing for the first batch)."""
        own, earlier = self.write(keys), self.runs()
        if not earlier:
            self._place(own)
            return None
        batch = self.spark.table(own)
        fresh = reduce(lambda left, run: left.join(run, HASH, "left_anti"), earlier, batch)
        new = self.write(fresh)
        again = self.write(batch.join(self.spark.table(new), HASH, "left_anti"))
        self.drop(own)
        self._place(new)
        return again

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        self.drop(*(t for level in self.levels for t in level))


def repeated_lines(docs: DataFrame, doc_id: str, text: str, *, min_chars: int = 40, min_docs: int = 5,
                   batches: int = 4, fan_in: int = 3) -> DataFrame:
    """Per document the hashes of the lines that it loses: ``__doc, __drop``."""
    spark = docs.sparkSession
    edges = [i / batches for i in range(1, batches)]
    bounds = docs.agg(F.percentile_approx(doc_id, edges).alias("b")).first()["b"] or []
    below = F.lit(0)
    for b in bounds:            # 0 for the largest ids; null ids come last
        below = below + F.when(F.col("__doc") > b, 0).otherwise(1)
    found = (docs.select(F.col(doc_id).alias("__doc"), F.explode(line_keys(F.col(text), min_chars)).alias("__k"))
             .select("__doc", "__k.*").withColumn("__batch", below))
    lines = scratch_table(spark, found.write.partitionBy("__batch"), "lines")
    runs = SortedRuns(spark, int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    repeats = []
    for b in range(len(bounds) + 1):
        batch = spark.table(lines).where(F.col("__batch") == b)
        held = batch.select("__doc", *HASH).distinct()      # rows with one id are one document
        keys = held.groupBy(*HASH).agg(F.count(F.lit(1)).alias("__docs"), F.max("__doc").alias("__top"))
        repeats.append(runs.add(keys))
    repeats = [t for t in repeats if t]
    held = reduce(DataFrame.unionByName, runs.runs())
    if repeats:
        more = reduce(DataFrame.unionByName, map(spark.table, repeats))
        more = more.groupBy(*HASH).agg(F.sum("__docs").alias("__more"))
        held = held.join(more, HASH, "left")
    else:
        held = held.withColumn("__more", F.lit(0).cast("long"))
    common = cut(held.where(F.col("__docs") + F.coalesce("__more", F.lit(0)) >= min_docs).select(*HASH, "__top"))
    lost = spark.table(lines).join(small(common), HASH).where(~F.col("__doc").eqNullSafe(F.col("__top")))
    lost = cut(lost.groupBy("__doc").agg(F.collect_set(F.struct(*HASH)).alias("__drop")))
    runs.close()
    runs.drop(lines, *repeats)
    return lost


@passes_columns
def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Adds ``n_lines``, ``n_dropped`` and ``kept`` (the lines that stay,
    joined by line feeds) to the documents.

    A key found in ``min_docs`` documents loses all its lines but those of the
    largest id holding it.  Null and empty texts are one empty line.  Rows with
    one id are one document; null ids are one too, the smallest.  A line repeated within a text stays or goes as a whole.  Columns
    of the added names are replaced; all others are passed on."""
    lost = repeated_lines(docs, doc_id, text, **how)
    min_chars = how.get("min_chars", 40)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)

    def stays(line: Column) -> Column:
        key = _strip(line)
        return ~((F.char_length(key) >= min_chars) & F.array_contains("__drop", _hash(lower_ascii(key))))

    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept")]
    both = docs.join(lost, F.col(doc_id).eqNullSafe(F.col("__doc")), "left")
    rest = F.when(F.col("__drop").isNull(), F.coalesce(F.col(text), F.lit(""))) \
        .otherwise(F.array_join(F.filter(lines, stays), "\n"))
    gone = F.when(F.col("__drop").isNull(), 0).otherwise(F.size(F.filter(lines, lambda x: ~stays(x))))
    return both.select(*names, F.size(lines).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"),
                       rest.alias("kept"))


def digest_lines(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of :func:`dedup_lines`."""
    out = dedup_lines(docs.select("doc_id", "text"), **how)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def lines_sql(table: str = "documents") -> str:
    return f"""
WITH l AS (
  SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM {table})),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        '{UPPER}', '{UPPER.lower()}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
r AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id"""
