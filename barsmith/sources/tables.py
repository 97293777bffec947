"""Typed scans of the parquet tables.

A scan is lazy: Catalyst prunes columns and pushes filters into the parquet
reader, so ``read_table(...).select(a, b).filter(...)`` reads two columns and
skips row groups by their min/max statistics.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# (session, view name) -> source path of the registered view
_REGISTERED: dict[tuple, str] = {}


def _session_key(spark: SparkSession) -> tuple:
    return spark.sparkContext.applicationId, spark.conf.get("spark.sql.session.timeZone"), id(spark)


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register driver tables as temp views (a view is only a named plan).

    Registration reads the parquet footer on the driver; it is done once per
    session and folder (a view that still points at the same path is kept)."""
    sk = _session_key(spark)
    for n in names or DRIVER_TABLES:
        p = table_path(sf_dir, n)
        if _REGISTERED.get((sk, n)) == p and spark.catalog.tableExists(n):
            continue
        try:
            df = read_table(spark, sf_dir, n)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or names:
                raise
            continue                     # a table that this folder does not have
        df.createOrReplaceTempView(n)
        _REGISTERED[(sk, n)] = p


def scan_market_table(spark: SparkSession, path: str, schema=None,
                      fmt: str = "parquet") -> DataFrame:
    """Read a bars/ticks/greeks/trades/symbols table with a fixed schema.

    With ``schema`` given no inference pass runs; partitioned layouts
    (``date=.../``) prune by partition value when filtered on it.
    """
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def scan_jdbc(spark: SparkSession, url: str, table: str, partition_column: str,
              lower: int, upper: int, num_partitions: int, properties: dict | None = None,
              schema: str | None = None) -> DataFrame:
    """S2 from a relational store: a partitioned JDBC scan (``num_partitions``
    parallel range queries on ``partition_column``); filters and column
    selections on the result are pushed into the generated SQL."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table) \
        .option("partitionColumn", partition_column).option("lowerBound", lower) \
        .option("upperBound", upper).option("numPartitions", num_partitions)
    if schema:
        r = r.option("customSchema", schema)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r.load()
