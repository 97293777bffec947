"""Instrument list source/sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.schemas import INSTRUMENTS

# Header names accepted for the instrument list, mapped to the
# canonical columns (the documented header and the shipped sample differ).
HEADER_ALIASES = {"secType": "sec_type", "sectype": "sec_type", "right": "opt_type",
                  "optType": "opt_type", "lastTradeDateOrContractMonth": "expiry"}
CANONICAL = [f.name for f in INSTRUMENTS.fields]


def canonical_columns(df: DataFrame) -> DataFrame:
    """Rename alias headers, add missing canonical columns as NULL, cast to
    the instrument schema (unparsable numbers -> NULL)."""
    out = df
    for a, c in HEADER_ALIASES.items():
        if a in out.columns and c not in out.columns:
            out = out.withColumnRenamed(a, c)
    cols = []
    for f in INSTRUMENTS.fields:
        if f.name in out.columns:
            col = F.col(f.name).cast("string")
            cols.append((col.try_cast(f.dataType) if f.dataType.typeName() == "double" else col).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return out.select(*cols)


def scan_instruments(spark: SparkSession, path: str) -> DataFrame:
    """Read an instrument CSV (header row) into the 7 canonical columns.
    Everything is read as text first so either header spelling works."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return canonical_columns(raw)


def write_instruments(df: DataFrame, path: str) -> None:
    """S9 sink: write a list version (a folder of CSV parts with headers) at
    ``path``.  Each version gets its own path, so a rewrite never changes a
    list another job is reading; publish a version by moving its finished
    folder into place."""
    df.write.mode("overwrite").option("header", True).csv(path)
