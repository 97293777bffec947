"""Query registry."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DateType, MapType, StructType

from barsmith.sources.fixtures import register_fixtures, with_fixtures


def present(df: DataFrame) -> DataFrame:
    """Result presentation shared with the SQL twins: DATE columns as
    TIMESTAMP (midnight) and nested columns as JSON text, so results compare
    as plain scalars in any client."""
    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, DateType):
            cols[f.name] = F.col(f.name).cast("timestamp_ntz")
        elif isinstance(f.dataType, (ArrayType, StructType, MapType)):
            cols[f.name] = F.to_json(F.col(f.name))
    return df.withColumns(cols) if cols else df


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession], DataFrame]   # fixtures already registered
    fixtures: tuple[str, ...]
    sql: str | None = None                        # DuckDB text (fixtures as CTEs)
    doc: str = ""
    tags: tuple[str, ...] = field(default_factory=tuple)
    dates: tuple[str, ...] = ()      # DATE columns of the result (shown as TIMESTAMP)
    nested: tuple[str, ...] = ()     # nested columns of the result (shown as JSON)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        register_fixtures(spark, sf_dir, list(self.fixtures))
        return present(self.build(spark))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        sql = with_fixtures(self.sql, self.fixtures) if self.fixtures else self.sql
        rep = [f"CAST({c} AS TIMESTAMP) AS {c}" for c in self.dates] + \
              [f"CAST(to_json({c}) AS VARCHAR) AS {c}" for c in self.nested]
        if rep:
            sql = f"SELECT * REPLACE ({', '.join(rep)}) FROM (\n{sql}\n) _q"
        return sql


REGISTRY: dict[str, Query] = {}


def register(name: str, fixtures=(), sql: str | None = None, tags=(), dates=(), nested=()):
    """Decorator: ``@register('q', fixtures=['fx_ticks'], sql='SELECT ...')``.
    ``dates`` / ``nested`` name the result's DATE and nested columns so the
    SQL twin presents them like the Spark side (see :func:`present`)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, tuple(fixtures), sql, (fn.__doc__ or "").strip(),
                               tuple(tags), tuple(dates), tuple(nested))
        return fn
    return deco
