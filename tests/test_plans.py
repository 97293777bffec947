"""Plan properties every registered query must keep at any scale."""

import pytest

from barsmith.plans import load_all
from tests.conftest import SF_SMALL

REG = load_all()

# Physical operators that do not scale: pairwise products, row-at-a-time Python.
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REG))
def test_no_pairwise_or_row_python(spark, name):
    plan = _plan(REG[name].run(spark, SF_SMALL))
    bad = [op for op in FORBIDDEN if op in plan]
    assert not bad, f"{name}: {bad}"


def test_scan_pushes_filters_and_prunes_columns(spark):
    df = REG["scan_market_table"].run(spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "l_comment" not in plan and "l_returnflag" not in plan


def test_bars_keep_symbol_windows_off_tick_rows(spark):
    """N-tick bars must not window over a whole symbol: every Window on the
    tick side is partitioned by (symbol, chunk)."""
    plan = _plan(REG["resample_tick_count"].run(spark, SF_SMALL))
    windows = [ln for ln in plan.splitlines() if "Window [" in ln and "row_number()" in ln]
    assert windows
    for line in windows:
        assert "_chunk" in line, line


@pytest.mark.parametrize("name", sorted(REG))
def test_presentation_annotations_match_schema(spark, name):
    """The SQL twin presents exactly the columns the Spark side converts."""
    from pyspark.sql.types import ArrayType, DateType, MapType, StructType
    q = REG[name]
    from barsmith.sources.fixtures import register_fixtures
    register_fixtures(spark, SF_SMALL, list(q.fixtures))
    raw = q.build(spark)
    dates = {f.name for f in raw.schema.fields if isinstance(f.dataType, DateType)}
    nested = {f.name for f in raw.schema.fields if isinstance(f.dataType, (ArrayType, StructType, MapType))}
    assert dates == set(q.dates) and nested == set(q.nested)
