"""Every registered query against its DuckDB twin (the driver's check, run
locally on sf0.001 to keep the suite quick; tools/oracle_check.py runs sf0.01)."""

import pytest

from barsmith.plans import load_all
from tests.conftest import SF_SMALL

REG = load_all()


@pytest.fixture(scope="module")
def con():
    from tools.oracle_check import duck_con
    return duck_con(SF_SMALL)


@pytest.mark.parametrize("name", sorted(REG))
def test_query_matches_oracle(spark, con, name):
    from tools.oracle_check import compare
    r = compare(spark, con, name, REG[name], SF_SMALL)
    assert r["status"] in ("OK", "rows-only"), r.get("detail")


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
