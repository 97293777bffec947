"""Short codes of the dashboard view (P14) against a plain version."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.operators import reports as R

CODES = ["LONG", "short", "Market", "STOPLIMIT", "LIMITLIMIT", "TARGET\nSTOP", "\nLIMIT", "STOMARKETP", "SHOLONGRT",
         "", "x", "SIGNAL é LONG", "ﬃSTOP", None]


def plain(code):
    if code is None:
        return None
    code = code.upper()
    for long_, short in R.SHORT_CODES:
        code = code.replace(long_, short, 1)
    return code


def trades(spark):
    return spark.createDataFrame([(c, c, c, "highFlyer", 0.0) for c in CODES],
                                 "direction string, order_type string, exit_reason string, algo string, target double")


def test_codes_against_plain(spark):
    """The first occurrence counts wherever it stands, after a line break too."""
    for r in R.report_view(trades(spark)).collect():
        assert r["direction_code"] == r["order_type_code"] == plain(r["direction"])
        assert r["exit_reason_code"] == plain(r["exit_reason"] or "")
        assert r["algo_name"] == "High Flyer" and r["target_shown"] is None


def test_codes_need_no_patterns(spark):
    """One pattern a row (the algo name), none for each code of each column."""
    view = R.report_view(trades(spark)).select(F.col("direction_code"), "order_type_code", "exit_reason_code")
    assert "regexp" not in view._jdf.queryExecution().optimizedPlan().toString()
