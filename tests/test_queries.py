"""Named queries against their SQL, and general properties of results."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, connect

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, name, SMALL) is None


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E.oracle_sql())))
def test_runs(spark, name):
    assert E.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["country_month_panel", "theme_frequency", "dbscan"])
def test_number_of_partitions_does_not_matter(spark, name):
    one = sorted(map(tuple, E.queries()[name](spark, SMALL).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert sorted(map(tuple, E.queries()[name](spark, SMALL).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_panel_counts_every_event(spark):
    q = E.queries()
    panel = q["country_month_panel"](spark, SMALL).agg({"Misinfo_Event_Count": "sum"}).first()[0]
    report = {r.measure: r.n for r in q["clean_drop_report"](spark, SMALL).collect()}
    assert panel == report["final_rows"]
    assert report["raw_rows"] == sum(v for k, v in report.items() if k != "raw_rows")


def test_zero_fill_has_empty_and_filled_cells(spark):
    cells = E.queries()["country_month_panel_zero_fill"](spark, "/root/testdata/sf0.001")
    counts = cells.selectExpr("count_if(Misinfo_Event_Count = 0) AS empty", "count_if(Misinfo_Event_Count > 0) AS filled").first()
    assert counts.empty > 100 and counts.filled > 10
