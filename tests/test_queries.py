"""Every driver-table query against its SQL, on the smallest tables."""

import pytest

from tests.conftest import SF, canonical

from envidecl.plans import cases, datasets, driver, families, records

assert cases and datasets and records  # they register their queries with driver


@pytest.mark.parametrize("name", sorted(driver.QUERIES))
def test_matches_sql(spark, duck, name):
    ours, theirs = driver.QUERIES[name](spark, SF).toPandas(), duck.sql(driver.ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = families.equality_filters(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderpriority,1-URGENT)" in plan.split("PushedFilters")[1]
    assert "o_totalprice" not in plan and "o_orderdate" not in plan
