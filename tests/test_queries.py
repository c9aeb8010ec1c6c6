import pytest
from compare import both

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
PLAIN = sorted(k for k in entry.oracle_sql() if not k.startswith(("op", "pipeline")))


@pytest.mark.parametrize("name", PLAIN)
def test_query_equals_sql(spark, name):
    got, want = both(spark, D, entry.queries()[name], entry.oracle_sql()[name])
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["outlet", "day", "total_articles", "complete"]


def test_filter_and_columns_reach_the_scan(spark):
    plan = entry.queries()["day_coverage"](spark, D)._jdf.queryExecution().executedPlan().toString()
    # One exchange of the runs by outlet and day; the one by outlet alone carries a row a day.
    assert "PushedFilters: [" in plan and "value" in plan and plan.count("Exchange hashpartitioning") == 2
