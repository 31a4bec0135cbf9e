"""Every query of the core against its SQL on the smallest tables."""

import pytest

from conftest import SF, compare
from marlspike.plans import registry

ENTRIES = registry.entries()


@pytest.mark.parametrize("entry", ENTRIES, ids=lambda e: e.name)
def test_query(entry, spark, duck):
    df = entry.run(spark, str(SF))
    if entry.sql:
        compare(df, duck, entry.sql)
    else:
        assert df.collect() is not None


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_names_match():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_topk_plan_has_no_full_sort(spark):
    from marlspike.plans.search_queries import bm25_topk

    plan = bm25_topk(spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
