import pytest
from compare import assert_same

import __spark_entry__ as entry
from factmill.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, name):
    assert_same(entry.queries()[name](spark, small).toPandas(), small, ORACLE[name])


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "para", "sent", "fact", "key_term", "score"]
    assert out.count() > 0


def test_capped_facts_plan_limits_windows_early(spark, small):
    plan = entry.queries()["capped_per_part"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
