"""What reaches the scan: columns and filters."""

import re

from quillon import catalog
from quillon.operators.filters import FilterSpec
from quillon.plans.trials_view import trials

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(plan: str) -> set[str]:
    return {c.split(":")[0] for part in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in part.split(",") if c}


def test_base_columns_read_orders_alone(spark):
    plan = plan_of(catalog.QUERIES["q_status_counts"](spark, SF))
    assert read_columns(plan) <= {"o_orderkey", "o_orderstatus", "o_custkey", "o_orderdate", "o_orderpriority"} and "lineitem" not in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(FilterSpec(date_range=("1996-01-01", "1997-01-01")).apply(trials(spark, SF, "submission_date")).select("id"))
    assert read_columns(plan) == {"o_orderkey", "o_orderdate"}
    detail = plan_of(catalog.QUERIES["q_trial_detail"](spark, SF).filter("id = 7"))
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(o_orderkey,7\)", detail)


def test_exploded_columns_make_no_arrays(spark):
    plan = plan_of(catalog.QUERIES["q_top_organ"](spark, SF))
    assert "collect_set" not in plan and "Generate" not in plan and read_columns(plan) <= {"o_orderkey", "l_orderkey", "l_partkey", "p_partkey", "p_type", "o_custkey", "o_orderstatus"}
