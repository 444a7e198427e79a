"""Physical-plan properties the design relies on (checked on the executed plan)."""

import datetime as dt
import re

from ledgerlens.operators import invoices, rfm
from ledgerlens.plans import models
from ledgerlens.sources import lines_from_tpch

SF = "/root/testdata/sf0.001"


def executed_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_adapter_prunes_columns_and_joins_by_key(spark):
    plan = executed_plan(lines_from_tpch(spark, SF).groupBy("customer_type").count())
    scan = [ln for ln in plan.splitlines() if "lineitem.parquet" in ln]
    assert scan, plan
    read = re.search(r"ReadSchema: struct<([^>]*)>", scan[0]).group(1)
    assert set(c.split(":")[0] for c in read.split(",")) <= {"l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount"}
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_top_products_uses_window_group_limit(spark):
    plan = executed_plan(invoices.top_products(lines_from_tpch(spark, SF), 10))
    assert "WindowGroupLimit" in plan


def test_rfm_cuts_are_broadcast(spark):
    base = invoices.rfm_base(lines_from_tpch(spark, SF))
    scored = rfm.rfm_scores(rfm.rfm_customer(base, dt.date(2001, 12, 31)))
    plan = executed_plan(scored)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_product_models_filter_by_broadcast_semi_join(spark):
    plan = executed_plan(models.product_lines(lines_from_tpch(spark, SF), "B2B"))
    assert re.search(r"BroadcastHashJoin .*LeftSemi", plan), plan
