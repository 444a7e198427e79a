import datetime as dt

import pytest

import __spark_entry__ as E
from ledgerlens.functions.rules import LECTURE_LEVELS
from ledgerlens.plans import models
from ledgerlens.sources import LINE_SCHEMA


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 * len(LECTURE_LEVELS)
    assert df.columns == [
        "customer_type", "segment", "no_customers", "avg_spending", "avg_transactions",
        "avg_recency_days", "total_customers", "percentage",
    ]


def test_registry_and_oracle_keys():
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) >= 40
    for bad in ("segment_dim", "rule_coverage"):
        assert bad not in q  # fixed small inputs are library functions, not queries


@pytest.mark.parametrize("name", ["null_profile", "top_products", "rfm_histogram_monetary", "ols_invoice", "model_metrics"])
def test_queries_run_on_smoke_data(spark, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() >= 0
    assert all(not c.startswith("__") for c in df.columns)


def test_small_product_guard(spark):
    rows = []
    for prod, n in (("big", 50), ("small", 49)):
        for i in range(n):
            rows.append((str(i), "c", "B2B", prod, "cat", "r", dt.date(2020, 1, 1 + i % 28), 1.0, 1.0, 0.0, 1000.0 if prod == "small" else 1.0))
    df = spark.createDataFrame(rows, LINE_SCHEMA)
    got = {r["product"] for r in models.eligible_products(df, 10).collect()}
    assert got == {"big"}  # 'small' has more revenue but only 49 lines
