import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import invoices, quality
from ledgerlens.sources import LINE_SCHEMA, clean_name_list, lines_from_tpch

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

D = dt.date


def line(order="1", cust="c1", ctype="B2B", product="p", region="r", date=D(2020, 1, 1), up=2.0, q=1.0, disc=0.1, tp=1.8):
    return (order, cust, ctype, product, "cat", region, date, up, q, disc, tp)


@pytest.fixture(scope="module")
def dirty(spark):
    rows = [
        line(),
        line(order="2", ctype=""),
        line(order="3", ctype=None),
        line(order="4", up=None, q=float("nan")),
        line(order="5", product="", region=None, up=None),
        line(order="5", product="", region=None, up=None),  # exact duplicate with nulls
        line(order="6", up=0.0),  # unit_price <= 0
        line(order="7", q=-1.0),  # quantity <= 0
        line(order="8", disc=1.5),  # discount > 1
        line(order="9", tp=-3.0),  # total_price < 0
        line(order="10", up=-1.0, disc=-0.2),  # breaks two rules
        line(order="11", disc=-0.0),
        line(order="11", disc=0.0),  # equal to the previous row (-0.0 == 0.0)
    ]
    return spark.createDataFrame(rows, LINE_SCHEMA)


def test_blank_to_null_and_null_profile(spark, dirty):
    cleaned = quality.blank_to_null(dirty)
    prof = {r["column_name"]: r["n_missing"] for r in quality.null_profile(cleaned).collect()}
    assert prof["customer_type"] == 2  # '' and null
    assert prof["product"] == 2
    assert prof["region"] == 2
    assert prof["unit_price"] == 3
    assert prof["quantity"] == 1  # NaN counts as missing
    assert prof["order_id"] == 0
    raw = {r["column_name"]: r["n_missing"] for r in quality.null_profile(dirty).collect()}
    assert raw["customer_type"] == 1  # '' is not missing before the cleaning step


def test_duplicate_count_null_safe(spark, dirty):
    r = quality.duplicate_count(dirty).first()
    assert r["n_rows"] == 13 and r["duplicate_rows"] == 2
    none = quality.duplicate_count(dirty.where(F.col("order_id").isin("1", "2"))).first()
    assert none["duplicate_rows"] == 0


def test_invalid_count_rules(spark, dirty):
    r = quality.invalid_count(dirty).first()
    assert r["invalid_rows"] == 5
    assert (r["bad_unit_price"], r["bad_quantity"], r["bad_discount"], r["bad_total_price"]) == (2, 1, 2, 1)


def test_clean_names():
    assert clean_name_list(["Order ID", "order-id", "UnitPrice", "Größe", "Order ID"]) == [
        "order_id", "order_id_2", "unit_price", "grosse", "order_id_3",
    ]
    assert clean_name_list(["% share", "#items", "2nd"]) == ["percent_share", "number_items", "x2nd"]


def test_all_null_group_sum_zero_mean_null(spark):
    rows = [line(order="1", cust="c", tp=None, disc=None, up=None, q=None), line(order="2", cust="c", tp=None, disc=None, up=None, q=None)]
    inv = invoices.numeric_invoice(spark.createDataFrame(rows, LINE_SCHEMA)).first()
    assert inv["total_price"] == 0.0 and inv["quantity"] == 0.0
    assert inv["discount"] is None and inv["unit_price"] is None


def test_two_orders_one_day_grains(spark):
    rows = [line(order="1", cust="c"), line(order="2", cust="c"), line(order="2", cust="c", product="q")]
    df = spark.createDataFrame(rows, LINE_SCHEMA)
    assert invoices.numeric_invoice(df).count() == 1
    assert invoices.full_invoice(df).count() == 2
    assert invoices.rfm_base(df).first()["total_price"] == pytest.approx(5.4)


def test_revenue_ties_top10(spark):
    rows = [line(order=str(i), product=f"p{i:02d}", tp=float(100 - i)) for i in range(12)]
    rows = [line(order=str(i), product=f"p{i:02d}", tp=10.0 if i >= 8 else float(100 - i)) for i in range(12)]
    top = invoices.top_products(spark.createDataFrame(rows, LINE_SCHEMA), 10).orderBy("rank").collect()
    assert [r["product"] for r in top] == [f"p{i:02d}" for i in range(10)]
    assert top[-1]["total_revenue"] == 10.0


def test_date_range_and_preview(spark, dirty):
    r = quality.date_range(dirty).first()
    assert r["min_date"] == D(2020, 1, 1) and r["max_date"] == D(2020, 1, 1)
    assert quality.preview(dirty, 4).count() == 4


@pytest.mark.parametrize(
    "sf,ctype,lines_n,customers,days,full_inv,products,big",
    [
        (SF001, "B2B", 3453, 87, 855, 856, 62, 32),
        (SF001, "B2C", 2547, 63, 617, 617, 62, 24),
        (SF01, "B2B", 35672, 908, 8791, 8811, 64, 64),
        (SF01, "B2C", 24328, 592, 5920, 5932, 64, 64),
    ],
)
def test_fixture_facts(spark, sf, ctype, lines_n, customers, days, full_inv, products, big):
    ln = lines_from_tpch(spark, sf).where(F.col("customer_type") == ctype)
    assert ln.count() == lines_n
    assert ln.select("customer_id").distinct().count() == customers
    assert invoices.numeric_invoice(ln).count() == days
    assert invoices.full_invoice(ln).count() == full_inv
    per = ln.groupBy("product").count()
    assert per.count() == products
    assert per.where(F.col("count") >= 50).count() == big
    assert quality.duplicate_count(ln).first()["duplicate_rows"] == 0


def test_glimpse(spark, dirty):
    g = quality.glimpse(dirty, 3).collect()
    assert [r["column_name"] for r in g] == [f.name for f in LINE_SCHEMA.fields]
    first = {r["column_name"]: r for r in g}
    assert first["order_id"]["sample"] == "1, 10, 11"
    assert first["unit_price"]["data_type"] == "double"
