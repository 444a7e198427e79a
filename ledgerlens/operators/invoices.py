"""Roll-ups of line items: customer-day and full invoices, product revenue.

``customer_type`` is always the leading group key, so the B2B and B2C
twins of every table come from one scan and one shuffle. It is never the
only key of a large aggregate (two values would make two giant groups).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.sources.lines import typed_lines

TYPE = "customer_type"


def known(name: str) -> Column:
    """A measure with NaN as null, so that sums, means and ranks skip it."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def total(name: str) -> Column:
    # sum over an all-null group is 0 (as with na.rm sums); means stay null.
    return F.coalesce(F.sum(known(name)), F.lit(0.0))


def _measures():
    return [
        total("quantity").alias("quantity"),
        F.avg(known("discount")).alias("discount"),
        F.avg(known("unit_price")).alias("unit_price"),
        total("total_price").alias("total_price"),
    ]


def rfm_base(lines: DataFrame) -> DataFrame:
    """Revenue per customer and day: (customer_type, customer_id, order_date, total_price)."""
    return (
        typed_lines(lines)
        .groupBy(TYPE, "customer_id", "order_date")
        .agg(total("total_price").alias("total_price"))
    )


def numeric_invoice(lines: DataFrame) -> DataFrame:
    """One invoice per customer and day: summed quantity and revenue, mean discount and unit price."""
    return typed_lines(lines).groupBy(TYPE, "customer_id", "order_date").agg(*_measures())


def full_invoice(lines: DataFrame) -> DataFrame:
    """One invoice per order, customer, day and region (a finer grain than ``numeric_invoice``)."""
    return typed_lines(lines).groupBy(TYPE, "order_id", "customer_id", "order_date", "region").agg(*_measures())


def combined_invoices(lines: DataFrame) -> DataFrame:
    """Both customer types' full invoices in one table, labelled by type.

    Appending the two typed tables is free here: the type already is a key.
    """
    return full_invoice(lines)


def product_revenue(lines: DataFrame) -> DataFrame:
    return typed_lines(lines).groupBy(TYPE, "product").agg(total("total_price").alias("total_revenue"))


def top_products(lines: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` products by revenue per customer type, ties broken by product name.

    ``row_number() <= n`` over a window is planned as a window group limit:
    every task keeps at most ``n`` rows per type before the shuffle.
    """
    w = Window.partitionBy(TYPE).orderBy(F.col("total_revenue").desc(), F.col("product").asc())
    return (
        product_revenue(lines)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .select(TYPE, "rank", "product", "total_revenue")
    )
