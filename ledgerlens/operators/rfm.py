"""Recency / frequency / monetary scoring and the data behind the RFM charts.

Input is the customer-day table (``invoices.rfm_base``), so frequency
counts purchase days, not order ids. Scores are computed per customer type
from type-7 quintile cuts over customers (not rows):

* frequency, monetary: ``1 + #(cuts <= x)``  (high value = 5)
* recency:            ``5 - #(cuts <= x)``  (recent = 5)

Tied cuts simply leave some scores unused; ``ntile`` is never used since it
would split ties by row order.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.quantiles import clean, exact_quantiles_wide
from ledgerlens.session import stored

TYPE = "customer_type"
QUINTILES = {"c1": 0.2, "c2": 0.4, "c3": 0.6, "c4": 0.8}
SCORE_VARS = {"recency_days": "recency_score", "transaction_count": "frequency_score", "amount": "monetary_score"}


def default_analysis_date(base: DataFrame, col: str = "order_date") -> dt.date | None:
    """31 December of the year of the latest order (one tiny aggregate); None if no row has a date."""
    y = base.agg(F.year(F.max(col)).alias("y")).first()["y"]
    return None if y is None else dt.date(int(y), 12, 31)


def rfm_customer(base: DataFrame, analysis_date: dt.date | str | None = None) -> DataFrame:
    """Per customer: most recent date, days since it, purchase days, amount.

    Without any date there is no analysis date: the days are null.
    """
    if analysis_date is None:
        analysis_date = default_analysis_date(base)
    ad = F.lit(None if analysis_date is None else str(analysis_date)).cast("date")
    return base.groupBy(TYPE, "customer_id").agg(
        F.max("order_date").alias("date_most_recent"),
        F.datediff(ad, F.max("order_date")).cast("long").alias("recency_days"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.coalesce(F.sum("total_price"), F.lit(0.0)).alias("amount"),
    )


def customer_state(base: DataFrame) -> DataFrame:
    """What later loads need of the customer-days so far: last day, number of days and amount of each customer."""
    return base.groupBy(TYPE, "customer_id").agg(
        F.max("order_date").alias("last_day"), F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("total_price"), F.lit(0.0)).alias("amount")
    )


def merge_state(state: DataFrame, new_days: DataFrame) -> DataFrame:
    """The state after new customer-days, without reading the old ones.

    A load holds whole days: a customer's day must lie in one load only, as it counts
    once in each. Only the two small tables are shuffled, by customer.
    """
    return (
        state.unionByName(customer_state(new_days)).groupBy(TYPE, "customer_id")
        .agg(F.max("last_day").alias("last_day"), F.sum("days").alias("days"), F.sum("amount").alias("amount"))
    )


def rfm_from_state(state: DataFrame, analysis_date: dt.date | str | None = None) -> DataFrame:
    """The table of ``rfm_customer`` from the state."""
    if analysis_date is None:
        analysis_date = default_analysis_date(state, "last_day")
    ad = F.lit(None if analysis_date is None else str(analysis_date)).cast("date")
    return state.select(
        TYPE, "customer_id", F.col("last_day").alias("date_most_recent"), F.datediff(ad, "last_day").cast("long").alias("recency_days"), F.col("days").alias("transaction_count"), "amount"
    )


def rfm_cuts(customers: DataFrame) -> DataFrame:
    """Quintile cuts per customer type and variable, one row per type:
    ``recency_days_c1..c4, transaction_count_c1..c4, amount_c1..c4``.

    ``customers`` is read once a digit, so it should be a written table.
    """
    values = customers.select(TYPE, *[clean(F.col(v)).alias(v) for v in SCORE_VARS])
    q = exact_quantiles_wide(values, [TYPE], list(SCORE_VARS), QUINTILES)
    aggs = [
        F.max(F.when(F.col("variable") == v, F.col(c))).alias(f"{v}_{c}")
        for v in SCORE_VARS
        for c in QUINTILES
    ]
    return stored(q.groupBy(TYPE).agg(*aggs), "cuts")


def rfm_scores(customers: DataFrame) -> DataFrame:
    """Customers with recency/frequency/monetary scores 1..5 and ``rfm_score``.

    The customer table is read once a digit of the cuts and once for the
    scores, so it is first written to the shared checkpoint folder. The cuts have
    one row per customer type, which the planner broadcasts, so the customer
    table is not shuffled again.
    """
    customers = stored(customers, "customers")
    j = customers.join(rfm_cuts(customers), TYPE)

    def above(v):
        n = F.lit(0)
        for c in QUINTILES:
            n = n + F.when(F.col(v) >= F.col(f"{v}_{c}"), 1).otherwise(0)
        return F.when(F.col(v).isNotNull(), n)  # no value, no score

    r = (F.lit(5) - above("recency_days")).cast("int")
    f = (F.lit(1) + above("transaction_count")).cast("int")
    m = (F.lit(1) + above("amount")).cast("int")
    return j.select(
        TYPE,
        "customer_id",
        "date_most_recent",
        "recency_days",
        "transaction_count",
        "amount",
        r.alias("recency_score"),
        f.alias("frequency_score"),
        m.alias("monetary_score"),
        (r * 100 + f * 10 + m).alias("rfm_score"),
    )


def rfm_score_counts(scored: DataFrame) -> DataFrame:
    """Customers per score combination (bar chart data)."""
    return scored.groupBy(TYPE, "rfm_score", "recency_score", "frequency_score", "monetary_score").agg(
        F.count(F.lit(1)).alias("n_customers")
    )


def rfm_score_distribution(scored: DataFrame, metric: str) -> DataFrame:
    """Customers per score value of one metric (recency / frequency / monetary)."""
    col = f"{metric}_score"
    return scored.groupBy(TYPE, F.col(col).alias("score")).agg(F.count(F.lit(1)).alias("n_customers"))


RAW_METRIC = {"recency": "recency_days", "frequency": "transaction_count", "monetary": "amount"}


def rfm_histogram(scored: DataFrame, metric: str, n_bins: int = 30) -> DataFrame:
    """Equal-width histogram of a raw metric per customer type.

    Bin ``i`` covers ``[min + i·w, min + (i+1)·w)``, the last bin is closed
    (``w = (max - min) / n_bins``; a constant metric lands in bin 0). The
    per-type range is a one-row-per-type aggregate, broadcast back.
    """
    col = RAW_METRIC[metric]
    x = F.col(col).cast("double")
    rng = scored.groupBy(TYPE).agg(F.min(x).alias("__mn"), F.max(x).alias("__mx"))
    j = scored.select(TYPE, x.alias("__v")).join(F.broadcast(rng), TYPE)
    span = F.col("__mx") - F.col("__mn")
    idx = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__v") - F.col("__mn")) * F.lit(float(n_bins)) / span), F.lit(n_bins - 1))
    )
    return (
        j.where(F.col("__v").isNotNull())
        .groupBy(TYPE, idx.cast("int").alias("bin"), "__mn", "__mx")
        .agg(F.count(F.lit(1)).alias("n_customers"))
        .select(
            TYPE,
            "bin",
            (F.col("__mn") + F.col("bin") * span / F.lit(float(n_bins))).alias("bin_lo"),
            (F.col("__mn") + (F.col("bin") + 1) * span / F.lit(float(n_bins))).alias("bin_hi"),
            "n_customers",
        )
    )


def rfm_order_dist(scored: DataFrame) -> DataFrame:
    """Customers by number of purchase days."""
    return scored.groupBy(TYPE, "transaction_count").agg(F.count(F.lit(1)).alias("n_customers"))


def rfm_heatmap(scored: DataFrame) -> DataFrame:
    """Mean monetary value per recency x frequency score cell."""
    return scored.groupBy(TYPE, "recency_score", "frequency_score").agg(
        F.avg("amount").alias("avg_monetary"), F.count(F.lit(1)).alias("n_customers")
    )


def rfm_scatter(scored: DataFrame) -> DataFrame:
    """Recency against monetary value, one point per customer (all customers)."""
    return scored.select(TYPE, "customer_id", "recency_days", "amount")
