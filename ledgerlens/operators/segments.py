"""Segment labels from rule lists and the per-segment reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.rules import DEFAULT_LABEL, RULE_SETS, Rule, label_column
from ledgerlens.session import local_frame
from ledgerlens.sources.lines import CUSTOMER_TYPES

TYPE = "customer_type"


def half_up_ratio(num: str, den: str, digits: int):
    """``round(num / den, digits)``, half away from zero, for integer-valued
    SQL expressions ``num`` and ``den`` (den > 0): exact integer arithmetic."""
    scale = 10**digits
    return F.expr(
        f"CAST(sign({num}) * ((abs(CAST({num} AS DECIMAL(38,0))) * {2 * scale} + ({den})) div (2 * ({den}))) AS DOUBLE) / {float(scale)}"
    )


def assign_segments(scored: DataFrame, rules: Sequence[Rule] | str = "lecture", default: str = DEFAULT_LABEL) -> DataFrame:
    """Add ``segment``: a projection (chained CASE WHEN), no shuffle."""
    if isinstance(rules, str):
        rules = RULE_SETS[rules][0]
    return scored.withColumn("segment", label_column(rules, default=default))


def segment_dim(spark: SparkSession, levels: Sequence[str], types: Sequence[str] = CUSTOMER_TYPES) -> DataFrame:
    """(customer_type, segment, seg_order) for every type and level: a fixed
    dimension of len(types)·len(levels) rows built locally."""
    schema = T.StructType(
        [
            T.StructField(TYPE, T.StringType(), False),
            T.StructField("segment", T.StringType(), False),
            T.StructField("seg_order", T.IntegerType(), False),
        ]
    )
    rows = [(t, s, i + 1) for t in types for i, s in enumerate(levels)]
    return local_frame(spark, rows, schema)


def segment_report(segmented: DataFrame, levels: Sequence[str] | str = "lecture") -> DataFrame:
    """Per type and level: customers, mean spending / purchase days / recency,
    the type's customer total and the share in percent.

    Every level appears (zeros when empty); labels outside ``levels`` are
    left out of the rows but still count in ``total_customers``. Rows are in
    level order. The customer table is aggregated once (type, segment); the
    per-type totals come from those few rows, and the level dimension is a
    proven-small local table.
    """
    if isinstance(levels, str):
        levels = RULE_SETS[levels][1]
    spark = segmented.sparkSession
    # Sums of exact integers (amount in 1e-4 units, counts, days) make the
    # rounded means independent of summation order: the half-up rounding is
    # done by integer division, so a mean sitting exactly on a half cent is
    # rounded the same way on every run and in every engine.
    agg = (
        segmented.groupBy(TYPE, "segment")
        .agg(
            F.count(F.lit(1)).alias("no_customers"),
            F.sum(F.floor(F.col("amount") * F.lit(10000.0) + F.lit(0.5)).cast("decimal(38,0)")).alias("__s_amt"),
            F.sum(F.col("transaction_count").cast("decimal(38,0)")).alias("__s_tc"),
            F.sum(F.col("recency_days").cast("decimal(38,0)")).alias("__s_rd"),
        )
        .select(
            TYPE,
            "segment",
            "no_customers",
            half_up_ratio("__s_amt", "no_customers * 10000", 2).alias("avg_spending"),
            half_up_ratio("__s_tc", "no_customers", 2).alias("avg_transactions"),
            half_up_ratio("__s_rd", "no_customers", 1).alias("avg_recency_days"),
        )
    )
    totals = agg.groupBy(TYPE).agg(F.sum("no_customers").alias("total_customers"))
    dim = F.broadcast(segment_dim(spark, levels))
    rep = (
        dim.join(totals, TYPE)
        .join(agg, [TYPE, "segment"], "left")
        .select(
            TYPE,
            "seg_order",
            "segment",
            F.coalesce("no_customers", F.lit(0)).cast("long").alias("no_customers"),
            F.coalesce("avg_spending", F.lit(0.0)).alias("avg_spending"),
            F.coalesce("avg_transactions", F.lit(0.0)).alias("avg_transactions"),
            F.coalesce("avg_recency_days", F.lit(0.0)).alias("avg_recency_days"),
            F.col("total_customers").cast("long").alias("total_customers"),
            F.coalesce(half_up_ratio("100 * no_customers", "total_customers", 1), F.lit(0.0)).alias("percentage"),
        )
    )
    return rep.orderBy(TYPE, "seg_order").drop("seg_order")


def uncategorized_sample(segmented: DataFrame, n: int = 10, label: str = DEFAULT_LABEL) -> DataFrame:
    """First ``n`` customers (by id) per type that no rule labelled."""
    w = Window.partitionBy(TYPE).orderBy("customer_id")
    return (
        segmented.where(F.col("segment") == label)
        .withColumn("__rn", F.row_number().over(w))
        .where(F.col("__rn") <= n)
        .select(
            TYPE,
            "customer_id",
            "recency_score",
            "frequency_score",
            "monetary_score",
            "amount",
            "transaction_count",
            "recency_days",
        )
    )
