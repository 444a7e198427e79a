"""Numeric profiles: count, mean, sd, min, quartiles, max per variable (A4, A5, V1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.quantiles import clean, exact_quantiles_wide
from ledgerlens.session import stored
from ledgerlens.sources.lines import NUMERIC_COLUMNS, typed_lines

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def long_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide -> long ``(keys..., variable, var_order, value)`` in one projection."""
    items = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), F.lit(i + 1).alias("var_order"), F.col(c).cast("double").alias("value"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(*keys, F.explode(items).alias("__kv")).select(*keys, "__kv.*")


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str] = NUMERIC_COLUMNS,
    keys: Sequence[str] = ("customer_type",),
) -> DataFrame:
    """One row per (keys, variable): count (missing values included), mean,
    sample sd, min, q25, median, q75, max (missing values and NaN ignored).

    The table is read once and its cleaned columns are written; the moments are one
    wide aggregate of them, the exact quartiles come from the digit passes, which all
    columns share. No value list is ever gathered in a cell.
    """
    keys = list(keys)
    values = stored(df.select(*keys, *[clean(F.col(c)).alias(c) for c in columns]), "values")
    quartiles = exact_quantiles_wide(values, keys, columns, QUARTILES)
    out = moments_long(values, keys, columns).join(quartiles, [*keys, "variable"], "left")
    return out.orderBy(*keys, "var_order").select(*keys, "variable", "count", "mean", "sd", "min", "q25", "median", "q75", "max")


def moments_long(values: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys..., variable, var_order, count, mean, sd, min, max), from one wide aggregate."""
    measures = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    wide = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *[f(c).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, f in measures.items()])
    items = F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(i + 1).alias("var_order"), *[F.col(f"{m}_{i}").alias(m) for m in measures]) for i, c in enumerate(columns)])
    return wide.select(*keys, "count", F.explode(items).alias("__m")).select(*keys, "count", "__m.*")


def line_summary(lines: DataFrame) -> DataFrame:
    return numeric_profile(typed_lines(lines))


def invoice_summary(invoices: DataFrame) -> DataFrame:
    return numeric_profile(invoices)


SKETCH_K = 400  # KLL parameter: a rank error of about 0.7 % of the rows


def sketch_profile(df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS, keys: Sequence[str] = ("customer_type", "order_date"), k: int = SKETCH_K) -> DataFrame:
    """A summary table that merges: per ``keys`` the row count and, per column, count, sum, sum of squares about its mean, min, max and a KLL sketch.

    Written once a load (per type and day, say); any coarser profile is made from it without the rows.
    """
    aggs = [F.count(F.lit(1)).alias("count")]
    for c in columns:
        x = clean(F.col(c))
        aggs += [F.count(x).alias(f"n_{c}"), F.avg(x).alias(f"mean_{c}"), F.var_pop(x).alias(f"var_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}")]
        aggs.append(F.kll_sketch_agg_double(x, F.lit(k)).alias(f"sketch_{c}"))
    return df.groupBy(*keys).agg(*aggs)


def approx_profile(sketches: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS, keys: Sequence[str] = ("customer_type",), k: int = SKETCH_K) -> DataFrame:
    """``numeric_profile`` from a table of ``sketch_profile`` (or several loads' tables appended): quartiles are approximate, the rest is exact."""
    keys, aggs = list(keys), [F.sum("count").alias("count")]
    centre = sketches.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(f"n_{c}") * F.col(f"mean_{c}")), F.sum(f"n_{c}")).alias(f"__c_{c}") for c in columns])
    for c in columns:
        n, away = F.col(f"n_{c}"), F.col(f"mean_{c}") - F.col(f"__c_{c}")
        aggs += [F.first(f"__c_{c}").alias(f"mean_{c}"), F.min(f"min_{c}").alias(f"min_{c}"), F.max(f"max_{c}").alias(f"max_{c}")]
        ss = F.sum(n * (F.col(f"var_{c}") + away * away))
        aggs.append(F.sqrt(F.try_divide(ss, F.when(F.sum(n) > 1, F.sum(n) - 1))).alias(f"sd_{c}"))
        # a sketch without values is left out
        aggs.append(F.kll_merge_agg_double(F.when(n > 0, F.col(f"sketch_{c}")), F.lit(k)).alias(f"sketch_{c}"))
    merged = sketches.join(centre, keys).groupBy(*keys).agg(*aggs)

    def at(c, p):
        return F.when(F.col(f"min_{c}").isNotNull(), F.kll_sketch_get_quantile_double(f"sketch_{c}", F.lit(p)))

    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("variable"), F.lit(i + 1).alias("var_order"), *[F.col(f"{m}_{c}").alias(m) for m in ("mean", "sd", "min")],
                *[at(c, p).alias(q) for q, p in QUARTILES.items()], F.col(f"max_{c}").alias("max"),
            )
            for i, c in enumerate(columns)
        ]
    )
    out = merged.select(*keys, "count", F.explode(items).alias("__m")).select(*keys, "count", "__m.*")
    return out.orderBy(*keys, "var_order").select(*keys, "variable", "count", "mean", "sd", "min", "q25", "median", "q75", "max")
