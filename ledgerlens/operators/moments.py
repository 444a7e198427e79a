"""Mergeable moment tables: count, means and co-moments per cell, combined without the rows (L1, L2).

A moment table is what ``ols.cell_moments`` gives: one row per cell with ``n``,
``mean_<v>`` and ``cov_<a>__<b>``. Tables of several loads of rows, or the cells
of one table over fewer columns, combine by the parallel formula: the means
of the union are weighted means, and each cell adds its own co-moment plus that
of its mean about the new one. The differences are taken before they are
multiplied, so large means do not cancel. A model is refitted from a stored table
and the moments of new rows, without a scan of the old ones.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moment_variables(columns: Sequence[str]) -> list[str]:
    """The variables of a moment table, in the order of its columns."""
    return [c.removeprefix("mean_") for c in columns if c.startswith("mean_")]


def merge_moments(tables: DataFrame | Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One moment table over the cells ``by``, from one or more tables that have these columns.

    Null keys are cells too. Both steps are plain aggregates of moment rows with
    partial aggregation; the means are joined back by the planner.
    """
    every = functools.reduce(DataFrame.unionByName, [tables] if isinstance(tables, DataFrame) else list(tables))
    by, vs = list(by), moment_variables(every.columns)
    n = F.col("n")
    keys = {c: f"__k_{c}" for c in by}
    means = every.groupBy(*by).agg(F.sum("n").alias("__n"), *[(F.sum(n * F.col(f"mean_{v}")) / F.sum("n")).alias(f"__m_{v}") for v in vs])
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()], F.lit(True))
    both = every.join(means.withColumnsRenamed(keys), same) if by else every.crossJoin(means)  # one row
    away = {v: F.col(f"mean_{v}") - F.col(f"__m_{v}") for v in vs}
    sums = []
    for i, a in enumerate(vs):
        for b in vs[i:]:
            sums.append((F.sum(n * (F.col(f"cov_{a}__{b}") + away[a] * away[b])) / F.first("__n")).alias(f"cov_{a}__{b}"))
    return both.groupBy(*by).agg(F.sum("n").alias("n"), *[F.first(f"__m_{v}").alias(f"mean_{v}") for v in vs], *sums)
