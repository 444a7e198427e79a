"""Exact quantiles by radix selection, and approximate ones from mergeable sketches.

``percentile`` keeps a value->count map per group and finishes each group in one
task, so a group with billions of distinct values would not fit. Here a value
becomes a 64-bit integer that sorts like it, and its digits are settled from
the highest down, with one aggregate a digit:

1. The values are written once, as narrow columns, so that no pass reads the
   source or runs its joins again.
2. A pass counts the rows of each group by their next digit, among the values whose
   higher digits are those of some target rank. Counts are added up in the
   tasks before the shuffle, so a hot group is one histogram a task.
3. A running count over a histogram finds the digit in which each target lies, and
   the rank that is left within it. After the last digit the value is known.

A histogram has at most 2**22 entries for each group and prefix, however many values
there are. There is one path for every size and number of groups, no sample
or bracket that could be missed, and nothing comes to the driver: targets and
histograms are tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import stored

DIGITS = (20, 22, 22)  # bits of the digits, the highest first


def clean(x: Column) -> Column:
    """The value as a double; NaN counts as missing."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _names(columns: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def with_order_key(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with a 64-bit integer for each double (not NaN) that sorts like it; both zeros are equal.

    Exponent and mantissa are taken apart by divisions by powers of two, which are exact;
    the logarithm only proposes the exponent. Each step is a column of its own, so that
    none is computed twice. The numbers without a leading one have a mantissa below 1.
    """
    x, g, p, e, k = _names([value, f"{name}_g", f"{name}_p", f"{name}_e", f"{name}_k"])
    own = _names(df.columns)
    out = df.selectExpr(*own, f"CAST(greatest(least(floor(log2(abs({x}))), 1023), -1022) AS INT) AS {g}")
    out = out.selectExpr(*own, g, f"abs({x}) / pow(2D, {g}) AS {p}")
    out = out.selectExpr(*own, f"CASE WHEN {p} >= 2 THEN {g} + 1 WHEN {p} < 1 AND {g} > -1022 THEN {g} - 1 ELSE {g} END AS {e}")
    size = f"shiftleft(CAST({e} + 1022 AS BIGINT), 52) + CAST(abs({x}) / pow(2D, {e}) * 4503599627370496D AS BIGINT)"
    out = out.selectExpr(*own, f"CASE WHEN {x} = 0 THEN 0L WHEN abs({x}) = double('infinity') THEN {0x7FF0000000000000}L ELSE {size} END AS {k}")
    return out.selectExpr(*own, f"CASE WHEN {x} < 0 THEN -{k} ELSE {k} END AS `{name}`")


def _join(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal columns, nulls equal, that keeps them once."""
    same = F.expr(" AND ".join(f"`{c}` <=> `__r_{c}`" for c in columns) or "TRUE")
    more = [c for c in right.columns if c not in columns]
    out = left.join(right.selectExpr(*[f"`{c}` AS `__r_{c}`" for c in columns], *_names(more)), same, how)
    return out if how == "left_semi" else out.selectExpr(*_names([*left.columns, *more]))


def _targets(n: str, ps: Sequence[float], rule: str) -> str:
    """SQL of the ranks (from 0) that each quantile needs, with the share of the way between them."""
    items = []
    for i, p in enumerate(ps):
        if rule == "linear":
            h = f"(CAST({n} - 1 AS DOUBLE) * {float(p)!r}D)"
            low, share = f"CAST(floor({h}) AS BIGINT)", f"{h} - floor({h})"
            high = f"least({low} + 1, {n} - 1)"
        else:
            low = high = f"least(greatest(CAST(ceil({float(p)!r}D * {n}) AS BIGINT) - 1, 0), {n} - 1)"
            share = "0D"
        items += [f"named_struct('q', {i}, 'side', {side}, 'rank', {rank}, 'share', {share})" for side, rank in enumerate((low, high))]
    return f"array({', '.join(items)})"


def _select(values: DataFrame, groups: list[str], columns: Sequence[str], ps: Sequence[float], rule: str, digits: Sequence[int]) -> DataFrame:
    """(groups..., __v, __n, __q0, __q1, ...): quantiles of each column ``__v`` (its number) of a stored table; groups without values are left out."""
    key = [*groups, "__v"]
    own, place = _names(key), _names([*key, "__prefix"])
    items = ", ".join(f"named_struct('__v', {i}, '__x', {c})" for i, c in enumerate(_names(columns)))
    one = ["0 AS __v", f"`{columns[0]}` AS __x"] if len(columns) == 1 else [f"inline(array({items}))"]
    long = with_order_key(values.selectExpr(*_names(groups), *one).where("__x IS NOT NULL"), "__x", "__k")
    by_place = f"PARTITION BY {', '.join(place)}"
    targets, shift = None, 64
    for step, bits in enumerate(digits):
        above, shift = shift, shift - bits
        first, last = step == 0, step == len(digits) - 1
        digit = f"shiftright(__k, {shift})" + ("" if first else f" & {(1 << bits) - 1}L")
        rows = long.selectExpr(*own, "__x", f"{'0L' if first else f'shiftright(__k, {above})'} AS __prefix", f"{digit} AS __digit")
        if not first:
            rows = _join(rows, targets.selectExpr(*place), [*key, "__prefix"], "left_semi")
        # all rows of a whole key are equal
        hist = rows.groupBy(*place, "__digit").agg(F.expr("count(1) AS __c"), F.expr("min(__x) AS __x" if last else "0 AS __x"))
        running = f"sum(__c) OVER ({by_place} ORDER BY __digit ROWS UNBOUNDED PRECEDING) AS __cum"
        hist = hist.selectExpr("*", running, *([f"sum(__c) OVER ({by_place}) AS __n"] if first else []))
        hist = hist.selectExpr("*", f"{_targets('__n', ps, rule)} AS __t") if first else _join(hist, targets, [*key, "__prefix"])
        hit = hist.selectExpr("*", "filter(__t, t -> t.rank >= __cum - __c AND t.rank < __cum) AS __hit").where("size(__hit) > 0")
        if not last:
            left = "transform(__hit, t -> named_struct('q', t.q, 'side', t.side, 'rank', t.rank - (__cum - __c), 'share', t.share)) AS __t"
            whole = "__digit" if first else f"shiftleft(__prefix, {bits}) | __digit"
            targets = stored(hit.selectExpr(*own, f"{whole} AS __prefix", "__n", left), "targets")
    found = hit.selectExpr(*own, "__n", "__x AS __value", "inline(__hit)")
    sides = [f"max(CASE WHEN q = {i} AND side = {side} THEN __value END) AS __s{i}_{side}" for i in range(len(ps)) for side in (0, 1)]
    shares = [f"max(CASE WHEN q = {i} THEN share END) AS __f{i}" for i in range(len(ps))]
    wide = found.groupBy(*own).agg(F.expr("max(__n) AS __n"), *map(F.expr, [*sides, *shares]))
    between = [f"CASE WHEN __f{i} = 0 OR __s{i}_0 = __s{i}_1 THEN __s{i}_0 ELSE __s{i}_0 + __f{i} * (__s{i}_1 - __s{i}_0) END AS __q{i}" for i in range(len(ps))]
    return wide.selectExpr(*own, "__n", *between)


def exact_quantiles(
    df: DataFrame,
    group_cols: Sequence[str],
    value_col: str,
    probs: dict[str, float],
    extra_aggs: Sequence[Column] = (),
    rule: str = "linear",
    digits: Sequence[int] = DIGITS,
) -> DataFrame:
    """Per group: ``n`` (non-null, non-NaN count), one column per entry of
    ``probs`` holding the quantile, and any ``extra_aggs`` over the written
    values (they may use ``__x``, the cleaned value). Nulls and NaN are ignored; a
    group without values gets null quantiles. A null group is a group.

    ``rule="linear"`` interpolates between the order statistics around
    ``(n-1)·p`` (R type 7); ``rule="inverse_cdf"`` returns the smallest value
    with at least ``ceil(p·n)`` values at or below it (R type 1), no
    interpolation. The result is a written table with one row a group.
    """
    if rule not in ("linear", "inverse_cdf"):
        raise ValueError(f"unknown quantile rule {rule!r}")
    if sum(digits) != 64:
        raise ValueError("the digits must have 64 bits together")
    groups = list(group_cols)
    values = stored(df.select(*groups, clean(F.col(value_col)).alias("__x")), "values")
    stats = values.groupBy(*groups).agg(F.count("__x").alias("n"), *extra_aggs)
    found = _select(values, groups, ["__x"], list(probs.values()), rule, digits).drop("__v", "__n")
    out = _join(stats, found, groups, "left")
    extra = [c for c in stats.columns if c not in groups and c != "n"]
    return stored(out.select(*groups, "n", *[F.col(f"__q{i}").alias(name) for i, name in enumerate(probs)], *extra), "quantiles")


def exact_quantiles_wide(values: DataFrame, group_cols: Sequence[str], columns: Sequence[str], probs: dict[str, float], digits: Sequence[int] = DIGITS) -> DataFrame:
    """(groups..., variable, quantiles...) of several columns of a written table, linear rule; all columns share each pass.

    The columns are cleaned doubles. Groups without any value of a variable have no row for it.
    The last pass is left to the plan that uses the result.
    """
    groups = list(group_cols)
    found = _select(values, groups, columns, list(probs.values()), "linear", digits)
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("__v") + 1)
    return found.select(*groups, name.alias("variable"), *[F.col(f"__q{i}").alias(q) for i, q in enumerate(probs)])


def type7_quantile(values: Sequence[float], p: float) -> float | None:
    """Reference formula for tests: order statistics interpolated at (n-1)p."""
    xs = sorted(v for v in values if v is not None and not (isinstance(v, float) and math.isnan(v)))
    if not xs:
        return None
    h = (len(xs) - 1) * p
    lo = math.floor(h)
    hi = min(lo + 1, len(xs) - 1)
    return xs[lo] + (h - lo) * (xs[hi] - xs[lo])
