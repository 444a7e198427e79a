"""Segment rule lists and report level orders, kept as data.

A rule is ``(label, recency, frequency, monetary)`` where each score range is
an inclusive ``(low, high)`` pair over the scores 1..5 (``None`` = open).
Rules are tried in order; the first match wins; rows matching none get the
list's default label. Users can pass their own lists of the same shape.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

Range = tuple[int | None, int | None]
Rule = tuple[str, Range, Range, Range]

ANY: Range = (None, None)

# ---------------------------------------------------------------------------
# Segment labels, rule lists and level orders as used by the
# analysis this library reproduces. "Can’t Lose Them" uses U+2019.
# ---------------------------------------------------------------------------

LECTURE_RULES: list[Rule] = [
    ("Champions", (4, 5), (4, 5), (4, 5)),
    ("Loyal Customers", (2, 5), (3, 5), (3, 5)),
    ("Potential Loyalist", (3, 5), (1, 3), (1, 3)),
    ("New Customers", (4, 5), (None, 1), (None, 1)),
    ("Promising", (3, 4), (None, 1), (None, 1)),
    ("Need Attention", (2, 3), (2, 3), (2, 3)),
    ("About To Sleep", (2, 3), (None, 2), (None, 2)),
    ("At Risk", (None, 2), (2, 5), (2, 5)),
    ("Can’t Lose Them", (None, 1), (4, 5), (4, 5)),
    ("Hibernating", (1, 2), (1, 2), (1, 2)),
    ("Lost", (None, 2), (None, 2), (None, 2)),
]

CUSTOM_RULES: list[Rule] = [
    ("Champions", (5, None), (5, None), (5, None)),
    ("Loyal Customers", (4, None), (4, None), (4, None)),
    ("Potential Loyalist", (4, None), (3, None), (3, None)),
    ("New Customers", (4, None), (2, None), (2, None)),
    ("Occasional Shoppers", (3, None), (2, 2), ANY),
    ("Need Attention", (3, None), (3, None), (3, None)),
    ("Promising", (3, None), (1, 1), ANY),
    ("At Risk", (2, None), (3, None), ANY),
    ("About To Sleep", (2, None), (2, 2), ANY),
    ("Can’t Lose Them", (1, None), (3, None), ANY),
    ("Hibernating", (1, None), (None, 2), (None, 3)),
    ("Active High Value", (3, None), ANY, (3, None)),
    ("Active Medium Value", (3, None), ANY, (2, None)),
    ("Dormant High Value", (None, 2), ANY, (2, None)),
    ("Lost", (None, 1), (None, 1), (None, 1)),
]

# Script variant of the custom list: "Lost" placed before the Active rules
# and widened. It labels every score triple exactly as CUSTOM_RULES does.
CUSTOM_RULES_SCRIPT: list[Rule] = [
    *CUSTOM_RULES[:11],
    ("Lost", (None, 3), (None, 1), (None, 2)),
    *CUSTOM_RULES[11:14],
]

DEFAULT_LABEL = "Uncategorized"

LECTURE_LEVELS = [
    "Champions", "Loyal Customers", "Potential Loyalist", "New Customers",
    "Promising", "Need Attention", "About To Sleep", "At Risk",
    "Can’t Lose Them", "Hibernating", "Lost", "Uncategorized",
]

CUSTOM_LEVELS = [
    "Champions", "Loyal Customers", "Potential Loyalist",
    "New Customers", "Need Attention", "Promising",
    "About To Sleep", "At Risk", "Can’t Lose Them",
    "Hibernating", "Lost", "Dormant High Value",
    "Occasional Shoppers",
]

CUSTOM16_LEVELS = [
    "Champions", "Loyal Customers", "Potential Loyalist",
    "New Customers", "Need Attention", "Promising",
    "About To Sleep", "At Risk", "Can’t Lose Them",
    "Hibernating", "Lost", "Active High Value",
    "Active Medium Value", "Dormant High Value",
    "Occasional Shoppers", "Dormant Big Spenders",
]

RULE_SETS = {
    "lecture": (LECTURE_RULES, LECTURE_LEVELS),
    "custom": (CUSTOM_RULES, CUSTOM_LEVELS),
    "custom16": (CUSTOM_RULES_SCRIPT, CUSTOM16_LEVELS),
}


def _range_col(c: Column, rng: Range) -> Column | None:
    lo, hi = rng
    if lo is not None and hi is not None:
        return c.between(lo, hi)
    if lo is not None:
        return c >= lo
    if hi is not None:
        return c <= hi
    return None


def rule_condition(rule: Rule, r: Column, f: Column, m: Column) -> Column:
    parts = [p for p in (_range_col(r, rule[1]), _range_col(f, rule[2]), _range_col(m, rule[3])) if p is not None]
    cond = F.lit(True)
    for p in parts:
        cond = cond & p
    return cond


def label_column(
    rules: Sequence[Rule],
    r: Column | str = "recency_score",
    f: Column | str = "frequency_score",
    m: Column | str = "monetary_score",
    default: str = DEFAULT_LABEL,
) -> Column:
    """Ordered rule list as one chained CASE WHEN (first match wins)."""
    r, f, m = (F.col(x) if isinstance(x, str) else x for x in (r, f, m))
    expr = None
    for rule in rules:
        cond = rule_condition(rule, r, f, m)
        expr = F.when(cond, F.lit(rule[0])) if expr is None else expr.when(cond, F.lit(rule[0]))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def rule_sql(rules: Sequence[Rule], r="recency_score", f="frequency_score", m="monetary_score", default=DEFAULT_LABEL) -> str:
    """The same rule list as SQL text (for oracles and SQL users)."""

    def rng(c, x):
        lo, hi = x
        if lo is not None and hi is not None:
            return f"{c} BETWEEN {lo} AND {hi}"
        if lo is not None:
            return f"{c} >= {lo}"
        if hi is not None:
            return f"{c} <= {hi}"
        return None

    whens = []
    for label, rr, ff, mm in rules:
        parts = [p for p in (rng(r, rr), rng(f, ff), rng(m, mm)) if p] or ["TRUE"]
        whens.append(f"WHEN {' AND '.join(parts)} THEN '{label}'")
    return "CASE " + " ".join(whens) + f" ELSE '{default}' END"


def _matches(rule: Rule, triple: tuple[int, int, int]) -> bool:
    for (lo, hi), v in zip(rule[1:], triple):
        if lo is not None and v < lo:
            return False
        if hi is not None and v > hi:
            return False
    return True


def label_of(rules: Sequence[Rule], triple: tuple[int, int, int], default: str = DEFAULT_LABEL) -> str:
    for rule in rules:
        if _matches(rule, triple):
            return rule[0]
    return default


def rule_coverage(rules: Sequence[Rule], default: str = DEFAULT_LABEL, scores: range = range(1, 6)) -> list[tuple[str, int, int]]:
    """For each rule (and the default): (label, position, number of score
    triples it labels). Rules with 0 triples are dead: shadowed by earlier
    rules. The 125 triples are a fixed enumeration, not data, so this runs
    locally; it checks a rule list before it is used on customers."""
    counts = {i: 0 for i in range(len(rules) + 1)}
    for triple in product(scores, scores, scores):
        for i, rule in enumerate(rules):
            if _matches(rule, triple):
                counts[i] += 1
                break
        else:
            counts[len(rules)] += 1
    out = [(rule[0], i + 1, counts[i]) for i, rule in enumerate(rules)]
    out.append((default, len(rules) + 1, counts[len(rules)]))
    return out
