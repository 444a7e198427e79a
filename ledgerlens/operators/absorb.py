"""Least squares with one factor of any width, eliminated by blocks (L3, M3).

The dummies of the absorbed factor, with the intercept, form a diagonal block of
the normal equations: one number of rows a level. Eliminating that block first
leaves a system in the other columns only (its Schur complement), as wide as they
are, whatever the number of levels:

1. per (model, level): sums of the other design columns and of the label over the
   level's rows, in long form, from the cells;
2. per model: the products of those sums over the level's row count, added up as
   tasks read the levels, one small matrix a task and model;
3. per model: the Gram matrix of the other columns, from cells merged over the
   absorbed factor, less that matrix, swept in term order;
4. per block of levels: each level's effect, its mean of what the other columns
   leave, with its variance from the same small inverse;
5. residual sums from the cells and the coefficients, then the summary.

Nothing holds all cells or all levels of a model in one task, and no array is as
long as the cells and as wide as the design. The absorbed factor counts as the
first term when it is decided which of several collinear columns is aliased;
predictions do not depend on that order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.stats import f_upper_p, t_two_sided_p
from ledgerlens.operators import ols
from ledgerlens.operators.moments import merge_moments
from ledgerlens.session import materialize, stored

LEVEL_BLOCK = 4096  # levels of a model whose effects one task computes at a time
PLACED_LEVELS = 32_768  # levels, at most about, that one task puts in order
HELD_NUMBERS = 4_000_000  # numbers of the matrices that a task holds before it gives them out
COUNT, LABEL = "#", "="  # columns of the level sums: rows, label
BASE = "^"  # marks the sums of the first level

NARROW_FIELDS = [f for f in ols.TERM_FIELDS if f[0] not in ("std_error", "t_value", "p_value")]
FIT_FIELDS = [("n", T.LongType()), ("rank", T.IntegerType()), ("tss", T.DoubleType())]
SOLUTION_FIELDS = [
    ("labels", T.ArrayType(T.StringType())),
    ("beta", T.ArrayType(T.DoubleType())),
    ("inverse", T.ArrayType(T.DoubleType())),
    ("base", T.ArrayType(T.DoubleType())),  # effect, rows and means of the first level
    ("first_index", T.IntegerType()),
    ("n_levels", T.LongType()),
]


def narrow_spec(spec: ols.ModelSpec) -> ols.ModelSpec:
    """The model without its absorbed factor."""
    return ols.ModelSpec(spec.label, tuple(t for t in spec.terms if t != spec.absorb), spec.factors - {spec.absorb}, spec.interactions, spec.keys)


def label_of(kind: str, variable: str | None, factor: str | None, level: str | None) -> str:
    """The name of a design column in the level sums."""
    return {"numeric": f"n:{variable}", "factor": f"f:{factor}={level}", "interaction": f"i:{variable}:{factor}={level}"}[kind]


def level_sums(cells: DataFrame, spec: ols.ModelSpec) -> DataFrame:
    """(model keys, level, text, pos, n_levels, cols, sums): sums of the centred design columns over each level's rows.

    ``pos`` is the level's place in its own order, from 1. Only columns that are not zero are listed.
    """
    keys, d = spec.model_keys, spec.absorb
    n = F.col("n")
    variables = [*spec.numerics, spec.label]
    # one row a model; its size is known, so that where it is small the cells are not dealt by model
    centre = stored(cells.groupBy(*keys).agg(*[(F.sum(n * F.col(f"mean_{v}")) / F.sum("n")).alias(f"__c_{v}") for v in variables]), "centres")
    away = {v: n * (F.col(f"mean_{v}") - F.col(f"__c_{v}")) for v in variables}

    def entry(label, value):
        return F.struct(label.alias("col"), value.cast("double").alias("s"))

    def at(prefix, f):
        return F.concat(F.lit(f"{prefix}{f}="), F.col(f).cast("string"))

    entries = [entry(F.lit(COUNT), n), entry(F.lit(LABEL), away[spec.label])]
    entries += [entry(F.lit(f"n:{t}"), away[t]) if t not in spec.factors else entry(at("f:", t), n) for t in spec.terms if t != d]
    entries += [entry(at(f"i:{x}:", f), away[x]) for x, f in spec.interactions]
    long = cells.join(centre, keys).select(*keys, F.col(d).alias("level"), F.explode(F.array(*entries)).alias("e"))
    sums = long.groupBy(*keys, "level", "e.col").agg(F.sum("e.s").alias("s"))
    per_level = sums.groupBy(*keys, "level").agg(F.collect_list(F.struct("col", "s")).alias("e"))  # at most one entry a narrow column
    # ranges of levels follow each other: a level's place is that in its range after the levels of earlier ones
    parts = max(1, math.ceil(cells.count() / PLACED_LEVELS))
    spread = materialize(per_level.repartitionByRange(parts, *keys, "level").withColumn("__part", F.spark_partition_id()))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))  # one row a range and model
    starts = sizes.select(*keys, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("n_levels"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("level"))
    return spread.withColumn("__in", inside).join(starts, [*keys, "__part"]).select(
        *keys, "level", F.col("level").cast("string").alias("text"), (F.col("__before") + F.col("__in")).alias("pos"),
        "n_levels", F.col("e.col").alias("cols"), F.col("e.s").alias("sums"),
    )


def level_products(levels: DataFrame, spec: ols.ModelSpec) -> DataFrame:
    """(model keys, i, j, v): for each pair of columns the products of a level's sums over its rows, added over all levels.

    Rows with i = BASE give the first level's sums, and its number of levels.
    """
    keys = spec.model_keys
    schema = T.StructType([*(levels.schema[k] for k in keys), T.StructField("i", T.StringType()), T.StructField("j", T.StringType()), T.StructField("v", T.DoubleType())])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[dict, np.ndarray]] = {}

        def given_out():
            out: list[list] = [[] for _ in schema.names]
            for key, (index, total) in held.items():
                names = list(index)
                i, j = np.nonzero(np.triu(total))
                for column, value in zip(out, key, strict=False):
                    column += [value] * len(i)
                out[-3] += [names[a] for a in i]
                out[-2] += [names[b] for b in j]
                out[-1] += total[i, j].tolist()
            held.clear()
            kinds = [levels_schema.field(k).type for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [*kinds, pa.string(), pa.string(), pa.float64()], strict=True)], names=schema.names)

        for batch in batches:
            levels_schema = batch.schema
            by_key = [batch.column(k).to_pylist() for k in keys]
            for r, (cols, sums) in enumerate(zip(batch.column("cols").to_pylist(), batch.column("sums").to_pylist(), strict=True)):
                key = tuple(c[r] for c in by_key)
                index, total = held.get(key, ({}, np.zeros((0, 0))))
                place = [index.setdefault(c, len(index)) for c in cols]
                if len(index) > len(total):
                    wider = np.zeros((2 * len(index), 2 * len(index)))
                    wider[: len(total), : len(total)] = total
                    total = wider
                held[key] = (index, total)
                s = np.array(sums)
                part = np.outer(s, s) / s[cols.index(COUNT)]
                low, high = np.minimum.outer(place, place), np.maximum.outer(place, place)
                upper = np.triu(np.ones(part.shape, dtype=bool))
                np.add.at(total, (low[upper], high[upper]), part[upper])
            if sum(t.size for _, t in held.values()) > HELD_NUMBERS:
                yield given_out()
        if held:
            yield given_out()

    # the places of two columns differ between tasks; the pair is given in one order
    pairs = levels.select(*keys, "cols", "sums").mapInArrow(products, schema)
    added = pairs.groupBy(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("v").alias("v"))
    first = levels.where("pos = 1")
    base = first.select(*keys, F.lit(BASE).alias("i"), F.explode(F.arrays_zip("cols", "sums")).alias("e")).select(*keys, "i", F.col("e.cols").alias("j"), F.col("e.sums").alias("v"))
    count = first.select(*keys, F.lit(BASE).alias("i"), F.lit(BASE).alias("j"), F.col("n_levels").cast("double").alias("v"))
    return added.unionByName(base).unionByName(count)


def solve_narrow(cells: pd.DataFrame, products: pd.DataFrame, spec: ols.ModelSpec, keys: list[str]) -> list[dict]:
    """One model's coefficients but for the absorbed levels, and a row that their effects follow from."""
    design = ols.design_of(cells, narrow_spec(spec))
    cols = design.cols[1:]
    labels = [label_of(c[1], c[2], c[3], None if c[4] is None else design.level_text(c[3], c[4])) for c in cols]
    at = {c: k for k, c in enumerate([*labels, LABEL])}
    within = np.zeros((len(at), len(at)))
    base: dict[str, float] = {}
    for i, j, v in zip(products["i"], products["j"], products["v"], strict=True):
        if i == BASE:
            base[j] = v
        elif i in at and j in at:
            within[at[i], at[j]] = within[at[j], at[i]] = v
    n_levels = int(base[BASE])
    q = len(cols)
    own = np.diag(design.gram)[1:]
    kept, factor = ols.sweep(design.gram[1:, 1:] - within[:q, :q], cols, design.raw_sq, own)
    inverse = np.linalg.inv(factor).T @ np.linalg.inv(factor) if kept else np.zeros((0, 0))
    beta_c = inverse @ (design.gram_y[1:] - within[:q, q])[kept]
    # the first level: its effect is the centred intercept
    n_1 = base[COUNT]
    means = np.array([base.get(labels[k], 0.0) / n_1 for k in kept])
    effect = base.get(LABEL, 0.0) / n_1 - means @ beta_c
    both = np.concatenate([[effect], beta_c])
    var = np.zeros((len(both), len(both)))
    var[1:, 1:] = inverse
    var[0, 1:] = var[1:, 0] = -inverse @ means
    var[0, 0] = 1 / n_1 + means @ inverse @ means
    every = [design.cols[0], *cols]
    with_intercept = [0, *(k + 1 for k in kept)]
    t = ols.uncentring(every, with_intercept, design.mean_of)
    beta, unit_var = t @ both, np.diag(t @ var @ t.T)
    beta[0] += design.mean_of[spec.label]
    pos = {j: k for k, j in enumerate(with_intercept)}

    absorbed_at = spec.terms.index(spec.absorb)
    before = {"(Intercept)", *spec.terms[:absorbed_at]}
    shared = {k: cells[k].iloc[0] for k in keys} | {"n": int(round(design.n.sum())), "rank": len(kept) + n_levels, "tss": design.tss}
    rows, first_index = [], 0
    for j, c in enumerate(every):
        owner = c[0] if c[1] == "intercept" else f"{c[2]}:{c[3]}" if c[1] == "interaction" else c[2] or c[3]
        earlier = owner in before
        first_index += earlier
        row = {"term_index": j + 1 + (0 if earlier else n_levels - 1), "term": c[0], "kind": c[1], "variable": c[2], "factor": c[3]}
        row |= {"level": None if c[4] is None else design.level_text(c[3], c[4]), "aliased": j not in pos}
        row |= {"estimate": float(beta[pos[j]]), "unit_var": float(unit_var[pos[j]])} if j in pos else {"estimate": None, "unit_var": None}
        rows.append(shared | row)
    for f in narrow_spec(spec).factor_cols:
        text = design.level_text(f, design.levels[f][0])
        rows.append(shared | {"term_index": 0, "term": f"{f}{ols._fmt_level(design.levels[f][0])}", "kind": "baseline", "factor": f, "level": text, "estimate": 0.0, "aliased": False})
    solution = {"labels": [labels[k] for k in kept], "beta": beta_c.tolist(), "inverse": inverse.ravel().tolist(), "base": [effect, n_1, *means.tolist()]}
    rows.append(shared | solution | {"term_index": -1, "kind": "solution", "first_index": first_index, "n_levels": n_levels})
    return rows


def level_effects(levels: pd.DataFrame, solved: pd.DataFrame, spec: ols.ModelSpec, keys: list[str]) -> pd.DataFrame:
    """Effects of a block of absorbed levels against the first one."""
    one = solved.iloc[0]
    at = {c: k for k, c in enumerate(one["labels"])}
    beta, base = np.array(one["beta"], dtype=float), np.array(one["base"], dtype=float)
    inverse = np.array(one["inverse"], dtype=float).reshape(len(beta), len(beta))
    means, n, label = np.zeros((len(levels), len(beta))), np.ones(len(levels)), np.zeros(len(levels))
    for r, (cols, sums) in enumerate(zip(levels["cols"], levels["sums"], strict=True)):
        for c, s in zip(cols, sums, strict=True):
            if c == COUNT:
                n[r] = s
            elif c == LABEL:
                label[r] = s
            elif c in at:
                means[r, at[c]] = s
    means /= n[:, None]
    away = means - base[2:]
    first = levels["pos"].to_numpy() == 1
    effect = np.where(first, 0.0, label / n - means @ beta - base[0])
    var = 1 / n + 1 / base[1] + np.einsum("rk,kl,rl->r", away, inverse, away)
    out = pd.DataFrame({k: [one[k]] * len(levels) for k in [*keys, "n", "rank", "tss"]})
    out["term_index"] = np.where(first, 0, int(one["first_index"]) + levels["pos"].to_numpy() - 1)
    out["term"] = [f"{spec.absorb}{ols._fmt_level(v)}" for v in levels["level"]]
    out["kind"] = np.where(first, "baseline", "factor")
    out["variable"], out["factor"], out["level"] = None, spec.absorb, levels["text"].to_numpy()
    out["estimate"], out["unit_var"], out["aliased"] = effect, np.where(first, np.nan, var), False
    return out


def residual_sums(fitted: ols.FittedModels, cells: DataFrame) -> DataFrame:
    """(model keys, rss): squared residuals from the moments of the cells; a cell's mean residual is taken before it is squared."""
    spec = fitted.spec
    order = [*spec.numerics, spec.label]

    def cov(a, b):
        i, j = sorted((order.index(a), order.index(b)))
        return F.col(f"cov_{order[i]}__{order[j]}")

    miss, spread = F.col(f"mean_{spec.label}") - F.col("__a"), cov(spec.label, spec.label)
    for x in spec.numerics:
        slope = F.col(f"__s_{x}")
        miss = miss - slope * F.col(f"mean_{x}")
        spread = spread - 2 * slope * cov(x, spec.label)
        for z in spec.numerics:
            spread = spread + slope * F.col(f"__s_{z}") * cov(x, z)
    scored = ols.with_effects(fitted, cells)
    return scored.groupBy(*spec.model_keys).agg(F.sum(F.col("n") * (miss * miss + F.greatest(spread, F.lit(0.0)))).alias("rss"))


def summary(rows: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    """Standard errors, t and F tests from unit variances and residual sums."""
    out = rows.copy()
    df = out["n"] - out["rank"]
    sigma2 = (out["rss"] / df).where(df > 0)
    out["df_resid"], out["sigma"] = df, np.sqrt(sigma2)
    r2 = (1.0 - out["rss"] / out["tss"]).where(out["tss"] > 0)
    out["r2"], out["adj_r2"] = r2, (1.0 - (1.0 - r2) * (out["n"] - 1.0) / df).where(df > 0)
    df1 = out["rank"] - 1
    f = ((out["tss"] - out["rss"]) / df1 / sigma2).where((df1 > 0) & (sigma2 > 0))
    out["f_stat"], out["f_df1"], out["f_df2"] = f, df1, df
    known: dict[tuple, float | None] = {}
    for args in zip(f, df1, df, strict=True):
        if args not in known:
            known[args] = None if math.isnan(args[0]) else f_upper_p(*args)
    out["f_p_value"] = [known[args] for args in zip(f, df1, df, strict=True)]
    out["std_error"] = np.sqrt(sigma2 * out["unit_var"].clip(lower=0.0))
    out["t_value"] = (out["estimate"] / out["std_error"]).where(out["std_error"] > 0)
    out["p_value"] = [None if math.isnan(t) else t_two_sided_p(t, d) for t, d in zip(out["t_value"], df, strict=True)]
    return out[names]


def fit_absorbed(cells: DataFrame, spec: ols.ModelSpec) -> ols.FittedModels:
    """Fit one model per key from its cells, with ``spec.absorb`` eliminated; the result is that of ``ols.fit_cells``."""
    keys, d = spec.model_keys, spec.absorb
    narrow = narrow_spec(spec)
    schema = ols._result_schema(cells, spec)
    cells = materialize(cells)
    levels = materialize(level_sums(cells, spec))
    few = merge_moments(cells, [*keys, *narrow.factor_cols]).withColumns({f"__t_{f}": F.col(f).cast("string") for f in narrow.factor_cols})
    kept = [cells.schema[k] for k in keys]
    fields = [T.StructField(n, t) for n, t in [*NARROW_FIELDS, ("unit_var", T.DoubleType()), *FIT_FIELDS]]
    solved_schema = T.StructType([*kept, *fields, *(T.StructField(n, t) for n, t in SOLUTION_FIELDS)])
    level_schema = T.StructType([*kept, *fields])

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = solve_narrow(left, right, spec, keys)
        return pd.DataFrame([{c: r.get(c) for c in solved_schema.names} for r in rows], dtype=object)

    def effects(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return level_effects(left, right, spec, keys)[level_schema.names]

    solved = materialize(few.groupBy(*keys).cogroup(level_products(levels, spec).groupBy(*keys)).applyInPandas(solve, solved_schema))
    block = F.floor((F.col("pos") - 1) / LEVEL_BLOCK).alias("block")
    solutions = solved.where("kind = 'solution'").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_levels") - 1) / LEVEL_BLOCK))))
    wide = levels.select("*", block).groupBy(*keys, "block").cogroup(solutions.groupBy(*keys, "block")).applyInPandas(effects, level_schema)
    terms = materialize(solved.where("kind <> 'solution'").select(*level_schema.names).unionByName(wide))
    # an absent standard error is null, not NaN
    rss = residual_sums(ols.FittedModels(spec, terms), cells)
    names = schema.names
    told = terms.join(rss, keys).mapInPandas(lambda parts: (summary(p, names) for p in parts), schema)
    doubles = [f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)]
    return ols.FittedModels(spec, materialize(told.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in doubles})))
