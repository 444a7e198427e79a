"""Many least-squares regressions in one distributed pass.

A model is a label, main-effect terms in formula order (numeric or
factor), numeric x factor interactions, and optional key columns (one model
per key value, e.g. per customer type and product).

The design matrix is never built row by row. Factors are constant inside a
*cell* (one combination of key and factor values), so the Gram matrix of
any design with dummies and numeric x dummy interactions is a sum over
cells of the cells' moment matrices:

1. ``cell_moments``: one ``groupBy(keys, factors)`` computing count, means
   and population covariances (Spark's numerically stable, mergeable
   co-moment aggregate; map-side partial aggregation), so the output size
   is the number of cells, independent of the row count.
2. ``fit``: ``applyInPandas`` per model over its cells only: levels
   (sorted, first = baseline) come from the training cells, numerics are
   centred on the model mean through the parallel-axis rule, the Gram
   matrix is accumulated per pair of moment rows, and an incremental
   Cholesky sweep in term order marks aliased columns (constant or
   collinear with earlier terms: null estimate, ``aliased = true``). The
   solution is mapped back to the uncentred parameterisation with its
   covariance, giving standard errors, t and p values, sigma, R², adjusted
   R² and the F test.
3. ``predict``: coefficients are a small table (checked row count,
   checkpointed); slopes per model and effects per (model, factor level)
   are broadcast-joined to the rows. An unseen level yields a null
   prediction.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.stats import f_upper_p, t_two_sided_p
from ledgerlens.session import materialize

MODEL = "__model"
# Aliasing rule (term order decides which of two collinear columns stays).
CONST_TOL = 1e-14  # centred sum of squares <= CONST_TOL * raw sum of squares
PIVOT_TOL = 1e-10  # Cholesky pivot <= PIVOT_TOL * column's own centred sum of squares


@dataclass(frozen=True)
class ModelSpec:
    label: str
    terms: tuple[str, ...]
    factors: frozenset[str] = field(default_factory=frozenset)
    interactions: tuple[tuple[str, str], ...] = ()
    keys: tuple[str, ...] = ()
    absorb: str | None = None  # a factor of any width, eliminated in Spark (see ``absorb``)

    def __post_init__(self):
        if self.absorb is not None and (self.absorb not in self.factors or self.absorb not in self.terms or any(f == self.absorb for _, f in self.interactions)):
            raise ValueError(f"{self.absorb!r} must be a factor among the terms, without interactions, to be absorbed")

    @property
    def numerics(self) -> list[str]:
        out = [t for t in self.terms if t not in self.factors]
        for x, _ in self.interactions:
            if x not in out:
                out.append(x)
        return out

    @property
    def factor_cols(self) -> list[str]:
        out = [t for t in self.terms if t in self.factors]
        for _, f in self.interactions:
            if f not in out:
                out.append(f)
        return out

    @property
    def model_keys(self) -> list[str]:
        return list(self.keys) if self.keys else [MODEL]

    def columns(self) -> list[str]:
        return [self.label, *self.numerics, *self.factor_cols]

    def formula(self) -> str:
        rhs = list(self.terms) + [f"{x}:{f}" for x, f in self.interactions]
        return f"{self.label} ~ {' + '.join(rhs)}"


def model_frame(df: DataFrame, spec: ModelSpec, extra: Sequence[str] = ()) -> DataFrame:
    """Model columns only, rows with a null (or NaN) in any of them dropped."""
    cols = list(dict.fromkeys([*spec.keys, *spec.columns(), *extra]))
    out = df.select(*cols)
    if not spec.keys:
        out = out.withColumn(MODEL, F.lit(0))
    cond = F.lit(True)
    for c in spec.columns():
        dt = out.schema[c].dataType
        ok = F.col(c).isNotNull()
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            ok = ok & ~F.isnan(F.col(c))
        cond = cond & ok
    return out.where(cond)


def _vars(spec: ModelSpec) -> list[str]:
    return [*spec.numerics, spec.label]


def cell_moments(frame: DataFrame, spec: ModelSpec, by: Sequence[str] = ()) -> DataFrame:
    """Sufficient statistics per (model keys, factor values, ``by``): one aggregate."""
    vs = _vars(spec)
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(F.col(v).cast("double")).alias(f"mean_{v}") for v in vs]
    for i, a in enumerate(vs):
        for b in vs[i:]:
            aggs.append(F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"cov_{a}__{b}"))
    return frame.groupBy(*spec.model_keys, *spec.factor_cols, *by).agg(*aggs)


FIT_FIELDS = [
    ("n", T.LongType()),
    ("rank", T.IntegerType()),
    ("df_resid", T.LongType()),
    ("sigma", T.DoubleType()),
    ("r2", T.DoubleType()),
    ("adj_r2", T.DoubleType()),
    ("f_stat", T.DoubleType()),
    ("f_df1", T.IntegerType()),
    ("f_df2", T.LongType()),
    ("f_p_value", T.DoubleType()),
    ("rss", T.DoubleType()),
    ("tss", T.DoubleType()),
]
TERM_FIELDS = [
    ("term_index", T.IntegerType()),
    ("term", T.StringType()),
    ("kind", T.StringType()),
    ("variable", T.StringType()),
    ("factor", T.StringType()),
    ("level", T.StringType()),
    ("estimate", T.DoubleType()),
    ("std_error", T.DoubleType()),
    ("t_value", T.DoubleType()),
    ("p_value", T.DoubleType()),
    ("aliased", T.BooleanType()),
]


def _fmt_level(v) -> str:
    if isinstance(v, (float, np.floating)) and float(v).is_integer():
        return str(int(v))
    return str(v)


@dataclass
class Design:
    """The Gram matrix of a model's centred design, from its cells.

    ``cols`` are (term, kind, variable, factor, level, u, cells): u is the place of the
    column's variable in the moment basis [1, numerics, label], cells marks those of its level.
    """

    cols: list[tuple]
    u: np.ndarray
    gram: np.ndarray
    gram_y: np.ndarray
    tss: float
    raw_sq: np.ndarray  # uncentred sums of squares by u, for the constant-column rule
    mean_of: dict[str, float]
    levels: dict[str, list]
    texts: dict[str, dict]  # the text of each level as Spark casts it
    n: np.ndarray  # rows a cell
    away: np.ndarray  # cell mean minus model mean, by variable

    def weights(self) -> np.ndarray:
        """Dummies by cell and column."""
        w = np.ones((len(self.n), len(self.cols)))
        for j, c in enumerate(self.cols):
            if c[6] is not None:
                w[:, j] = c[6].astype(float)
        return w

    def level_text(self, factor: str, level) -> str:
        return self.texts[factor].get(level, _fmt_level(level))


def design_of(pdf: pd.DataFrame, spec: ModelSpec) -> Design:
    """Columns and Gram matrix of one model from its cell moments (pure numpy)."""
    vs = _vars(spec)
    nums = spec.numerics
    k = len(nums)
    yi = k + 1  # index of y in the moment basis [1, x1..xk, y]
    n_c = pdf["n"].to_numpy(dtype=float)
    N = float(n_c.sum())
    means = np.column_stack([pdf[f"mean_{v}"].to_numpy(dtype=float) for v in vs]) if vs else np.zeros((len(pdf), 0))
    gm = (n_c[:, None] * means).sum(axis=0) / N
    d = means - gm  # cell mean minus model mean
    C = len(pdf)
    B = k + 2
    M = np.zeros((C, B, B))
    M[:, 0, 0] = n_c
    for a in range(len(vs)):
        M[:, 0, a + 1] = M[:, a + 1, 0] = n_c * d[:, a]
        for b in range(a, len(vs)):
            cov = pdf[f"cov_{vs[a]}__{vs[b]}"].to_numpy(dtype=float)
            val = n_c * (cov + d[:, a] * d[:, b])
            M[:, a + 1, b + 1] = M[:, b + 1, a + 1] = val
    raw_sq = np.zeros(B)  # uncentred sums of squares of numerics, for the constant-column rule
    for a in range(len(vs)):
        cov = pdf[f"cov_{vs[a]}__{vs[a]}"].to_numpy(dtype=float)
        raw_sq[a + 1] = float((n_c * (cov + means[:, a] ** 2)).sum())

    # factor levels from the training cells, sorted in their own type
    levels: dict[str, list] = {}
    for f in spec.factor_cols:
        vals = pd.unique(pdf[f])
        levels[f] = sorted(vals.tolist())

    # the text of each level as Spark casts it
    texts = {f: dict(zip(pdf[f], pdf[f"__t_{f}"], strict=True)) if f"__t_{f}" in pdf else {} for f in spec.factor_cols}

    cols = []  # (term, kind, variable, factor, level, u, dummy mask or None)
    cols.append(("(Intercept)", "intercept", None, None, None, 0, None))
    for t in spec.terms:
        if t in spec.factors:
            for lv in levels[t][1:]:
                cols.append((f"{t}{_fmt_level(lv)}", "factor", None, t, lv, 0, (pdf[t] == lv).to_numpy()))
        else:
            cols.append((t, "numeric", t, None, None, nums.index(t) + 1, None))
    for x, f in spec.interactions:
        for lv in levels[f][1:]:
            cols.append((f"{x}:{f}{_fmt_level(lv)}", "interaction", x, f, lv, nums.index(x) + 1, (pdf[f] == lv).to_numpy()))
    p = len(cols)
    u = np.array([c[5] for c in cols])
    out = Design(cols, u, np.zeros((p, p)), np.zeros(p), float(M[:, yi, yi].sum()), raw_sq, {v: gm[i] for i, v in enumerate(vs)}, levels, texts, n_c, d)
    W, G, Gy = out.weights(), out.gram, out.gram_y
    for s in np.unique(u):
        js = np.where(u == s)[0]
        Gy[js] = (W[:, js] * M[:, s, yi][:, None]).sum(axis=0)
        for t_ in np.unique(u):
            jt = np.where(u == t_)[0]
            G[np.ix_(js, jt)] = (W[:, js] * M[:, s, t_][:, None]).T @ W[:, jt]
    return out


def sweep(gram: np.ndarray, cols: list[tuple], raw_sq: np.ndarray, own: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Columns that are kept, in term order, and their Cholesky factor.

    Each kept column is eliminated from the rest at once, so a column costs one
    update and aliased columns are skipped. ``own`` are the columns' own sums of squares.
    """
    kept: list[int] = []
    columns: list[np.ndarray] = []
    S = gram.copy()
    for j in range(len(cols)):
        if own[j] <= 0:
            continue
        if cols[j][1] == "numeric" and own[j] <= CONST_TOL * max(raw_sq[cols[j][5]], 0.0):
            continue
        r = S[j, j]
        if r <= PIVOT_TOL * own[j]:
            continue
        column = S[j:, j] / math.sqrt(r)
        S[j + 1 :, j + 1 :] -= np.outer(column[1:], column[1:])
        kept.append(j)
        columns.append(np.concatenate([np.zeros(j), column]))
    return kept, np.column_stack(columns)[kept, :] if kept else np.zeros((0, 0))


def uncentring(cols: list[tuple], kept: list[int], mean_of: dict[str, float]) -> np.ndarray:
    """The matrix that takes the coefficients of the centred design (kept columns, the intercept first) to those of the plain one.

    The label's mean is still to be added to the intercept.
    """
    pos = {j: i for i, j in enumerate(kept)}
    Tm = np.eye(len(kept))
    for j in kept:
        kind, var, fac, lv = cols[j][1], cols[j][2], cols[j][3], cols[j][4]
        if kind == "numeric":
            Tm[pos[0], pos[j]] -= mean_of[var]
        elif kind == "interaction":
            # the factor main effect absorbs -b·mean of its interactions
            for jj in kept:
                if cols[jj][1] == "factor" and cols[jj][3] == fac and cols[jj][4] == lv:
                    Tm[pos[jj], pos[j]] -= mean_of[var]
                    break
            else:
                Tm[pos[0], pos[j]] -= mean_of[var]
    return Tm


def solve_cells(pdf: pd.DataFrame, spec: ModelSpec, key_names: list[str]) -> pd.DataFrame:
    """Least squares for one model from its cell moments (pure numpy)."""
    vs = _vars(spec)
    design = design_of(pdf, spec)
    cols, u, d, n_c, tss, levels, texts = design.cols, design.u, design.away, design.n, design.tss, design.levels, design.texts
    N, C, B, yi, mean_of = float(n_c.sum()), len(n_c), len(vs) + 1, len(vs), design.mean_of
    W = design.weights()
    kept, Lk = sweep(design.gram, cols, design.raw_sq, np.diag(design.gram))
    Gy = design.gram_y
    rank = len(kept)
    # beta~ = G_KK^-1 Gy_K via the Cholesky factor
    w = np.linalg.solve(Lk, Gy[kept])
    beta_c = np.linalg.solve(Lk.T, w)
    # residuals cell by cell: their mean is a difference taken before squaring,
    # so a near-perfect fit does not cancel as tss - w·w would
    V = np.zeros((C, B))
    V[:, yi] = 1.0
    for j, b_j in zip(kept, beta_c, strict=True):
        V[:, u[j]] -= W[:, j] * b_j
    mean_res = V[:, 0] + (V[:, 1:] * d).sum(axis=1)
    spread = np.zeros(C)
    for a in range(len(vs)):
        for b in range(a, len(vs)):
            twice = 1.0 if a == b else 2.0
            spread += twice * V[:, a + 1] * V[:, b + 1] * pdf[f"cov_{vs[a]}__{vs[b]}"].to_numpy(dtype=float)
    rss = float((n_c * (mean_res**2 + np.maximum(spread, 0.0))).sum())
    df_resid = int(round(N)) - rank
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")
    Linv = np.linalg.inv(Lk)
    cov_c = sigma2 * (Linv.T @ Linv)

    # back to the uncentred parameterisation: beta = T beta~ (+ y mean on the intercept)
    pos = {j: i for i, j in enumerate(kept)}
    Tm = uncentring(cols, kept, mean_of)
    beta = Tm @ beta_c
    beta[pos[0]] += mean_of[spec.label]
    cov = Tm @ cov_c @ Tm.T
    se = np.sqrt(np.clip(np.diag(cov), 0.0, None)) if df_resid > 0 else np.full(rank, np.nan)

    r2 = 1.0 - rss / tss if tss > 0 else None
    adj = 1.0 - (1.0 - r2) * (N - 1.0) / df_resid if (r2 is not None and df_resid > 0) else None
    df1 = rank - 1
    f_stat = ((tss - rss) / df1) / sigma2 if (df1 > 0 and df_resid > 0 and sigma2 > 0) else None
    f_p = f_upper_p(f_stat, df1, df_resid) if f_stat is not None else None
    sigma = math.sqrt(sigma2) if df_resid > 0 else None

    fit = {
        "n": int(round(N)),
        "rank": rank,
        "df_resid": df_resid,
        "sigma": sigma,
        "r2": r2,
        "adj_r2": adj,
        "f_stat": f_stat,
        "f_df1": df1,
        "f_df2": df_resid,
        "f_p_value": f_p,
        "rss": rss,
        "tss": tss,
    }
    key_vals = {kname: pdf[kname].iloc[0] for kname in key_names}
    rows = []
    for j, c in enumerate(cols):
        if j in pos:
            est = float(beta[pos[j]])
            s = float(se[pos[j]]) if df_resid > 0 else None
            tv = est / s if (s is not None and s > 0) else None
            pv = t_two_sided_p(tv, df_resid) if tv is not None else None
            aliased = False
        else:
            est = s = tv = pv = None
            aliased = True
        rows.append(
            {
                **key_vals,
                "term_index": j + 1,
                "term": c[0],
                "kind": c[1],
                "variable": c[2],
                "factor": c[3],
                "level": None if c[4] is None else texts[c[3]].get(c[4], _fmt_level(c[4])),
                "estimate": est,
                "std_error": s,
                "t_value": tv,
                "p_value": pv,
                "aliased": aliased,
                **fit,
            }
        )
    # baseline levels carry effect 0; prediction needs them to tell "seen" from "unseen"
    for f in spec.factor_cols:
        if levels[f]:
            rows.append(
                {
                    **key_vals,
                    "term_index": 0,
                    "term": f"{f}{_fmt_level(levels[f][0])}",
                    "kind": "baseline",
                    "variable": None,
                    "factor": f,
                    "level": texts[f].get(levels[f][0], _fmt_level(levels[f][0])),
                    "estimate": 0.0,
                    "std_error": None,
                    "t_value": None,
                    "p_value": None,
                    "aliased": False,
                    **fit,
                }
            )
    return pd.DataFrame(rows)


def _result_schema(cells: DataFrame, spec: ModelSpec) -> T.StructType:
    fields = [cells.schema[k] for k in spec.model_keys]
    fields += [T.StructField(n, t) for n, t in TERM_FIELDS]
    fields += [T.StructField(n, t) for n, t in FIT_FIELDS]
    return T.StructType(fields)


@dataclass
class FittedModels:
    spec: ModelSpec
    table: DataFrame  # every design column + baseline rows, with fit statistics

    def coefficients(self) -> DataFrame:
        """R-style coefficient table (aliased terms kept with null estimate)."""
        keys = list(self.spec.keys)
        return self.table.where(F.col("kind") != "baseline").select(
            *keys, "term_index", "term", "estimate", "std_error", "t_value", "p_value", "aliased"
        )

    def fit_stats(self) -> DataFrame:
        keys = list(self.spec.keys)
        names = [n for n, _ in FIT_FIELDS]
        return self.table.where(F.col("term_index") == 1).select(*keys, *names)


def save(fitted: FittedModels, path: str) -> None:
    """Store models where another session can load them: the coefficient and level table, and the formula beside it."""
    spec = fitted.spec
    formula = {"label": spec.label, "terms": spec.terms, "factors": sorted(spec.factors), "interactions": spec.interactions, "keys": spec.keys, "absorb": spec.absorb}
    spark = fitted.table.sparkSession
    fitted.table.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/coefficients")
    spark.range(1).select(F.lit(json.dumps(formula)).alias("formula")).write.mode("errorifexists").parquet(f"{path}/formula")


def load(spark: SparkSession, path: str) -> FittedModels:
    """Models stored by ``save``. A store without its formula raises."""
    formula = json.loads(spark.read.parquet(f"{path}/formula").first()["formula"])
    spec = ModelSpec(
        formula["label"], tuple(formula["terms"]), frozenset(formula["factors"]), tuple(tuple(i) for i in formula["interactions"]), tuple(formula["keys"]), formula["absorb"]
    )
    return FittedModels(spec, spark.read.parquet(f"{path}/coefficients"))


def fit(frame: DataFrame, spec: ModelSpec) -> FittedModels:
    """Fit one model per key value; ``frame`` comes from ``model_frame``."""
    return fit_cells(cell_moments(frame, spec), spec)


def fit_cells(cells: DataFrame, spec: ModelSpec) -> FittedModels:
    """Fit one model per key value from its cell moments.

    A level's text is made once, here, by Spark; predictions match it.
    """
    if spec.absorb is not None:
        from ledgerlens.operators.absorb import fit_absorbed

        return fit_absorbed(cells, spec)
    keys = spec.model_keys
    schema = _result_schema(cells, spec)
    cells = cells.withColumns({f"__t_{f}": F.col(f).cast("string") for f in spec.factor_cols})

    def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = solve_cells(pdf, spec, keys)
        return out[[f.name for f in schema.fields]]

    return FittedModels(spec, materialize(cells.groupBy(*keys).applyInPandas(_solve, schema=schema)))


def with_effects(fitted: FittedModels, frame: DataFrame) -> DataFrame:
    """``frame`` with each row's intercept ``__a`` and slopes ``__s_<x>``.

    ``__a`` is the intercept with the row's factor effects; it is null
    exactly when a factor level was not seen in training. A slope includes
    the row's interactions. Aliased coefficients count as 0. Levels are
    matched by the text that Spark gives them, the same on both sides.
    """
    spec = fitted.spec
    keys = spec.model_keys
    tab = fitted.table
    est = F.coalesce(F.col("estimate"), F.lit(0.0))
    slope_aggs = [F.max(F.when(F.col("kind") == "intercept", est)).alias("__b0")]
    nums_main = [t for t in spec.terms if t not in spec.factors]
    for x in nums_main:
        slope_aggs.append(F.max(F.when((F.col("kind") == "numeric") & (F.col("variable") == x), est)).alias(f"__b_{x}"))
    out = frame.join(tab.groupBy(*keys).agg(*slope_aggs), keys, "left")
    intercept = F.col("__b0")
    slopes = {x: F.coalesce(F.col(f"__b_{x}"), F.lit(0.0)) if x in nums_main else F.lit(0.0) for x in spec.numerics}
    helpers = ["__b0", *[f"__b_{x}" for x in nums_main]]
    for f in spec.factor_cols:
        inter = [x for x, ff in spec.interactions if ff == f]
        aggs = [F.max(F.when(F.col("kind").isin("factor", "baseline"), est)).alias(f"__e_{f}")]
        for x in inter:
            aggs.append(F.max(F.when((F.col("kind") == "interaction") & (F.col("variable") == x), est)).alias(f"__i_{f}_{x}"))
        eff = tab.where(F.col("factor") == f).groupBy(*keys, F.col("level").alias(f"__lv_{f}")).agg(*aggs)
        out = out.withColumn(f"__lv_{f}", F.col(f).cast("string")).join(eff, [*keys, f"__lv_{f}"], "left")
        intercept = intercept + F.col(f"__e_{f}")
        for x in inter:
            slopes[x] = slopes[x] + F.coalesce(F.col(f"__i_{f}_{x}"), F.lit(0.0))
        helpers += [f"__lv_{f}", f"__e_{f}", *[f"__i_{f}_{x}" for x in inter]]
    return out.withColumns({"__a": intercept, **{f"__s_{x}": c for x, c in slopes.items()}}).drop(*helpers)


def predict(fitted: FittedModels, frame: DataFrame, out_col: str = "prediction") -> DataFrame:
    """Add ``out_col`` = fitted value for every row of ``frame`` (rows of an
    unseen factor level get null). The coefficient tables have a row per
    model and level; Spark broadcasts them if they are small."""
    spec = fitted.spec
    pred = F.col("__a")
    for x in spec.numerics:
        pred = pred + F.col(f"__s_{x}") * F.col(x)
    out = with_effects(fitted, frame).withColumn(out_col, pred).drop("__a", *[f"__s_{x}" for x in spec.numerics])
    return out if spec.keys else out.drop(MODEL)
