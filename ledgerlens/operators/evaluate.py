"""Train/test split and model evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ols import MODEL, FittedModels, ModelSpec, cell_moments, fit_cells, with_effects
from ledgerlens.operators.quantiles import exact_quantiles
from ledgerlens.session import materialize

# 0xcccccccc / 2**32 = 0.8: share of rows (by key) in the training side.
TRAIN_THRESHOLD = "cccccccc"


def split_flag(key_cols: Sequence[str], threshold: str = TRAIN_THRESHOLD):
    """Deterministic 80/20 split by a hash of stable keys (ids, text, dates).

    Stateless: no shuffle, independent of partitioning and input order, the
    same rows in any engine with md5. Rows with equal keys go to the same
    side. Doubles are never hashed (their text differs between engines).
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return F.substring(F.md5(text), 1, 8) < F.lit(threshold)


def train_test_split(df: DataFrame, key_cols: Sequence[str], flag: str = "is_train") -> DataFrame:
    return df.withColumn(flag, split_flag(key_cols))


def _key_hash(key_cols: Sequence[str]):
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")


def stratified_split(
    df: DataFrame,
    model_keys: Sequence[str],
    label: str,
    key_cols: Sequence[str],
    p: float = 0.8,
    groups: int = 4,
    flag: str = "is_train",
) -> DataFrame:
    """80/20 split stratified on the target, per model.

    The target is cut at its percentiles into up to ``groups`` bins per
    model (interval ``(c_{i-1}, c_i]``, lowest included; tied cuts merge
    bins). Within each bin the training side is the ``ceil(p·n)`` rows with
    the smallest key hash: the threshold is that exact order statistic of
    the hash, found by ``exact_quantiles`` (no window over a whole bin). Cuts
    and thresholds are written tables with a row per model and bin; the planner joins
    them by their size, for three models or 300,000. Rows with equal keys
    share a hash and a side. Rows with a null target stay in the test side.
    """
    mk = list(model_keys)
    probs = {f"__c{i}": i / groups for i in range(1, groups)}
    cuts = exact_quantiles(df, mk, label, probs)
    binned = df.join(cuts.select(*mk, *probs), mk, "left")
    bin_col = F.lit(0)
    for c in probs:
        bin_col = bin_col + F.when(F.col(label) > F.col(c), 1).otherwise(0)
    binned = binned.withColumn("__bin", bin_col).withColumn("__h", _key_hash(key_cols)).drop(*probs)
    thr = exact_quantiles(binned.where(F.col(label).isNotNull()), [*mk, "__bin"], "__h", {"__t": p}, rule="inverse_cdf")
    out = binned.join(thr.select(*mk, "__bin", "__t"), [*mk, "__bin"], "left")
    is_train = F.coalesce(F.col(label).isNotNull() & (F.col("__h") <= F.col("__t")), F.lit(False))
    return out.withColumn(flag, is_train).drop("__bin", "__h", "__t")


def residual_quantiles(fitted: FittedModels, scored: DataFrame, label: str, pred: str = "prediction") -> DataFrame:
    """min, q25, median, q75, max of residuals per model (exact quantiles).

    The residuals are written once, so the joins of the predictions run once.
    """
    keys = fitted.spec.model_keys
    res = scored.withColumn("__res", F.col(label) - F.col(pred))
    q = exact_quantiles(
        res,
        keys,
        "__res",
        {"q25": 0.25, "median": 0.5, "q75": 0.75},
        extra_aggs=[F.min("__x").alias("min"), F.max("__x").alias("max")],
    )
    out = q.select(*keys, "min", "q25", "median", "q75", "max")
    return out.drop(MODEL) if MODEL in out.columns else out


def test_metrics(scored: DataFrame, keys: Sequence[str], label: str, pred: str = "prediction") -> DataFrame:
    """Hold-out metrics per model key, from one aggregate.

    * ``rmse_test``  sqrt(mean((y - ŷ)²))
    * ``test_r2``    1 - SSres/SStot with SStot about the test mean
    * ``r2_corr``    squared correlation of y and ŷ (a different statistic)
    * ``n_test`` all test rows, ``n_unscored`` rows without a prediction
    Rows without a prediction (unseen factor level) are left out of the
    statistics. A flat test target gives a null R² instead of an error.
    """
    y, p = F.col(label), F.col(pred)
    ok = p.isNotNull()
    e2 = F.when(ok, (y - p) * (y - p))
    ys = F.when(ok, y)
    agg = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_test"),
        F.count_if(~ok).alias("n_unscored"),
        F.sum(e2).alias("__sse"),
        F.count(e2).alias("__n"),
        F.var_pop(ys).alias("__var"),
        F.covar_pop(F.when(ok, y), p).alias("__cyp"),
        F.var_pop(F.when(ok, p)).alias("__vp"),
    )
    sst = F.col("__var") * F.col("__n")
    return agg.select(
        *keys,
        F.sqrt(F.try_divide(F.col("__sse"), F.col("__n").cast("double"))).alias("rmse_test"),
        (F.lit(1.0) - F.try_divide(F.col("__sse"), F.when(sst > 0, sst))).alias("test_r2"),
        F.try_divide(
            F.col("__cyp") * F.col("__cyp"), F.when((F.col("__var") > 0) & (F.col("__vp") > 0), F.col("__var") * F.col("__vp"))
        ).alias("r2_corr"),
        "n_test",
        "n_unscored",
    )


def cell_metrics(fitted: FittedModels, cells: DataFrame) -> DataFrame:
    """``test_metrics`` of a linear model from the moments of its test cells.

    In a cell (model keys x factor levels) the prediction is one line in the
    numeric variables, so its mean, its variance and its covariance with the
    target follow from the cell's own: no row is read again and none is
    predicted. Cells are combined around the model's test means.
    """
    spec = fitted.spec
    keys, xs, y = spec.model_keys, spec.numerics, spec.label
    order = [*xs, y]

    def cov(a: str, b: str):
        i, j = sorted((order.index(a), order.index(b)))
        return F.col(f"cov_{order[i]}__{order[j]}")

    mean_p, var_p, cov_yp = F.col("__a"), F.lit(0.0), F.lit(0.0)
    for x in xs:
        s = F.col(f"__s_{x}")
        mean_p = mean_p + s * F.col(f"mean_{x}")
        cov_yp = cov_yp + s * cov(x, y)
        for z in xs:
            var_p = var_p + s * F.col(f"__s_{z}") * cov(x, z)
    c = with_effects(fitted, cells).withColumns({"__my": F.col(f"mean_{y}"), "__mp": mean_p, "__vy": cov(y, y), "__vp": var_p, "__cyp": cov_yp})
    ok = F.col("__a").isNotNull()
    scored = F.when(ok, F.col("n"))
    means = c.groupBy(*keys).agg(
        F.sum("n").alias("n_test"),
        F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("n_unscored"),
        F.sum(scored).cast("double").alias("__n"),
        F.try_divide(F.sum(scored * F.col("__my")), F.sum(scored)).alias("__ybar"),
        F.try_divide(F.sum(scored * F.col("__mp")), F.sum(scored)).alias("__pbar"),
    )
    dy, dp = F.col("__my") - F.col("__ybar"), F.col("__mp") - F.col("__pbar")
    miss = F.col("__my") - F.col("__mp")
    spread = F.greatest(F.col("__vy") - 2 * F.col("__cyp") + F.col("__vp"), F.lit(0.0))
    sums = c.where(ok).join(means.select(*keys, "__ybar", "__pbar"), keys).groupBy(*keys).agg(
        F.sum(F.col("n") * (spread + miss * miss)).alias("__sse"),
        F.sum(F.col("n") * (F.col("__vy") + dy * dy)).alias("__syy"),
        F.sum(F.col("n") * (F.col("__vp") + dp * dp)).alias("__spp"),
        F.sum(F.col("n") * (F.col("__cyp") + dy * dp)).alias("__syp"),
    )
    syy, spp, syp = F.col("__syy"), F.col("__spp"), F.col("__syp")
    out = means.join(sums, keys, "left").select(
        *keys,
        F.sqrt(F.try_divide(F.col("__sse"), F.col("__n"))).alias("rmse_test"),
        (F.lit(1.0) - F.try_divide(F.col("__sse"), F.when(syy > 0, syy))).alias("test_r2"),
        F.try_divide(syp * syp, F.when((syy > 0) & (spp > 0), syy * spp)).alias("r2_corr"),
        "n_test",
        "n_unscored",
    )
    return out if spec.keys else out.drop(MODEL)


def fit_and_test(frame: DataFrame, spec: ModelSpec, flag: str = "is_train") -> tuple[FittedModels, DataFrame]:
    """Fit on the rows with ``flag``, evaluate on the others: one scan and one
    aggregate of ``frame`` by (model keys, factor levels, flag). Only those
    cells are written, as the fit and the evaluation both read them."""
    cells = materialize(cell_moments(frame, spec, [flag]))
    fitted = fit_cells(cells.where(F.col(flag)).drop(flag), spec)
    return fitted, cell_metrics(fitted, cells.where(~F.col(flag)).drop(flag))


def coef_compare(fitted: FittedModels, terms: Sequence[str] = ("quantity", "discount", "unit_price"), group_col: str = "customer_type") -> DataFrame:
    """Selected slopes side by side across a key (e.g. B2B vs B2C)."""
    coefs = fitted.coefficients()
    return coefs.where(F.col("term").isin(*terms)).select(
        "term", F.col(group_col).alias("group"), "estimate", "std_error", "aliased"
    )
