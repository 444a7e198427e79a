"""Named analyses over the star-schema fixture: the ``queries()`` registry.

Every entry takes ``(spark, sf_dir)``, reads the fixture tables through the
line-item adapter and returns a lazy DataFrame over the whole tables. The
matching DuckDB SQL lives in ``plans.oracle``. Doubles that the analysis
does not round itself are rounded for comparison (``cmp4``: the same IEEE
operations as the SQL side), so summation order cannot flip the last bit.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import invoices, profile, quality, rfm, segments
from ledgerlens.plans import oracle
from ledgerlens.plans.oracle import CMP_OFFSET
from ledgerlens.session import checkpoint_dir
from ledgerlens.sources.lines import lines_from_tpch, read_lines_csv
from ledgerlens.sources.names import clean_names

ANALYSIS_DATE = dt.date.fromisoformat(oracle.ANALYSIS_DATE)

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def cmp4_col(c):
    return F.floor(c * F.lit(10000.0) + F.lit(CMP_OFFSET)) / F.lit(10000.0)


def cmp4(df: DataFrame) -> DataFrame:
    """Round every double column for engine-independent comparison."""
    return df.select(
        *[
            cmp4_col(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def register(name: str, compare_round: bool = True):
    def deco(fn: QueryFn) -> QueryFn:
        if compare_round:
            QUERIES[name] = lambda spark, sf_dir: cmp4(fn(spark, sf_dir))
        else:
            QUERIES[name] = fn
        return fn

    return deco


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_from_tpch(spark, sf_dir)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = invoices.rfm_base(lines(spark, sf_dir))
    return rfm.rfm_scores(rfm.rfm_customer(base, ANALYSIS_DATE))


# ---------------------------------------------------------------- quality


@register("date_range")
def q_date_range(spark, sf_dir):
    return quality.date_range(lines(spark, sf_dir))


@register("null_profile")
def q_null_profile(spark, sf_dir):
    """Missing values per column after empty strings became null (as in the analysis)."""
    return quality.null_profile(quality.blank_to_null(lines(spark, sf_dir)))


@register("duplicate_count")
def q_duplicate_count(spark, sf_dir):
    """Duplicate rows after empty strings became null (as in the analysis)."""
    return quality.duplicate_count(quality.blank_to_null(lines(spark, sf_dir)))


@register("invalid_count")
def q_invalid_count(spark, sf_dir):
    return quality.invalid_count(lines(spark, sf_dir))


# Header text as a spreadsheet export would carry it; ``clean_names`` maps
# it back to the library's snake_case names.
EXPORT_HEADERS = [
    "Order ID", "Customer-ID", "CustomerType", "Product", "Category", "Region",
    "Order Date", "UnitPrice", "Quantity", "Discount", "Total Price",
]


@register("clean_columns")
def q_clean_columns(spark, sf_dir):
    return clean_names(lines(spark, sf_dir).toDF(*EXPORT_HEADERS))


@register("blank_to_null")
def q_blank_to_null(spark, sf_dir):
    return quality.blank_to_null(lines(spark, sf_dir))


@register("preview")
def q_preview(spark, sf_dir):
    return quality.preview(lines(spark, sf_dir), 4)


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole line table with NaN, nulls, blanks, implausible values and
    repeated rows put in by remainders of the order id (every row is kept)."""
    o, nan, null = F.col("order_id"), F.lit(float("nan")), F.lit(None)

    def put(name: str, *cases):
        c = F.col(name)
        out = F
        for m, r, v in cases:
            out = out.when(o % m == r, -c if isinstance(v, str) else v)
        return out.otherwise(c).alias(name)

    df = lines(spark, sf_dir).select(
        "order_id", "customer_id", "customer_type",
        put("product", (31, 10, F.lit(""))), "category", put("region", (37, 11, F.lit(""))), "order_date",
        put("unit_price", (19, 7, F.lit(0.0)), (23, 8, null)),
        put("quantity", (11, 3, nan), (13, 5, "minus")),
        put("discount", (7, 2, null), (11, 4, nan), (17, 6, F.lit(1.5))),
        put("total_price", (11, 3, nan), (29, 9, "minus")),
    )
    return df.unionByName(df.where(o % 41 == 12))


@register("null_profile_dirty")
def q_null_profile_dirty(spark, sf_dir):
    return quality.null_profile(quality.blank_to_null(dirty_lines(spark, sf_dir)))


@register("duplicate_count_dirty")
def q_duplicate_count_dirty(spark, sf_dir):
    return quality.duplicate_count(quality.blank_to_null(dirty_lines(spark, sf_dir)))


@register("invalid_count_dirty")
def q_invalid_count_dirty(spark, sf_dir):
    return quality.invalid_count(dirty_lines(spark, sf_dir))


@register("blank_to_null_dirty")
def q_blank_to_null_dirty(spark, sf_dir):
    return quality.blank_to_null(dirty_lines(spark, sf_dir)).select("order_id", "customer_id", "product", "region", "order_date")


@register("numeric_invoice_dirty")
def q_numeric_invoice_dirty(spark, sf_dir):
    return invoices.numeric_invoice(dirty_lines(spark, sf_dir))


@register("top_products_dirty")
def q_top_products_dirty(spark, sf_dir):
    return invoices.top_products(dirty_lines(spark, sf_dir))


@register("top_products_csv")
def q_top_products_csv(spark, sf_dir):
    """All lines written as CSV with export headers in another order, read back by name."""
    named = dict(zip(oracle.LINE_COLS, EXPORT_HEADERS, strict=True))
    order = sorted(oracle.LINE_COLS, key=lambda c: c[::-1])
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    lines(spark, sf_dir).select(*[F.col(c).alias(named[c]) for c in order]).write.option("header", True).csv(path)
    return invoices.top_products(read_lines_csv(spark, path))


# ---------------------------------------------------------------- invoices


@register("rfm_base")
def q_rfm_base(spark, sf_dir):
    return invoices.rfm_base(lines(spark, sf_dir))


@register("numeric_invoice")
def q_numeric_invoice(spark, sf_dir):
    return invoices.numeric_invoice(lines(spark, sf_dir))


@register("full_invoice")
def q_full_invoice(spark, sf_dir):
    return invoices.full_invoice(lines(spark, sf_dir))


@register("combined_invoices")
def q_combined_invoices(spark, sf_dir):
    return invoices.combined_invoices(lines(spark, sf_dir))


@register("top_products")
def q_top_products(spark, sf_dir):
    return invoices.top_products(lines(spark, sf_dir), 10)


# ---------------------------------------------------------------- profiles


@register("line_summary")
def q_line_summary(spark, sf_dir):
    return profile.line_summary(lines(spark, sf_dir))


@register("invoice_summary")
def q_invoice_summary(spark, sf_dir):
    return profile.invoice_summary(invoices.numeric_invoice(lines(spark, sf_dir)))


# ---------------------------------------------------------------- RFM


@register("rfm_customer")
def q_rfm_customer(spark, sf_dir):
    return rfm.rfm_customer(invoices.rfm_base(lines(spark, sf_dir)), ANALYSIS_DATE)


@register("rfm_customer_default_date")
def q_rfm_customer_default_date(spark, sf_dir):
    """As ``rfm_customer``, at 31 December of the latest order's year."""
    return rfm.rfm_customer(invoices.rfm_base(lines(spark, sf_dir)))


@register("rfm_scores")
def q_rfm_scores(spark, sf_dir):
    return scored(spark, sf_dir)


@register("rfm_score_counts")
def q_rfm_score_counts(spark, sf_dir):
    return rfm.rfm_score_counts(scored(spark, sf_dir))


def _hist(metric):
    return lambda spark, sf_dir: rfm.rfm_histogram(scored(spark, sf_dir), metric)


def _score_dist(metric):
    return lambda spark, sf_dir: rfm.rfm_score_distribution(scored(spark, sf_dir), metric)


for _m in ("recency", "frequency", "monetary"):
    register(f"rfm_histogram_{_m}")(_hist(_m))
    register(f"rfm_score_dist_{_m}")(_score_dist(_m))


@register("rfm_order_dist")
def q_rfm_order_dist(spark, sf_dir):
    return rfm.rfm_order_dist(scored(spark, sf_dir))


@register("rfm_heatmap")
def q_rfm_heatmap(spark, sf_dir):
    return rfm.rfm_heatmap(scored(spark, sf_dir))


@register("rfm_scatter")
def q_rfm_scatter(spark, sf_dir):
    return rfm.rfm_scatter(scored(spark, sf_dir))


# ---------------------------------------------------------------- segments

SEGMENT_COLS = ["customer_type", "customer_id", "recency_score", "frequency_score", "monetary_score", "rfm_score", "segment"]


@register("segment_lecture")
def q_segment_lecture(spark, sf_dir):
    return segments.assign_segments(scored(spark, sf_dir), "lecture").select(*SEGMENT_COLS)


@register("segment_custom")
def q_segment_custom(spark, sf_dir):
    return segments.assign_segments(scored(spark, sf_dir), "custom").select(*SEGMENT_COLS)


@register("uncategorized_sample")
def q_uncategorized_sample(spark, sf_dir):
    return segments.uncategorized_sample(segments.assign_segments(scored(spark, sf_dir), "lecture"), 10)


def segment_report_for(rule_set: str) -> QueryFn:
    def fn(spark, sf_dir):
        seg = segments.assign_segments(scored(spark, sf_dir), rule_set)
        return segments.segment_report(seg, rule_set)

    return fn


for _rs in ("lecture", "custom", "custom16"):
    register(f"segment_report_{_rs}", compare_round=False)(segment_report_for(_rs))


@register("report_sink", compare_round=False)
def q_report_sink(spark, sf_dir):
    """The lecture report written as parquet to the shared folder and read back."""
    from ledgerlens.operators.report import write_report

    rep = segment_report_for("lecture")(spark, sf_dir)
    path = write_report(rep, "segment_report_lecture", checkpoint_dir(spark))
    return spark.read.parquet(path)


# ---------------------------------------------------------------- regressions


def _models():
    from ledgerlens.plans import models

    return models


def cmp_sig_col(c, digits: int = 9):
    e = F.floor(F.log10(F.abs(c))) - (digits - 1)
    up = F.pow(F.lit(10.0), e)
    down = F.pow(F.lit(10.0), -e)
    return (
        F.when((c == 0) | c.isNull(), c)
        .when(e >= 0, F.floor(c / up + F.lit(CMP_OFFSET)) * up)
        .otherwise(F.floor(c * down + F.lit(CMP_OFFSET)) / down)
    )


@register("ols_moments", compare_round=False)
def q_ols_moments(spark, sf_dir):
    """Cell moments of the invoice model with region (one row per type x region),
    compared at 9 significant digits (sums of squares reach 1e10)."""
    m = _models()
    from ledgerlens.operators import ols

    frame = ols.model_frame(invoices.full_invoice(lines(spark, sf_dir)), m.M_INVOICE_REGION)
    cells = ols.cell_moments(frame, m.M_INVOICE_REGION)
    return cells.select(
        *[cmp_sig_col(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in cells.schema.fields]
    )


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    m = _models()
    return m.invoice_frame(lines(spark, sf_dir)).select("customer_type", *m.INVOICE_KEYS, "is_train")


@register("ols_product_b2b")
def q_ols_product_b2b(spark, sf_dir):
    return _models().fit_products(lines(spark, sf_dir), "B2B").coefficients()


@register("ols_product_b2c")
def q_ols_product_b2c(spark, sf_dir):
    return _models().fit_products(lines(spark, sf_dir), "B2C").coefficients()


@register("ols_fit")
def q_ols_fit(spark, sf_dir):
    m = _models()
    ln = lines(spark, sf_dir)
    el = m.eligible_products(ln)
    return m.fit_products(ln, "B2B", el).fit_stats().unionByName(m.fit_products(ln, "B2C", el).fit_stats())


@register("ols_fit_all", compare_round=False)
def q_ols_fit_all(spark, sf_dir):
    """Fit summaries of the pooled, invoice, combined and weekend models, at 6 significant digits."""
    m = _models()
    ln = lines(spark, sf_dir)
    fits = {
        "pooled_b2c": m.pooled_b2c(ln),
        "invoice": m.invoice_model(ln)[0],
        "invoice_region_quarter": m.invoice_rq_model(ln)[0],
        "invoice_region": m.invoice_region_model(ln)[0],
        "combined": m.combined_model(ln),
        "weekend": m.weekend_model(ln)[0],
    }
    out = None
    for name, fitted in fits.items():
        stats = fitted.fit_stats()
        group = F.col("customer_type") if "customer_type" in stats.columns else F.lit("all")
        doubles = [cmp_sig_col(F.col(c), 6).alias(c) for c in ("sigma", "r2", "adj_r2", "f_stat")]
        one = stats.select(F.lit(name).alias("model"), group.alias("customer_type"), "n", "rank", "df_resid", *doubles, "f_df1", "f_df2")
        out = one if out is None else out.unionByName(one)
    return out


@register("invoice_metrics_stratified", compare_round=False)
def q_invoice_metrics_stratified(spark, sf_dir):
    """Hold-out metrics of the invoice model under the split stratified on its target."""
    from ledgerlens.operators import evaluate, ols

    m = _models()
    rows = evaluate.stratified_split(invoices.numeric_invoice(lines(spark, sf_dir)), ["customer_type"], m.M_INVOICE.label, m.INVOICE_KEYS)
    _, out = evaluate.fit_and_test(ols.model_frame(rows, m.M_INVOICE, extra=["is_train"]), m.M_INVOICE)
    return out.select("customer_type", *[cmp_sig_col(F.col(c), 6).alias(c) for c in ("rmse_test", "r2_corr", "test_r2")], "n_test", "n_unscored")


@register("ols_pooled_b2c")
def q_ols_pooled_b2c(spark, sf_dir):
    return _models().pooled_b2c(lines(spark, sf_dir)).coefficients()


@register("ols_invoice")
def q_ols_invoice(spark, sf_dir):
    return _models().invoice_model(lines(spark, sf_dir))[0].coefficients()


@register("ols_invoice_rq")
def q_ols_invoice_rq(spark, sf_dir):
    return _models().invoice_rq_model(lines(spark, sf_dir))[0].coefficients()


@register("ols_invoice_region")
def q_ols_invoice_region(spark, sf_dir):
    return _models().invoice_region_model(lines(spark, sf_dir))[0].coefficients()


@register("ols_combined")
def q_ols_combined(spark, sf_dir):
    return _models().combined_model(lines(spark, sf_dir)).coefficients()


@register("ols_weekend")
def q_ols_weekend(spark, sf_dir):
    return _models().weekend_model(lines(spark, sf_dir))[0].coefficients()


@register("ols_predict", compare_round=False)
def q_ols_predict(spark, sf_dir):
    """In-sample predictions of the invoice model with region (prediction
    compared at 6 significant digits, inputs at 4 decimals)."""
    from ledgerlens.operators import ols

    fitted, frame = _models().invoice_region_model(lines(spark, sf_dir))
    out = ols.predict(fitted, frame)
    return out.select(
        "customer_type", "order_id", "customer_id", "order_date", "region",
        *[cmp4_col(F.col(c)).alias(c) for c in ("quantity", "discount", "unit_price", "total_price")],
        cmp_sig_col(F.col("prediction"), 6).alias("prediction"),
    )


@register("ols_residuals", compare_round=False)
def q_ols_residuals(spark, sf_dir):
    """Residual quantiles of the invoice model with region (6 significant digits)."""
    from ledgerlens.operators import evaluate, ols

    fitted, frame = _models().invoice_region_model(lines(spark, sf_dir))
    out = evaluate.residual_quantiles(fitted, ols.predict(fitted, frame), "total_price")
    return out.select("customer_type", *[cmp_sig_col(F.col(c), 6).alias(c) for c in ("min", "q25", "median", "q75", "max")])


@register("model_metrics", compare_round=False)
def q_model_metrics(spark, sf_dir):
    return _models().model_metrics(lines(spark, sf_dir))


@register("invoice_model_metrics", compare_round=False)
def q_invoice_model_metrics(spark, sf_dir):
    """Hold-out metrics of the two invoice models, compared at 6 significant digits."""
    out = _models().invoice_model_metrics(lines(spark, sf_dir))
    return out.select(
        "model", "customer_type", *[cmp_sig_col(F.col(c), 6).alias(c) for c in ("rmse_test", "r2_corr", "test_r2")],
        "n_test", "n_unscored",
    )


@register("weekend_metrics", compare_round=False)
def q_weekend_metrics(spark, sf_dir):
    return _models().weekend_metrics(lines(spark, sf_dir))


@register("coef_compare", compare_round=False)
def q_coef_compare(spark, sf_dir):
    """Slopes across customer types, compared at 6 significant digits."""
    from ledgerlens.operators import evaluate

    cc = evaluate.coef_compare(_models().invoice_region_model(lines(spark, sf_dir))[0])
    return cc.select("term", "group", cmp_sig_col(F.col("estimate"), 6).alias("estimate"),
                     cmp_sig_col(F.col("std_error"), 6).alias("std_error"), "aliased")


@register("ols_coef")
def q_ols_coef(spark, sf_dir):
    """Coefficient tables of all per-product models (both customer types)."""
    m = _models()
    ln = lines(spark, sf_dir)
    el = m.eligible_products(ln)
    return m.fit_products(ln, "B2B", el).coefficients().unionByName(m.fit_products(ln, "B2C", el).coefficients())


@register("train_test_split_stratified")
def q_train_test_split_stratified(spark, sf_dir):
    """Split of the customer-day invoices stratified on total_price per type."""
    from ledgerlens.operators import evaluate

    m = _models()
    inv = invoices.numeric_invoice(lines(spark, sf_dir))
    out = evaluate.stratified_split(inv, ["customer_type"], "total_price", m.INVOICE_KEYS)
    return out.select("customer_type", *m.INVOICE_KEYS, "is_train")


@register("coef_table", compare_round=False)
def q_coef_table(spark, sf_dir):
    """Coefficients as a (term, estimate, group) table for the invoice model with
    region, both types appended (estimates at 6 significant digits)."""
    fitted, _ = _models().invoice_region_model(lines(spark, sf_dir))
    return fitted.coefficients().select(
        "term", F.col("customer_type").alias("group"), cmp_sig_col(F.col("estimate"), 6).alias("estimate")
    )


@register("glimpse")
def q_glimpse(spark, sf_dir):
    """Column names, types and the first four values of the line-item table."""
    return quality.glimpse(lines(spark, sf_dir), 4)


@register("ols_moments_merged", compare_round=False)
def q_ols_moments_merged(spark, sf_dir):
    """The table of ``ols_moments`` combined from the moments of two loads of orders."""
    from ledgerlens.operators import ols
    from ledgerlens.operators.moments import merge_moments

    spec = _models().M_INVOICE_REGION
    frame = ols.model_frame(invoices.full_invoice(lines(spark, sf_dir)), spec, extra=["order_date"])
    loads = [ols.cell_moments(frame.where(c), spec) for c in ("order_date < '1998-01-01'", "order_date >= '1998-01-01'")]
    cells = merge_moments(loads, [*spec.model_keys, *spec.factor_cols])
    return cells.select(*[cmp_sig_col(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in cells.schema.fields])


@register("ols_customer_effects", compare_round=False)
def q_ols_customer_effects(spark, sf_dir):
    """Slopes beside an effect for every customer, which is absorbed; the customers are counted, not listed."""
    fitted = _models().customer_effects_model(lines(spark, sf_dir))
    narrow = fitted.table.where("kind = 'numeric'").select(
        "customer_type", "term", *[cmp_sig_col(F.col(c), 6).alias(c) for c in ("estimate", "std_error", "sigma", "r2")], "aliased", "n", "rank"
    )
    effects = fitted.table.where("factor = 'customer_id' AND kind = 'factor'").groupBy("customer_type").agg(
        F.count(F.lit(1)).alias("n_effects"), cmp_sig_col(F.sum("estimate"), 6).alias("sum_effects")
    )
    return narrow.join(effects, "customer_type")


@register("ols_predict_stored", compare_round=False)
def q_ols_predict_stored(spark, sf_dir):
    """The predictions of ``ols_predict`` from models stored in the shared folder and loaded again."""
    from ledgerlens.operators import ols

    fitted, frame = _models().invoice_region_model(lines(spark, sf_dir))
    path = f"{checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    ols.save(fitted, path)
    out = ols.predict(ols.load(spark, path), frame)
    return out.select(
        "customer_type", "order_id", "customer_id", "order_date", "region",
        *[cmp4_col(F.col(c)).alias(c) for c in ("quantity", "discount", "unit_price", "total_price")],
        cmp_sig_col(F.col("prediction"), 6).alias("prediction"),
    )


@register("rfm_customer_merged")
def q_rfm_customer_merged(spark, sf_dir):
    """The table of ``rfm_customer`` from the state of the earlier days and a load of later ones."""
    base = invoices.rfm_base(lines(spark, sf_dir))
    state = rfm.customer_state(base.where("order_date < '1998-01-01'"))
    return rfm.rfm_from_state(rfm.merge_state(state, base.where("order_date >= '1998-01-01'")), ANALYSIS_DATE)


@register("quality_report_dirty", compare_round=False)
def q_quality_report_dirty(spark, sf_dir):
    """All measures of the dirtied line table from one scan, blanks as missing."""
    return quality.quality_run(quality.blank_to_null(dirty_lines(spark, sf_dir))).report


@register("quality_rejects_dirty", compare_round=False)
def q_quality_rejects_dirty(spark, sf_dir):
    """The rejected rows of that scan with the rules they break."""
    run = quality.quality_run(quality.blank_to_null(dirty_lines(spark, sf_dir)))
    return run.rejected.select("order_id", "customer_id", "product", "order_date", F.array_join("failed_rules", ",").alias("failed_rules"))


@register("line_summary_approx")
def q_line_summary_approx(spark, sf_dir):
    """The line profile from sketches by type and day; each quartile's rank among the lines lies within 1.5 % of what it should be."""
    ln = lines(spark, sf_dir).where(F.col("customer_type").isin(*oracle.CUSTOMER_TYPES))
    got = profile.approx_profile(profile.sketch_profile(ln))
    names = list(profile.QUARTILES)
    values = profile.long_values(ln, ["customer_type"], profile.NUMERIC_COLUMNS).where("value IS NOT NULL AND NOT isnan(value)")
    both = values.join(got.select("customer_type", "variable", *names), ["customer_type", "variable"])
    ranks = both.groupBy("customer_type", "variable").agg(
        *[F.avg((F.col("value") < F.col(q)).cast("int")).alias(f"{q}_low") for q in names], *[F.avg((F.col("value") <= F.col(q)).cast("int")).alias(f"{q}_high") for q in names]
    )
    ok = F.lit(True)
    for q, p in profile.QUARTILES.items():
        ok = ok & (F.col(f"{q}_low") <= p + 0.015) & (F.col(f"{q}_high") >= p - 0.015)
    return got.drop(*names).join(ranks.select("customer_type", "variable", ok.alias("quartiles_ok")), ["customer_type", "variable"])
