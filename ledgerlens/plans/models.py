"""The regressions of the analysis as model specs over Spark frames (M1-M9).

Every model family is fitted in one job for all its keys (customer type,
product), never in a driver loop over products.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate, invoices, ols
from ledgerlens.session import local_frame
from ledgerlens.sources.lines import typed_lines

TYPE = "customer_type"
LINE_KEYS = ["order_id", "customer_id", "product", "order_date"]
INVOICE_KEYS = ["customer_id", "order_date"]
FULL_INVOICE_KEYS = ["order_id", "customer_id", "order_date", "region"]
MIN_ROWS = 50

M_PRODUCT_B2B = ols.ModelSpec("quantity", ("discount", "region", "month"), frozenset({"region", "month"}), keys=(TYPE, "product"))
M_PRODUCT_B2C = ols.ModelSpec("quantity", ("region", "month"), frozenset({"region", "month"}), keys=(TYPE, "product"))
M_POOLED_B2C = ols.ModelSpec(
    "quantity", ("discount", "product", "region", "month"), frozenset({"product", "region", "month"}), keys=(TYPE,), absorb="product"
)
M_INVOICE = ols.ModelSpec("total_price", ("quantity", "discount", "unit_price"), keys=(TYPE,))
M_INVOICE_RQ = ols.ModelSpec(
    "total_price", ("quantity", "discount", "unit_price", "region", "quarter"), frozenset({"region"}), keys=(TYPE,)
)
M_INVOICE_REGION = ols.ModelSpec(
    "total_price", ("quantity", "discount", "unit_price", "region"), frozenset({"region"}), keys=(TYPE,)
)
M_CUSTOMER = ols.ModelSpec(
    "total_price", ("customer_id", "quantity", "discount", "unit_price", "region"), frozenset({"customer_id", "region"}), keys=(TYPE,), absorb="customer_id"
)
M_COMBINED = ols.ModelSpec(
    "total_price",
    ("quantity", "discount", "unit_price", "region", TYPE),
    frozenset({"region", TYPE}),
    interactions=(("quantity", TYPE), ("discount", TYPE), ("unit_price", TYPE)),
)
M_WEEKEND = ols.ModelSpec(
    "quantity", ("unit_price", "region", "month", "is_weekend"), frozenset({"region", "month"}), keys=(TYPE, "product")
)


def eligible_products(lines: DataFrame, n: int = 10, min_rows: int = MIN_ROWS) -> DataFrame:
    """Top ``n`` products by revenue per type that have at least ``min_rows``
    lines (the guard counts rows after the product filter, before nulls are
    dropped). One aggregate gives revenue and line count together; the
    window keeps <= n rows for each of the two types. The result is collected
    once and returned as a local table, so the model passes that filter on it
    do not each re-run this scan."""
    agg = typed_lines(lines).groupBy(TYPE, "product").agg(
        invoices.total("total_price").alias("total_revenue"), F.count(F.lit(1)).alias("n_lines")
    )
    w = Window.partitionBy(TYPE).orderBy(F.col("total_revenue").desc(), F.col("product").asc())
    top = agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    out = top.where(F.col("n_lines") >= min_rows).select(TYPE, "product", "rank")
    return local_frame(lines.sparkSession, out.collect(), out.schema)


def product_lines(lines: DataFrame, ctype: str, n: int = 10, eligible: DataFrame | None = None) -> DataFrame:
    """Lines of one customer type restricted to its eligible top products.

    The product list has at most ``n`` rows per type, so it is broadcast to
    the line scan as a semi-join (no shuffle of the lines).
    """
    eligible = eligible if eligible is not None else eligible_products(lines, n)
    prods = eligible.where(F.col(TYPE) == ctype).select(TYPE, "product")
    return (
        typed_lines(lines)
        .where(F.col(TYPE) == ctype)
        .join(F.broadcast(prods), [TYPE, "product"], "left_semi")
        .withColumn("month", F.date_format("order_date", "MM"))
    )


def product_frame(lines: DataFrame, ctype: str, eligible: DataFrame | None = None) -> tuple[ols.ModelSpec, DataFrame]:
    spec = M_PRODUCT_B2B if ctype == "B2B" else M_PRODUCT_B2C
    frame = ols.model_frame(product_lines(lines, ctype, eligible=eligible), spec)
    return spec, frame


def fit_products(lines: DataFrame, ctype: str, eligible: DataFrame | None = None) -> ols.FittedModels:
    spec, frame = product_frame(lines, ctype, eligible)
    return ols.fit(frame, spec)


def product_metrics(lines: DataFrame, ctype: str, eligible: DataFrame | None = None) -> DataFrame:
    """Per product: fit on the 80 % side, evaluate on the 20 % side."""
    spec = M_PRODUCT_B2B if ctype == "B2B" else M_PRODUCT_B2C
    rows = evaluate.train_test_split(product_lines(lines, ctype, eligible=eligible), LINE_KEYS)
    fitted, m = evaluate.fit_and_test(ols.model_frame(rows, spec, extra=["is_train"]), spec)
    fs = fitted.fit_stats()
    return fs.join(m, list(spec.keys), "left").select(
        *spec.keys,
        F.round("r2", 3).alias("train_r2"),
        F.round("adj_r2", 3).alias("train_adj_r2"),
        F.round("test_r2", 3).alias("test_r2"),
        F.round("rmse_test", 3).alias("rmse_test"),
        F.col("n").alias("n_train"),
        F.coalesce("n_test", F.lit(0)).alias("n_test"),
        F.coalesce("n_unscored", F.lit(0)).alias("n_unscored"),
    )


def model_metrics(lines: DataFrame) -> DataFrame:
    eligible = eligible_products(lines)
    return product_metrics(lines, "B2B", eligible).unionByName(product_metrics(lines, "B2C", eligible))


def pooled_b2c(lines: DataFrame) -> ols.FittedModels:
    rows = typed_lines(lines).where(F.col(TYPE) == "B2C").withColumn("month", F.date_format("order_date", "MM"))
    return ols.fit(ols.model_frame(rows, M_POOLED_B2C), M_POOLED_B2C)


def invoice_frame(lines: DataFrame) -> DataFrame:
    return evaluate.train_test_split(invoices.numeric_invoice(lines), INVOICE_KEYS)


def full_invoice_frame(lines: DataFrame) -> DataFrame:
    inv = invoices.full_invoice(lines).withColumn("quarter", F.quarter("order_date").cast("double"))
    return evaluate.train_test_split(inv, FULL_INVOICE_KEYS)


def _split_fit(rows: DataFrame, spec: ols.ModelSpec, name: str):
    fitted, m = evaluate.fit_and_test(ols.model_frame(rows, spec, extra=["is_train"]), spec)
    return fitted, m.withColumn("model", F.lit(name))


def invoice_model(lines: DataFrame):
    return _split_fit(invoice_frame(lines), M_INVOICE, "invoice")


def invoice_rq_model(lines: DataFrame):
    return _split_fit(full_invoice_frame(lines), M_INVOICE_RQ, "invoice_region_quarter")


def invoice_model_metrics(lines: DataFrame) -> DataFrame:
    """Hold-out RMSE and R² (as squared correlation, and as 1 - SSres/SStot)."""
    _, a = invoice_model(lines)
    _, b = invoice_rq_model(lines)
    return a.unionByName(b).select("model", TYPE, "rmse_test", "r2_corr", "test_r2", "n_test", "n_unscored")


def invoice_region_model(lines: DataFrame) -> tuple[ols.FittedModels, DataFrame]:
    frame = ols.model_frame(invoices.full_invoice(lines), M_INVOICE_REGION, extra=FULL_INVOICE_KEYS)
    return ols.fit(frame, M_INVOICE_REGION), frame


def customer_effects_model(lines: DataFrame) -> ols.FittedModels:
    """Invoices with an effect of their own for every customer, however many there are."""
    return ols.fit(ols.model_frame(invoices.full_invoice(lines), M_CUSTOMER), M_CUSTOMER)


def combined_model(lines: DataFrame) -> ols.FittedModels:
    frame = ols.model_frame(invoices.combined_invoices(lines), M_COMBINED)
    return ols.fit(frame, M_COMBINED)


def weekend_rows(lines: DataFrame) -> DataFrame:
    """B2C lines of the best-selling B2C product, with the weekend flag.

    Rows with a null in any selected column (discount included, although
    the model does not use it) are dropped, as in the analysis.
    """
    top1 = eligible_products(lines, 1).where(F.col(TYPE) == "B2C").select(TYPE, "product")
    rows = (
        typed_lines(lines)
        .where(F.col(TYPE) == "B2C")
        .join(F.broadcast(top1), [TYPE, "product"], "left_semi")
        .withColumn("month", F.month("order_date"))
        .withColumn("is_weekend", F.when(F.dayofweek("order_date").isin(1, 7), 1.0).otherwise(0.0))
    )
    rows = rows.dropna(subset=["quantity", "discount", "unit_price", "region", "month", "is_weekend"])
    return evaluate.train_test_split(rows, LINE_KEYS)


def weekend_model(lines: DataFrame) -> tuple[ols.FittedModels, DataFrame]:
    """The fitted model and its hold-out metrics."""
    return evaluate.fit_and_test(ols.model_frame(weekend_rows(lines), M_WEEKEND, extra=["is_train"]), M_WEEKEND)


def weekend_metrics(lines: DataFrame) -> DataFrame:
    _, m = weekend_model(lines)
    return m.select(*M_WEEKEND.keys, F.round("rmse_test", 2).alias("rmse"), F.round("test_r2", 4).alias("r2"), "n_test")
