"""NaN and nulls, typed factors, CSV columns by name, session rules."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import session
from ledgerlens.operators import evaluate, invoices, ols, quality, rfm
from ledgerlens.sources import LINE_SCHEMA, read_lines_csv

NAN = float("nan")


def line(product="p", price=1.0, quantity=1.0, discount=0.0, total=1.0, customer="c"):
    return ("o", customer, "B2B", product, "cat", "r", dt.date(2020, 1, 1), price, quantity, discount, total)


def test_nan_is_missing_in_sums_means_and_ranks(spark):
    df = spark.createDataFrame([line(total=2.0, discount=0.5), line(total=NAN, discount=NAN, quantity=NAN), line("q", total=NAN)], LINE_SCHEMA)
    row = invoices.numeric_invoice(df).first()
    assert (row.total_price, row.quantity, row.discount) == (2.0, 2.0, 0.25)
    assert [(r.product, r.total_revenue) for r in invoices.top_products(df).orderBy("rank").collect()] == [("p", 2.0), ("q", 0.0)]
    assert invoices.rfm_base(df).first().total_price == 2.0


def test_nan_is_not_implausible(spark):
    df = spark.createDataFrame([line(discount=NAN, price=NAN, quantity=NAN, total=NAN), line(discount=1.5)], LINE_SCHEMA)
    row = quality.invalid_count(df).first()
    assert (row.invalid_rows, row.bad_discount) == (1, 1)


def test_customer_without_a_date_has_no_score(spark):
    rows = [("B2B", str(i), dt.date(2020, 1, 1 + i), 10.0 * i) for i in range(10)] + [("B2B", "x", None, 5.0)]
    base = spark.createDataFrame(rows, "customer_type string, customer_id string, order_date date, total_price double")
    got = {r.customer_id: r for r in rfm.rfm_scores(rfm.rfm_customer(base, "2020-12-31")).collect()}
    assert got["x"].recency_score is None and got["x"].rfm_score is None
    assert all(got[str(i)].recency_score is not None for i in range(10))


@pytest.mark.parametrize("kind", ["double", "boolean", "int", "string"])
def test_predictions_for_factors_of_any_type(spark, kind):
    df = spark.range(20).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast(kind).alias("f"), (F.col("id") * 3 + F.col("id") % 2 * 7).cast("double").alias("y"))
    spec = ols.ModelSpec("y", ("x", "f"), frozenset({"f"}))
    frame = ols.model_frame(df.withColumn("__mine", F.lit(1)), spec, extra=["__mine"])
    out = ols.predict(ols.fit(frame, spec), frame).collect()
    assert len(out) == 20 and all(abs(r.prediction - r.y) < 1e-8 and r["__mine"] == 1 for r in out)


def test_metrics_from_cells_equal_metrics_from_rows(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        f, x, z = "abc"[i % 3] if i % 50 else "d", rng.normal(), rng.normal()
        rows.append(("k1" if i % 2 else "k2", f, float(x), float(z), float(2 * x - z + (f == "b") + rng.normal()), i % 5 != 0 and f != "d"))
    df = spark.createDataFrame(rows, "k string, f string, x double, z double, y double, is_train boolean")
    spec = ols.ModelSpec("y", ("x", "z", "f"), frozenset({"f"}), interactions=(("x", "f"),), keys=("k",))
    frame = ols.model_frame(df, spec, extra=["is_train"])
    fitted, got = evaluate.fit_and_test(frame, spec)
    want = evaluate.test_metrics(ols.predict(fitted, frame.where("not is_train")), ["k"], "y")
    a, b = ({r.k: r.asDict() for r in d.collect()} for d in (got, want))
    assert a.keys() == b.keys() and any(r["n_unscored"] for r in a.values())
    for k in a:
        for c in a[k]:
            assert a[k][c] == (pytest.approx(b[k][c], rel=1e-9) if isinstance(b[k][c], float) else b[k][c])


def test_near_perfect_fit_keeps_its_small_residuals(spark):
    x = np.linspace(0, 1, 400)
    noise = 1e-3 * np.sin(np.arange(400) * 1.7)
    df = spark.createDataFrame([(float(a), float(1e3 + 5e3 * a + e)) for a, e in zip(x, noise, strict=True)], "x double, y double")
    spec = ols.ModelSpec("y", ("x",))
    got = ols.fit(ols.model_frame(df, spec), spec).fit_stats().first().sigma
    design = np.column_stack([np.ones(400), x])
    res = noise - design @ np.linalg.lstsq(design, noise, rcond=None)[0]
    assert got == pytest.approx(math.sqrt(res @ res / 398), rel=0.2)


def test_wide_factor_is_solved_within_seconds(spark):
    df = spark.range(4500).select((F.col("id") % 1500).cast("string").alias("f"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    spec = ols.ModelSpec("y", ("x", "f"), frozenset({"f"}))
    assert ols.fit(ols.model_frame(df, spec), spec).fit_stats().first()["rank"] == 1501


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Region,Order ID,Quantity\nNorth,17,2.5\nSouth,18,many\nEast,19\n")
    schema = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("region", T.StringType()), T.StructField("quantity", T.DoubleType()), T.StructField("discount", T.DoubleType())])
    rows = read_lines_csv(spark, str(tmp_path / "a.csv"), schema, corrupt_col="raw_line").orderBy("order_id").collect()
    assert [(r.order_id, r.region, r.quantity, r.discount) for r in rows] == [(17, "North", 2.5, None), (18, "South", None, None), (19, "East", None, None)]
    assert [r.raw_line for r in rows] == [None, None, "East,19"]


def test_no_local_checkpoint_folder_on_a_cluster():
    class Conf:
        @staticmethod
        def get(*_):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: Conf)

    class Session:
        sparkContext = Context
        conf = Conf

    with pytest.raises(ValueError, match="shared folder"):
        session.checkpoint_dir(Session)


def test_master_is_left_to_the_submitter(monkeypatch):
    asked = []

    class Builder:
        def appName(self, _):
            return self

        def master(self, m):
            asked.append(m)
            return self

        def config(self, *_):
            return self

        def getOrCreate(self):
            raise StopIteration

    for port, want in (("4040", []), (None, ["local[*]"])):
        asked.clear()
        monkeypatch.setattr(session.SparkSession, "builder", Builder())
        monkeypatch.setenv("PYSPARK_GATEWAY_PORT", port) if port else monkeypatch.delenv("PYSPARK_GATEWAY_PORT", raising=False)
        with pytest.raises(StopIteration):
            session.get_spark()
        assert asked == want
