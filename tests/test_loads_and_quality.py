"""One-scan quality runs, duplicates by two fingerprints, stored models, customer states, splits of many models, empty tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate, invoices, ols, quality, rfm
from ledgerlens.plans import models
from ledgerlens.sources import LINE_SCHEMA, lines_from_tpch, read_lines_csv

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return lines_from_tpch(spark, SF001)


def test_collisions_of_the_first_hash_are_verified(spark):
    rows = [(i % 7, "x" if i % 3 else None, float(i % 2)) for i in range(100)] + [(1, "x", -0.0), (1, "x", 0.0), (1, "x", float("nan")), (1, "x", float("nan"))]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    want = df.count() - df.distinct().count()
    second = F.xxhash64("a", "b", F.col("c") + 0.0)
    for weak in (F.lit(0).cast("long"), F.xxhash64("a"), F.xxhash64("a", "b")):
        got = quality.duplicate_count(df, fingerprints=(weak, second)).first()
        assert (got["n_rows"], got["duplicate_rows"]) == (len(rows), want)
    assert quality.duplicate_count(df).first()["duplicate_rows"] == want
    assert tuple(quality.duplicate_count(df.limit(0)).first()) == (0, 0)


def test_duplicates_scan_the_table_once(spark, lines, monkeypatch):
    plans, write = [], quality.stored

    def watch(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(quality, "stored", watch)
    out = quality.duplicate_count(lines)
    assert len(plans) == 1 and plans[0].count("l_extendedprice") > 0
    assert "lineitem" not in out._jdf.queryExecution().optimizedPlan().toString() and out.first()["duplicate_rows"] == 0


def test_quality_run_equals_the_single_operators(spark, lines):
    nan, null = F.lit(float("nan")), F.lit(None)
    dirty = lines.withColumns({
        "quantity": F.when(F.col("order_id") % 5 == 0, -F.col("quantity")).when(F.col("order_id") % 7 == 0, nan).otherwise(F.col("quantity")),
        "discount": F.when(F.col("order_id") % 3 == 0, null).when(F.col("order_id") % 11 == 0, F.lit(2.0)).otherwise(F.col("discount")),
    })
    run = quality.quality_run(dirty)
    got = {(r["section"], r["name"]): r["value"] for r in run.report.collect()}
    invalid = quality.invalid_count(dirty).first().asDict()
    assert got["rows", "rejected"] == str(invalid.pop("invalid_rows")) and got["rows", "all"] == str(dirty.count())
    assert {k: got["broken_rule", k] for k in invalid} == {k: str(v) for k, v in invalid.items()}
    assert {r["column_name"]: str(r["n_missing"]) for r in quality.null_profile(dirty).collect()} == {n: v for (s, n), v in got.items() if s == "missing"}
    dates = quality.date_range(dirty).first()
    assert (got["date", "first"], got["date", "last"]) == (str(dates["min_date"]), str(dates["max_date"]))
    assert run.accepted.columns == dirty.columns and run.accepted.count() + run.rejected.count() == dirty.count()
    assert run.rejected.where("size(failed_rules) = 0").count() == 0
    twice = run.rejected.where(F.array_contains("failed_rules", "bad_quantity") & F.array_contains("failed_rules", "bad_discount")).count()
    assert twice == dirty.where("quantity <= 0 AND discount > 1 AND NOT isnan(discount)").count() > 0


def test_quality_run_counts_malformed_lines(spark, tmp_path):
    header = "order_id,customer_id,customer_type,product,category,region,order_date,unit_price,quantity,discount,total_price"
    good = "1,c,B2B,p,k,r,2020-01-01,1,2,0.1,2"
    (tmp_path / "lines.csv").write_text("\n".join([header, good, good + ",more", "1,2", good.replace("0.1", "7")]) + "\n")
    df = read_lines_csv(spark, str(tmp_path / "lines.csv"), LINE_SCHEMA, corrupt_col="bad_line")
    run = quality.quality_run(df, malformed_col="bad_line")
    got = {(r["section"], r["name"]): r["value"] for r in run.report.collect()}
    assert got["broken_rule", "malformed_line"] == "2" and got["broken_rule", "bad_discount"] == "1" and got["rows", "rejected"] == "3"
    empty = quality.quality_run(df.limit(0), malformed_col="bad_line")
    assert empty.accepted.count() == empty.rejected.count() == 0
    assert {r["value"] for r in empty.report.collect()} == {"0", None}


def test_stored_models_predict_alike(spark, lines, tmp_path):
    for name, fitted, frame in (("region", *models.invoice_region_model(lines)), ("combined", models.combined_model(lines), ols.model_frame(invoices.combined_invoices(lines), models.M_COMBINED))):
        ols.save(fitted, f"{tmp_path}/{name}")
        back = ols.load(spark.newSession(), f"{tmp_path}/{name}")
        assert back.spec == fitted.spec
        order = frame.drop(ols.MODEL).columns
        a, b = (sorted(map(str, ols.predict(f, frame).select(*order, "prediction").collect())) for f in (fitted, ols.FittedModels(back.spec, spark.read.parquet(f"{tmp_path}/{name}/coefficients"))))
        assert a == b
        with pytest.raises(Exception):
            ols.save(fitted, f"{tmp_path}/{name}")  # a store is not overwritten
    with pytest.raises(Exception):
        ols.load(spark, f"{tmp_path}/nothing")


def test_states_of_loads_merge(spark, lines):
    base = invoices.rfm_base(lines)
    cuts = ["1996-06-01", "1998-03-01", "2003-01-01"]
    state = rfm.customer_state(base.where(F.col("order_date") < cuts[0]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        state = rfm.merge_state(state, base.where((F.col("order_date") >= a) & (F.col("order_date") < b)))
    columns = ["customer_type", "customer_id", "date_most_recent", "recency_days", "transaction_count", F.round("amount", 4)]
    got, want = (sorted(map(str, t.select(*columns).collect())) for t in (rfm.rfm_from_state(state), rfm.rfm_customer(base)))
    assert got == want


def test_split_of_many_models_is_exact(spark):
    """Thousands of models: ceil(0.8 n) training rows in each quartile of each."""
    df = spark.range(24_000).select((F.col("id") % 3000).alias("m"), F.col("id").alias("row"), F.xxhash64("id").cast("double").alias("y"))
    out = evaluate.stratified_split(df, ["m"], "y", ["row"])
    assert "__bin" not in out.columns
    per = {r["m"]: (r["n"], r["t"]) for r in out.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_train").cast("int")).alias("t")).collect()}
    assert len(per) == 3000 and set(per.values()) == {(8, 4 * math.ceil(0.8 * 2))}
    import inspect

    assert "broadcast(" not in inspect.getsource(evaluate)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LINE_SCHEMA)
    listed = quality.glimpse(none).collect()
    assert [r["column_name"] for r in listed] == LINE_SCHEMA.fieldNames() and {r["sample"] for r in listed} == {""}
    base = invoices.rfm_base(none)
    assert rfm.default_analysis_date(base) is None and rfm.rfm_scores(rfm.rfm_customer(base)).count() == 0
    undated = spark.createDataFrame([("B2B", "c", None, 1.0)], "customer_type string, customer_id string, order_date date, total_price double")
    assert rfm.rfm_customer(undated).first()["recency_days"] is None
    assert rfm.rfm_customer(undated, dt.date(2020, 1, 1)).count() == 1
