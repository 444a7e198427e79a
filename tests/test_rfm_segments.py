import datetime as dt
from itertools import product

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import rules
from ledgerlens.operators import invoices, rfm, segments
from ledgerlens.sources import lines_from_tpch

SF01 = "/root/testdata/sf0.01"


def test_rule_coverage_lecture():
    cov = {label: n for label, _, n in rules.rule_coverage(rules.LECTURE_RULES)}
    assert cov == {
        "Champions": 8, "Loyal Customers": 28, "Potential Loyalist": 24, "New Customers": 0, "Promising": 0,
        "Need Attention": 3, "About To Sleep": 3, "At Risk": 20, "Can’t Lose Them": 0, "Hibernating": 3,
        "Lost": 0, "Uncategorized": 36,
    }


def test_rule_coverage_custom_and_script_variant_agree():
    cov = {label: n for label, _, n in rules.rule_coverage(rules.CUSTOM_RULES)}
    assert cov["Champions"] == 1 and cov["Loyal Customers"] == 7 and cov["Potential Loyalist"] == 10
    assert cov["New Customers"] == 14 and cov["Occasional Shoppers"] == 7 and cov["Need Attention"] == 9
    assert cov["Promising"] == 15 and cov["At Risk"] == 27 and cov["About To Sleep"] == 5
    assert cov["Can’t Lose Them"] == 15 and cov["Hibernating"] == 9 and cov["Dormant High Value"] == 6
    for dead in ("Active High Value", "Active Medium Value", "Lost", "Uncategorized"):
        assert cov[dead] == 0
    for t in product(range(1, 6), repeat=3):
        assert rules.label_of(rules.CUSTOM_RULES, t) == rules.label_of(rules.CUSTOM_RULES_SCRIPT, t)


def test_score_grid_spark_matches_rules(spark):
    grid = spark.createDataFrame(list(product(range(1, 6), repeat=3)), "recency_score int, frequency_score int, monetary_score int")
    for name, (rl, _) in rules.RULE_SETS.items():
        got = {(r[0], r[1], r[2]): r[3] for r in segments.assign_segments(grid, rl).collect()}
        for t, label in got.items():
            assert label == rules.label_of(rl, t), (name, t)


def customers_df(spark, tc, amounts=None, recency=None):
    n = len(tc)
    amounts = amounts or [float(i + 1) * 10 for i in range(n)]
    recency = recency or list(range(1, n + 1))
    rows = [("B2B", f"c{i}", dt.date(2001, 1, 1), recency[i], tc[i], amounts[i]) for i in range(n)]
    schema = "customer_type string, customer_id string, date_most_recent date, recency_days long, transaction_count long, amount double"
    return spark.createDataFrame(rows, schema)


def test_freq_ties_leave_scores_unused(spark):
    tc = [1] * 6 + [2] * 4
    scored = rfm.rfm_scores(customers_df(spark, tc)).collect()
    f = {r["customer_id"]: r["frequency_score"] for r in scored}
    # cuts at 0.2..0.8 of {1x6, 2x4}: 1, 1, 1.4 (interpolated), 2 -> scores 3 (for 1) and 5 (for 2);
    # scores 1, 2 and 4 stay unused
    assert {f[f"c{i}"] for i in range(6)} == {3}
    assert {f[f"c{i}"] for i in range(6, 10)} == {5}
    r = {x["customer_id"]: x["recency_score"] for x in scored}
    assert r["c0"] == 5 and r["c9"] == 1
    for x in scored:
        assert x["rfm_score"] == 100 * x["recency_score"] + 10 * x["frequency_score"] + x["monetary_score"]


def test_empty_segments_report(spark):
    rows = [("B2B", "a", 5, 5, 5, 100.0, 10, 3), ("B2B", "b", 5, 5, 5, 200.0, 20, 5), ("B2B", "c", 1, 1, 1, 10.0, 1, 900)]
    schema = "customer_type string, customer_id string, recency_score int, frequency_score int, monetary_score int, amount double, transaction_count long, recency_days long"
    seg = segments.assign_segments(spark.createDataFrame(rows, schema), "lecture")
    rep = segments.segment_report(seg, "lecture").collect()
    assert [r["segment"] for r in rep] == rules.LECTURE_LEVELS
    by = {r["segment"]: r for r in rep}
    assert by["Champions"]["no_customers"] == 2 and by["Champions"]["avg_spending"] == 150.0
    assert by["Champions"]["percentage"] == 66.7 and by["Hibernating"]["percentage"] == 33.3
    assert by["Lost"]["no_customers"] == 0 and by["Lost"]["avg_spending"] == 0.0
    assert all(r["total_customers"] == 3 for r in rep)


def test_half_up_rounding_is_exact(spark):
    # mean 1210767.615 exactly: must round up regardless of summation order
    rows = [("B2B", f"c{i}", 5, 5, 5, v, 1, 1) for i, v in enumerate([1210767.61, 1210767.62])]
    schema = "customer_type string, customer_id string, recency_score int, frequency_score int, monetary_score int, amount double, transaction_count long, recency_days long"
    seg = segments.assign_segments(spark.createDataFrame(rows, schema), "lecture")
    champ = [r for r in segments.segment_report(seg, "lecture").collect() if r["segment"] == "Champions"][0]
    assert champ["avg_spending"] == 1210767.62


LECTURE_SF01 = {
    "B2B": [169, 264, 176, 0, 0, 39, 47, 123, 0, 63, 0, 27],
    "B2C": [105, 186, 124, 0, 0, 26, 16, 75, 0, 46, 0, 14],
}
CUSTOM_SF01 = {
    "B2B": {"Champions": 48, "Loyal Customers": 121, "Potential Loyalist": 73, "New Customers": 70, "Occasional Shoppers": 56,
            "Need Attention": 108, "Promising": 50, "At Risk": 120, "About To Sleep": 46, "Can’t Lose Them": 82,
            "Hibernating": 131, "Dormant High Value": 3, "Lost": 0},
    "B2C": {"Champions": 24, "Loyal Customers": 81, "Potential Loyalist": 52, "New Customers": 47, "Occasional Shoppers": 44,
            "Need Attention": 62, "Promising": 28, "At Risk": 100, "About To Sleep": 28, "Can’t Lose Them": 57,
            "Hibernating": 68, "Dormant High Value": 1, "Lost": 0},
}


@pytest.fixture(scope="module")
def scored01(spark):
    base = invoices.rfm_base(lines_from_tpch(spark, SF01))
    return rfm.rfm_scores(rfm.rfm_customer(base, dt.date(2001, 12, 31)))


def test_fixture_lecture_segments(spark, scored01):
    rep = segments.segment_report(segments.assign_segments(scored01, "lecture"), "lecture").collect()
    for t in ("B2B", "B2C"):
        assert [r["no_customers"] for r in rep if r["customer_type"] == t] == LECTURE_SF01[t]


def test_fixture_custom_segments(spark, scored01):
    rep = segments.segment_report(segments.assign_segments(scored01, "custom"), "custom").collect()
    for t in ("B2B", "B2C"):
        got = {r["segment"]: r["no_customers"] for r in rep if r["customer_type"] == t}
        assert got == CUSTOM_SF01[t]


def test_scores_in_range_and_invariants(spark, scored01):
    agg = scored01.agg(
        *[F.min(c).alias(f"mn_{c}") for c in ("recency_score", "frequency_score", "monetary_score")],
        *[F.max(c).alias(f"mx_{c}") for c in ("recency_score", "frequency_score", "monetary_score")],
    ).first()
    assert all(agg[f"mn_{c}"] >= 1 and agg[f"mx_{c}"] <= 5 for c in ("recency_score", "frequency_score", "monetary_score"))
    rep = segments.segment_report(segments.assign_segments(scored01, "lecture"), "lecture")
    shares = rep.groupBy("customer_type").agg(F.sum("percentage").alias("s")).collect()
    assert all(abs(r["s"] - 100) <= 0.6 for r in shares)


def test_weekend_flag(spark):

    days = [dt.date(2024, 6, d) for d in range(2, 9)]  # Sun 2 June .. Sat 8 June
    df = spark.createDataFrame([(d,) for d in days], "d date")
    flags = [r[0] for r in df.select(F.dayofweek("d").isin(1, 7).cast("int")).collect()]
    assert flags == [1, 0, 0, 0, 0, 0, 1]


def test_rule_sql_matches_rule_data():
    import duckdb

    con = duckdb.connect()
    con.execute(
        "CREATE TABLE g AS SELECT r AS recency_score, f AS frequency_score, m AS monetary_score "
        "FROM range(1, 6) t1(r), range(1, 6) t2(f), range(1, 6) t3(m)"
    )
    for name, (rl, _) in rules.RULE_SETS.items():
        got = con.execute(f"SELECT recency_score, frequency_score, monetary_score, {rules.rule_sql(rl)} FROM g").fetchall()
        assert len(got) == 125
        for r, f, m, label in got:
            assert label == rules.label_of(rl, (r, f, m)), (name, r, f, m)


def test_report_sink_csv(spark, scored01):
    import glob
    import tempfile

    import pandas as pd

    from ledgerlens.operators.report import write_report

    rep = segments.segment_report(segments.assign_segments(scored01, "lecture"), "lecture")
    path = write_report(rep, "segment report", tempfile.mkdtemp(prefix="ledgerlens-rep-"), fmt="csv", digits=1)
    files = glob.glob(f"{path}/*.csv")
    assert len(files) == 1
    back = pd.read_csv(files[0])
    assert len(back) == 24 and list(back.columns) == rep.columns
    assert (back["avg_spending"].round(1) == back["avg_spending"]).all()
