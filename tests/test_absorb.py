"""A wide factor eliminated by blocks, and moment tables that merge."""

import dataclasses
import re
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import absorb, evaluate, ols
from ledgerlens.operators.moments import merge_moments


def make(n=600, seed=1, levels=40):
    rng = np.random.default_rng(seed)
    product = rng.choice([f"p{i:05d}" for i in range(levels)], n)
    region, month = rng.choice(["b", "a", "c"], n), rng.choice(["01", "02", "03"], n)
    x, z = rng.normal(10, 3, n), rng.uniform(0, 1, n)
    y = 2 + 3 * x - 4 * z + np.array([hash(p) % 7 for p in product]) + (region == "b") * 1.5 + rng.normal(0, 1, n) + (region == "c") * 0.3 * x
    return pd.DataFrame({"k": np.where(np.arange(n) % 3 == 0, "one", "two"), "y": y, "x": x, "z": z, "product": product, "region": region, "month": month})


SPEC = ols.ModelSpec("y", ("x", "product", "region", "z", "month"), frozenset({"product", "region", "month"}), (("x", "region"),), ("k",))


def fitted(spark, pdf, spec):
    return ols.fit(ols.model_frame(spark.createDataFrame(pdf), spec), spec)


@pytest.mark.parametrize("keys", [("k",), ()])
def test_equals_the_dense_solution(spark, keys):
    pdf = make()
    pdf.loc[pdf["k"] == "two", "z"] = 0.25  # aliased in one model
    pdf["w"] = 2 * pdf["x"] + 1  # collinear with an earlier term
    spec = dataclasses.replace(SPEC, keys=keys, terms=("x", "product", "region", "z", "w", "month"))
    dense = fitted(spark, pdf, spec)
    wide = fitted(spark, pdf, dataclasses.replace(spec, absorb="product"))
    for of in ("coefficients", "fit_stats"):
        by = [*keys, "term_index"] if of == "coefficients" else [*keys]
        want, got = (getattr(f, of)().toPandas() for f in (dense, wide))
        want, got = (d.sort_values(by).reset_index(drop=True) if by else d for d in (want, got))
        pd.testing.assert_frame_equal(got, want, rtol=1e-7, atol=1e-9, check_dtype=False)
    rows = ["kind", "variable", "factor", "level"]
    assert sorted(map(str, dense.table.select(*rows).collect())) == sorted(map(str, wide.table.select(*rows).collect()))


def test_predictions_and_hold_out(spark):
    pdf = make(seed=3)
    df = spark.createDataFrame(pdf).withColumn("is_train", F.col("z") < 0.8)
    out = []
    for spec in (SPEC, dataclasses.replace(SPEC, absorb="product")):
        model, metrics = evaluate.fit_and_test(ols.model_frame(df, spec, extra=["is_train"]), spec)
        pred = ols.predict(model, ols.model_frame(df, spec)).toPandas().sort_values(["k", "y"])["prediction"].to_numpy()
        out.append((pred, metrics.toPandas().sort_values("k").reset_index(drop=True)))
    np.testing.assert_allclose(out[0][0], out[1][0], rtol=1e-9)
    pd.testing.assert_frame_equal(out[0][1], out[1][1], rtol=1e-8)


def test_twenty_thousand_levels(spark):
    """25 regions and 12 months beside them; checked by sweeping the levels' means out of every column."""
    rng = np.random.default_rng(5)
    n, levels = 120_000, 20_000
    level = np.concatenate([np.arange(levels), rng.integers(0, levels, n - levels)])
    region, month, x = rng.integers(0, 25, n), rng.integers(1, 13, n), rng.normal(5, 2, n)
    y = 1 + 0.7 * x + 0.01 * level + 0.2 * region - 0.1 * month + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame({"y": y, "x": x, "product": level, "region": region, "month": month})
    spec = ols.ModelSpec("y", ("x", "product", "region", "month"), frozenset({"product", "region", "month"}), absorb="product")
    begun = time.perf_counter()
    model = fitted(spark, pdf, spec)
    took = time.perf_counter() - begun
    got = model.coefficients().toPandas().set_index("term")
    assert len(got) == 1 + 1 + levels - 1 + 24 + 11 and got["term_index"].is_unique
    cols = np.column_stack([x, *[(region == r) * 1.0 for r in range(1, 25)], *[(month == m) * 1.0 for m in range(2, 13)]])
    counts = np.bincount(level, minlength=levels)

    def means(v):
        return np.bincount(level, v, levels) / counts

    swept = np.column_stack([c - means(c)[level] for c in cols.T])
    beta, *_ = np.linalg.lstsq(swept, y - means(y)[level], rcond=None)
    names = ["x", *[f"region{r}" for r in range(1, 25)], *[f"month{m}" for m in range(2, 13)]]
    np.testing.assert_allclose(got.loc[names, "estimate"], beta, rtol=1e-7, atol=1e-9)
    effect = means(y) - np.column_stack([means(c) for c in cols.T]) @ beta
    assert got.loc["(Intercept)", "estimate"] == pytest.approx(effect[0], rel=1e-8)
    np.testing.assert_allclose(got.loc[[f"product{i}" for i in range(1, levels)], "estimate"], effect[1:] - effect[0], rtol=1e-6, atol=1e-8)
    rss = float((((y - means(y)[level]) - swept @ beta) ** 2).sum())
    stats = model.fit_stats().first()
    assert stats["rank"] == levels + 36 and stats["rss"] == pytest.approx(rss, rel=1e-9)
    inverse = np.linalg.inv(swept.T @ swept)
    sigma2 = rss / (n - levels - 36)
    assert got.loc["x", "std_error"] == pytest.approx(np.sqrt(sigma2 * inverse[0, 0]), rel=1e-7)
    m = np.column_stack([means(c) for c in cols.T])
    for i in (1, 777, levels - 1):
        var = 1 / counts[i] + 1 / counts[0] + (m[i] - m[0]) @ inverse @ (m[i] - m[0])
        assert got.loc[f"product{i}", "std_error"] == pytest.approx(np.sqrt(sigma2 * var), rel=1e-7)
    assert took < 120


def test_blocks_and_given_out_matrices(spark, monkeypatch):
    """Levels dealt over many blocks, and matrices given out early, change nothing."""
    pdf = make(seed=7)
    spec = dataclasses.replace(SPEC, absorb="product")
    want = fitted(spark, pdf, spec).coefficients().toPandas().sort_values(["k", "term_index"])
    monkeypatch.setattr(absorb, "LEVEL_BLOCK", 3)
    monkeypatch.setattr(absorb, "HELD_NUMBERS", 1)
    got = fitted(spark, pdf, spec).coefficients().toPandas().sort_values(["k", "term_index"])
    pd.testing.assert_frame_equal(got.reset_index(drop=True), want.reset_index(drop=True), rtol=1e-9)


def test_what_cannot_be_absorbed():
    for bad in ({"absorb": "x"}, {"absorb": "region"}, {"absorb": "nothing"}):
        with pytest.raises(ValueError):
            dataclasses.replace(SPEC, **bad)


def test_moments_of_loads_merge(spark):
    pdf = make(seed=9)
    pdf["y"] += 1e6  # large means do not cancel
    spec = ols.ModelSpec("y", ("x", "z", "region"), frozenset({"region"}), keys=("k",))
    frame = ols.model_frame(spark.createDataFrame(pdf), spec, extra=["month"])
    by = ["k", "region"]
    loads = [ols.cell_moments(frame.where(F.col("month") == m), spec) for m in ("01", "02", "03")]
    whole, merged, coarser = (
        d.toPandas().sort_values(by).reset_index(drop=True) for d in (ols.cell_moments(frame, spec), merge_moments(loads, by), merge_moments(ols.cell_moments(frame, spec, ["month"]), by))
    )
    for got in (merged, coarser):
        pd.testing.assert_frame_equal(got[whole.columns], whole, rtol=1e-9)
    a, b = (ols.fit_cells(c, spec).table.toPandas().sort_values(["k", "term_index", "term"]).reset_index(drop=True) for c in (ols.cell_moments(frame, spec), merge_moments(loads, by)))
    pd.testing.assert_frame_equal(a, b, rtol=1e-6)
    one = merge_moments(loads, []).first()
    assert one["n"] == len(pdf) and one["mean_x"] == pytest.approx(pdf["x"].mean()) and one["cov_x__x"] == pytest.approx(pdf["x"].var(ddof=0))
    assert merge_moments(loads[0].where("false"), by).count() == 0


def test_levels_are_placed_in_ranges(spark, monkeypatch):
    """No task puts all levels of a model in order."""
    monkeypatch.setattr(absorb, "PLACED_LEVELS", 8)
    spec, pdf = dataclasses.replace(SPEC, absorb="product"), make()
    levels = absorb.level_sums(ols.cell_moments(ols.model_frame(spark.createDataFrame(pdf), spec), spec), spec)
    plan = levels._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and not re.search(r"windowspecdefinition\(k#\d+, level#", plan)
    got = {(r.k, r.level): (r.pos, r.n_levels) for r in levels.collect()}
    for k, some in pdf.groupby("k"):
        names = sorted(set(some["product"]))
        assert [got[k, p] for p in names] == [(i + 1, len(names)) for i in range(len(names))]
    assert len(got) == pdf.groupby("k")["product"].nunique().sum()
