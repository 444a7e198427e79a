"""Registered regression queries against brute force on the smallest fixture.

The model frame is pulled to pandas (sf0.001 is small), the R-style design
(treatment contrasts, sorted levels, interactions) is built densely, aliased
columns are found by an incremental rank test, and numpy's least squares
gives the reference coefficients.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import evaluate, ols
from ledgerlens.plans import models
from ledgerlens.sources import lines_from_tpch

SF = "/root/testdata/sf0.001"


def dense_design(pdf, spec):
    cols, names = [np.ones(len(pdf))], ["(Intercept)"]
    levels = {f: sorted(pdf[f].unique().tolist()) for f in spec.factor_cols}
    for t in spec.terms:
        if t in spec.factors:
            for lv in levels[t][1:]:
                cols.append((pdf[t] == lv).to_numpy(float))
                names.append(f"{t}{lv}")
        else:
            cols.append(pdf[t].to_numpy(float))
            names.append(t)
    for x, f in spec.interactions:
        for lv in levels[f][1:]:
            cols.append(pdf[x].to_numpy(float) * (pdf[f] == lv).to_numpy(float))
            names.append(f"{x}:{f}{lv}")
    return np.column_stack(cols), names


def brute(pdf, spec):
    X, names = dense_design(pdf, spec)
    Xs = X / np.maximum(np.abs(X).max(axis=0), 1e-300)
    kept = []
    for j in range(X.shape[1]):
        if np.linalg.matrix_rank(Xs[:, kept + [j]], tol=1e-9 * np.sqrt(len(X))) == len(kept) + 1:
            kept.append(j)
    beta, *_ = np.linalg.lstsq(X[:, kept], pdf[spec.label].to_numpy(float), rcond=None)
    out = {n: None for n in names}
    for j, b in zip(kept, beta):
        out[names[j]] = b
    return out


def compare(fitted, frame, spec):
    coefs = fitted.coefficients().toPandas()
    pdf = frame.toPandas()
    keys = list(spec.keys)
    groups = pdf.groupby(keys) if keys else [((), pdf)]
    n_models = 0
    for key, sub in groups:
        key = key if isinstance(key, tuple) else (key,)
        want = brute(sub, spec)
        got = coefs
        for k, v in zip(keys, key):
            got = got[got[k] == v]
        got = dict(zip(got["term"], got["estimate"]))
        assert set(got) == set(want)
        for t, w in want.items():
            g = got[t]
            if w is None:
                assert g is None or pd.isna(g), t
            else:
                assert g == pytest.approx(w, rel=1e-6, abs=1e-6 * max(1.0, abs(w))), (key, t)
        n_models += 1
    assert n_models >= 1


@pytest.fixture(scope="module")
def lines(spark):
    return lines_from_tpch(spark, SF)


def test_per_product_models(spark, lines):
    for ctype in ("B2B", "B2C"):
        spec, frame = models.product_frame(lines, ctype)
        compare(ols.fit(frame, spec), frame, spec)


def test_pooled_combined_and_region_models(spark, lines):
    rows = lines.where(F.col("customer_type") == "B2C").withColumn("month", F.date_format("order_date", "MM"))
    frame = ols.model_frame(rows, models.M_POOLED_B2C)
    compare(ols.fit(frame, models.M_POOLED_B2C), frame, models.M_POOLED_B2C)
    fitted = models.combined_model(lines)
    frame = ols.model_frame(models.invoices.combined_invoices(lines), models.M_COMBINED)
    compare(fitted, frame.drop(ols.MODEL), models.M_COMBINED)
    fitted, frame = models.invoice_region_model(lines)
    compare(fitted, frame, models.M_INVOICE_REGION)


def test_weekend_model_and_metrics(spark, lines):
    spec = models.M_WEEKEND
    frame = ols.model_frame(models.weekend_rows(lines), spec, extra=["is_train"])
    train = frame.where(F.col("is_train"))
    fitted = ols.fit(train, spec)
    compare(fitted, train, spec)
    m = models.weekend_metrics(lines).first()
    pdf_tr, pdf_te = train.toPandas(), frame.where(~F.col("is_train")).toPandas()
    want = brute(pdf_tr, spec)
    X, names = dense_design(pd.concat([pdf_tr, pdf_te]), spec)
    Xte = X[len(pdf_tr):]
    b = np.array([0.0 if want.get(n) is None else want[n] for n in names])
    seen = np.ones(len(pdf_te), bool)
    for f in spec.factor_cols:
        seen &= pdf_te[f].isin(pdf_tr[f].unique()).to_numpy()
    e = pdf_te["quantity"].to_numpy()[seen] - (Xte @ b)[seen]
    y = pdf_te["quantity"].to_numpy()[seen]
    assert m["rmse"] == pytest.approx(round(float(np.sqrt(np.mean(e**2))), 2), abs=0.0051)
    assert m["r2"] == pytest.approx(round(1 - (e @ e) / ((y - y.mean()) @ (y - y.mean())), 4), abs=0.00011)


def test_product_metrics_bruteforce(spark, lines):
    got = models.model_metrics(lines).toPandas()
    assert len(got) >= 1
    spec = models.M_PRODUCT_B2B
    rows = evaluate.train_test_split(models.product_lines(lines, "B2B"), models.LINE_KEYS)
    pdf = ols.model_frame(rows, spec, extra=["is_train"]).toPandas()
    for prod, sub in pdf.groupby("product"):
        tr, te = sub[sub["is_train"]], sub[~sub["is_train"]]
        r = got[(got["customer_type"] == "B2B") & (got["product"] == prod)].iloc[0]
        assert r["n_train"] == len(tr) and r["n_test"] == len(te)
        want = brute(tr, spec)
        X, names = dense_design(tr, spec)
        b = np.array([0.0 if want[n] is None else want[n] for n in names])
        res = tr["quantity"].to_numpy() - X @ b
        yc = tr["quantity"].to_numpy() - tr["quantity"].mean()
        assert r["train_r2"] == pytest.approx(round(1 - res @ res / (yc @ yc), 3), abs=0.0011)
