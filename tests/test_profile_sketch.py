"""Profiles from stored sketches: exact but for the quartiles, whose rank error is measured."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.profile import QUARTILES, approx_profile, numeric_profile, sketch_profile


def test_rank_error_of_merged_sketches(spark):
    rng = np.random.default_rng(4)
    n = 60_000
    pdf = pd.DataFrame({"t": rng.choice(["a", "b"], n, p=[0.9, 0.1]), "day": rng.integers(0, 90, n), "x": rng.lognormal(3, 1, n), "y": np.round(rng.normal(0, 5, n))})
    pdf.loc[:500, "x"] = np.nan
    df = spark.createDataFrame(pdf)
    # two loads, each a table by type and day
    loads = [sketch_profile(df.where(c), ["x", "y"], ["t", "day"]) for c in ("day < 40", "day >= 40")]
    got = approx_profile(loads[0].unionByName(loads[1]), ["x", "y"], ["t"]).toPandas().set_index(["t", "variable"])
    want = numeric_profile(df, ["x", "y"], ["t"]).toPandas().set_index(["t", "variable"])
    for c in ("count", "mean", "sd", "min", "max"):
        np.testing.assert_allclose(got[c], want.loc[got.index, c], rtol=1e-9)
    for (t, v), row in got.iterrows():
        xs = np.sort(pdf.loc[pdf["t"] == t, v].dropna().to_numpy())
        for name, p in QUARTILES.items():
            low, high = np.searchsorted(xs, row[name]) / len(xs), np.searchsorted(xs, row[name], "right") / len(xs)
            assert low - 0.015 <= p <= high + 0.015, (t, v, name)


def test_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, 2.0), ("b", 2, None)], "t string, day int, x double")
    got = {r["t"]: r for r in approx_profile(sketch_profile(df, ["x"], ["t", "day"]), ["x"], ["t"]).collect()}
    assert got["a"]["count"] == 1 and got["a"]["median"] is None and got["a"]["mean"] is None
    assert got["b"]["count"] == 2 and got["b"]["median"] == 2.0 and got["b"]["sd"] is None
    assert approx_profile(sketch_profile(df.where(F.lit(False)), ["x"], ["t", "day"]), ["x"], ["t"]).count() == 0
