import numpy as np
import pandas as pd
import pytest

from ledgerlens.operators.quantiles import exact_quantiles, type7_quantile

PROBS = {"q25": 0.25, "median": 0.5, "q75": 0.75, "p99": 0.99, "p0": 0.0}


def brute(pdf, p):
    return {g: np.quantile(sub["x"].dropna().to_numpy(), p, method="linear") for g, sub in pdf.groupby("g")}


def check(spark, pdf, **kw):
    out = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", PROBS, **kw).toPandas().set_index("g")
    for name, p in PROBS.items():
        want = brute(pdf, p)
        for g, v in want.items():
            assert out.loc[g, name] == pytest.approx(v, rel=0, abs=1e-12), (name, g)


def test_quantile_four(spark):
    pdf = pd.DataFrame({"g": ["a"] * 4, "x": [1.0, 2.0, 3.0, 10.0]})
    out = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", {"q25": 0.25, "m": 0.5, "q75": 0.75}).first()
    assert (out["q25"], out["m"], out["q75"]) == (1.75, 2.5, 4.75)
    assert type7_quantile([1, 2, 3, 10], 0.75) == 4.75


@pytest.mark.parametrize("kw", [{}, {"digits": (16, 16, 16, 16)}, {"digits": (12, 1, 51)}])
def test_digits_match_bruteforce(spark, kw):
    rng = np.random.default_rng(7)
    n = 20000
    g = rng.choice(["hot", "cold", "mid"], n, p=[0.7, 0.1, 0.2])
    x = np.round(rng.lognormal(3, 1, n), 2)  # many ties
    x[rng.random(n) < 0.01] = np.nan
    pdf = pd.DataFrame({"g": g, "x": x})
    pdf.loc[pdf.index[:50], "x"] = None
    check(spark, pdf, **kw)


def test_heavy_ties_and_constant_group(spark):
    n = 5000
    pdf = pd.DataFrame({"g": ["c"] * n + ["t"] * n, "x": [0.0] * n + [float(i % 3) for i in range(n)]})
    check(spark, pdf)


def test_empty_group_gives_null(spark):
    pdf = pd.DataFrame({"g": ["a", "a", "b"], "x": [1.0, 2.0, None]})
    out = exact_quantiles(spark.createDataFrame(pdf, "g string, x double"), ["g"], "x", {"m": 0.5}).toPandas().set_index("g")
    assert out.loc["a", "m"] == 1.5 and pd.isna(out.loc["b", "m"]) and out.loc["b", "n"] == 0


def test_inverse_cdf_rule(spark):
    pdf = pd.DataFrame({"g": ["a"] * 10, "x": [float(v) for v in range(10, 0, -1)]})
    out = exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", {"t": 0.8, "z": 0.0, "o": 1.0}, rule="inverse_cdf").first()
    assert (out["t"], out["z"], out["o"]) == (8.0, 1.0, 10.0)


@pytest.mark.parametrize("rule", ["linear", "inverse_cdf"])
def test_many_groups(spark, rule):
    import ledgerlens.operators.quantiles as Q

    rng = np.random.default_rng(5)
    n = 30000
    pdf = pd.DataFrame({"g": rng.choice([f"k{i}" for i in range(6)], n, p=[0.5, 0.3, 0.1, 0.05, 0.04, 0.01]),
                        "x": np.round(rng.normal(10, 4, n), 1)})
    pdf.loc[pdf.index[:20], "x"] = None
    out = Q.exact_quantiles(spark.createDataFrame(pdf), ["g"], "x", PROBS, rule=rule).toPandas().set_index("g")
    method = "linear" if rule == "linear" else "inverted_cdf"
    for name, p in PROBS.items():
        for g, sub in pdf.groupby("g"):
            want = np.quantile(sub["x"].dropna().to_numpy(), p, method=method)
            assert out.loc[g, name] == pytest.approx(want, abs=1e-12), (rule, name, g)


SPECIAL = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308,
           float("inf"), float("-inf"), 0.1, 1 / 3, 2.0**52 + 1, 2.0**53 - 1, 1e22, 1e-300, *[2.0**e for e in range(-1074, 1024, 37)],
           *[np.nextafter(2.0**e, d) for e in range(-1020, 1024, 61) for d in (0.0, np.inf)]]


def test_order_key_sorts_like_the_doubles(spark):
    from ledgerlens.operators.quantiles import with_order_key

    rng = np.random.default_rng(1)
    more = rng.integers(-(2**63), 2**63 - 1, 20000, dtype=np.int64).view(np.float64)
    xs = np.unique(np.concatenate([SPECIAL, more[~np.isnan(more)], rng.normal(0, 1, 2000)]))
    rows = with_order_key(spark.createDataFrame(pd.DataFrame({"x": xs})), "x", "k").toPandas().sort_values("x")
    bits = rows["x"].to_numpy().view(np.int64)
    want = np.where(bits >= 0, bits, -(bits & np.int64(2**63 - 1)))
    assert (rows["k"].to_numpy() == want).all() and (np.diff(want) > 0).all()


def test_special_values_and_null_groups(spark):
    rows = [(None, float(x)) for x in SPECIAL] + [("a", float("inf")), ("a", float("inf")), ("b", None), ("c", float("nan"))]
    out = exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", {"low": 0.0, "m": 0.5, "high": 1.0}).collect()
    got = {r["g"]: (r["n"], r["low"], r["m"], r["high"]) for r in out}
    xs = sorted(SPECIAL)
    assert got[None][:2] == (len(xs), xs[0]) and got[None][3] == xs[-1] and got[None][2] == np.quantile(xs, 0.5)
    assert got["a"] == (2, float("inf"), float("inf"), float("inf")) and got["b"] == got["c"] == (0, None, None, None)
    assert exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", {"m": 0.5}).count() == 0


def test_nothing_comes_to_the_driver():
    import inspect

    import ledgerlens.operators.quantiles as Q

    source = inspect.getsource(Q)
    assert not any(x in source for x in (".collect()", ".toPandas()", ".first()", "local_frame", "broadcast("))
