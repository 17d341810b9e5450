"""Closed-form statistics: skew/kurtosis vs pandas, Shapiro-Wilk, normaltest, KDE peaks."""

import numpy as np
import pandas as pd

from tabloom.operators import distribution as D
from tabloom.operators.kernels import moments, quantiles


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    m = moments(df, ["x"]).first()
    s = pd.Series(x)
    assert abs(m["skew"] - s.skew()) < 1e-9
    assert abs(m["kurt"] - s.kurt()) < 1e-9
    assert abs(m["std"] - s.std()) < 1e-9


def test_exact_quantiles_match_numpy(spark):
    x = np.array([5.0, 1.0, 3.0, 3.0, 9.0, 2.0, 7.0])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = {r["q"]: r["value"] for r in quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9]).collect()}
    for q, v in got.items():
        assert abs(v - np.quantile(x, q)) < 1e-12


def brute_shapiro(x):
    """Royston's W and p with numpy, for comparison."""
    from math import exp, log, sqrt
    from statistics import NormalDist
    nd = NormalDist()
    poly = lambda c, v: sum(k * v ** i for i, k in enumerate(c))
    x = np.sort(np.asarray(x, float))
    n = len(x)
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / sqrt(n)
    a = m.copy()
    an, an1 = poly(D.C1, u) + m[-1] / sqrt(mm), poly(D.C2, u) + m[-2] / sqrt(mm)
    a[2:-2] /= sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2))
    a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n <= 11:
        z = (-log(poly(D.G, n) - log(1 - w)) - poly(D.C3, n)) / exp(poly(D.C4, n))
    else:
        z = (log(1 - w) - poly(D.C5, log(n))) / exp(poly(D.C6, log(n)))
    return w, 1 - nd.cdf(z)


def test_shapiro_brute_force(spark):
    rng = np.random.default_rng(3)
    cols = {"book": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], "normal": rng.normal(size=300),
            "exp": rng.exponential(size=300), "ties": rng.integers(0, 6, 100), "eight": rng.normal(size=8)}
    for name, x in cols.items():
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        r = D.shapiro_wilk(df, ["x"]).first()
        w, p = brute_shapiro(x)
        assert r["n"] == len(x) and abs(r["w"] - w) < 1e-6 and abs(r["p"] - p) < 1e-4, name
    assert abs(brute_shapiro(cols["book"])[0] - 0.7888) < 1e-3


def test_normality_has_a_row_for_every_size(spark):
    rng = np.random.default_rng(4)
    n = 6000
    pdf = pd.DataFrame({"big": rng.normal(size=n), "const": np.ones(n),
                        "small": [float(v) if i < 50 else None for i, v in enumerate(rng.normal(size=n))],
                        "tiny": [1.0, 2.0, 4.0] + [None] * (n - 3)})
    got = {r["column"]: r for r in D.normality(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    assert {c: (r["n"], r["method"]) for c, r in got.items()} == {
        "big": (n, "dagostino"), "const": (n, None), "small": (50, "shapiro"), "tiny": (3, None)}
    assert got["big"]["is_normal"] == (got["big"]["normal_p"] > 0.05) and not got["const"]["is_normal"]


def test_nan_is_missing(spark):
    from tabloom.operators.profile import column_profile
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    r = column_profile(df).first()
    assert (r["mean"], r["non_null"], r["null_count"], r["max"]) == (2.0, 2, 2, 3.0)
    m = moments(df, ["x"]).first()
    assert (m["n"], m["mean"], m["max"]) == (2, 2.0, 3.0)


def test_vif_edges(spark):
    rng = np.random.default_rng(6)
    a = rng.normal(size=400)
    b = a + rng.normal(size=400)
    pdf = pd.DataFrame({"a": a, "b": b, "free": rng.normal(size=400), "const": np.ones(400)})
    got = {r["feature"]: r["vif"] for r in D.vif(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    r2 = np.corrcoef(a, b)[0, 1] ** 2
    assert abs(got["a"] - 1 / (1 - r2)) < 0.1 and abs(got["free"] - 1) < 0.05 and got["const"] is None
    pdf["copy"] = pdf["a"]
    got = {r["feature"]: r["vif"] for r in D.vif(spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    assert got["a"] == got["copy"] == float("inf") and got["free"] < 2


def test_kde_peaks(spark):
    rng = np.random.default_rng(5)
    bimodal = np.concatenate([rng.normal(-4, 1, 400), rng.normal(4, 1, 400)])
    pdf = pd.DataFrame({"bi": bimodal, "uni": rng.normal(0, 1, 800), "const": np.ones(800)})
    res = {r["column"]: r["peaks"] for r in D.modality(spark.createDataFrame(pdf), ["bi", "uni", "const"]).collect()}
    assert res["bi"] == 2 and res["uni"] == 1 and res["const"] == 1


def test_mean_independent_of_partitioning(spark):
    from pyspark.sql import functions as F
    vals = [(0.01 * (i % 9),) for i in range(60000)]
    base = spark.createDataFrame(vals, "x double")
    means = {moments(base.repartition(n), ["x"]).first()["mean"] for n in (1, 3, 8, 17)}
    assert len(means) == 1
    huge = spark.createDataFrame([(1e300,), (1e300,)], "x double")  # does not fit a decimal: double fallback
    assert moments(huge, ["x"]).first()["mean"] == 1e300
    _ = F  # keep import local to the test
