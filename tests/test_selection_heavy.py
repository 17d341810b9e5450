"""Exact quantiles by narrowing and frequent values by sketches, against pandas."""
import numpy as np
import pandas as pd
import pytest

from tabloom.operators import heavy as H
from tabloom.operators import selection as SE
from tabloom.operators.kernels import quantiles, value_counts


def frame(n=30000):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"unique": rng.permutation(n) * 1.5, "skew": np.exp(rng.normal(size=n) * 9), "tie": rng.integers(0, 3, n),
                        "const": 7.0, "some": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)), "void": np.nan,
                        "a.b": np.where(rng.random(n) < 0.5, -np.inf, rng.normal(size=n))})
    return pdf


@pytest.mark.parametrize("n", [30000, 5, 1])
def test_quantiles_equal_pandas(spark, n):
    pdf = frame(n)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    cols = [c for c in pdf if c != "a.b"]
    got = {(r["column"], r["q"]): r["value"] for r in quantiles(spark.createDataFrame(pdf).repartition(6), cols, probs).collect()}
    for c in cols:
        for q in probs:
            want = pdf[c].quantile(q)
            assert (c, q) not in got if np.isnan(want) else got[c, q] == pytest.approx(want, rel=1e-12), (c, q)


def test_infinite_values_and_a_margin_that_is_too_small(spark):
    pdf = frame(20000)
    df = spark.createDataFrame(pdf)
    for margin in (SE.MARGIN, 1e-4):  # the second one misses its ranks and has to widen
        got = {(r["column"], r["q"]): r["value"] for r in SE.select_quantiles(df, ["unique", "a.b"], [0.3, 0.8], k=8, margin=margin).collect()}
        assert got["unique", 0.3] == pytest.approx(pdf["unique"].quantile(0.3)) and got["a.b", 0.3] == -np.inf
        assert got["a.b", 0.8] == pytest.approx(np.quantile(pdf["a.b"], 0.8))


def test_only_values_near_the_ranks_are_counted(spark, monkeypatch):
    seen = []
    whole = SE.running_total
    monkeypatch.setattr(SE, "running_total", lambda df, *a, **k: (seen.append(df.count()), whole(df, *a, **k))[1])
    SE.select_quantiles(spark.createDataFrame(frame()), ["unique"], [0.5]).collect()
    assert 0 < seen[0] < 0.02 * 30000


def test_top_counts_are_exact(spark):
    rng = np.random.default_rng(3)
    n = 40000
    pdf = pd.DataFrame({"zipf": rng.zipf(1.3, n).astype("int64"), "few": rng.choice(["b", "a", ""], n), "unique": [f"k{i}" for i in range(n)],
                        "flat": rng.integers(0, 15000, n).astype("int64"), "x.y": rng.choice([1.5, np.nan, -2.0], n)})
    pdf["null"] = None
    df = spark.createDataFrame(pdf, "zipf long, few string, unique string, flat long, `x.y` double, null string").repartition(5)
    got = {}
    for r in H.top_counts(df, df.columns, 5, items=512).collect():
        got.setdefault(r["column"], []).append((r["rnk"], r["value"], r["n"]))
    for c in df.columns:
        s = pdf[c].dropna().map(lambda v: v if isinstance(v, str) else repr(v))
        want = sorted(s.value_counts().items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got.get(c, [])) == [(i, v, k) for i, (v, k) in enumerate(want, 1)], c
    sure = H.candidates(df, df.columns, 512)
    assert set(sure["few"]["values"]) == {"a", "b", ""} and sure["unique"]["bound"] > 1


def test_near_constant_and_near_unique(spark):
    n = 20000
    df = spark.range(n).selectExpr("'c' as const", "if(id % 250 = 0, 'x', 'c') as most", "if(id % 100 = 0, 'x', 'c') as less",
                                   "if(id < 10, id, null) as nulls", "concat('k', id) as code", "concat('k', id % 19500) as almost",
                                   "concat('k', id div 2) as half", "cast(null as string) as void")
    assert H.near_constant(df, df.columns, 0.995) == {"const": 1.0, "most": 0.996, "nulls": 0.9995, "void": 1.0}
    text = ["const", "code", "almost", "half", "void"]
    assert H.near_unique(df, text, 0.95) == {"code": 1.0, "almost": 0.975}
    assert H.near_constant(df.limit(0), ["const"], 0.995) == {} == H.near_unique(df.limit(0), ["code"], 0.95)
    with pytest.raises(ValueError):
        H.near_constant(df, ["const"], 0.001)
    assert value_counts(df, ["const"]).count() == 1
