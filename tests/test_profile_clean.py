"""Profiling and cleaning on hand-made edge cases (ties, NULLs, junk text, NaN / inf)."""

import math

from pyspark.sql import functions as F

from tabloom.operators import clean as CL
from tabloom.operators import profile as PR


def test_profile_counts_and_top5_ties(spark):
    rows = [(1.0, "b"), (2.0, "a"), (None, "a"), (4.0, "b"), (4.0, None), (6.0, "c")]
    df = spark.createDataFrame(rows, "x double, s string")
    p = {r["column"]: r for r in PR.column_profile(df).collect()}
    assert p["x"]["total"] == 6 and p["x"]["null_count"] == 1 and p["x"]["unique_count"] == 4
    assert abs(p["x"]["median"] - 4.0) < 1e-12 and p["x"]["mode"] is None
    assert p["s"]["mode"] == "a" and p["s"]["top5"] == "a,b,c"  # ties broken by value


def test_type_repair_decisions(spark):
    vals = [(str(i * 1.5), f"2024-01-{(i % 28) + 1:02d}", "x" if i % 4 == 0 else str(i)) for i in range(40)]
    vals[0] = ("junk", vals[0][1], vals[0][2])  # 1 of 40 not numeric -> 97.5 % parseable
    df = spark.createDataFrame(vals, "a string, d string, m string")
    plan = CL.type_repair_plan(df)
    assert plan["a"] == ("numeric", None) and plan["d"] == ("datetime", "yyyy-MM-dd") and "m" not in plan
    out = CL.apply_type_repair(df, plan)
    assert dict(out.dtypes)["a"] == "double" and dict(out.dtypes)["d"] == "timestamp"
    assert out.where(F.col("a").isNull()).count() == 1


def test_numeric_text_guard(spark):
    df = spark.createDataFrame([("1d",), (" 3 ",), ("1e3",), ("",), ("True",)], "t string")
    got = [r[0] for r in df.select(CL.parse_number(F.col("t"))).collect()]
    assert got == [None, 3.0, 1000.0, None, None]


def test_winsorize_and_impute(spark):
    df = spark.createDataFrame([(float(i), "b" if i % 2 else "a") for i in range(101)] + [(None, None)],
                               "x double, s string")
    bounds = CL.winsor_bounds(df, ["x"])
    assert abs(bounds["x"][0] - 1.0) < 1e-12 and abs(bounds["x"][1] - 99.0) < 1e-12
    w = CL.winsorize(df, bounds)
    assert w.agg(F.min("x"), F.max("x")).first() == (1.0, 99.0)
    assert w.where(F.col("x").isNull()).count() == 1  # NULL is not clipped into a bound
    plan = CL.impute_plan(w, ["x"], ["s"])
    assert plan["x"] == 50.0 and plan["s"] == "a"  # 51 a vs 50 b


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("z",), ("y",), ("z",), ("y",)], "s string")
    assert CL.impute_plan(df, [], ["s"])["s"] == "y"


def test_sanitize_nan_inf(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.5,)], "x double")
    assert [r[0] for r in CL.sanitize(df, ["x"]).collect()] == [0.0, 0.0, 0.0, 2.5]


def test_constant_and_high_cardinality(spark):
    df = spark.createDataFrame([(1.0, f"k{i}", "a" if i else "b") for i in range(1000)],
                               "c double, u string, n string")
    const = {r["column"]: r["drop"] for r in CL.constant_columns(df).collect()}
    card = {r["column"]: r["drop"] for r in CL.high_cardinality_columns(df).collect()}
    assert const == {"c": True, "u": False, "n": True}  # 999/1000 = 0.999 >= 0.995
    assert card["u"] and not card["n"]


def test_skew_constant_is_zero(spark):
    from tabloom.operators.kernels import moments
    m = moments(spark.createDataFrame([(3.0,)] * 10, "x double"), ["x"]).first()
    assert m["skew"] == 0.0 and m["kurt"] == 0.0 and m["std"] == 0.0


def test_normaltest_is_calibrated(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.normal(size=6000), "e": rng.exponential(size=6000)})
    res = {r["column"]: r["normal_p"] for r in PR.normality(spark.createDataFrame(pdf), ["g", "e"]).collect()}
    assert res["g"] > 0.01 and res["e"] < 1e-10 and not math.isnan(res["g"])
