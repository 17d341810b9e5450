"""A22 against a brute-force implementation of the same estimator on untied data."""

import math

import numpy as np
import pandas as pd

from tabloom.operators.knn_mi import knn_mutual_info


def _psi(n: int) -> float:
    return sum(1.0 / i for i in range(1, n)) - 0.5772156649015329


def brute(x, y, k=3):
    x, y = np.asarray(x, float), np.asarray(y)
    keep = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[keep], y[keep]
    n = len(x)
    tot = 0.0
    ks, ncs, ms = [], [], []
    for i in range(n):
        same = x[(y == y[i])]
        nc = len(same)
        kk = min(k, nc - 1)
        d = np.sort(np.abs(same - x[i]))[1:]  # drop itself
        r = d[kk - 1]
        m = int(np.sum(np.abs(x - x[i]) < r))
        ks.append(_psi(kk)); ncs.append(_psi(nc)); ms.append(_psi(m))
    return max(0.0, _psi(n) + np.mean(ks) - np.mean(ncs) - np.mean(ms))


def test_knn_mi_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=400) + 0.8 * y
    z = rng.uniform(size=400)
    pdf = pd.DataFrame({"rid": np.arange(400), "x": x, "z": z, "y": y.astype("int32")})
    got = {r["feature"]: r["mutual_info"] for r in
           knn_mutual_info(spark.createDataFrame(pdf), ["x", "z"], "y", "rid", jitter=False).collect()}
    sx, sz = x / x.std(), z / z.std()
    assert math.isclose(got["x"], brute(sx, y), abs_tol=1e-9)
    assert math.isclose(got["z"], brute(sz, y), abs_tol=1e-9)
    assert got["x"] > got["z"]


def test_slices_with_halo_see_every_neighbour(spark, monkeypatch):
    import tabloom.operators.knn_mi as K
    rng = np.random.default_rng(11)
    y = rng.choice([0, 1, 2, 3], size=300, p=[0.6, 0.3, 0.09, 0.01])
    x = rng.normal(size=300) * (1 + y)
    df = spark.createDataFrame(pd.DataFrame({"rid": np.arange(300), "x": x, "y": y.astype("int32")}))
    want = brute(x / x.std(), y)
    for size in (3, 7, 50, 1000):
        monkeypatch.setattr(K, "SLICE", size)
        got = K.knn_mutual_info(df, ["x"], "y", "rid", jitter=False).first()
        assert math.isclose(got["mutual_info"], want, abs_tol=1e-9)


def test_equal_values_have_radius_zero(spark):
    """A point whose neighbours equal it counts the points equal to it (itself included): no psi(0)."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    x = np.where(rng.random(200) < 0.5, rng.integers(0, 4, 200) + 0.0, rng.normal(size=200))
    pdf = pd.DataFrame({"rid": np.arange(200), "x": x, "c": np.full(200, 1e6), "y": y.astype("int32")})
    got = {r["feature"]: r for r in knn_mutual_info(spark.createDataFrame(pdf), ["x", "c"], "y", "rid", jitter=False).collect()}
    s, parts = x / x.std(), []
    for i in range(200):
        same = s[y == y[i]]
        r = np.sort(np.abs(same - s[i]))[3]
        near = np.abs(s - s[i])
        parts.append(_psi(3) - _psi(len(same)) - _psi(int(np.sum(near < r) if r > 0 else np.sum(near == 0))))
    assert math.isclose(got["x"]["mutual_info"], max(0.0, _psi(200) + np.mean(parts)), abs_tol=1e-9)
    assert got["c"]["mutual_info"] == 0.0 and got["c"]["n"] == 200


def test_no_self_join_in_the_plan(spark):
    from pyspark.sql import functions as F

    from tabloom.operators.knn_mi import neighbour_radius
    pts = spark.range(50).select(F.lit("a").alias("column"), F.lit(1).alias("_y"), (F.col("id") + 1).alias("_p"),
                                 (F.col("id") * F.col("id")).cast("double").alias("x"), F.lit(3).alias("_k"))
    got = {r["_p"]: r["_r"] for r in neighbour_radius(pts, 3, 10).collect()}
    v = [float(i * i) for i in range(50)]
    assert got == {i + 1: sorted(abs(v[i] - z) for j, z in enumerate(v) if j != i)[2] for i in range(50)}
    assert "Join" not in neighbour_radius(pts, 3)._jdf.queryExecution().optimizedPlan().toString()


def test_targets_unique_per_row_and_no_values(spark):
    df = spark.createDataFrame([(i, float(i), None, i) for i in range(20)], "rid long, x double, none double, y long")
    got = {r["feature"]: (r["mutual_info"], r["n"]) for r in knn_mutual_info(df, ["x", "none"], "y", "rid").collect()}
    assert got == {"x": (0.0, 0), "none": (0.0, 0)}


def _odd(spark):
    """Text classes (one of a single point, one rare), ties, constants, nulls, NaN and an infinite value."""
    rng = np.random.default_rng(3)
    n = 700
    y = rng.choice(["a", "b", "c"], size=n, p=[0.6, 0.39, 0.01]).astype(object)
    y[5], y[6:9] = "alone", None
    x = rng.normal(size=n) + (y == "a")
    cols = {"x": x, "ties": np.round(x), "one": np.full(n, 7.0), "gaps": np.where(rng.random(n) < 0.2, np.nan, x * 1e9),
            "far": np.where(np.arange(n) == 11, np.inf, x)}
    rows = [(int(i), y[i], None if i % 13 == 0 else float(cols["x"][i]), *[float(cols[c][i]) for c in ("ties", "one", "gaps", "far")], None)
            for i in range(n)]
    return spark.createDataFrame(rows + rows[:40], "rid long, `y.z` string, x double, ties double, one double, gaps double, far double, "
                                                   "none double")


def test_blocks_and_windows_agree(spark, monkeypatch):
    import tabloom.operators.knn_mi as K
    df, names = _odd(spark), ["x", "ties", "one", "gaps", "far", "none"]
    for jitter in (True, False):
        got = {}
        for classes, size, points in ((0, 1000, 1000), (256, 1000, 100_000), (256, 2, 100_000), (256, 40, 90)):
            for name, value in (("CLASSES", classes), ("SLICE", size), ("POINTS", points)):
                monkeypatch.setattr(K, name, value)
            rows = K.knn_mutual_info(df, names, "y.z", "rid", jitter=jitter).collect()
            got[classes, size] = {r["feature"]: (round(r["mutual_info"], 9), r["n"]) for r in rows}
        want = got.pop((0, 1000))
        assert want["x"][0] > 0.05 and want["none"] == (0.0, 0)
        assert all(g == want for g in got.values())


def test_input_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(300).selectExpr("id as rid", "sin(id) as x", "cos(id * id) as z", "cast(id % 2 as int) as y")
    got = knn_mutual_info(df.mapInArrow(run, df.schema), ["x", "z"], "y", "rid").collect()
    assert {r["n"] for r in got} == {300} and seen.value == 300
