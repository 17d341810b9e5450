"""Joins (null-safe, lookup, positional merge, key discovery) and fitted feature semantics."""

from pyspark.sql import functions as F

from tabloom.operators import features as FE
from tabloom.operators import joins as JN


def test_null_safe_join(spark):
    l = spark.createDataFrame([(1, "a"), (None, "b")], "k int, x string")
    r = spark.createDataFrame([(1, "one"), (None, "nil")], "rk int, y string")
    plain = {r["x"]: r["y"] for r in JN.join(l, r, "k", "rk").collect()}
    safe = {r["x"]: r["y"] for r in JN.join(l, r, "k", "rk", null_keys_match=True).collect()}
    assert plain == {"a": "one", "b": None} and safe == {"a": "one", "b": "nil"}


def test_lookup_join_keeps_rows_and_collapses_equal_clash(spark):
    t1 = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k long, c string")
    t2 = spark.createDataFrame([(1, "x", 10), (1, "x", 11), (2, "y", 20)], "k long, c string, v int")
    out = JN.lookup_join(t1, t2)
    assert out.count() == 3 and out.columns == ["k", "c", "v"]
    assert {r["k"]: r["v"] for r in out.collect()} == {1: 10, 2: 20, 3: None}


def test_positional_merge_drops_identical(spark):
    a = spark.createDataFrame([(1, 5.0), (2, None)], "rid long, x double")
    b = spark.createDataFrame([(1, 5.0, 5.0), (2, 7.0, 7.0), (3, 1.0, 1.0)], "rid long, x double, x2 double")
    m = JN.positional_merge(a, b, "rid", drop_similar=True)
    assert m.columns == ["rid", "x"] and {r["rid"]: r["x"] for r in m.collect()} == {1: 5.0, 2: 7.0, 3: 1.0}


def test_key_discovery(spark):
    o = spark.createDataFrame([(i, i % 10) for i in range(100)], "ok long, ck long")
    c = spark.createDataFrame([(i, "s") for i in range(10)], "cid long, seg string")
    pairs = {(r["left_column"], r["right_column"]) for r in JN.key_candidates_by_overlap(o, c).collect()}
    assert ("ck", "cid") in pairs


def test_target_encoding_oof_excludes_own_fold(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), ("a", 1, 2), ("b", 0, 0)], "c string, y int, f int")
    fit = FE.target_encoding("te", df, "c", "y", fold="f")
    got = {(r["c"], r["f"]): r["te"] for r in fit.transform(df).collect()}
    assert got[("a", 0)] == 0.5 and got[("a", 1)] == 1.0
    assert got[("b", 0)] == 0.5  # only in its own fold -> global mean


def test_numeric_map_median_fill(spark):
    aux = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k long, v double")
    df = spark.createDataFrame([(1,), (9,)], "k long")
    got = {r["k"]: r["fe"] for r in FE.numeric_map("fe", aux, "k", "v").transform(df).collect()}
    assert got == {1: 10.0, 9: 20.0}


def test_frequency_shares_sum_to_one(spark):
    src = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    t = FE.freq_encoding("f", src, "c").transform(src.distinct())
    assert abs(sum(r["f"] for r in t.where(F.col("c").isNotNull()).collect()) - 1.0) < 1e-12


def test_distinct_rows_are_counted_by_hash(spark, capsys):
    """A task keeps two longs per distinct row, not the row; NULLs, NaN and signed zeros count as rows compare."""
    from tabloom.operators.joins import duplicate_rows, join_diagnostics
    nan = float("nan")
    rows = [(1, None, "a", 0.0), (None, 1, "a", 0.0), (1, None, "a", -0.0), (1, 1, None, nan), (1, 1, None, nan), (1, 1, "", nan),
            (None, None, None, None), (None, None, None, None), (1, 2, "bc", 1.0), (1, 2, "b", 1.0), (2, 1, "b", 1.0)]
    df = spark.createDataFrame(rows, "x long, y long, `s t` string, d double")
    want = df.count() - df.distinct().count()
    assert want == 3
    assert tuple(duplicate_rows(df).first()) == (11, want)
    got = join_diagnostics(df, df, ["y", "s t"])
    r = got.first()
    assert (r["rows_before"], r["rows_after"], r["duplicate_rows"]) == (11, 11, want)
    assert [x["null_pct"] for x in r["new_column_null_pct"]] == [36.36, 36.36]
    duplicate_rows(df).explain()
    assert "xxhash64" in capsys.readouterr().out
    nested = spark.createDataFrame([([1, None],), ([None, 1],), ([1, None],)], "a array<int>")
    assert tuple(duplicate_rows(nested).first()) == (3, 1)
    wide = spark.createDataFrame([(None, *[1] * 70), (1, *[1] * 69, None), (None, *[1] * 70)], ", ".join(f"c{i} int" for i in range(71)))
    assert tuple(duplicate_rows(wide).first()) == (3, 1)
