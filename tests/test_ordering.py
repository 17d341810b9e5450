"""The sliced running total must equal the plain single-window result."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.operators.ordering import first_per_key, running_total


def test_sliced_running_total_equals_window(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 2).alias("g"),
                                  ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    # force slicing: tiny slice size and an explicit group size hint
    sliced = running_total(df, ["g"], ["v", "id"], out="cum", rows_per_slice=300,
                           group_rows={(0,): 2500, (1,): 2500})
    plain = df.withColumn("cum", F.count(F.lit(1)).over(
        Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)))
    a = {r["id"]: r["cum"] for r in sliced.collect()}
    b = {r["id"]: r["cum"] for r in plain.collect()}
    assert a == b


def test_first_per_key_keep_first_and_last(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (None, 5, "x"), (None, 4, "y")],
                               "k int, o int, v string")
    first = {r["k"]: r["v"] for r in first_per_key(df, ["k"], ["o"]).collect()}
    last = {r["k"]: r["v"] for r in first_per_key(df, ["k"], ["o"], keep="last").collect()}
    assert first == {1: "a", None: "y"} and last == {1: "c", None: "x"}


def test_dense_codes_large_path_matches_window(spark, monkeypatch):
    from tabloom.operators import ordering
    vals = spark.createDataFrame([(f"v{i % 97:03d}",) for i in range(2000)], "s string")
    small = {r["s"]: r["_code"] for r in ordering.dense_codes(vals, "s").collect()}
    monkeypatch.setattr(ordering, "SMALL_INPUT_BYTES", 0)
    large = {r["s"]: r["_code"] for r in ordering.dense_codes(vals, "s").collect()}
    assert small == large and sorted(small.values()) == list(range(97))
