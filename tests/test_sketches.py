"""Key discovery by sketches: a planted key among many columns, unequal sizes, exact counts behind the estimates."""
import pytest
from pyspark.sql import functions as F

from tabloom.operators import sketches as SK
from tabloom.operators.joins import key_candidates_by_overlap


def wide(spark, n, seed, planted=None):
    df = spark.range(n)
    cols = [F.xxhash64("id", F.lit(seed * 1000 + c)).cast("string").alias(f"c{seed}_{c}") for c in range(39)]
    return df.select(*cols, (planted if planted is not None else F.col("id")).alias(f"key{seed}"))


def brute(left, right, ratio):
    lp, rp = left.toPandas(), right.toPandas()
    out = []
    for a in lp:
        x = set(lp[a].dropna().map(str))
        for b in rp:
            y = set(rp[b].dropna().map(str))
            if x and len(x & y) / len(x) >= ratio:
                out.append((a, b, len(x & y), len(x)))
    return sorted(out)


def test_planted_key_among_forty_columns(spark):
    left = wide(spark, 20000, 1, F.col("id") % 15000)
    right = wide(spark, 30000, 2, F.col("id") + 3000)
    got = key_candidates_by_overlap(left, right, 0.5)
    assert [tuple(r)[:4] for r in got.collect()] == [("key1", "key2", 12000, 15000)]
    pairs = SK.possible_pairs(left, left.columns, right, right.columns, 0.5)
    assert [p[:2] for p in pairs] == [("key1", "key2")]  # 1 of 1600 pairs is joined
    assert pairs[0][2] == pytest.approx(15000, rel=0.05)


def test_small_columns_nulls_and_ties(spark):
    left = spark.range(200).select((F.col("id") % 7).alias("a"), F.when(F.col("id") > 500, F.col("id")).alias("none"),
                                   F.when(F.col("id") % 2 == 0, F.lit("")).otherwise("x").alias("t"),
                                   (F.col("id") % 4).cast("double").alias("d"), F.lit("only").alias("c.1"))
    right = spark.range(90000).select(F.col("id").alias("big"), (F.col("id") % 5).alias("b"), F.lit("").alias("e"),
                                      F.lit(None).cast("string").alias("none"), (F.col("id") % 3).cast("double").alias("d"))
    for ratio in (0.5, 0.3, 1.0):
        got = sorted(tuple(r)[:4] for r in key_candidates_by_overlap(left, right, ratio).collect())
        assert got == brute(left, right, ratio)


def test_left_columns_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(SK, "SMALL_BYTES", 0)
    left = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    right = spark.range(4000).select(F.col("id").alias("x"), (F.col("id") % 10).alias("y"))
    got = sorted(tuple(r)[:4] for r in key_candidates_by_overlap(left, right, 0.5).collect())
    assert got == brute(left, right, 0.5)


def test_no_rows(spark):
    left = spark.createDataFrame([], "a long, b string")
    right = spark.range(5).select(F.col("id").alias("a"))
    assert key_candidates_by_overlap(left, right).collect() == []
    assert key_candidates_by_overlap(right, left).collect() == []
