"""Feature quality statistics: properties of the reference's compute_stats tests."""

import math

from pyspark.sql import functions as F

from tabloom.operators import quality as Q


def _stats(df, feats, target="target"):
    return {r["feature"]: r.asDict() for r in Q.feature_stats(df, feats, target).collect()}


def test_stats_for_exactly_the_features(simple_train):
    st = _stats(simple_train, ["feat_a", "feat_b"])
    assert set(st) == {"feat_a", "feat_b"}
    for row in st.values():
        for k in ("pearson", "spearman", "mutual_info", "null_pct", "nunique", "max_corr_with_others"):
            assert row[k] is not None and not (isinstance(row[k], float) and math.isnan(row[k]))


def test_identical_columns_are_collinear(simple_train):
    df = simple_train.withColumn("feat_c", F.col("feat_a"))
    st = _stats(df, ["feat_a", "feat_b", "feat_c"])
    assert st["feat_a"]["high_collinearity"] and st["feat_c"]["high_collinearity"]
    assert abs(st["feat_a"]["max_corr_with_others"] - 1.0) < 1e-9


def test_no_features_gives_empty(simple_train):
    assert Q.feature_stats(simple_train.select("row_id", "target"), [], "target").count() == 0


def test_half_null_pct(spark):
    rows = [(i, 1.0 if i < 5 else None, i % 2) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id long, feat double, target int")
    st = _stats(df, ["feat"])
    assert st["feat"]["null_pct"] == 50.0


def test_pearson_matches_numpy(simple_train):
    import numpy as np
    pdf = simple_train.toPandas()
    expect = np.corrcoef(pdf["feat_a"], pdf["target"])[0, 1]
    got = _stats(simple_train, ["feat_a"])["feat_a"]["pearson"]
    assert abs(got - expect) < 1e-9


def test_auc_matches_brute_force(simple_train):
    pdf = simple_train.toPandas()
    pos, neg = pdf[pdf.target == 1].feat_b.values, pdf[pdf.target == 0].feat_b.values
    brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = Q.spearman_auc_table(simple_train, ["feat_b"], "target").first()["auc"]
    assert abs(got - brute) < 1e-12


def test_constant_feature_is_weak_not_an_error(spark):
    df = spark.createDataFrame([(i, 1.0, i % 2) for i in range(20)], "row_id long, c double, target int")
    v = Q.verdicts(Q.feature_stats(df, ["c"], "target")).first()
    assert v["pearson"] == 0.0 and v["verdict"] == "weak"


def test_leaky_feature_flagged(simple_train):
    df = simple_train.withColumn("leak", F.col("target") + F.col("row_id") % 7 / 100.0)
    v = {r["feature"]: r["verdict"] for r in Q.verdicts(Q.feature_stats(df, ["leak", "feat_a"], "target")).collect()}
    assert v["leak"] == "suspicious_leakage"
