"""Queries: feature quality A15, A20-A28, M02-M04, M07, T01, T02, P24, W05, W06."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import features as FE
from ..operators import quality as Q
from ..operators.kernels import value_counts
from ..session import materialize
from ..sources.tables import load
from . import problems
from .flagship import report
from .q_features import OC_SQL, orders_with_customer
from .q_flagship import stats_sql
from .registry import query

FEATURES = ["o_totalprice", "c_acctbal", "fe_te_status", "fe_freq_segment", "fe_price_z", "fe_leak", "fe_constant"]

MAT_SQL = OC_SQL + """,
te AS (SELECT o_orderstatus AS c, avg(target) AS m FROM oc_train GROUP BY o_orderstatus),
g AS (SELECT avg(target) AS gm FROM oc_train),
fs AS (SELECT c_mktsegment AS c, count(*) / (SELECT count(c_mktsegment) FROM oc_train) AS f FROM oc_train
       WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment),
zs AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS m, coalesce(stddev_samp(o_totalprice), 0.0) AS s
       FROM oc_train GROUP BY o_orderstatus),
mat AS (SELECT a.o_orderkey, a.target, a.fold, a.o_totalprice, a.c_acctbal, coalesce(te.m, g.gm) AS fe_te_status,
               coalesce(fs.f, 0.0) AS fe_freq_segment, coalesce((a.o_totalprice - zs.m) / (zs.s + 1e-9), 0.0) AS fe_price_z,
               a.target + (a.o_orderkey * 7919 % 100) / 1000.0::DOUBLE AS fe_leak, 1.0::DOUBLE AS fe_constant
        FROM oc_train a LEFT JOIN te ON a.o_orderstatus = te.c CROSS JOIN g LEFT JOIN fs ON a.c_mktsegment = fs.c
        LEFT JOIN zs ON a.o_orderstatus IS NOT DISTINCT FROM zs.g)"""


def orders_matrix(spark, sf):
    """Training candidate matrix of the orders problem: (o_orderkey, target, fold, FEATURES)."""
    p, every, tr = orders_with_customer(spark, sf)
    fits = [FE.target_encoding("fe_te_status", tr, "o_orderstatus", "target"),
            FE.freq_encoding("fe_freq_segment", tr, "c_mktsegment"),
            FE.group_zscore("fe_price_z", tr, "o_totalprice", "o_orderstatus")]
    m = FE.apply_all(tr.select("o_orderkey", "target", "fold", "o_totalprice", "c_acctbal", "o_orderstatus",
                               "c_mktsegment"), fits)
    leak = F.col("target") + (F.col("o_orderkey") * 7919 % 100) / F.lit(1000.0)
    return m.select("o_orderkey", "target", "fold", "o_totalprice", "c_acctbal", "fe_te_status", "fe_freq_segment",
                    "fe_price_z", leak.alias("fe_leak"), F.lit(1.0).alias("fe_constant"))


def _stats(spark, sf):
    return Q.feature_stats(orders_matrix(spark, sf), FEATURES, "target")


REPORT_SQL = MAT_SQL + "," + stats_sql("mat", "o_orderkey", "target", FEATURES, None)


@query("a20_feature_stats", REPORT_SQL)
def a20(spark, sf):
    return report(_stats(spark, sf), None)


@query("a28_rubric_overall", REPORT_SQL.rsplit("SELECT rank, feature", 1)[0] + """
SELECT round(least(1.0, greatest(0.0, coalesce(avg(score) FILTER (WHERE verdict <> 'suspicious_leakage'), 0.0)
         - 0.10 * floor(sum(CAST(high_collinearity AS INTEGER)) / 2.0)
         - 0.05 * count(*) FILTER (WHERE null_pct > 30)
         - 0.30 * max(CAST(verdict = 'suspicious_leakage' AS INTEGER)))), 6) + 0.0 AS overall_score
FROM ranked""")
def a28(spark, sf):
    return Q.overall_score(Q.verdicts(_stats(spark, sf))).select(r6(F.col("overall_score")).alias("overall_score"))


@query("p24_weak_feature_filter", REPORT_SQL.rsplit("SELECT rank, feature", 1)[0] + """
SELECT feature, verdict FROM ranked WHERE verdict IN ('weak', 'suspicious_leakage')""")
def p24(spark, sf):
    v = Q.verdicts(_stats(spark, sf))
    return v.where(F.col("verdict").isin("weak", "suspicious_leakage")).select("feature", "verdict")


@query("t02_top5_selection", MAT_SQL + "," + stats_sql("mat", "o_orderkey", "target", FEATURES, 5))
def t02(spark, sf):
    return report(_stats(spark, sf), 5)


# A15 / A21 / A23 / A24 / M02 / M03 / M07 ------------------------------------------------------
LONG = f"long AS (UNPIVOT (SELECT o_orderkey, target, {', '.join(FEATURES)} FROM mat) ON {', '.join(FEATURES)} " \
       "INTO NAME feature VALUE value)"


@query("a15_target_pearson", MAT_SQL + f""", {LONG}
SELECT feature, round(covar_samp(value, target) / nullif(stddev_samp(value) * stddev_samp(target), 0), 6) + 0.0 AS pearson
FROM long GROUP BY feature""")
def a15(spark, sf):
    return Q.pearson_table(orders_matrix(spark, sf), FEATURES, "target").select(
        "feature", r6(F.col("pearson")).alias("pearson"))


RANKS_SQL = MAT_SQL + f""", {LONG},
rk AS (SELECT feature, value, target AS y, rank() OVER (PARTITION BY feature ORDER BY value)
              + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM long),
sp AS (SELECT feature, covar_samp(r, y) / nullif(stddev_samp(r) * stddev_samp(y), 0) AS spearman,
              (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)
                AS auc FROM rk GROUP BY feature)"""


@query("a21_spearman", RANKS_SQL + """
SELECT feature, round(coalesce(spearman, 0.0), 6) + 0.0 AS spearman FROM sp""")
def a21(spark, sf):
    t = Q.spearman_auc_table(orders_matrix(spark, sf), FEATURES, "target")
    return t.select("feature", r6(F.coalesce(F.col("spearman"), F.lit(0.0))).alias("spearman"))


@query("m02_m03_auc_gini", RANKS_SQL + """
SELECT feature, round(auc, 6) + 0.0 AS auc, round(2 * auc - 1, 6) + 0.0 AS gini FROM sp""")
def m02(spark, sf):
    t = Q.spearman_auc_table(orders_matrix(spark, sf), FEATURES, "target")
    return t.select("feature", r6(F.col("auc")).alias("auc"), r6(2 * F.col("auc") - 1).alias("gini"))


@query("m07_single_feature_auc_ranking", RANKS_SQL + """
SELECT feature, round(abs(coalesce(auc, 0.5) - 0.5), 6) + 0.0 AS auc_strength,
       row_number() OVER (ORDER BY abs(coalesce(auc, 0.5) - 0.5) DESC, feature) AS rank FROM sp""")
def m07(spark, sf):
    t = Q.spearman_auc_table(orders_matrix(spark, sf), FEATURES, "target")
    s = F.abs(F.coalesce(F.col("auc"), F.lit(0.5)) - 0.5)
    w = Window.orderBy(F.desc("_s"), "feature")  # one row per feature
    return t.withColumn("_s", s).select("feature", r6(F.col("_s")).alias("auc_strength"),
                                        F.row_number().over(w).cast("long").alias("rank"))


@query("a23_mutual_info_binned", REPORT_SQL.rsplit("SELECT rank, feature", 1)[0] + """
SELECT feature, round(mutual_info, 6) + 0.0 AS mutual_info FROM mi""")
def a23(spark, sf):
    m = orders_matrix(spark, sf)
    enc = Q.encoded(m, FEATURES, ["target"])
    return Q.mi_binned(enc, FEATURES, "target").select("feature", r6(F.col("mutual_info")).alias("mutual_info"))


@query("a24_collinearity_pairs", MAT_SQL + f""", {LONG}
SELECT a.feature AS feature_i, b.feature AS feature_j,
       round(abs(covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0)), 6) + 0.0 AS abs_corr
FROM long a JOIN long b ON a.o_orderkey = b.o_orderkey
WHERE list_position({FEATURES!r}, a.feature) < list_position({FEATURES!r}, b.feature)
GROUP BY a.feature, b.feature""")
def a24(spark, sf):
    m = orders_matrix(spark, sf)
    return Q.corr_pairs(m, FEATURES).select("feature_i", "feature_j", r6(F.col("abs_corr")).alias("abs_corr"))


# A26 / A27 ------------------------------------------------------------------------------------
def _mi_sql(src: str, name: str) -> str:
    return f"""
{name}_long AS (UNPIVOT (SELECT target, {', '.join(FEATURES)} FROM {src}) ON {', '.join(FEATURES)}
                INTO NAME feature VALUE value),
{name}_edges AS (SELECT feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
                 FROM {name}_long GROUP BY feature),
{name}_cnt AS (SELECT l.feature, len(list_filter(e.e, lambda x: x < l.value)) AS bin, l.target AS y, count(*) AS n
               FROM {name}_long l JOIN {name}_edges e USING (feature) GROUP BY ALL),
{name} AS (SELECT feature, greatest(sum(n / nn * ln(n * nn / (nx * ny))), 0) AS mi FROM (
             SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny,
                    sum(n) OVER (PARTITION BY feature) AS nn FROM {name}_cnt) GROUP BY feature)"""


A26_SQL = MAT_SQL + "," + _mi_sql("mat", "mi_full") + "," + _mi_sql("(SELECT * FROM mat WHERE fold = 1)", "mi_hold") + """,
d AS (SELECT f.feature, f.mi AS mi_full, h.mi AS mi_holdout,
             NOT (h.mi < 0.001 OR (f.mi > 0.01 AND h.mi < 0.2 * f.mi)) AS keep0 FROM mi_full f JOIN mi_hold h USING (feature))
SELECT feature, round(mi_full, 6) + 0.0 AS mi_full, round(mi_holdout, 6) + 0.0 AS mi_holdout,
       CASE WHEN (SELECT bool_or(keep0) FROM d) THEN keep0 ELSE true END AS keep FROM d"""


@query("a26_holdout_leakage_filter", A26_SQL)
def a26(spark, sf):
    m = materialize(orders_matrix(spark, sf), "matrix")
    return Q.holdout_filter(m, FEATURES, "target", "fold", 1).select(
        "feature", r6(F.col("mi_full")).alias("mi_full"), r6(F.col("mi_holdout")).alias("mi_holdout"), "keep")


SETS = {1: ["o_totalprice", "c_acctbal", "fe_te_status"], 2: ["fe_freq_segment", "fe_price_z", "fe_leak"]}
A27_SQL = REPORT_SQL.rsplit("SELECT rank, feature", 1)[0] + """,
sets AS (SELECT * FROM (VALUES """ + ", ".join(f"({k}, '{f}')" for k, fs in SETS.items() for f in fs) + """) v(set_id, feature)),
agg AS (SELECT s.set_id, max(CAST(abs(st.pearson) > 0.9 OR st.mutual_info > 0.5 AS INTEGER)) AS has_leak,
               sum(CASE WHEN abs(st.pearson) > 0.9 OR st.mutual_info > 0.5 THEN 0.0 ELSE st.mutual_info END) AS sum_mi,
               sum(CASE WHEN abs(st.pearson) > 0.9 OR st.mutual_info > 0.5 THEN 0.0 ELSE abs(st.pearson) END) AS sum_abs_pearson
        FROM sets s JOIN st USING (feature) GROUP BY s.set_id)
SELECT set_id, has_leak, round(sum_mi, 6) + 0.0 AS sum_mi, round(sum_abs_pearson, 6) + 0.0 AS sum_abs_pearson,
       row_number() OVER (ORDER BY has_leak, round(sum_mi, 6) DESC, sum_abs_pearson DESC, set_id) AS rank FROM agg"""


@query("a27_round_comparison", A27_SQL)
def a27(spark, sf):
    st = _stats(spark, sf)
    return Q.compare_sets(st, SETS)


# T01 ------------------------------------------------------------------------------------------
T01_SQL = OC_SQL + """,
n AS (UNPIVOT (SELECT target, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, c_acctbal,
                      CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM oc_train)
      ON o_custkey, o_totalprice, c_acctbal, c_nationkey INTO NAME feature VALUE value),
nc AS (SELECT feature AS "column", 'numeric' AS kind,
              abs(coalesce(covar_samp(value, target) / nullif(stddev_samp(value) * stddev_samp(target), 0), 0.0)) AS score
       FROM n GROUP BY feature),
c AS (UNPIVOT (SELECT target, o_orderstatus, c_mktsegment FROM oc_train) ON o_orderstatus, c_mktsegment
      INTO NAME feature VALUE value),
cr AS (SELECT feature, value, avg(target) AS rate FROM c GROUP BY feature, value),
cc AS (SELECT feature AS "column", 'categorical' AS kind, max(rate) - min(rate) AS score FROM cr GROUP BY feature
       HAVING count(*) <= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, "column") AS rnk FROM
      (SELECT * FROM nc UNION ALL SELECT * FROM cc))
SELECT "column", kind, round(score, 6) + 0.0 AS score, rnk FROM r
WHERE (kind = 'numeric' AND rnk <= 10) OR (kind = 'categorical' AND rnk <= 5)"""


@query("t01_best_original_columns", T01_SQL)
def t01(spark, sf):
    p, every, tr = orders_with_customer(spark, sf)
    b = Q.best_originals(tr, ["o_custkey", "o_totalprice", "c_acctbal", "c_nationkey"],
                         ["o_orderstatus", "c_mktsegment"], "target")
    return b.select("column", "kind", r6(F.col("score")).alias("score"), F.col("rnk").cast("long").alias("rnk"))


# W05 / W06 / M04 ------------------------------------------------------------------------------
@query("w05_average_ranks", """
WITH vc AS (SELECT l_quantity AS value, count(*) AS n FROM lineitem GROUP BY l_quantity)
SELECT value, n, sum(n) OVER (ORDER BY value) - n + (n + 1) / 2 AS avg_rank FROM vc""")
def w05(spark, sf):
    rt = Q.rank_table(load(spark, sf, "lineitem").withColumn("_y", F.lit(0)), ["l_quantity"], "_y")
    return rt.select("value", "n", F.col("avg_rank").cast("double").alias("avg_rank"))


@query("w06_stratified_folds_docs", problems.with_sql("docs") + " SELECT doc_id, quality, fold FROM docs_folds")
def w06(spark, sf):
    return problems.docs(spark, sf).folds.select("doc_id", "quality", F.col("fold").cast("long").alias("fold"))


@query("m04_stratified_kfold_orders", problems.with_sql("orders") + """
SELECT target, fold, count(*) AS n FROM orders_folds GROUP BY target, fold""")
def m04(spark, sf):
    f = problems.orders(spark, sf).folds
    return f.groupBy("target", F.col("fold").cast("long").alias("fold")).agg(F.count(F.lit(1)).alias("n"))
