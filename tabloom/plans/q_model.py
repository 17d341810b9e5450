"""Queries: model scoring and selection M01, M05, M06, T03; validation and roles M08-M13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import features as FE
from ..operators import model as MD
from ..operators import validate as V
from ..sources.tables import load
from . import problems
from .controller import fallback_ladder, top_up, two_round
from .q_clean import both_sides
from .q_features import OC_SQL, orders_with_customer
from .q_quality import FEATURES, orders_matrix
from .registry import query


def _cv_matrix(spark, sf):
    m = orders_matrix(spark, sf)
    return problems.stratified_folds(m.drop("fold"), "o_orderkey", "target", 5, out="cv_fold")


@query("m01_set_scoring")
def m01(spark, sf):
    feats = ["o_totalprice", "c_acctbal", "fe_te_status", "fe_freq_segment", "fe_price_z"]
    summary, _ = MD.score_set(_cv_matrix(spark, sf), feats, "target", "cv_fold")
    return summary


@query("m01_test_side")
def m01_test(spark, sf):
    """Saved scorer, loaded again for the held-back rows: AUC and Gini against their hidden labels, twice over
    (as one number per set, and by the ranking of the scored rows)."""
    from ..session import scratch_path
    p, every, tr = orders_with_customer(spark, sf)
    feats = ["o_totalprice", "c_acctbal", "o_orderstatus", "c_mktsegment"]
    path = MD.fit_scorer(tr, feats, "target", scratch_path(spark, "scorer"), max_iter=100)
    hidden = p.folds.where(F.col("fold") == 0).select("o_orderkey", "target")
    _, summary = MD.score_hidden(every.where(F.col("fold") == 0).drop("target"), hidden, feats, "o_orderkey", "target", path)
    return summary


@query("t03_top20_importances")
def t03(spark, sf):
    feats = ["o_totalprice", "c_acctbal", "fe_te_status", "fe_freq_segment", "fe_price_z"]
    _, imp = MD.score_set(_cv_matrix(spark, sf), feats, "target", "cv_fold", n_folds=0)
    return imp.orderBy(F.desc("importance"), "feature").limit(20)


@query("m05_importance_ranking")
def m05(spark, sf):
    return MD.importance_ranking(orders_matrix(spark, sf), FEATURES, "target")


@query("m06_recursive_elimination")
def m06(spark, sf):
    return MD.recursive_elimination(orders_matrix(spark, sf), FEATURES, "target", keep=5)


# M08 / M09 ------------------------------------------------------------------------------------
def _docs_outputs(spark, sf):
    p = problems.docs(spark, sf)
    docs = p.aux["documents"]
    fits = [FE.freq_encoding("fe_freq_source", docs, "source", key="doc_id"),
            FE.numeric_map("fe_n_chars", docs, "doc_id", "n_chars")]
    return p, FE.apply_all(p.train, fits), FE.apply_all(p.test, fits), [f.name for f in fits]


@query("m08_output_validation", problems.with_sql("docs") + """,
n AS (SELECT (SELECT count(*) FROM docs_train) AS tr, (SELECT count(*) FROM docs_test) AS te,
             (SELECT count(*) FROM docs_train WHERE doc_id % 2 = 0) AS half)
SELECT v.outputs, v."check", v.ok, v.detail FROM n, LATERAL (VALUES
  ('good', 'train_rows_kept', true, tr || '/' || tr), ('bad', 'train_rows_kept', half = tr, half || '/' || tr),
  ('good', 'test_rows_kept', true, te || '/' || te), ('bad', 'test_rows_kept', true, te || '/' || te),
  ('good', 'feature_count_1_to_5', true, '2'), ('bad', 'feature_count_1_to_5', true, '3'),
  ('good', 'train_originals_kept', true, ''), ('bad', 'train_originals_kept', true, ''),
  ('good', 'test_originals_kept', true, ''), ('bad', 'test_originals_kept', false, ''),
  ('good', 'same_features_same_order', true, ''), ('bad', 'same_features_same_order', false, ''),
  ('good', 'no_all_null_feature', true, ''), ('bad', 'no_all_null_feature', false, 'fe_null,fe_null'),
  ('good', 'unique_names', true, ''), ('bad', 'unique_names', true, ''),
  ('good', 'feature_null_cells', true, '0/0'), ('bad', 'feature_null_cells', false, half || '/' || te)) v(outputs, "check", ok, detail)""")
def m08(spark, sf):
    """Outputs as they should be, and ones with lost rows, a lost column, another order and an empty feature."""
    p, tr, te, feats = _docs_outputs(spark, sf)
    good = V.validate_outputs(p.train, p.test, tr, te, feats)
    empty = F.lit(None).cast("double")
    bad_tr = tr.where(F.col("doc_id") % 2 == 0).withColumn("fe_null", empty)
    bad_te = te.withColumn("fe_null", empty).select("doc_id", "fe_null", *reversed(feats))
    bad = V.validate_outputs(p.train, p.test, bad_tr, bad_te, [*feats, "fe_null"])
    return good.withColumn("outputs", F.lit("good")).unionByName(bad.withColumn("outputs", F.lit("bad")))


@query("m09_fallback_ladder", problems.with_sql("docs") + """,
d AS (SELECT doc_id, min(lang) AS lang, min(source) AS source FROM documents GROUP BY doc_id),
fl AS (SELECT lang AS c, count(*) / (SELECT count(lang) FROM documents) AS f FROM documents
       WHERE lang IS NOT NULL GROUP BY lang),
fs AS (SELECT source AS c, count(*) / (SELECT count(source) FROM documents) AS f FROM documents
       WHERE source IS NOT NULL GROUP BY source)
SELECT 1 AS level, t.side, t.doc_id, t.quality, t.toxic, round(coalesce(fl.f, 0.0), 6) + 0.0 AS fb_freq_lang,
       round(coalesce(fs.f, 0.0), 6) + 0.0 AS fb_freq_source
FROM (SELECT 'train' AS side, doc_id, quality, toxic FROM docs_train
      UNION ALL SELECT 'test', doc_id, NULL, toxic FROM docs_test) t LEFT JOIN d USING (doc_id) LEFT JOIN fl ON d.lang = fl.c LEFT JOIN fs ON d.source = fs.c""")
def m09(spark, sf):
    p = problems.docs(spark, sf)
    docs = load(spark, sf, "documents")
    level, tr, te, feats = fallback_ladder(p.train, p.test, {"documents": docs}, {"documents": ("doc_id", "doc_id")},
                                           "doc_id")
    return both_sides(tr, te).select(F.lit(level).alias("level"), "side", "doc_id", "quality", "toxic",
                                     *[r6(F.col(f)).alias(f) for f in feats])


@query("m09_top_up", problems.with_sql("docs") + """,
d AS (SELECT doc_id, min(lang) AS lang, min(source) AS source, min(n_chars) AS n_chars FROM documents GROUP BY doc_id),
med AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS m FROM d),
fl AS (SELECT lang AS c, count(*) / (SELECT count(lang) FROM documents) AS f FROM documents WHERE lang IS NOT NULL GROUP BY lang),
fs AS (SELECT source AS c, count(*) / (SELECT count(source) FROM documents) AS f FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT t.side, t.doc_id, t.quality, t.toxic, CASE WHEN t.side = 'train' THEN doc_id % 7 ELSE 0 END + 0.0 AS fe_train_only, doc_id % 5 + 0.0 AS fe_mod,
       round(coalesce(fl.f, 0.0), 6) + 0.0 AS fb_freq_lang, round(coalesce(fs.f, 0.0), 6) + 0.0 AS fb_freq_source,
       round(coalesce(CAST(d.n_chars AS DOUBLE), med.m), 6) + 0.0 AS fb_map_n_chars
FROM (SELECT 'train' AS side, doc_id, quality, toxic FROM docs_train
      UNION ALL SELECT 'test', doc_id, NULL, toxic FROM docs_test) t LEFT JOIN d USING (doc_id) LEFT JOIN fl ON d.lang = fl.c LEFT JOIN fs ON d.source = fs.c CROSS JOIN med""")
def m09_top_up(spark, sf):
    """Two features are left after the leak filter (one of them on the train side only): three more fill the set."""
    p = problems.docs(spark, sf)
    tr = p.train.withColumn("fe_train_only", (F.col("doc_id") % 7).cast("double")).withColumn("fe_mod", (F.col("doc_id") % 5).cast("double"))
    te = p.test.withColumn("fe_mod", (F.col("doc_id") % 5).cast("double"))
    docs = load(spark, sf, "documents")
    tr, te, feats = top_up(tr, te, ["fe_train_only", "fe_gone", "fe_mod"], {"documents": docs}, {"documents": ("doc_id", "doc_id")})
    return both_sides(tr, te).select("side", "doc_id", "quality", "toxic", *[r6(F.col(f)).alias(f) for f in feats])


# M10 / M11 / M13 ------------------------------------------------------------------------------
@query("m10_target_detection", problems.with_sql("orders") + """
SELECT 'o_flag' AS "column", 0 AS position, count(DISTINCT o_orderkey % 3) AS n_distinct, false AS chosen FROM orders_train
UNION ALL SELECT 'target', 1, count(DISTINCT target), true FROM orders_train""")
def m10(spark, sf):
    p = problems.orders(spark, sf)
    tr = p.train.select("o_orderkey", (F.col("o_orderkey") % 3).alias("o_flag"), "o_custkey", "o_orderstatus",
                        "o_totalprice", "o_orderdate", "target")
    return V.detect_target(tr, p.test)


@query("m11_id_detection", problems.with_sql("orders") + """,
c AS (SELECT 'o_orderkey' AS "column", 0 AS position, count(DISTINCT o_orderkey) AS nunique FROM orders_test
      UNION ALL SELECT 'o_custkey', 1, count(DISTINCT o_custkey) FROM orders_test
      UNION ALL SELECT 'o_orderstatus', 2, count(DISTINCT o_orderstatus) FROM orders_test
      UNION ALL SELECT 'o_totalprice', 3, count(DISTINCT o_totalprice) FROM orders_test
      UNION ALL SELECT 'o_orderdate', 4, count(DISTINCT o_orderdate) FROM orders_test)
SELECT "column", position, nunique, row_number() OVER (ORDER BY nunique DESC, position) = 1 AS chosen FROM c""")
def m11(spark, sf):
    return V.detect_id(problems.orders(spark, sf).test)


@query("m13_feature_list")
def m13(spark, sf):
    p, tr, te, feats = _docs_outputs(spark, sf)
    names = V.feature_columns(tr, "doc_id", "quality", p.train.columns)
    return spark.createDataFrame([(n,) for n in names], "feature string")


# M12 ------------------------------------------------------------------------------------------
@query("m12_two_round_controller")
def m12(spark, sf):
    p, every, tr = orders_with_customer(spark, sf)
    round1 = [FE.target_encoding("fe_te_status", tr, "o_orderstatus", "target"),
              FE.freq_encoding("fe_freq_segment", tr, "c_mktsegment"),
              FE.group_zscore("fe_price_z", tr, "o_totalprice", "o_orderstatus"),
              FE.expression("fe_constant", "1.0")]
    pool = [FE.log1p("fe_log_price", tr, "o_totalprice"),
            FE.cooccurrence("fe_cooc", tr, "o_orderstatus", "c_mktsegment"),
            FE.interaction("fe_status_x_segment", tr, ["o_orderstatus", "c_mktsegment"], "target"),
            FE.ratio("fe_price_per_balance", "o_totalprice", "c_acctbal")]
    winner, top = two_round(tr, "target", "fold", 1, round1, pool, 5)
    return top.select(F.lit(winner).alias("winning_set"), "rank", "feature", r6(F.col("score")).alias("score"),
                      "verdict", r6(F.col("mutual_info")).alias("mutual_info"))
