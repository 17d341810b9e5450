"""Queries: distribution shape A10/X02, A11, A25; compositions P19-P22; T04, T05."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import clean as CL
from ..operators import distribution as D
from ..operators import quality as Q
from ..operators.kernels import value_counts
from ..sources.tables import load
from . import problems
from .fixtures import line_fx, line_fx_sql, unpivot_sql
from .flagship import report
from .q_clean import both_sides
from .prepare import assemble_candidates, prepare_data, process_pair
from .q_features import orders_with_customer
from .q_model import _docs_outputs
from .q_quality import FEATURES, REPORT_SQL, orders_matrix
from .registry import query

KDE_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "const_col", "l_extendedprice"]
A11_SQL = line_fx_sql() + ", " + unpivot_sql(
    "num", "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in KDE_COLS) + " FROM line_fx", KDE_COLS) + """,
vc AS (SELECT "column", value, count(*) AS n FROM num WHERE value IS NOT NULL GROUP BY "column", value),
st AS (SELECT "column", count(value) AS nn, stddev_samp(value) AS sd, min(value) AS mn, max(value) AS mx
       FROM num GROUP BY "column"),
pts AS (SELECT st."column", r.i, st.mn + r.i * (st.mx - st.mn) / 199 AS g, st.sd * pow(st.nn, -0.2) AS h
        FROM st CROSS JOIN range(0, 200) r(i) WHERE st.nn >= 2 AND st.sd > 0),
dens AS (SELECT p."column", p.i, sum(bb.n * exp(-0.5 * ((p.g - bb.value) / p.h) * ((p.g - bb.value) / p.h))) AS d
         FROM pts p JOIN vc AS bb USING ("column") GROUP BY p."column", p.i),
pk AS (SELECT "column", sum(CASE WHEN d > lg AND d > ld THEN 1 ELSE 0 END) AS peaks FROM (
         SELECT *, lag(d) OVER (PARTITION BY "column" ORDER BY i) AS lg,
                lead(d) OVER (PARTITION BY "column" ORDER BY i) AS ld FROM dens) GROUP BY "column")
SELECT st."column", CAST(CASE WHEN st.nn < 2 OR st.sd IS NULL OR st.sd = 0 THEN 1 ELSE coalesce(pk.peaks, 0) END AS BIGINT)
         AS peaks,
       CASE WHEN st.nn < 2 OR st.sd IS NULL OR st.sd = 0 THEN 1 ELSE coalesce(pk.peaks, 0) END > 1 AS multimodal
FROM st LEFT JOIN pk USING ("column")"""


@query("a11_kde_modality", A11_SQL)
def a11(spark, sf):
    return D.modality(line_fx(spark, sf), KDE_COLS)


@query("a10_shapiro_wilk")
def a10(spark, sf):
    """Normality of columns of every size: the test follows the number of values."""
    c = load(spark, sf, "customer")
    p = load(spark, sf, "part").select(F.col("p_retailprice").alias("c_acctbal_part"))
    s = load(spark, sf, "supplier").select("s_acctbal")
    n = load(spark, sf, "nation").select("n_regionkey")
    out = D.normality(c, ["c_acctbal", "c_nationkey", "c_custkey"])
    for df in (p, s, n):
        out = out.unionByName(D.normality(df, df.columns))
    return out.withColumn("normal_p", F.round("normal_p", 4))


@query("a25_vif")
def a25(spark, sf):
    return D.vif(orders_matrix(spark, sf), FEATURES).select("feature", r6(F.col("vif")).alias("vif"))


# P19 ------------------------------------------------------------------------------------------
P19_IN = ["l_orderkey", "l_linenumber", "l_quantity", "price_text", "tax_text", "ship_text", "flag_padded",
          "const_col", "near_const", "row_code", "l_returnflag"]
P19_KEPT = ["l_orderkey", "l_linenumber", "l_quantity", "price_text", "tax_text", "ship_text", "flag_padded",
            "l_returnflag"]
P19_SQL = line_fx_sql() + f""",
prep AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity,
                CASE WHEN regexp_matches(price_text, '{CL.NUMERIC_TEXT}') THEN TRY_CAST(trim(price_text) AS DOUBLE) END
                  AS price_text,
                lower(trim(tax_text)) AS tax_text, try_strptime(ship_text, '%Y-%m-%d') AS ship_text,
                lower(trim(flag_padded)) AS flag_padded, const_col, near_const, lower(trim(row_code)) AS row_code,
                lower(trim(l_returnflag)) AS l_returnflag FROM line_fx),
""" + unpivot_sql("v", "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in P19_KEPT) + " FROM prep",
                  P19_KEPT) + """
SELECT "column", count(value) AS non_null, count(DISTINCT value) AS unique_count FROM v GROUP BY "column"
"""


@query("p19_prepare_pipeline", P19_SQL)
def p19(spark, sf):
    out, _ = prepare_data(line_fx(spark, sf).select(*P19_IN))
    vc = value_counts(out, out.columns)
    return vc.groupBy("column").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
                                    .cast("long").alias("non_null"), F.count("value").alias("unique_count"))


@query("p19_dropped_columns", line_fx_sql() + """,
d AS (SELECT DISTINCT l_orderkey, l_linenumber, const_col, near_const, lower(trim(row_code)) AS row_code, l_returnflag, l_quantity
      FROM line_fx),
c AS (SELECT const_col, near_const, count(*) AS n FROM d GROUP BY ALL)
SELECT 'const_col' AS "column", 'constant' AS reason, 1.0 AS share
UNION ALL SELECT 'near_const', 'constant', round(max(n) / sum(n), 6) FROM (SELECT near_const, sum(n) AS n FROM c GROUP BY 1)
          HAVING max(n) / sum(n) >= 0.995
UNION ALL SELECT 'row_code', 'high_cardinality', round(count(DISTINCT row_code) / count(*), 6) FROM d
          HAVING count(DISTINCT row_code) / count(*) >= 0.95""")
def p19_dropped(spark, sf):
    """The part of the prepare report that says which columns went, and why."""
    cols = ["l_orderkey", "l_linenumber", "const_col", "near_const", "row_code", "l_returnflag", "l_quantity"]
    _, rep = prepare_data(line_fx(spark, sf).select(*cols))
    return rep["dropped"].select("column", "reason", r6(F.col("share")).alias("share"))


def _clip(c):
    return f"round(least(greatest(CAST(s.{c} AS DOUBLE), b.{c}_lo), b.{c}_hi), 6) + 0.0 AS {c}"


P20_NUMS = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("p20_train_test_processing", problems.with_sql("orders") + f""",
b AS (SELECT {", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.01) AS {c}_lo, quantile_cont(CAST({c} AS DOUBLE), 0.99) AS {c}_hi" for c in P20_NUMS)}
      FROM orders_train),
s AS (SELECT 'train' AS side, * FROM orders_train UNION ALL SELECT 'test', *, NULL FROM orders_test)
SELECT s.side, {", ".join(_clip(c) for c in P20_NUMS)}, {_clip("o_totalprice").replace("AS o_totalprice", "AS price_text")},
       s.o_orderstatus, s.o_orderdate, s.target
FROM s CROSS JOIN b""")
def p20(spark, sf):
    p = problems.orders(spark, sf)
    tr = p.train.withColumn("price_text", F.col("o_totalprice").cast("string"))
    te = p.test.withColumn("price_text", F.col("o_totalprice").cast("string"))
    both = both_sides(*process_pair(tr, te, "target"))
    return both.select("side", *[r6(F.col(c)).alias(c) for c in [*P20_NUMS, "price_text"]], "o_orderstatus", "o_orderdate", "target")


@query("p21_output_projection", problems.with_sql("docs") + """,
d AS (SELECT doc_id, min(source) AS source, min(n_chars) AS n_chars FROM documents GROUP BY doc_id),
fs AS (SELECT source AS c, count(*) / (SELECT count(source) FROM documents) AS f FROM documents
       WHERE source IS NOT NULL GROUP BY source),
med AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS m FROM d)
SELECT t.side, t.doc_id, t.quality, t.toxic, round(coalesce(fs.f, 0.0), 6) + 0.0 AS fe_freq_source,
       round(coalesce(CAST(d.n_chars AS DOUBLE), med.m), 6) + 0.0 AS fe_n_chars
FROM (SELECT 'train' AS side, doc_id, quality, toxic FROM docs_train
      UNION ALL SELECT 'test', doc_id, NULL, toxic FROM docs_test) t LEFT JOIN d USING (doc_id) LEFT JOIN fs ON d.source = fs.c CROSS JOIN med""")
def p21(spark, sf):
    p, tr, te, feats = _docs_outputs(spark, sf)
    names = [r6(F.col(f)).alias(f) for f in feats]
    return both_sides(tr.select(*p.train.columns, *names), te.select(*p.test.columns, *names))


@query("p22_candidate_matrix")
def p22(spark, sf):
    p, every, tr = orders_with_customer(spark, sf)
    te = every.where(F.col("fold") == 0).drop("target")
    tr = tr.withColumn("fe_ratio €", F.try_divide(F.col("o_totalprice"), F.col("c_acctbal")))
    te = te.withColumn("fe_ratio €", F.try_divide(F.col("o_totalprice"), F.col("c_acctbal")))
    a, b, names = assemble_candidates(tr, te, "o_orderkey", "target", ["o_totalprice", "c_acctbal"],
                                      ["o_orderstatus", "c_mktsegment"], ["fe_ratio €"])
    return both_sides(a, b)


@query("t04_first_candidate_columns")
def t04(spark, sf):
    rows = []
    for t, key in (("customer", "c_custkey"), ("documents", "doc_id"), ("lineitem", "l_orderkey")):
        cols = [c for c in load(spark, sf, t).columns if c != key][:5]
        rows += [(t, i, c) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "table string, position int, column string")


@query("t05_ordering", REPORT_SQL)
def t05(spark, sf):
    st = Q.feature_stats(orders_matrix(spark, sf), FEATURES, "target")
    return report(st, None).orderBy("rank")


@query("a22_knn_mutual_info")
def a22(spark, sf):
    from ..operators.knn_mi import knn_mutual_info
    m = orders_matrix(spark, sf)
    return knn_mutual_info(m, FEATURES, "target", "o_orderkey").select(
        "feature", r6(F.col("mutual_info")).alias("mutual_info"), "n")


@query("a19_candidate_report_with_importance")
def a19(spark, sf):
    from ..operators import model as MD
    m = orders_matrix(spark, sf)
    st = Q.feature_stats(m, FEATURES, "target")
    imp = MD.importance_ranking(m, FEATURES, "target", max_iter=150)
    return (st.join(imp, "feature", "left")
            .select("feature", r6(F.col("pearson")).alias("pearson"), r6(F.col("mutual_info")).alias("mutual_info"),
                    r6(F.col("null_pct")).alias("null_pct"), "nunique", r6(F.col("importance")).alias("importance"))
            .orderBy(F.desc("importance"), "feature"))


# W03 / W04 / X02 ------------------------------------------------------------------------------
@query("w03_positions_for_trend", """
WITH vc AS (SELECT epoch(o_orderdate) AS value, count(*) AS n FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT value, n, sum(n) OVER (ORDER BY value) - n + 1 AS first_pos, sum(n) OVER (ORDER BY value) AS last_pos FROM vc""")
def w03(spark, sf):
    """Rows sharing a timestamp occupy consecutive sorted positions: (value, n, first_pos, last_pos)."""
    from ..operators.kernels import cumulative_counts
    o = load(spark, sf, "orders").where(F.col("o_orderdate").isNotNull())
    vc = (o.groupBy((F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double") / 1e6).alias("value"))
          .agg(F.count(F.lit(1)).alias("n")).withColumn("column", F.lit("o_orderdate")))
    cum = cumulative_counts(vc.select("column", "value", "n"))
    return cum.select("value", "n", (F.col("cum_before") + 1).alias("first_pos"), F.col("cum").alias("last_pos"))


W04_SQL = A11_SQL[:A11_SQL.rindex("pk AS (")] + """
peaks AS (SELECT "column", i FROM (
            SELECT *, lag(d) OVER (PARTITION BY "column" ORDER BY i) AS lg,
                   lead(d) OVER (PARTITION BY "column" ORDER BY i) AS ld FROM dens) WHERE d > lg AND d > ld)
SELECT "column", CAST(i AS INTEGER) AS i FROM peaks"""


@query("w04_kde_local_maxima", W04_SQL)
def w04(spark, sf):
    dens = D.kde_density(line_fx(spark, sf), KDE_COLS)
    return D.local_maxima(dens, "column", "i", "d").select("column", F.col("i").cast("int").alias("i"))


@query("x02_per_column_pandas")
def x02(spark, sf):
    """Spread of every column (supplier and part numerics), of any size."""
    return D.spread(load(spark, sf, "supplier"), ["s_acctbal"]).unionByName(
        D.spread(load(spark, sf, "part"), ["p_retailprice", "p_size"]))
