"""Queries: joins J01-J12 and set operations U01, U02, U04."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import joins as JN
from ..operators.features import lookup
from ..sources.tables import Catalog, load
from . import problems
from .registry import query


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")


# J01 ------------------------------------------------------------------------------------------
@query("j01_left_join_orders_customer", """
SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey""")
def j01_left(spark, sf):
    return JN.join(load(spark, sf, "orders"), load(spark, sf, "customer"), "o_custkey", "c_custkey", "left")


@query("j01_outer_join_key_coalesce", """
WITH l AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
SELECT coalesce(l.o_custkey, c.c_custkey) AS o_custkey, l.n_orders, c.c_mktsegment
FROM l FULL OUTER JOIN customer c ON l.o_custkey = c.c_custkey""")
def j01_outer(spark, sf):
    left = load(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    right = load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return JN.join(left, right, "o_custkey", "c_custkey", "outer").select("o_custkey", "n_orders", "c_mktsegment")


@query("j01_null_safe_join", """
WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders),
r AS (SELECT CASE WHEN c_custkey = 1 THEN NULL ELSE c_custkey END AS c_custkey, c_mktsegment FROM customer)
SELECT l.o_orderkey, l.o_custkey, r.c_mktsegment FROM l LEFT JOIN r ON l.o_custkey IS NOT DISTINCT FROM r.c_custkey""")
def j01_nullsafe(spark, sf):
    left = load(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).otherwise(F.col("o_custkey")).alias("o_custkey"))
    right = load(spark, sf, "customer").select(
        F.when(F.col("c_custkey") == 1, F.lit(None)).otherwise(F.col("c_custkey")).alias("c_custkey"), "c_mktsegment")
    return JN.join(left, right, "o_custkey", "c_custkey", "left", null_keys_match=True)


# J02 / J03 / J04 ------------------------------------------------------------------------------
J02_SQL = """
WITH d AS (SELECT doc_id, lang, source, n_chars FROM documents),
j1 AS (SELECT d.*, l.quality, l.toxic FROM d LEFT JOIN labels l ON d.doc_id = l.doc_id),
li AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem),
j2 AS (SELECT o.*, li.l_linenumber, li.l_quantity FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey),
s1 AS (SELECT 'documents_labels' AS join_name, (SELECT count(*) FROM d) AS rows_before, count(*) AS rows_after,
              6 AS n_cols, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM j1)) AS duplicate_rows,
              round(100.0 * (count(*) - count(quality)) / count(*), 2) AS p1,
              round(100.0 * (count(*) - count(toxic)) / count(*), 2) AS p2 FROM j1),
s2 AS (SELECT 'orders_lineitem' AS join_name, (SELECT count(*) FROM orders) AS rows_before, count(*) AS rows_after,
              8 AS n_cols, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM j2)) AS duplicate_rows,
              round(100.0 * (count(*) - count(l_linenumber)) / count(*), 2) AS p1,
              round(100.0 * (count(*) - count(l_quantity)) / count(*), 2) AS p2 FROM j2)
SELECT join_name, rows_before, rows_after, rows_before - rows_after AS rows_lost, n_cols, duplicate_rows,
       'quality' AS "column", p1 + 0.0 AS null_pct FROM s1
UNION ALL SELECT join_name, rows_before, rows_after, rows_before - rows_after, n_cols, duplicate_rows, 'toxic', p2 + 0.0 FROM s1
UNION ALL SELECT join_name, rows_before, rows_after, rows_before - rows_after, n_cols, duplicate_rows, 'l_linenumber', p1 + 0.0 FROM s2
UNION ALL SELECT join_name, rows_before, rows_after, rows_before - rows_after, n_cols, duplicate_rows, 'l_quantity', p2 + 0.0 FROM s2"""


@query("j02_join_diagnostics", J02_SQL)
def j02(spark, sf):
    docs = _docs(spark, sf)
    labels = load(spark, sf, "labels")
    orders = load(spark, sf, "orders")
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    out = None
    for name, left, right, lk, rk in [("documents_labels", docs, labels, "doc_id", "doc_id"),
                                      ("orders_lineitem", orders, li, "o_orderkey", "l_orderkey")]:
        joined = JN.join(left, right, lk, rk, "left")
        new = [c for c in joined.columns if c not in left.columns]
        d = JN.join_diagnostics(left, joined, new).select(
            F.lit(name).alias("join_name"), "rows_before", "rows_after", "rows_lost", "n_cols", "duplicate_rows",
            F.inline("new_column_null_pct"))
        out = d if out is None else out.unionByName(d)
    return out.select("join_name", "rows_before", "rows_after", "rows_lost", "n_cols", "duplicate_rows", "column",
                      (F.col("null_pct") + F.lit(0.0)).alias("null_pct"))


@query("j03_match_rate", """
SELECT 'documents_labels' AS join_name, count(*) AS left_rows,
       count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS matched_rows,
       round(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) / count(*), 6) + 0.0 AS match_rate
FROM documents
UNION ALL
SELECT 'orders_lineitem', count(*), count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
       round(count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) / count(*), 6) + 0.0
FROM orders""")
def j03(spark, sf):
    a = JN.match_rate(_docs(spark, sf), load(spark, sf, "labels"), "doc_id", "doc_id") \
        .select(F.lit("documents_labels").alias("join_name"), "*")
    b = JN.match_rate(load(spark, sf, "orders"), load(spark, sf, "lineitem"), "o_orderkey", "l_orderkey") \
        .select(F.lit("orders_lineitem").alias("join_name"), "*")
    return a.unionByName(b).withColumn("match_rate", r6(F.col("match_rate")))


@query("j04_relationship", """
WITH p AS (
  SELECT 'orders_customer' AS join_name, (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)) AS left_max,
         (SELECT max(c) FROM (SELECT count(*) AS c FROM customer GROUP BY c_custkey)) AS right_max
  UNION ALL
  SELECT 'orders_lineitem', (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)),
         (SELECT max(c) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey))
  UNION ALL
  SELECT 'documents_labels', (SELECT max(c) FROM (SELECT count(*) AS c FROM documents GROUP BY doc_id)),
         (SELECT max(c) FROM (SELECT count(*) AS c FROM labels GROUP BY doc_id)))
SELECT join_name, left_max, right_max,
       CASE WHEN left_max > 1 AND right_max > 1 THEN 'N:M' WHEN left_max > 1 THEN 'N:1'
            WHEN right_max > 1 THEN '1:N' ELSE '1:1' END AS relationship FROM p""")
def j04(spark, sf):
    o, c, li = load(spark, sf, "orders"), load(spark, sf, "customer"), load(spark, sf, "lineitem")
    parts = [("orders_customer", o, c, "o_custkey", "c_custkey"), ("orders_lineitem", o, li, "o_orderkey", "l_orderkey"),
             ("documents_labels", _docs(spark, sf), load(spark, sf, "labels"), "doc_id", "doc_id")]
    out = None
    for name, left, right, lk, rk in parts:
        r = JN.relationship(left, right, lk, rk).select(F.lit(name).alias("join_name"), "*")
        out = r if out is None else out.unionByName(r)
    return out


# J05 / J06 / J07 ------------------------------------------------------------------------------
@query("j05_lookup_join", """
WITH t2 AS (SELECT doc_id, lang, source, n_chars FROM documents
            UNION ALL SELECT doc_id, 'zz', source, n_chars FROM documents WHERE doc_id % 7 = 0),
d AS (SELECT DISTINCT ON (doc_id) * FROM t2 ORDER BY doc_id, lang NULLS FIRST, source NULLS FIRST, n_chars NULLS FIRST)
SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars FROM labels l LEFT JOIN d USING (doc_id)""")
def j05(spark, sf):
    docs = _docs(spark, sf)
    t2 = docs.unionByName(docs.where(F.col("doc_id") % 7 == 0).withColumn("lang", F.lit("zz")))
    return JN.lookup_join(load(spark, sf, "labels"), t2)


J06_SQL = """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.quality, b.quality) AS quality, a.toxic, b.lang, b.n_chars
FROM labels a FULL OUTER JOIN
     (SELECT doc_id, lang, n_chars, CAST(n_chars % 2 AS INTEGER) AS quality FROM documents) b ON a.doc_id = b.doc_id"""


def _j06_inputs(spark, sf):
    t1 = load(spark, sf, "labels")
    t2 = load(spark, sf, "documents").select("doc_id", "lang", "n_chars", F.col("n_chars").alias("n_chars_copy"),
                                             (F.col("n_chars") % 2).cast("int").alias("quality"))
    return t1, t2


@query("j06_positional_merge", J06_SQL)
def j06(spark, sf):
    t1, t2 = _j06_inputs(spark, sf)
    return JN.positional_merge(t1, t2, "doc_id", drop_similar=True)


@query("u04_column_concat", J06_SQL.replace("b.n_chars\n", "b.n_chars, b.n_chars_copy\n").replace(
    "SELECT doc_id, lang, n_chars, CAST", "SELECT doc_id, lang, n_chars, n_chars AS n_chars_copy, CAST"))
def u04(spark, sf):
    t1, t2 = _j06_inputs(spark, sf)
    return JN.positional_merge(t1, t2, "doc_id", drop_similar=False)


@query("j07_merge_chain", """
SELECT o.*, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment, n.n_name, n.n_regionkey
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def j07(spark, sf):
    cat = Catalog.from_dir(spark, sf, ["orders", "customer", "nation"])
    return JN.merge_chain(cat, "orders", [JN.JoinSpec("orders", "customer", "o_custkey", "c_custkey"),
                                          JN.JoinSpec("orders", "nation", "c_nationkey", "n_nationkey")])


# J08 / J09 / U01 ------------------------------------------------------------------------------
@query("j08_key_by_name", """
WITH r AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
d AS (SELECT 'l_partkey' AS "column", count(*) - count(DISTINCT l_partkey) AS duplicates, 1 AS position FROM r
      UNION ALL SELECT 'l_suppkey', count(*) - count(DISTINCT l_suppkey), 2 FROM r)
SELECT "column", duplicates, position - 1 AS position,
       row_number() OVER (ORDER BY duplicates, position) = 1 AS chosen FROM d""")
def j08(spark, sf):
    li = load(spark, sf, "lineitem")
    right = li.select("l_partkey", "l_suppkey").distinct()
    return JN.key_candidates_by_name(li, right)


J09_SQL = """
WITH l AS (UNPIVOT (SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
                           o_orderstatus FROM orders) ON COLUMNS(*) INTO NAME "column" VALUE value),
r AS (UNPIVOT (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
                      c_mktsegment FROM customer) ON COLUMNS(*) INTO NAME "column" VALUE value),
ld AS (SELECT DISTINCT "column", value FROM l), rd AS (SELECT DISTINCT "column", value FROM r),
ldc AS (SELECT "column" AS left_column, count(*) AS left_distinct FROM ld GROUP BY "column"),
ov AS (SELECT ld."column" AS left_column, rd."column" AS right_column, count(*) AS overlap
       FROM ld JOIN rd USING (value) GROUP BY ld."column", rd."column")
SELECT left_column, right_column, overlap, left_distinct, round(overlap / left_distinct, 6) + 0.0 AS ratio
FROM ov JOIN ldc USING (left_column) WHERE overlap / left_distinct >= 0.5"""


@query("j09_key_by_overlap", J09_SQL)
def j09(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = JN.key_candidates_by_overlap(o, c, 0.5)
    return k.select("left_column", "right_column", "overlap", "left_distinct", r6(F.col("ratio")).alias("ratio"))


@query("u01_value_intersection", """
SELECT o_custkey AS value FROM orders INTERSECT SELECT c_custkey FROM customer""")
def u01(spark, sf):
    return load(spark, sf, "orders").select(F.col("o_custkey").alias("value")).intersect(
        load(spark, sf, "customer").select(F.col("c_custkey").alias("value")))


@query("u02_column_sets")
def u02(spark, sf):
    """Column-set difference / intersection between train and test (schema-level, rows-only)."""
    p = problems.orders(spark, sf)
    tr, te = p.train.columns, p.test.columns
    rows = [(c, c in tr, c in te) for c in dict.fromkeys(tr + te)]
    return spark.createDataFrame(rows, "column string, in_train boolean, in_test boolean")


# J10 / J11 / J12 ------------------------------------------------------------------------------
@query("j10_dictionary_lookup", """
WITH d AS (SELECT c_custkey, min(c_acctbal) AS c_acctbal FROM customer GROUP BY c_custkey)
SELECT o.o_orderkey, d.c_acctbal FROM orders o LEFT JOIN d ON o.o_custkey = d.c_custkey""")
def j10(spark, sf):
    table = lookup(load(spark, sf, "customer"), "c_custkey", "c_acctbal")
    o = load(spark, sf, "orders")
    return o.join(table, o["o_custkey"] == table["_k"], "left").select("o_orderkey", F.col("_v").alias("c_acctbal"))


@query("j11_feature_attach", problems.with_sql("orders") + """,
f AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY l_orderkey)
SELECT t.o_orderkey, t.target, f.n_lines, round(f.sum_qty, 6) + 0.0 AS sum_qty FROM orders_train t LEFT JOIN f USING (o_orderkey)""")
def j11(spark, sf):
    p = problems.orders(spark, sf)
    feats = (load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.count(F.lit(1)).alias("n_lines"), r6(F.sum("l_quantity")).alias("sum_qty")))
    return JN.attach(p.train.select("o_orderkey", "target"), feats, "o_orderkey")


@query("j12_label_join", problems.with_sql("docs") + """
SELECT t.doc_id, l.quality FROM docs_test t LEFT JOIN labels l USING (doc_id)""")
def j12(spark, sf):
    p = problems.docs(spark, sf)
    return JN.attach(p.test.select("doc_id"), load(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
