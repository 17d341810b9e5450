"""Queries: cleaning and projection operators P01-P24, W01 keep-first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import clean as CL
from ..operators.ordering import first_per_key
from ..sources.tables import load
from . import problems
from .fixtures import LINE_NUMERIC, LINE_STRINGS, line_fx, line_fx_sql, unpivot_sql
from .registry import query

NUM_RX = CL.NUMERIC_TEXT


def _fx(spark, sf):
    return line_fx(spark, sf)


# P01 / P02 / P03 ------------------------------------------------------------------------------
@query("p01_numeric_repair", line_fx_sql() + f"""
SELECT l_orderkey, l_linenumber,
       CASE WHEN regexp_matches(price_text, '{NUM_RX}') THEN TRY_CAST(trim(price_text) AS DOUBLE) END AS price_text,
       tax_text
FROM line_fx""")
def p01(spark, sf):
    df = _fx(spark, sf).select("l_orderkey", "l_linenumber", "price_text", "tax_text")
    return CL.fix_dtypes(df)


@query("p02_datetime_repair", line_fx_sql() + """
SELECT l_orderkey, l_linenumber, try_strptime(ship_text, '%Y-%m-%d') AS ship_text FROM line_fx""")
def p02(spark, sf):
    return CL.fix_dtypes(_fx(spark, sf).select("l_orderkey", "l_linenumber", "ship_text"))


@query("p03_normalize_categories", line_fx_sql() + """
SELECT l_orderkey, l_linenumber, lower(trim(flag_padded)) AS flag_padded FROM line_fx""")
def p03(spark, sf):
    return CL.normalize_categories(_fx(spark, sf).select("l_orderkey", "l_linenumber", "flag_padded"))


# P04 / W01 ------------------------------------------------------------------------------------
@query("p04_dedup_keep_first", """
SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY l_orderkey, l_linenumber, l_quantity""")
def p04_first(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return CL.drop_duplicates(li, "l_orderkey", ["l_linenumber", "l_quantity"], "first")[0]


@query("w01_keep_last_per_key", """
SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY l_orderkey, l_linenumber DESC, l_quantity DESC""")
def w01(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return first_per_key(li, ["l_orderkey"], ["l_linenumber", "l_quantity"], keep="last")


@query("p04_dropped_count", "SELECT count(*) - count(DISTINCT l_orderkey) AS dropped FROM lineitem")
def p04_dropped(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return CL.drop_duplicates(li, "l_orderkey", ["l_linenumber", "l_quantity"])[1]


# P05 / P06 ------------------------------------------------------------------------------------
P05_COLS = LINE_NUMERIC + LINE_STRINGS + ["status_nulls"]
P06_COLS = ["l_returnflag", "l_linestatus", "flag_padded", "status_nulls", "row_code", "ship_text", "tax_text",
            "price_text"]


@query("p05_constant_columns", line_fx_sql() + ", " + unpivot_sql(
    "v", "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in P05_COLS) + " FROM line_fx", P05_COLS) + """,
c AS (SELECT "column", value, count(*) AS n FROM v GROUP BY "column", value)
SELECT "column", round(max(n) / sum(n), 6) + 0.0 AS top_share, max(n) / sum(n) >= 0.995 AS "drop"
FROM c GROUP BY "column"
""")
def p05(spark, sf):
    df = _fx(spark, sf).select(*P05_COLS)
    return CL.constant_columns(df).select("column", r6(F.col("top_share")).alias("top_share"), "drop")


@query("p06_high_cardinality", line_fx_sql() + ", " + unpivot_sql(
    "v", "SELECT " + ", ".join(P06_COLS) + " FROM line_fx", P06_COLS) + """,
c AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY "column", value)
SELECT "column", round(count(*) / sum(n), 6) + 0.0 AS unique_ratio, count(*) / sum(n) >= 0.95 AS "drop"
FROM c GROUP BY "column"
""")
def p06(spark, sf):
    df = _fx(spark, sf).select(*P06_COLS)
    return CL.high_cardinality_columns(df).select("column", r6(F.col("unique_ratio")).alias("unique_ratio"), "drop")


# P07 / P08 ------------------------------------------------------------------------------------
@query("p07_winsorize", problems.with_sql("orders") + """,
b AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders_train)
SELECT o_orderkey, round(CASE WHEN o_totalprice IS NOT NULL THEN least(greatest(o_totalprice, lo), hi) END, 6) + 0.0
       AS o_totalprice
FROM orders_folds CROSS JOIN b""")
def p07(spark, sf):
    p = problems.orders(spark, sf)
    bounds = CL.winsor_bounds(p.train, ["o_totalprice"])
    both = p.train.select("o_orderkey", "o_totalprice").unionByName(p.test.select("o_orderkey", "o_totalprice"))
    w = CL.winsorize(both, bounds)
    return w.select("o_orderkey", r6(F.col("o_totalprice")).alias("o_totalprice"))


@query("p08_impute_median_mode", line_fx_sql() + """,
b AS (SELECT quantile_cont(l_quantity, 0.01) AS lo, quantile_cont(l_quantity, 0.99) AS hi FROM line_fx),
clipped AS (SELECT l_orderkey, l_linenumber,
                   CASE WHEN l_quantity IS NOT NULL THEN least(greatest(l_quantity, lo), hi) END AS l_quantity,
                   status_nulls FROM line_fx CROSS JOIN b),
med AS (SELECT quantile_cont(l_quantity, 0.5) AS m FROM clipped),
md AS (SELECT status_nulls AS v FROM clipped WHERE status_nulls IS NOT NULL GROUP BY status_nulls
       ORDER BY count(*) DESC, status_nulls LIMIT 1)
SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, m), 6) + 0.0 AS l_quantity,
       coalesce(status_nulls, v) AS status_nulls
FROM clipped CROSS JOIN med CROSS JOIN md""")
def p08(spark, sf):
    df = _fx(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "status_nulls")
    clipped = CL.winsorize(df, CL.winsor_bounds(df, ["l_quantity"]))
    out = CL.impute(clipped, CL.impute_plan(clipped, ["l_quantity"], ["status_nulls"]))
    return out.select("l_orderkey", "l_linenumber", r6(F.col("l_quantity")).alias("l_quantity"), "status_nulls")


# P09 / P10 / P11 ------------------------------------------------------------------------------
@query("p09_sanitize", """
SELECT l_orderkey, l_linenumber,
       round(CASE WHEN l_discount = 0 THEN 0.0 ELSE l_extendedprice / l_discount END, 6) + 0.0 AS price_per_discount
FROM lineitem""")
def p09(spark, sf):
    li = load(spark, sf, "lineitem")
    df = li.select("l_orderkey", "l_linenumber",
                   F.try_divide(F.col("l_extendedprice"), F.col("l_discount")).alias("price_per_discount"))
    out = CL.sanitize(df, ["price_per_discount"])
    return out.withColumn("price_per_discount", r6(F.col("price_per_discount")))


@query("p10_fit_on_train_fill", problems.with_sql("orders") + """,
src AS (SELECT o_orderkey, fold, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders_folds),
med AS (SELECT coalesce(quantile_cont(price, 0.5), 0.0) AS m FROM src WHERE fold <> 0)
SELECT o_orderkey, round(coalesce(price, m), 6) + 0.0 AS price FROM src CROSS JOIN med""")
def p10(spark, sf):
    p = problems.orders(spark, sf)
    price = F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("price")
    tr = p.train.select("o_orderkey", price)
    te = p.test.select("o_orderkey", price)
    fills = CL.fit_fill(tr, ["price"])
    out = CL.apply_fill(tr, fills).unionByName(CL.apply_fill(te, fills))
    return out.withColumn("price", r6(F.col("price")))


@query("p11_sentinel_fill", line_fx_sql() + """
SELECT l_orderkey, l_linenumber, coalesce(l_quantity, -999.0) AS l_quantity FROM line_fx""")
def p11(spark, sf):
    df = _fx(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity")
    return CL.sentinel_fill(df, ["l_quantity"])


# P12 / P13 ------------------------------------------------------------------------------------
@query("p12_label_encode", problems.with_sql("orders") + """,
d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
      FROM (SELECT DISTINCT o_orderstatus AS v FROM orders_train WHERE o_orderstatus IS NOT NULL))
SELECT f.o_orderkey, coalesce(d.code, -1) AS o_orderstatus FROM orders_folds f LEFT JOIN d ON f.o_orderstatus = d.v""")
def p12(spark, sf):
    p = problems.orders(spark, sf)
    dic = CL.label_dictionary(p.train, "o_orderstatus")
    both = p.train.select("o_orderkey", "o_orderstatus").unionByName(p.test.select("o_orderkey", "o_orderstatus"))
    return CL.label_encode(both, "o_orderstatus", dic)


@query("p13_datetime_to_number", "SELECT o_orderkey, coalesce(epoch_us(o_orderdate), 0) AS o_orderdate FROM orders")
def p13(spark, sf):
    o = load(spark, sf, "orders")
    return o.select("o_orderkey", CL.datetime_to_number(F.col("o_orderdate")).alias("o_orderdate"))


@query("p14_column_kinds")
def p14(spark, sf):
    kinds = CL.column_kinds(problems.orders(spark, sf).train)
    return spark.createDataFrame([(c, k) for k, cs in kinds.items() for c in cs], "column string, kind string")


# P15 / P16 / P17 ------------------------------------------------------------------------------
# Non-ASCII, dotted and colliding display names given to the customer columns.
P15_NAMES = ["c_custkey", "Имя клиента", "c.nation key", "c_acctbal €", "Ségment"]


def _p15_expected():
    return CL.ascii_mapping(P15_NAMES, letter_prefix=True)


@query("p15_ascii_names", "SELECT " + ", ".join(
    f'{src} AS "{_p15_expected()[n]}"' for src, n in zip(
        ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], P15_NAMES)) + " FROM customer")
def p15(spark, sf):
    c = load(spark, sf, "customer")
    named = c.toDF(*P15_NAMES)
    m = CL.ascii_mapping(named.columns, letter_prefix=True)
    return named.toDF(*[m[x] for x in named.columns])


def both_sides(train, test):
    """Train and test rows in one frame; a column of one side only is NULL on the other."""
    return (train.withColumn("side", F.lit("train"))
            .unionByName(test.withColumn("side", F.lit("test")), allowMissingColumns=True))


@query("p16_rename_pair", problems.with_sql("orders") + """
SELECT 'train' AS side, o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total_price, o_orderdate, target FROM orders_train
UNION ALL SELECT 'test', o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, NULL FROM orders_test""")
def p16(spark, sf):
    p = problems.orders(spark, sf)
    tr = p.train.withColumnRenamed("o_totalprice", "total price €")
    te = p.test.withColumnRenamed("o_totalprice", "total price €")
    a, b, _ = CL.rename_pair(tr, te)
    return both_sides(a, b)


@query("p17_align_train_test", problems.with_sql("orders") + """
SELECT 'train' AS side, o_orderkey, o_totalprice, 1.0 AS fe_train_only, o_custkey FROM orders_train
UNION ALL SELECT 'test', o_orderkey, o_totalprice, 0.0, o_custkey FROM orders_test""")
def p17(spark, sf):
    p = problems.orders(spark, sf)
    tr = p.train.withColumn("fe_train_only", F.lit(1.0))
    return both_sides(*CL.align(tr, p.test, ["o_totalprice", "fe_train_only", "o_custkey"], keep=["o_orderkey"]))


@query("p18_json_safe_records", """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 3 THEN c_acctbal END AS ratio, c_custkey % 4 <> 3 AS ratio_is_null,
       CASE WHEN c_custkey % 4 = 3 THEN c_acctbal END AS nested, CASE WHEN c_custkey % 4 = 3 THEN c_acctbal END AS in_map,
       c_custkey % 4 <> 3 AS map_is_null
FROM customer""")
def p18(spark, sf):
    """NaN and both infinities, also inside arrays and maps, read back from the JSON text."""
    c = load(spark, sf, "customer")
    k = F.col("c_custkey") % 4
    bad = (F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("c_acctbal")))
    noisy = c.withColumn("ratio", bad).withColumn("list", F.array(F.lit(1.0), bad)).withColumn("map", F.create_map(F.lit("m"), bad))
    at = lambda path: F.get_json_object("json", path)
    return CL.to_json_safe(noisy).select(
        at("$.c_custkey").cast("long").alias("c_custkey"), at("$.c_name").alias("c_name"),
        at("$.ratio").cast("double").alias("ratio"), F.col("json").contains('"ratio":null').alias("ratio_is_null"),
        F.nullif(at("$.list[1]"), F.lit("null")).cast("double").alias("nested"),
        F.nullif(at("$.map.m"), F.lit("null")).cast("double").alias("in_map"), F.col("json").contains('"m":null').alias("map_is_null"))


# P21 / P23 ------------------------------------------------------------------------------------
@query("p23_filters", problems.with_sql("orders") + """
SELECT o_orderkey FROM orders_train
WHERE target = 1 AND o_totalprice IS NOT NULL AND o_totalprice BETWEEN 50000 AND 250000 AND o_orderstatus <> 'P'""")
def p23(spark, sf):
    t = problems.orders(spark, sf).train
    f = CL.dropna(t, ["o_totalprice"])
    return f.where((F.col("target") == 1) & F.col("o_totalprice").between(50000, 250000)
                   & (F.col("o_orderstatus") != "P")).select("o_orderkey")
