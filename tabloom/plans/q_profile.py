"""Queries: profiling (A01-A14, A16-A18), W02 top values, U03 duplicate rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import datetime_columns, rnd, r6
from ..operators import profile as PR
from ..operators.heavy import top_counts
from ..operators.kernels import moments, quantile_wide, numeric_value_counts, top_values, value_counts
from ..session import materialize
from ..sources.tables import load
from . import problems
from .fixtures import LINE_NUMERIC, LINE_STRINGS, line_fx, line_fx_sql, unpivot_sql
from .registry import query

NUM_COLS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in LINE_NUMERIC)
STR_COLS = ", ".join(LINE_STRINGS)
ALL_TEXT = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in LINE_NUMERIC + LINE_STRINGS)
NUM_LONG = unpivot_sql("num", f"SELECT {NUM_COLS} FROM line_fx", LINE_NUMERIC)
ALL_LONG = unpivot_sql("allv", f"SELECT {ALL_TEXT} FROM line_fx", LINE_NUMERIC + LINE_STRINGS)
STR_LONG = unpivot_sql("strv", f"SELECT {STR_COLS} FROM line_fx", LINE_STRINGS)

SKEW_SQL = ("CASE WHEN count(value) < 3 THEN NULL WHEN var_samp(value) = 0 THEN 0.0 ELSE skewness(value) END")
KURT_SQL = ("CASE WHEN count(value) < 4 THEN NULL WHEN var_samp(value) = 0 THEN 0.0 ELSE kurtosis(value) END")


def _round(df, cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


# A01 ------------------------------------------------------------------------------------------
A01_SQL = line_fx_sql() + f""", {NUM_LONG}, {ALL_LONG},
base AS (SELECT "column", count(*) AS total, count(value) AS non_null, count(*) - count(value) AS null_count,
                round(coalesce((count(*) - count(value)) / nullif(count(*), 0), 0.0), 4) AS null_ratio,
                count(DISTINCT value) AS unique_count,
                round(coalesce(count(DISTINCT value) / nullif(count(value), 0), 0.0), 4) AS unique_ratio
         FROM allv GROUP BY "column"),
mom AS (SELECT "column", CAST(sum(TRY_CAST(value AS DECIMAL(38,18))) AS DOUBLE) / count(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
               {SKEW_SQL} AS skew, {KURT_SQL} AS kurt,
               quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
               quantile_cont(value, 0.75) AS q75
        FROM num GROUP BY "column"),
outl AS (SELECT n."column", count(*) FILTER (WHERE n.value < m.q25 - 1.5 * (m.q75 - m.q25)
                                           OR n.value > m.q75 + 1.5 * (m.q75 - m.q25)) AS outliers
         FROM num n JOIN mom m USING ("column") GROUP BY n."column"),
vcs AS (SELECT "column", value, count(*) AS n FROM allv
        WHERE value IS NOT NULL AND "column" IN ('l_returnflag', 'l_linestatus', 'flag_padded') GROUP BY "column", value),
t5 AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rnk FROM vcs
       QUALIFY rnk <= 5),
t5a AS (SELECT "column", min(value) FILTER (WHERE rnk = 1) AS mode, string_agg(value, ',' ORDER BY rnk) AS top5
        FROM t5 GROUP BY "column")
SELECT b."column", b.total, b.non_null, b.null_count, b.null_ratio + 0.0 AS null_ratio, b.unique_count,
       b.unique_ratio + 0.0 AS unique_ratio,
       round(m.mean, 6) + 0.0 AS mean, round(m.std, 6) + 0.0 AS std, round(m.min, 6) + 0.0 AS min,
       round(m.max, 6) + 0.0 AS max, round(m.skew, 6) + 0.0 AS skew, round(m.kurt, 6) + 0.0 AS kurt,
       round(m.q25, 6) + 0.0 AS q25, round(m.median, 6) + 0.0 AS median, round(m.q75, 6) + 0.0 AS q75,
       o.outliers, t.mode, t.top5
FROM base b LEFT JOIN mom m USING ("column") LEFT JOIN outl o USING ("column") LEFT JOIN t5a t USING ("column")"""

PROFILE_COLS = ["column", "total", "non_null", "null_count", "null_ratio", "unique_count", "unique_ratio",
                "mean", "std", "min", "max", "skew", "kurt", "q25", "median", "q75", "outliers", "mode", "top5"]


@query("a01_profile_lineitem", A01_SQL)
def a01(spark, sf):
    prof = PR.column_profile(line_fx(spark, sf), LINE_NUMERIC + LINE_STRINGS)
    return _round(prof.select(*PROFILE_COLS), {"null_ratio", "unique_ratio", "mean", "std", "min", "max", "skew",
                                               "kurt", "q25", "median", "q75"})


# A02 ------------------------------------------------------------------------------------------
A02_SQL = line_fx_sql() + f""", {NUM_LONG}, {ALL_LONG},
base AS (SELECT "column", count(value) AS non_null,
                round(coalesce((count(*) - count(value)) / nullif(count(*), 0), 0.0), 4) + 0.0 AS null_ratio
         FROM allv GROUP BY "column"),
mom AS (SELECT "column", round(CAST(sum(TRY_CAST(value AS DECIMAL(38,18))) AS DOUBLE) / count(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std FROM num GROUP BY "column"),
vcs AS (SELECT "column", value, count(*) AS n FROM allv
        WHERE value IS NOT NULL AND "column" IN ('l_returnflag', 'l_linestatus', 'flag_padded') GROUP BY "column", value),
t5 AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rnk FROM vcs QUALIFY rnk <= 5),
t5a AS (SELECT "column", string_agg(value, ',' ORDER BY rnk) AS top5 FROM t5 GROUP BY "column")
SELECT "column", CASE WHEN m."column" IS NULL THEN 'other' ELSE 'numeric' END AS kind, non_null, null_ratio,
       m.mean, m.std, t.top5
FROM base b LEFT JOIN mom m USING ("column") LEFT JOIN t5a t USING ("column")"""


@query("a02_column_summary", A02_SQL)
def a02(spark, sf):
    df = line_fx(spark, sf)
    vc = value_counts(df, LINE_NUMERIC + LINE_STRINGS)
    base = vc.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("non_null"),
        rnd(F.coalesce(F.try_divide(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)),
                                        F.sum("n")), F.lit(0.0)), 4).alias("null_ratio"))
    m = moments(df, LINE_NUMERIC).select("column", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))
    t5 = PR.top5_text(vc.where(F.col("column").isin(LINE_STRINGS))).select("column", "top5")
    out = base.join(m, "column", "left").join(t5, "column", "left")
    return out.select("column", F.when(F.col("column").isin(LINE_NUMERIC), "numeric").otherwise("other").alias("kind"),
                      "non_null", r6(F.col("null_ratio")).alias("null_ratio"), "mean", "std", "top5")


# A03 ------------------------------------------------------------------------------------------
DUP_ORDERS_SQL = """
dup_orders AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 100 = 1)"""
ORD_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
ORD_STR = ["o_orderstatus", "o_orderpriority"]


def dup_orders(spark, sf):
    o = load(spark, sf, "orders")
    return o.unionByName(o.where(F.col("o_orderkey") % 100 == 1))


A03_SQL = "WITH " + DUP_ORDERS_SQL + f""",
{unpivot_sql("allv", "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in ORD_NUM + ORD_STR)
                + " FROM dup_orders", ORD_NUM + ORD_STR)},
{unpivot_sql("num", "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ORD_NUM) + " FROM dup_orders",
             ORD_NUM)},
base AS (SELECT "column", count(*) - count(value) AS null_count,
                round(100.0 * (count(*) - count(value)) / count(*), 2) + 0.0 AS null_pct,
                count(DISTINCT value) AS nunique FROM allv GROUP BY "column"),
mom AS (SELECT "column", round(min(value), 4) + 0.0 AS min, round(max(value), 4) + 0.0 AS max,
               round(CAST(sum(TRY_CAST(value AS DECIMAL(38,18))) AS DOUBLE) / count(value), 4) + 0.0 AS mean, round(stddev_samp(value), 4) + 0.0 AS std FROM num GROUP BY "column"),
vcs AS (SELECT "column", value, count(*) AS n FROM allv WHERE value IS NOT NULL
        AND "column" IN ('o_orderstatus', 'o_orderpriority') GROUP BY "column", value),
t5 AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rnk FROM vcs QUALIFY rnk <= 5),
t5a AS (SELECT "column", string_agg(value, ',' ORDER BY rnk) AS top5 FROM t5 GROUP BY "column"),
shape AS (SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS duplicate_rows
          FROM dup_orders)
SELECT b."column", s.n_rows, 6 AS n_cols, b.null_count, b.null_pct, b.nunique, m.min, m.max, m.mean, m.std, t.top5,
       s.duplicate_rows, b.null_pct > 30 AS flagged
FROM base b LEFT JOIN mom m USING ("column") LEFT JOIN t5a t USING ("column") CROSS JOIN shape s"""


@query("a03_table_info_orders", A03_SQL)
def a03(spark, sf):
    from ..operators.joins import duplicate_rows
    df = dup_orders(spark, sf)
    vc = value_counts(df, ORD_NUM + ORD_STR)
    base = vc.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).cast("long").alias("null_count"),
        F.sum("n").alias("_t"), F.count("value").alias("nunique"))
    base = base.withColumn("null_pct", rnd(F.col("null_count") * 100.0 / F.col("_t"), 2) + F.lit(0.0))
    m = moments(df, ORD_NUM).select("column", *[(rnd(F.col(c), 4) + F.lit(0.0)).alias(c)
                                                for c in ("min", "max", "mean", "std")])
    t5 = PR.top5_text(vc.where(F.col("column").isin(ORD_STR))).select("column", "top5")
    n_rows, dups = duplicate_rows(df).first()
    return (base.join(m, "column", "left").join(t5, "column", "left")
            .select("column", F.lit(n_rows).cast("long").alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"),
                    "null_count", "null_pct", "nunique", "min", "max", "mean", "std", "top5",
                    F.lit(dups).cast("long").alias("duplicate_rows"), (F.col("null_pct") > 30).alias("flagged")))


# A04 / A05 / A06 ------------------------------------------------------------------------------
A04_SQL = line_fx_sql() + f""", {NUM_LONG}
SELECT "column", count(value) AS n, round({SKEW_SQL}, 6) + 0.0 AS skew FROM num GROUP BY "column"
"""
A05_SQL = line_fx_sql() + f""", {NUM_LONG}
SELECT "column", count(value) AS n, round({KURT_SQL}, 6) + 0.0 AS kurt FROM num GROUP BY "column"
"""
A06_SQL = line_fx_sql() + f""", {NUM_LONG},
q AS (SELECT "column", quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75 FROM num GROUP BY "column")
SELECT "column", round(q25, 6) + 0.0 AS q25, round(q75, 6) + 0.0 AS q75,
       count(*) FILTER (WHERE value < q25 - 1.5 * (q75 - q25) OR value > q75 + 1.5 * (q75 - q25)) AS outliers
FROM num JOIN q USING ("column") GROUP BY "column", q25, q75"""


@query("a04_skewness", A04_SQL)
def a04(spark, sf):
    m = moments(line_fx(spark, sf), LINE_NUMERIC)
    return m.select("column", "n", r6(F.col("skew")).alias("skew"))


@query("a05_kurtosis", A05_SQL)
def a05(spark, sf):
    m = moments(line_fx(spark, sf), LINE_NUMERIC)
    return m.select("column", "n", r6(F.col("kurt")).alias("kurt"))


@query("a06_iqr_outliers", A06_SQL)
def a06(spark, sf):
    nvc = materialize(numeric_value_counts(line_fx(spark, sf), LINE_NUMERIC), "value-counts")
    q = quantile_wide(None, None, {"q25": 0.25, "q75": 0.75}, vc=nvc)
    oc = PR.outlier_counts(nvc, q)
    return q.join(oc, "column").select("column", r6(F.col("q25")).alias("q25"), r6(F.col("q75")).alias("q75"),
                                       "outliers")


# A07 / A08 ------------------------------------------------------------------------------------
A07_SQL = problems.with_sql("orders") + """
SELECT target AS value, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS ratio
FROM orders_train GROUP BY target"""


@query("a07_class_balance", A07_SQL)
def a07(spark, sf):
    cb = PR.class_balance(problems.orders(spark, sf).train, "target")
    return cb.select("value", "count", r6(F.col("ratio")).alias("ratio"))


A08_SQL = line_fx_sql() + f""",
{unpivot_sql("numt", f"SELECT target, {NUM_COLS} FROM line_fx", LINE_NUMERIC)}
SELECT "column", target AS class, round(CAST(sum(TRY_CAST(value AS DECIMAL(38,18))) AS DOUBLE) / count(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS std
FROM numt GROUP BY "column", target"""


@query("a08_per_class_moments", A08_SQL)
def a08(spark, sf):
    m = PR.per_class_moments(line_fx(spark, sf), LINE_NUMERIC, "target")
    return m.select("column", "class", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


# A09 ------------------------------------------------------------------------------------------
NT_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
A09_SQL = line_fx_sql() + f""",
{unpivot_sql("num", "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NT_NUMS) + " FROM line_fx",
             NT_NUMS)},
m AS (SELECT "column", count(value)::DOUBLE AS n, var_samp(value) AS v,
             skewness(value) * (count(value) - 2) / sqrt(count(value)::DOUBLE * (count(value) - 1)) AS g,
             kurtosis_pop(value) AS k FROM num GROUP BY "column"),
a AS (SELECT *, g * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
             3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
             (k + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
             6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s
      FROM m),
b AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, 6 + (8 / s) * (2 / s + sqrt(1 + 4 / (s * s))) AS aa FROM a),
c AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) * asinh(y / sqrt(2 / (w2 - 1))) AS z1,
             1 + x * sqrt(2 / (aa - 4)) AS d FROM b),
z AS (SELECT *, ((1 - 2 / (9 * aa)) - sign(d) * pow((1 - 2 / aa) / abs(d), 1.0 / 3.0)) / sqrt(2 / (9 * aa)) AS z2 FROM c)
SELECT "column", CAST(n AS BIGINT) AS n,
       round(CASE WHEN n > 5000 AND v > 0 THEN exp(-(z1 * z1 + z2 * z2) / 2) END, 6) + 0.0 AS normal_p FROM z"""


@query("a09_normaltest", A09_SQL)
def a09(spark, sf):
    nt = PR.normality(line_fx(spark, sf), NT_NUMS)
    return nt.select("column", "n", r6(F.col("normal_p")).alias("normal_p"))


# A12 / A13 / A14 ------------------------------------------------------------------------------
A12_SQL = line_fx_sql() + f""", {STR_LONG},
vc AS (SELECT "column", value, count(*) AS n FROM strv WHERE value IS NOT NULL GROUP BY "column", value)
SELECT "column", round(-sum(n / t * ln(n / t)), 6) + 0.0 AS entropy
FROM (SELECT *, sum(n) OVER (PARTITION BY "column") AS t FROM vc) GROUP BY "column"
"""


@query("a12_entropy", A12_SQL)
def a12(spark, sf):
    e = PR.entropy(line_fx(spark, sf), LINE_STRINGS)
    return e.select("column", r6(F.col("entropy")).alias("entropy"))


A13M_SQL = """SELECT month(o_orderdate) AS month, count(*) AS count FROM orders
WHERE o_orderdate IS NOT NULL GROUP BY month(o_orderdate)"""
A13W_SQL = """SELECT isodow(ts) - 1 AS weekday, count(*) AS count FROM events WHERE ts IS NOT NULL GROUP BY isodow(ts) - 1"""


@query("a13_datetime_by_month", A13M_SQL)
def a13m(spark, sf):
    return PR.datetime_counts(load(spark, sf, "orders"), "o_orderdate")[0]


@query("a13_datetime_by_weekday", A13W_SQL)
def a13w(spark, sf):
    return PR.datetime_counts(load(spark, sf, "events"), "ts")[1]


A14_SQL = """
WITH p AS (SELECT epoch(o_orderdate) AS t, row_number() OVER (ORDER BY o_orderdate) AS pos FROM orders
           WHERE o_orderdate IS NOT NULL)
SELECT count(*) AS n, round(regr_slope(t, pos), 6) + 0.0 AS slope, round(regr_r2(t, pos), 6) + 0.0 AS r2 FROM p"""


@query("a14_datetime_trend", A14_SQL)
def a14(spark, sf):
    t = PR.datetime_trend(load(spark, sf, "orders"), "o_orderdate")
    return t.select("n", r6(F.col("slope")).alias("slope"), r6(F.col("r2")).alias("r2"))


@query("a14_datetime_report")
def a14_report(spark, sf):
    """Slope, r2, p and trend flag of every datetime column of orders and lineitem."""
    out = None
    for t in ("orders", "lineitem"):
        df = load(spark, sf, t)
        part = PR.datetime_report(df, datetime_columns(df)).withColumn("table", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out.select("table", "column", "n", *[r6(F.col(c)).alias(c) for c in ("slope", "r2", "p")], "has_trend")


# A16 / A17 / A18 ------------------------------------------------------------------------------
A16_SQL = line_fx_sql() + f""",
{unpivot_sql("strt", "SELECT target, l_linestatus, flag_padded FROM line_fx", ["l_linestatus", "flag_padded"])},
r AS (SELECT "column", value, avg(target) AS rate FROM strt WHERE value IS NOT NULL AND target IS NOT NULL
      GROUP BY "column", value)
SELECT "column", round(max(rate) - min(rate), 6) + 0.0 AS spread,
       CASE WHEN max(rate) - min(rate) > 0.15 THEN 'high' WHEN max(rate) - min(rate) > 0.05 THEN 'medium'
            ELSE 'low' END AS band
FROM r GROUP BY "column"
"""


@query("a16_target_rate_spread", A16_SQL)
def a16(spark, sf):
    sp = PR.target_rate_spread(line_fx(spark, sf), ["l_linestatus", "flag_padded"], "target")
    return sp.select("column", r6(F.col("spread")).alias("spread"), "band")


EDA_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "const_col"]
EDA_STRS = ["l_linestatus", "flag_padded"]
A17_SQL = line_fx_sql() + f""",
{unpivot_sql("numt", "SELECT target, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in EDA_NUMS) + " FROM line_fx",
             EDA_NUMS)},
{unpivot_sql("strt", "SELECT target, " + ", ".join(EDA_STRS) + " FROM line_fx", EDA_STRS)},
nrep AS (SELECT "column", 'numeric' AS kind, (count(*) - count(value)) / count(*) AS null_ratio, CAST(sum(TRY_CAST(value AS DECIMAL(38,18))) AS DOUBLE) / count(value) AS mean,
                stddev_samp(value) AS std, min(value) AS min, max(value) AS max, {SKEW_SQL} AS skew,
                covar_samp(CASE WHEN value IS NOT NULL THEN target END, CASE WHEN value IS NOT NULL THEN value END)
                  / nullif(stddev_samp(CASE WHEN value IS NOT NULL THEN target END) * stddev_samp(value), 0) AS corr,
                count(DISTINCT value) AS unique_count, NULL::DOUBLE AS spread
         FROM numt GROUP BY "column"),
r AS (SELECT "column", value, avg(target) AS rate FROM strt WHERE value IS NOT NULL GROUP BY "column", value),
crep AS (SELECT s."column", 'other' AS kind, (count(*) - count(s.value)) / count(*) AS null_ratio, NULL::DOUBLE AS mean,
                NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS skew, NULL::DOUBLE AS corr,
                count(DISTINCT s.value) AS unique_count,
                (SELECT max(rate) - min(rate) FROM r WHERE r."column" = s."column") AS spread
         FROM strt s GROUP BY s."column"),
rep AS (SELECT * FROM nrep UNION ALL SELECT * FROM crep)
SELECT "column", kind, round(null_ratio, 6) + 0.0 AS null_ratio, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std,
       round(min, 6) + 0.0 AS min, round(max, 6) + 0.0 AS max, round(skew, 6) + 0.0 AS skew,
       round(corr, 6) + 0.0 AS corr, unique_count, round(spread, 6) + 0.0 AS spread,
       CASE WHEN kind = 'other' THEN (
         SELECT string_agg(value || '=' || CAST(CAST(round(n * 100.0 / t) AS INTEGER) AS VARCHAR), ',' ORDER BY n DESC, value)
         FROM (SELECT value, n, sum(n) OVER () AS t, row_number() OVER (ORDER BY n DESC, value) AS k
               FROM (SELECT value, count(*) AS n FROM strt WHERE strt."column" = rep."column" AND value IS NOT NULL GROUP BY value))
         WHERE k <= 5) END AS top5 FROM rep"""


def eda_report(df, nums, strs, target):
    """One row per column; numeric part from moments + Pearson, categorical part from spreads."""
    from ..operators.quality import pearson_table
    vc = value_counts(df, nums + strs)
    base = vc.groupBy("column").agg(
        (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("null_ratio"),
        F.count("value").alias("unique_count"))
    m = moments(df, nums).select("column", "mean", "std", "min", "max", "skew")
    p = pearson_table(df, nums, target).withColumnRenamed("feature", "column").withColumnRenamed("pearson", "corr")
    sp = PR.target_rate_spread(df, strs, target).select("column", "spread")
    # the five most frequent values of a categorical column with their whole-percent shares
    svc = vc.where(F.col("column").isin(strs) & F.col("value").isNotNull())
    total = svc.groupBy("column").agg(F.sum("n").alias("t"))
    top = top_values(svc, 5).join(total, "column").groupBy("column").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rnk", "value", F.round(F.col("n") * 100.0 / F.col("t")).cast("int").alias("pct")))),
        lambda s: F.concat(s["value"], F.lit("="), s["pct"].cast("string"))), ",").alias("top5"))
    out = (base.join(m, "column", "left").join(p, "column", "left").join(sp, "column", "left")
           .join(top, "column", "left"))
    return out.select("column", F.when(F.col("column").isin(nums), "numeric").otherwise("other").alias("kind"),
                      *[r6(F.col(c)).alias(c) for c in ("null_ratio", "mean", "std", "min", "max", "skew", "corr")],
                      F.col("unique_count").cast("long").alias("unique_count"), r6(F.col("spread")).alias("spread"), "top5")


@query("a17_eda_report", A17_SQL)
def a17(spark, sf):
    return eda_report(line_fx(spark, sf), EDA_NUMS, EDA_STRS, "target")


A18_SQL = A17_SQL[:A17_SQL.rindex('SELECT "column", kind, round(null_ratio')] + """
SELECT "column", concat_ws(',',
  CASE WHEN kind = 'numeric' THEN CASE WHEN abs(corr) > 0.15 THEN 'corr_strong' WHEN abs(corr) > 0.05 THEN 'corr_weak'
       ELSE 'corr_none' END
       ELSE CASE WHEN spread > 0.15 THEN 'spread_strong' WHEN spread > 0.05 THEN 'spread_weak' ELSE 'spread_none' END END,
  CASE WHEN kind = 'numeric' THEN CASE WHEN abs(skew) > 3 THEN 'skew_heavy' WHEN abs(skew) > 1 THEN 'skew_moderate' END END,
  CASE WHEN null_ratio > 0.2 THEN 'null_high' WHEN null_ratio > 0.05 THEN 'null_some' END,
  CASE WHEN unique_count <= 2 THEN 'binary' WHEN unique_count <= 6 THEN 'low_cardinality'
       WHEN unique_count > 50 THEN 'high_cardinality' END) AS findings
FROM rep"""


@query("a18_findings", A18_SQL)
def a18(spark, sf):
    rep = eda_report(line_fx(spark, sf), EDA_NUMS, EDA_STRS, "target")
    return PR.findings(rep.where(F.col("kind") == "numeric"), rep.where(F.col("kind") == "other"))


# W02 / U03 ------------------------------------------------------------------------------------
W02_SQL = """
WITH s AS (SELECT * FROM (SELECT o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders)
           UNPIVOT INCLUDE NULLS (value FOR "column" IN (o_orderstatus, o_orderpriority, o_custkey))),
vc AS (SELECT "column", value, count(*) AS n FROM s WHERE value IS NOT NULL GROUP BY "column", value)
SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rnk FROM vc QUALIFY rnk <= 5"""


@query("w02_top5_values", W02_SQL)
def w02(spark, sf):
    top = top_counts(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"], 5)
    return top.select("column", "value", "n", F.col("rnk").cast("long").alias("rnk"))


U03_SQL = "WITH " + DUP_ORDERS_SQL + """
SELECT count(*) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dup_orders)) AS duplicate_rows
FROM dup_orders"""


@query("u03_duplicate_rows", U03_SQL)
def u03(spark, sf):
    from ..operators.joins import duplicate_rows
    return duplicate_rows(dup_orders(spark, sf))
