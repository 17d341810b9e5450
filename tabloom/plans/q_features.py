"""Queries: feature constructors F01-F20, X01 and the 1:N aggregates A29-A32.

Fitted on the training split, applied to every labelled row (train and test),
output (id, feature...) rounded to 6 dp.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cols import r6, rnd
from ..operators import features as FE
from ..operators import joins as JN
from ..operators.kernels import exact_mean
from ..operators.rolling import recent_against_year
from ..sources.tables import load
from . import problems
from .fixtures import line_fx, line_fx_sql
from .registry import query

OC_SQL = problems.with_sql("orders") + """,
oc_all AS (SELECT f.*, c.c_acctbal, c.c_mktsegment, c.c_nationkey FROM orders_folds f
           LEFT JOIN customer c ON f.o_custkey = c.c_custkey),
oc_train AS (SELECT * FROM oc_all WHERE fold <> 0)"""


def orders_with_customer(spark, sf):
    """(problem, all labelled rows + customer columns, train part) for the orders problem."""
    p = problems.orders(spark, sf)
    cust = load(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    every = JN.join(p.folds, cust, "o_custkey", "c_custkey", "left")
    return p, every, every.where(F.col("fold") != 0)


def _out(df, key, names):
    return df.select(*key, *[r6(F.col(n)).alias(n) for n in names])


# F01 / F02 / F19 ------------------------------------------------------------------------------
@query("f01_numeric_map", OC_SQL + """,
d AS (SELECT c_custkey, min(c_acctbal) AS v FROM customer GROUP BY c_custkey),
med AS (SELECT quantile_cont(v, 0.5) AS m FROM d)
SELECT f.o_orderkey, round(coalesce(d.v, med.m), 6) + 0.0 AS fe_acctbal
FROM orders_folds f LEFT JOIN d ON f.o_custkey = d.c_custkey CROSS JOIN med""")
def f01(spark, sf):
    p = problems.orders(spark, sf)
    fit = FE.numeric_map("fe_acctbal", load(spark, sf, "customer"), "c_custkey", "c_acctbal", left_key="o_custkey")
    return _out(fit.transform(p.folds.select("o_orderkey", "o_custkey")), ["o_orderkey"], ["fe_acctbal"])


@query("f02_freq_encoding", OC_SQL + """,
fq AS (SELECT o_orderstatus AS c, count(*) / (SELECT count(o_orderstatus) FROM orders_train) AS f
       FROM orders_train WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus)
SELECT a.o_orderkey, round(coalesce(fq.f, 0.0), 6) + 0.0 AS fe_freq_status
FROM orders_folds a LEFT JOIN fq ON a.o_orderstatus = fq.c""")
def f02(spark, sf):
    p = problems.orders(spark, sf)
    fit = FE.freq_encoding("fe_freq_status", p.train, "o_orderstatus")
    return _out(fit.transform(p.folds.select("o_orderkey", "o_orderstatus")), ["o_orderkey"], ["fe_freq_status"])


@query("f02_freq_encoding_via_key", """
WITH d AS (SELECT c_custkey, min(c_mktsegment) AS v FROM customer GROUP BY c_custkey),
fq AS (SELECT c_mktsegment AS c, count(*) / (SELECT count(c_mktsegment) FROM customer) AS f
       FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
SELECT o.o_orderkey, round(coalesce(fq.f, 0.0), 6) + 0.0 AS fb_freq_c_mktsegment
FROM orders o LEFT JOIN d ON o.o_custkey = d.c_custkey LEFT JOIN fq ON d.v = fq.c""")
def f02k(spark, sf):
    cust = load(spark, sf, "customer")
    fit = FE.freq_encoding("fb_freq_c_mktsegment", cust, "c_mktsegment", key="o_custkey", aux_key="c_custkey")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return _out(fit.transform(o), ["o_orderkey"], ["fb_freq_c_mktsegment"])


@query("f19_count_encoding", OC_SQL + """,
fq AS (SELECT o_orderstatus AS c, CAST(count(*) AS DOUBLE) AS f FROM orders_train
       WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus)
SELECT a.o_orderkey, coalesce(fq.f, 0.0) AS fe_cnt_status FROM orders_folds a LEFT JOIN fq ON a.o_orderstatus = fq.c""")
def f19(spark, sf):
    p = problems.orders(spark, sf)
    fit = FE.count_encoding("fe_cnt_status", p.train, "o_orderstatus")
    return _out(fit.transform(p.folds.select("o_orderkey", "o_orderstatus")), ["o_orderkey"], ["fe_cnt_status"])


# F03 / F14 ------------------------------------------------------------------------------------
@query("f03_target_encoding", OC_SQL + """,
te AS (SELECT o_orderstatus AS c, avg(target) AS m FROM orders_train GROUP BY o_orderstatus),
g AS (SELECT avg(target) AS gm FROM orders_train)
SELECT a.o_orderkey, round(coalesce(te.m, g.gm), 6) + 0.0 AS fe_te_status
FROM orders_folds a LEFT JOIN te ON a.o_orderstatus = te.c CROSS JOIN g""")
def f03(spark, sf):
    p = problems.orders(spark, sf)
    fit = FE.target_encoding("fe_te_status", p.train, "o_orderstatus", "target")
    return _out(fit.transform(p.folds.select("o_orderkey", "o_orderstatus")), ["o_orderkey"], ["fe_te_status"])


@query("f03_target_encoding_oof", OC_SQL + """,
per AS (SELECT o_orderstatus AS c, fold, sum(target) AS s, count(*) AS n FROM orders_train_f GROUP BY o_orderstatus, fold),
tot AS (SELECT c, sum(s) AS ts, sum(n) AS tn FROM per GROUP BY c),
te AS (SELECT o_orderstatus AS c, avg(target) AS m FROM orders_train GROUP BY o_orderstatus),
g AS (SELECT avg(target) AS gm FROM orders_train)
SELECT a.o_orderkey,
       round(CASE WHEN a.fold <> 0 THEN coalesce((tot.ts - per.s) / nullif(tot.tn - per.n, 0), g.gm)
                  ELSE coalesce(te.m, g.gm) END, 6) + 0.0 AS fe_te_oof_status
FROM orders_folds a LEFT JOIN per ON a.o_orderstatus IS NOT DISTINCT FROM per.c AND a.fold = per.fold
LEFT JOIN tot ON a.o_orderstatus IS NOT DISTINCT FROM tot.c LEFT JOIN te ON a.o_orderstatus = te.c CROSS JOIN g"""
       .replace("orders_train_f", "(SELECT * FROM orders_folds WHERE fold <> 0)"))
def f03oof(spark, sf):
    p = problems.orders(spark, sf)
    tr = p.folds.where(F.col("fold") != 0)
    fit = FE.target_encoding("fe_te_oof_status", tr, "o_orderstatus", "target", fold="fold")
    a = fit.transform(tr.select("o_orderkey", "o_orderstatus", "fold"))
    b = fit.transform(p.test.select("o_orderkey", "o_orderstatus"))
    return _out(a.select("o_orderkey", "fe_te_oof_status").unionByName(b.select("o_orderkey", "fe_te_oof_status")),
                ["o_orderkey"], ["fe_te_oof_status"])


@query("f14_interaction", OC_SQL + """,
x AS (SELECT *, concat_ws('_', o_orderstatus, c_mktsegment) AS cat FROM oc_all),
te AS (SELECT cat, avg(target) AS m FROM x WHERE fold <> 0 GROUP BY cat),
g AS (SELECT avg(target) AS gm FROM orders_train)
SELECT x.o_orderkey, round(coalesce(te.m, g.gm), 6) + 0.0 AS fe_status_x_segment
FROM x LEFT JOIN te USING (cat) CROSS JOIN g""")
def f14(spark, sf):
    p, every, tr = orders_with_customer(spark, sf)
    fit = FE.interaction("fe_status_x_segment", tr, ["o_orderstatus", "c_mktsegment"], "target")
    return _out(fit.transform(every.select("o_orderkey", "o_orderstatus", "c_mktsegment")), ["o_orderkey"],
                ["fe_status_x_segment"])


@query("f15_cooccurrence", OC_SQL + """,
cc AS (SELECT o_orderstatus, c_mktsegment, count(*) AS n FROM oc_train GROUP BY o_orderstatus, c_mktsegment)
SELECT a.o_orderkey, coalesce(CAST(cc.n AS DOUBLE), 0.0) AS fe_cooc
FROM oc_all a LEFT JOIN cc ON a.o_orderstatus IS NOT DISTINCT FROM cc.o_orderstatus
                           AND a.c_mktsegment IS NOT DISTINCT FROM cc.c_mktsegment""")
def f15(spark, sf):
    p, every, tr = orders_with_customer(spark, sf)
    fit = FE.cooccurrence("fe_cooc", tr, "o_orderstatus", "c_mktsegment")
    return _out(fit.transform(every.select("o_orderkey", "o_orderstatus", "c_mktsegment")), ["o_orderkey"], ["fe_cooc"])


# F04 / F10 / F11 / F12 ------------------------------------------------------------------------
MONTH_CASE = "CASE lower(strftime(o_orderdate, '%b')) " + " ".join(
    f"WHEN '{k}' THEN {float(v)}" for k, v in FE.MONTHS.items()) + " END"


@query("f04_ordinal_map", f"""
SELECT o_orderkey, coalesce({MONTH_CASE}, 0.0) AS fe_month_ord FROM orders""")
def f04(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM").alias("_mon"))
    fit = FE.ordinal_map("fe_month_ord", "_mon", FE.MONTHS)
    return fit.transform(o).select("o_orderkey", "fe_month_ord")


@query("f10_cyclic", """
SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12.0), 6) + 0.0 AS fe_month_sin,
       round(cos(2 * pi() * month(o_orderdate) / 12.0), 6) + 0.0 AS fe_month_cos FROM orders""")
def f10(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", F.month("o_orderdate").alias("_m"))
    o = FE.apply_all(o, [FE.cyclic("fe_month_sin", "_m", 12, "sin"), FE.cyclic("fe_month_cos", "_m", 12, "cos")])
    return _out(o, ["o_orderkey"], ["fe_month_sin", "fe_month_cos"])


@query("f11_date_diff", """
SELECT l.l_orderkey, l.l_linenumber,
       CAST(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE)) AS DOUBLE) AS fe_ship_delay,
       CAST(date_diff('day', DATE '1992-01-01', CAST(l.l_shipdate AS DATE)) AS DOUBLE) AS fe_days_since_1992
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")
def f11(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    j = FE.apply_all(j, [FE.date_diff("fe_ship_delay", "l_shipdate", "o_orderdate"),
                         FE.date_diff("fe_days_since_1992", "l_shipdate", ref="1992-01-01")])
    return j.select("l_orderkey", "l_linenumber", "fe_ship_delay", "fe_days_since_1992")


@query("f12_date_bucket", """
SELECT o_orderkey, CAST(weekofyear(o_orderdate) AS DOUBLE) AS fe_week, CAST(month(o_orderdate) AS DOUBLE) AS fe_month,
       CAST(quarter(o_orderdate) AS DOUBLE) AS fe_quarter FROM orders""")
def f12(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    o = FE.apply_all(o, [FE.date_bucket("fe_week", "o_orderdate", "week"),
                         FE.date_bucket("fe_month", "o_orderdate", "month"),
                         FE.date_bucket("fe_quarter", "o_orderdate", "quarter")])
    return o.select("o_orderkey", "fe_week", "fe_month", "fe_quarter")


# F05 / F06 / F07 / F08 / F16 / F17 / X01 ------------------------------------------------------
@query("f05_ratio", OC_SQL + """
SELECT o_orderkey, round(coalesce(o_totalprice / (c_acctbal + 1e-9), 0.0), 6) + 0.0 AS fe_price_per_balance FROM oc_all""")
def f05(spark, sf):
    p, every, tr = orders_with_customer(spark, sf)
    return _out(FE.ratio("fe_price_per_balance", "o_totalprice", "c_acctbal").transform(every), ["o_orderkey"],
                ["fe_price_per_balance"])


@query("f06_diff_sum_product", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_tax, 6) + 0.0 AS fe_diff,
       round(l_extendedprice + l_tax, 6) + 0.0 AS fe_sum, round(l_extendedprice * l_discount, 6) + 0.0 AS fe_product
FROM lineitem""")
def f06(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_discount")
    li = FE.apply_all(li, [FE.arith("fe_diff", "l_extendedprice", "l_tax", "diff"),
                           FE.arith("fe_sum", "l_extendedprice", "l_tax", "sum"),
                           FE.arith("fe_product", "l_extendedprice", "l_discount", "product")])
    return _out(li, ["l_orderkey", "l_linenumber"], ["fe_diff", "fe_sum", "fe_product"])


@query("f07_group_zscore", OC_SQL + """,
st AS (SELECT o_orderstatus AS g, avg(o_totalprice) AS m, coalesce(stddev_samp(o_totalprice), 0.0) AS s
       FROM orders_train GROUP BY o_orderstatus)
SELECT a.o_orderkey, round(coalesce((a.o_totalprice - st.m) / (st.s + 1e-9), 0.0), 6) + 0.0 AS fe_price_z
FROM orders_folds a LEFT JOIN st ON a.o_orderstatus IS NOT DISTINCT FROM st.g""")
def f07(spark, sf):
    p = problems.orders(spark, sf)
    fit = FE.group_zscore("fe_price_z", p.train, "o_totalprice", "o_orderstatus")
    return _out(fit.transform(p.folds.select("o_orderkey", "o_totalprice", "o_orderstatus")), ["o_orderkey"],
                ["fe_price_z"])


@query("f08_quantile_bin", OC_SQL + """,
e AS (SELECT quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS edges, quantile_cont(o_totalprice, 0.5) AS med
      FROM orders_train)
SELECT a.o_orderkey,
       CASE WHEN a.o_totalprice IS NULL THEN 0.0
            ELSE CAST(len(list_filter(e.edges, lambda x: x < a.o_totalprice)) AS DOUBLE) END AS fe_price_bin,
       coalesce(CAST(a.o_totalprice > e.med AS DOUBLE), 0.0) AS fe_price_above_median
FROM orders_folds a CROSS JOIN e""")
def f08(spark, sf):
    p = problems.orders(spark, sf)
    fits = [FE.quantile_bin("fe_price_bin", p.train, "o_totalprice", 4),
            FE.above_median("fe_price_above_median", p.train, "o_totalprice")]
    out = FE.apply_all(p.folds.select("o_orderkey", "o_totalprice"), fits)
    return out.select("o_orderkey", "fe_price_bin", "fe_price_above_median")


@query("f16_log1p_square", OC_SQL + """,
med AS (SELECT quantile_cont(o_totalprice, 0.5) AS m FROM orders_train)
SELECT a.o_orderkey, round(coalesce(ln(1 + coalesce(a.o_totalprice, med.m)), 0.0), 6) + 0.0 AS fe_log_price,
       round(coalesce(a.o_totalprice, med.m) * coalesce(a.o_totalprice, med.m), 6) + 0.0 AS fe_sq_price
FROM orders_folds a CROSS JOIN med""")
def f16(spark, sf):
    p = problems.orders(spark, sf)
    fits = [FE.log1p("fe_log_price", p.train, "o_totalprice"), FE.square("fe_sq_price", p.train, "o_totalprice")]
    return _out(FE.apply_all(p.folds.select("o_orderkey", "o_totalprice"), fits), ["o_orderkey"],
                ["fe_log_price", "fe_sq_price"])


@query("f17_threshold", "SELECT o_orderkey, CAST(o_totalprice >= 200000 AS DOUBLE) AS fe_big_order FROM orders")
def f17(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return FE.threshold("fe_big_order", "o_totalprice", 200000).transform(o).select("o_orderkey", "fe_big_order")


@query("x01_expression_feature", OC_SQL + """
SELECT o_orderkey, round(coalesce(o_totalprice / (c_acctbal + 1), 0.0), 6) + 0.0 AS fe_expr FROM oc_all""")
def x01(spark, sf):
    p, every, tr = orders_with_customer(spark, sf)
    fit = FE.expression("fe_expr", "try_divide(o_totalprice, c_acctbal + 1)")
    return _out(fit.transform(every), ["o_orderkey"], ["fe_expr"])


# F09 / F18 ------------------------------------------------------------------------------------
@query("f09_flags", line_fx_sql() + """,
q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM line_fx)
SELECT l_orderkey, l_linenumber, coalesce(CAST(l_discount = 0 AS DOUBLE), 0.0) AS fe_zero_discount,
       CAST(l_quantity IS NULL AS DOUBLE) AS fe_qty_missing,
       coalesce(CAST(l_linenumber = 7 AS DOUBLE), 0.0) AS fe_line7,
       coalesce(CAST(l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1) AS DOUBLE), 0.0)
         AS fe_price_outlier
FROM line_fx CROSS JOIN q""")
def f09(spark, sf):
    df = line_fx(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_extendedprice")
    fits = [FE.flag("fe_zero_discount", "l_discount", "is_zero"), FE.flag("fe_qty_missing", "l_quantity", "is_missing"),
            FE.flag("fe_line7", "l_linenumber", "equals", 7),
            FE.flag("fe_price_outlier", "l_extendedprice", "is_outlier", train=df)]
    return FE.apply_all(df, fits).select("l_orderkey", "l_linenumber", "fe_zero_discount", "fe_qty_missing",
                                         "fe_line7", "fe_price_outlier")


@query("f18_rare_group", """
WITH s AS (SELECT event_type, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY event_type)
SELECT e.event_id, CASE WHEN s.share >= 0.1 THEN e.event_type ELSE 'other' END AS event_type_grouped
FROM events e LEFT JOIN s ON e.event_type = s.event_type""")
def f18(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "event_type")
    fit = FE.rare_group("event_type_grouped", ev, "event_type", 0.1)
    return fit.transform(ev).select("event_id", "event_type_grouped")


# F13 and A29-A32 ------------------------------------------------------------------------------
REF = problems.USERS_CUTOFF
F13_SQL = problems.with_sql("users") + f""",
agg AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS fe_n_events, sum(value) AS fe_sum_value,
               avg(value) AS fe_mean_value, stddev_samp(value) AS fe_std_value, max(value) AS fe_max_value,
               min(value) AS fe_min_value, CAST(count(DISTINCT event_type) AS DOUBLE) AS fe_n_types,
               avg(CAST(event_type = 'purchase' AS DOUBLE)) AS fe_purchase_share,
               CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-01-29') AS DOUBLE) AS fe_recency_days,
               sum(CASE WHEN ts >= TIMESTAMP '{REF}' - INTERVAL 7 DAY THEN value ELSE 0.0 END) AS fe_value_last7
        FROM events_hist GROUP BY user_id)
SELECT u.user_id, {", ".join(f"round(coalesce(a.{c}, 0.0), 6) + 0.0 AS {c}" for c in
    ["fe_n_events", "fe_sum_value", "fe_mean_value", "fe_std_value", "fe_max_value", "fe_min_value", "fe_n_types",
     "fe_purchase_share", "fe_recency_days", "fe_value_last7"])}
FROM users_folds u LEFT JOIN agg a USING (user_id)"""


def user_aggregates(hist):
    k = dict(key="user_id")
    return [FE.group_aggregate("fe_n_events", hist, column=None, how="count", **k),
            FE.group_aggregate("fe_sum_value", hist, column="value", how="sum", **k),
            FE.group_aggregate("fe_mean_value", hist, column="value", how="mean", **k),
            FE.group_aggregate("fe_std_value", hist, column="value", how="std", **k),
            FE.group_aggregate("fe_max_value", hist, column="value", how="max", **k),
            FE.group_aggregate("fe_min_value", hist, column="value", how="min", **k),
            FE.group_aggregate("fe_n_types", hist, column="event_type", how="nunique", **k),
            FE.group_aggregate("fe_purchase_share", hist, column="event_type", how="share", value="purchase", **k),
            FE.group_aggregate("fe_recency_days", hist, column="ts", how="recency", ref=REF, **k),
            FE.group_aggregate("fe_value_last7", hist, column="value", how="window_sum", ref=REF, days=7, ts="ts", **k)]


@query("f13_group_aggregates", F13_SQL)
def f13(spark, sf):
    p = problems.users(spark, sf)
    fits = user_aggregates(p.aux["events"])
    out = FE.apply_all(p.folds.select("user_id"), fits)
    return _out(out, ["user_id"], [f.name for f in fits])


@query("a29_group_aggregates", """
SELECT user_id, count(*) AS n, round(sum(value), 6) + 0.0 AS sum_value, round(CAST(sum(TRY_CAST(value AS DECIMAL(38,18))) AS DOUBLE) / count(value), 6) + 0.0 AS mean_value,
       round(stddev_samp(value), 6) + 0.0 AS std_value, max(value) AS max_value, min(value) AS min_value,
       count(DISTINCT event_type) AS nunique_type
FROM events GROUP BY user_id""")
def a29(spark, sf):
    ev = load(spark, sf, "events")
    g = lambda name, column, how: FE.group_aggregate(name, ev, "user_id", column, how)
    fits = [g("n", None, "count"), *[g(f"{h}_value", "value", h) for h in ("sum", "mean", "std", "max", "min")],
            g("nunique_type", "event_type", "nunique")]
    out = FE.apply_all(ev.select("user_id").distinct(), fits)
    return out.select("user_id", F.col("n").cast("long").alias("n"),
                      *[r6(F.col(f"{h}_value")).alias(f"{h}_value") for h in ("sum", "mean", "std")], "max_value", "min_value",
                      F.col("nunique_type").cast("long").alias("nunique_type"))


@query("a30_value_share", """
SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS purchase_share
FROM events GROUP BY user_id""")
def a30(spark, sf):
    ev = load(spark, sf, "events")
    f = FE.group_aggregate("purchase_share", ev, "user_id", "event_type", "share", value="purchase")
    return FE.apply_all(ev.select("user_id").distinct(), [f]).select("user_id", r6(F.col("purchase_share")).alias("purchase_share"))


@query("a31_recency", """
SELECT user_id, date_diff('day', CAST(max(ts) AS DATE), DATE '2024-02-01') AS recency_days FROM events GROUP BY user_id""")
def a31(spark, sf):
    ev = load(spark, sf, "events")
    f = FE.group_aggregate("recency_days", ev, "user_id", "ts", "recency", ref="2024-02-01 00:00:00")
    return FE.apply_all(ev.select("user_id").distinct(), [f]).select(
        "user_id", F.col("recency_days").cast("long").alias("recency_days"))


@query("a32_time_window", """
SELECT user_id,
       round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-24 00:00:00' THEN value ELSE 0.0 END), 6) + 0.0 AS value_last7,
       round(sum(value) / count(DISTINCT CAST(ts AS DATE)), 6) + 0.0 AS value_per_active_day
FROM events GROUP BY user_id""")
def a32(spark, sf):
    ev = load(spark, sf, "events")
    fits = [FE.group_aggregate("value_last7", ev, "user_id", "value", "window_sum", ref="2024-01-31 00:00:00", days=7, ts="ts"),
            FE.group_aggregate("value_per_active_day", ev, "user_id", "value", "per_day", ts="ts")]
    return FE.apply_all(ev.select("user_id").distinct(), fits).select(
        "user_id", *[r6(F.col(f.name)).alias(f.name) for f in fits])


@query("a32_recent_against_year", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS cust, o_orderdate,
                  CAST(o_totalprice AS DECIMAL(28,8)) AS v FROM orders),
s AS (SELECT o_orderkey,
             CAST(sum(v) OVER (PARTITION BY cust ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS recent,
             count(v) OVER (PARTITION BY cust ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS recent_n,
             CAST(sum(v) OVER (PARTITION BY cust ORDER BY o_orderdate RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE)
               * (30.0::DOUBLE / 365.0::DOUBLE) AS yearly_mean
      FROM o)
SELECT o_orderkey, round(recent, 4) + 0.0 AS recent, recent_n, round(yearly_mean, 4) + 0.0 AS yearly_mean,
       round(recent / nullif(yearly_mean, 0), 6) + 0.0 AS recent_ratio FROM s""")
def a32_year(spark, sf):
    """Each order against its customer's last 30 days and year; one customer is given a third of the orders."""
    o = load(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(0)).otherwise(F.col("o_custkey")).alias("cust"), "o_orderdate", "o_totalprice")
    out = recent_against_year(o, o, "cust", "o_orderkey", "o_orderdate", "o_orderdate", "o_totalprice")
    return out.select("o_orderkey", rnd(F.col("recent"), 4).alias("recent"), "recent_n", rnd(F.col("yearly_mean"), 4).alias("yearly_mean"),
                      r6(F.col("recent_ratio")).alias("recent_ratio"))


# F20 ------------------------------------------------------------------------------------------
F20_NUMS = ["o_custkey", "o_totalprice", "c_acctbal", "c_nationkey"]


def _f20_sql():
    med = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.5) AS m_{c}, min(CAST({c} AS DOUBLE)) AS n_{c}" for c in F20_NUMS)
    cols = []
    for c in F20_NUMS:
        x = f"coalesce(CAST(a.{c} AS DOUBLE), s.m_{c})"
        if c != "c_acctbal":  # the only column with a negative train minimum in this data
            cols.append(f"round(coalesce(ln(1 + {x}), 0.0), 6) + 0.0 AS fb_log1p_{c}")
        cols.append(f"round({x} * {x}, 6) + 0.0 AS fb_sq_{c}")
    for i, a in enumerate(F20_NUMS):
        for b in F20_NUMS[i + 1:]:
            xa = f"coalesce(CAST(a.{a} AS DOUBLE), s.m_{a})"
            xb = f"coalesce(CAST(a.{b} AS DOUBLE), s.m_{b})"
            cols.append(f"round(coalesce({xa} / nullif({xb}, 0), 0.0), 6) + 0.0 AS fb_{a}_div_{b}")
    return (OC_SQL + f""",
s AS (SELECT {med} FROM oc_train)
SELECT a.o_orderkey, a.o_custkey, a.o_totalprice, a.c_acctbal, a.c_nationkey, {", ".join(cols)}
FROM oc_train a CROSS JOIN s""")


@query("f20_auto_candidates", _f20_sql())
def f20(spark, sf):
    from .controller import auto_candidates
    p, every, tr = orders_with_customer(spark, sf)
    feats = auto_candidates(tr, F20_NUMS)
    out = FE.apply_all(tr.select("o_orderkey", *F20_NUMS), feats)
    return out.select("o_orderkey", *F20_NUMS, *[r6(F.col(f.name)).alias(f.name) for f in feats])
