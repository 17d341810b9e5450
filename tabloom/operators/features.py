"""Feature constructors F01-F20 and X01.

Every constructor is fit on the training side only and returns a ``Fitted``
whose ``transform`` appends one double column.  Fitted state is either a
DataFrame (lookup tables: joined, Spark decides broadcast by measured size)
or a handful of driver scalars from one-row aggregates.  No per-row Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cols import col, finite, safe_div
from .kernels import exact_mean, quantiles
from .ordering import first_per_key

EPS = 1e-9


@dataclass
class Fitted:
    name: str
    fn: Callable[[DataFrame], DataFrame]
    state: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.fn(df)


def _finish(c: Column) -> Column:
    """NaN / +-inf / NULL -> 0.0, as double."""
    return F.coalesce(finite(c), F.lit(0.0))


def _one(df: DataFrame, *aggs: Column):
    return df.agg(*aggs).first()


def exact_median(df: DataFrame, column: str) -> float | None:
    q = quantiles(df, [column], [0.5]).first()
    return None if q is None else q["value"]


def median_frame(df: DataFrame, column: str, name: str = "_med") -> DataFrame:
    """One-row DataFrame holding the exact median of ``column`` (NULL when there is no value)."""
    # zero rows when the column has no value: attached as a scalar subquery it reads as NULL
    return quantiles(df, [column], [0.5]).select(F.col("value").alias(name))


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a one-row DataFrame to every row as a scalar subquery.

    The subquery runs once and is inlined as a value: no join, no shuffle.  An
    empty ``scalars`` yields NULLs.
    """
    names = scalars.columns
    packed = scalars.select(F.struct(*[F.col(c) for c in names]).alias("_sc")).scalar()
    return df.withColumn("_sc", packed).select("*", *[F.col("_sc")[c].alias(c) for c in names]).drop("_sc")


def lookup(aux: DataFrame, key: str, column: str, order_by: list | None = None) -> DataFrame:
    """First ``column`` per ``key`` of ``aux`` (order_by defaults to the value)."""
    sub = aux.select(col(key).alias("_k"), col(column).alias("_v"))
    return first_per_key(sub, ["_k"], order_by or ["_v"])


# F01 ------------------------------------------------------------------------------------------
def numeric_map(name: str, aux: DataFrame, key: str, column: str, left_key: str | None = None) -> Fitted:
    """Value of ``aux.column`` for the row's key; unmatched -> median of the deduplicated column."""
    table = lookup(aux, key, column)
    med = median_frame(table.select(F.col("_v").cast("double").alias("v")), "v")
    lk = left_key or key

    def fn(df):
        j = with_scalars(df.join(table, col(lk) == F.col("_k"), "left"), med)
        val = F.coalesce(F.col("_v").cast("double"), F.col("_med"))
        return j.withColumn(name, _finish(val)).drop("_k", "_v", "_med")
    return Fitted(name, fn, {"median": med})


# F02 / F19 ------------------------------------------------------------------------------------
def _freq_fitted(name, src, column, key, aux_key, share):
    """Share (or count) of each category in ``src``; rows reach it directly or via ``key``."""
    vc = (src.where(col(column).isNotNull())
          .groupBy(col(column).alias("_c")).agg(F.count(F.lit(1)).alias("_n")))
    if share:
        total = src.agg(F.count(col(column)).alias("_t"))
        table = with_scalars(vc, total).select("_c", (F.col("_n") / F.col("_t")).alias("_f"))
    else:
        table = vc.select("_c", F.col("_n").cast("double").alias("_f"))
    via = lookup(src, aux_key or key, column) if key else None

    def fn(df):
        if via is None:
            j = df.join(table, col(column) == F.col("_c"), "left")
        else:
            j = (df.join(via, col(key) == F.col("_k"), "left")
                 .join(table, F.col("_v") == F.col("_c"), "left").drop("_k", "_v"))
        return j.withColumn(name, _finish(F.col("_f"))).drop("_c", "_f")
    return Fitted(name, fn, {"table": table})


def freq_encoding(name: str, src: DataFrame, column: str, key: str | None = None,
                  aux_key: str | None = None) -> Fitted:
    """share of the category among non-null values of ``src``; unmatched -> 0."""
    return _freq_fitted(name, src, column, key, aux_key, True)


def count_encoding(name: str, src: DataFrame, column: str, key: str | None = None,
                   aux_key: str | None = None) -> Fitted:
    """raw count of the category in ``src``; unmatched -> 0."""
    return _freq_fitted(name, src, column, key, aux_key, False)


# F03 / F14 ------------------------------------------------------------------------------------
def target_encoding(name: str, train: DataFrame, column: str | list[str], target: str,
                    via: tuple[DataFrame, str, str] | None = None, fold: str | None = None) -> Fitted:
    """Mean target per category on train; unseen -> global train mean.

    ``via=(aux, key, aux_key)`` fetches the category from an auxiliary table.
    ``fold`` gives the out-of-fold variant: a train row uses the mean of the
    other folds (sum and count per category and fold, minus its own fold).
    """
    cols = [column] if isinstance(column, str) else list(column)
    # a missing part is text of its own, so that (a, NULL) and (NULL, a) stay apart
    cat = (F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit("nan")) for c in cols]) if len(cols) > 1
           else col(cols[0]))

    def with_cat(df):
        if via is None:
            return df.withColumn("_cat", cat)
        aux, key, aux_key = via
        table = lookup(aux, aux_key, cols[0])
        return df.join(table, col(key) == F.col("_k"), "left").withColumnRenamed("_v", "_cat").drop("_k")

    tr = with_cat(train)
    g = train.agg(F.avg(col(target).cast("double")).alias("_g"))
    means = tr.groupBy("_cat").agg(F.avg(col(target).cast("double")).alias("_te"))
    if fold is None:
        def fn(df):
            j = with_scalars(with_cat(df).join(means, "_cat", "left"), g)
            return j.withColumn(name, _finish(F.coalesce(F.col("_te"), F.col("_g")))).drop("_cat", "_te", "_g")
        return Fitted(name, fn, {"global_mean": g})

    per = tr.groupBy("_cat", col(fold).alias("_fold")).agg(
        F.sum(col(target).cast("double")).alias("_s"), F.count(F.lit(1)).alias("_c"))
    tot = per.groupBy("_cat").agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    # null-safe: rows without a category are a category of their own
    oof = (per.join(tot.withColumnRenamed("_cat", "_tcat"), F.col("_cat").eqNullSafe(F.col("_tcat")))
           .select("_cat", "_fold", safe_div(F.col("_ts") - F.col("_s"), F.col("_tc") - F.col("_c")).alias("_te")))

    def fn_oof(df):
        x = with_cat(df)
        if fold in df.columns:
            j = x.join(oof, (x["_cat"].eqNullSafe(oof["_cat"])) & (col(fold) == oof["_fold"]), "left") \
                .drop(oof["_cat"]).drop("_fold")
        else:
            j = x.join(means, "_cat", "left")
        j = with_scalars(j, g)
        return j.withColumn(name, _finish(F.coalesce(F.col("_te"), F.col("_g")))).drop("_cat", "_te", "_g")
    return Fitted(name, fn_oof, {"global_mean": g})


def interaction(name: str, train: DataFrame, columns: list[str], target: str) -> Fitted:
    """concatenated categories, then target-encoded."""
    return target_encoding(name, train, columns, target)


# F04 ------------------------------------------------------------------------------------------
# Month and weekday ordinal maps stated by the catalogue.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
          "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
WEEKDAYS = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}


def ordinal_map(name: str, column: str, mapping: dict, default: float | None = None) -> Fitted:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(float(v)))])
    d = F.lit(default).cast("double") if default is not None else F.lit(None).cast("double")

    def fn(df):
        return df.withColumn(name, _finish(F.coalesce(F.try_element_at(m, F.lower(F.trim(col(column)))), d)))
    return Fitted(name, fn)


# F05 / F06 / F17 / X01 ------------------------------------------------------------------------
def ratio(name: str, a: str, b: str) -> Fitted:
    return Fitted(name, lambda df: df.withColumn(
        name, _finish(safe_div(col(a), col(b).cast("double") + F.lit(EPS)))))


def arith(name: str, a: str, b: str, op: str) -> Fitted:
    ops = {"diff": lambda x, y: x - y, "sum": lambda x, y: x + y, "product": lambda x, y: x * y}
    f = ops[op]
    return Fitted(name, lambda df: df.withColumn(
        name, _finish(f(col(a).cast("double"), col(b).cast("double")))))


def threshold(name: str, column: str, t: float) -> Fitted:
    return Fitted(name, lambda df: df.withColumn(name, (col(column) >= F.lit(t)).cast("double")))


def expression(name: str, expr: str) -> Fitted:
    """Any Spark SQL expression over the row; result sanitised to a finite double."""
    return Fitted(name, lambda df: df.withColumn(name, _finish(F.expr(expr))))


# F07 ------------------------------------------------------------------------------------------
def group_zscore(name: str, train: DataFrame, column: str, group: str) -> Fitted:
    """(x - mean_g) / (std_g + 1e-9) with train group statistics; unseen groups -> 0."""
    stats = train.groupBy(col(group).alias("_g")).agg(
        F.avg(col(column).cast("double")).alias("_m"),
        F.coalesce(F.stddev_samp(col(column).cast("double")), F.lit(0.0)).alias("_s"))

    def fn(df):
        j = df.join(stats, col(group).eqNullSafe(F.col("_g")), "left")
        z = (col(column).cast("double") - F.col("_m")) / (F.col("_s") + F.lit(EPS))
        return j.withColumn(name, _finish(z)).drop("_g", "_m", "_s")
    return Fitted(name, fn)


# F08 ------------------------------------------------------------------------------------------
def quantile_bin(name: str, train: DataFrame, column: str, n_bins: int = 4) -> Fitted:
    """Bin index = number of train quantile edges (k / n_bins) strictly below x."""
    from .kernels import quantile_edges
    edges = quantile_edges(None, [k / n_bins for k in range(1, n_bins)], train, [column]).select("_edges")

    def fn(df):
        x = col(column).cast("double")
        j = with_scalars(df, edges)
        return j.withColumn(name, F.when(x.isNull(), F.lit(0.0))
                            .otherwise(F.size(F.filter("_edges", lambda e: e < x)).cast("double"))).drop("_edges")
    return Fitted(name, fn, {"edges": edges})


def above_median(name: str, train: DataFrame, column: str) -> Fitted:
    med = median_frame(train, column)
    return Fitted(name, lambda df: with_scalars(df, med).withColumn(
        name, F.coalesce((col(column).cast("double") > F.col("_med")).cast("double"), F.lit(0.0))).drop("_med"),
        {"median": med})


# F09 ------------------------------------------------------------------------------------------
def flag(name: str, column: str, kind: str, value=None, train: DataFrame | None = None) -> Fitted:
    """is_zero | is_missing | equals (sentinel) | is_outlier (train IQR fences)."""
    c = col(column)
    if kind == "is_zero":
        e = F.coalesce((c == 0).cast("double"), F.lit(0.0))
    elif kind == "is_missing":
        e = c.isNull().cast("double")
    elif kind == "equals":
        e = F.coalesce((c == F.lit(value)).cast("double"), F.lit(0.0))
    elif kind == "is_outlier":
        from .kernels import quantile_wide
        q = quantile_wide(train, [column], {"_q1": 0.25, "_q3": 0.75}).select(
            (F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_lo"),
            (F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_hi"))
        x = c.cast("double")
        e = F.coalesce(((x < F.col("_lo")) | (x > F.col("_hi"))).cast("double"), F.lit(0.0))
        return Fitted(name, lambda df: with_scalars(df, q).withColumn(name, e).drop("_lo", "_hi"))
    else:
        raise ValueError(f"unknown flag kind {kind}")
    return Fitted(name, lambda df: df.withColumn(name, e))


# F10 ------------------------------------------------------------------------------------------
def cyclic(name: str, column: str, period: float, fn_name: str = "sin") -> Fitted:
    f = F.sin if fn_name == "sin" else F.cos
    ang = F.lit(2 * math.pi) * col(column).cast("double") / F.lit(float(period))
    return Fitted(name, lambda df: df.withColumn(name, _finish(f(ang))))


# F11 / F12 ------------------------------------------------------------------------------------
def date_diff(name: str, a: str, b: str | None = None, ref: str | None = None) -> Fitted:
    other = col(b) if b else F.lit(ref).cast("timestamp")
    return Fitted(name, lambda df: df.withColumn(
        name, _finish(F.datediff(col(a), other).cast("double"))))


def date_bucket(name: str, column: str, unit: str) -> Fitted:
    units = {"week": F.weekofyear, "month": F.month, "quarter": F.quarter,
             "weekday": lambda c: F.weekday(c), "year": F.year}
    return Fitted(name, lambda df: df.withColumn(name, _finish(units[unit](col(column)).cast("double"))))


# F13 (A29-A32) --------------------------------------------------------------------------------
def group_aggregate(name: str, aux: DataFrame, key: str, column: str | None, how: str,
                    left_key: str | None = None, value=None, ref: str | None = None,
                    days: int | None = None, ts: str | None = None) -> Fitted:
    """One 1:N aggregate per key of ``aux`` attached by a left join; no partner -> 0.

    how: count | sum | mean | std | max | min | nunique | share (col == value) |
    per_day (sum per distinct day of ``ts``) | recency (days from max(col) to ``ref``) | window_sum (sum over the last
    ``days`` before ``ref`` on ``ts``).
    """
    c = col(column) if column else None
    aggs = {
        "count": lambda: F.count(F.lit(1)),
        "sum": lambda: F.sum(c.cast("double")),
        "mean": lambda: exact_mean(c.cast("double")),
        "per_day": lambda: safe_div(F.sum(c.cast("double")), F.count_distinct(F.to_date(col(ts)))),
        "std": lambda: F.stddev_samp(c.cast("double")),
        "max": lambda: F.max(c.cast("double")),
        "min": lambda: F.min(c.cast("double")),
        "nunique": lambda: F.count_distinct(c),
        "share": lambda: F.avg((c == F.lit(value)).cast("double")),
        "recency": lambda: F.datediff(F.lit(ref).cast("timestamp"), F.max(c)),
        "window_sum": lambda: F.sum(F.when(col(ts) >= F.lit(ref).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS"),
                                           c.cast("double")).otherwise(F.lit(0.0))),
    }
    group = {"aux": aux, "key": key, "left_key": left_key or key, "agg": aggs[how]().cast("double")}
    fitted = Fitted(name, lambda df: attach_groups(df, [fitted]), {"group": group})
    return fitted


def attach_groups(df: DataFrame, fits: list[Fitted]) -> DataFrame:
    """Aggregates of one auxiliary table and key: one aggregation, one join."""
    g = fits[0].state["group"]
    cols = {f"_a{i}": f for i, f in enumerate(fits)}
    table = g["aux"].groupBy(col(g["key"]).alias("_k")).agg(
        *[f.state["group"]["agg"].alias(c) for c, f in cols.items()])
    j = df.join(table, col(g["left_key"]) == F.col("_k"), "left")
    return j.withColumns({f.name: _finish(F.col(c)) for c, f in cols.items()}).drop("_k", *cols)


# F15 ------------------------------------------------------------------------------------------
def cooccurrence(name: str, train: DataFrame, a: str, b: str) -> Fitted:
    """Rows of train sharing this (a, b) pair; unseen pair -> 0."""
    table = train.groupBy(col(a).alias("_a"), col(b).alias("_b")).agg(F.count(F.lit(1)).cast("double").alias("_n"))

    def fn(df):
        j = df.join(table, col(a).eqNullSafe(F.col("_a")) & col(b).eqNullSafe(F.col("_b")), "left")
        return j.withColumn(name, _finish(F.col("_n"))).drop("_a", "_b", "_n")
    return Fitted(name, fn)


# F16 ------------------------------------------------------------------------------------------
def log1p(name: str, train: DataFrame, column: str, median: float | None = None,
          minimum: float | None = None) -> Fitted | None:
    """log1p(x) with train-median fill; only when the train minimum is >= 0."""
    mn = minimum if minimum is not None else _one(train, F.min(col(column).cast("double")).alias("m"))["m"]
    if mn is None or mn < 0:
        return None
    med = median if median is not None else exact_median(train, column)

    def fn(df):
        x = F.coalesce(col(column).cast("double"), F.lit(med)) if column in df.columns else F.lit(med)
        return df.withColumn(name, _finish(F.log1p(x)))
    return Fitted(name, fn, {"median": med})


def square(name: str, train: DataFrame, column: str, median: float | None = None) -> Fitted:
    med = median if median is not None else exact_median(train, column)

    def fn(df):
        x = F.coalesce(col(column).cast("double"), F.lit(med)) if column in df.columns else F.lit(med)
        return df.withColumn(name, _finish(x * x))
    return Fitted(name, fn, {"median": med})


# F18 ------------------------------------------------------------------------------------------
def rare_group(name: str, train: DataFrame, column: str, min_share: float, other: str = "other") -> Fitted:
    """Categories below ``min_share`` of train rows become ``other`` (a string column)."""
    total = _one(train, F.count(F.lit(1)).alias("t"))["t"]
    keep = (train.groupBy(col(column).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") / F.lit(total) >= F.lit(min_share)).select("_c", F.lit(True).alias("_keep")))

    def fn(df):
        j = df.join(keep, col(column) == F.col("_c"), "left")
        return j.withColumn(name, F.when(F.col("_keep"), col(column)).otherwise(F.lit(other))).drop("_c", "_keep")
    return Fitted(name, fn)


def apply_all(df: DataFrame, fitted: list[Fitted]) -> DataFrame:
    """All features in their order; neighbouring aggregates of one table and key share one pass over it."""
    at = 0
    while at < len(fitted):
        g = fitted[at].state.get("group")
        end = at + 1
        if g is not None:
            while end < len(fitted) and _same_group(g, fitted[end].state.get("group")):
                end += 1
            df = attach_groups(df, fitted[at:end])
        else:
            df = fitted[at].transform(df)
        at = end
    return df


def _same_group(a: dict, b: dict | None) -> bool:
    return b is not None and a["aux"] is b["aux"] and (a["key"], a["left_key"]) == (b["key"], b["left_key"])


def median_ratio(name: str, train: DataFrame, a: str, b: str, medians: dict | None = None) -> Fitted:
    """F05 fallback variant: both sides filled with train medians; b = 0 -> 0."""
    from .kernels import quantile_wide
    med = medians or {r["column"]: r["m"] for r in quantile_wide(train, [a, b], {"m": 0.5}).collect()}

    def fn(df):
        x = F.coalesce(col(a).cast("double"), F.lit(med.get(a)))
        y = F.coalesce(col(b).cast("double"), F.lit(med.get(b)))
        return df.withColumn(name, _finish(F.try_divide(x, F.nullif(y, F.lit(0.0)))))
    return Fitted(name, fn, {"medians": med})


def fill_with_median(name: str, column: str, src: DataFrame, src_column: str) -> Fitted:
    """F01 after an attach: the attached value, else the median of ``src_column`` in ``src``
    (pass the deduplicated auxiliary table for the reference's numeric-map semantics)."""
    med = median_frame(src.select(col(src_column).cast("double").alias("v")), "v")

    def fn(df):
        j = with_scalars(df, med)
        return j.withColumn(name, _finish(F.coalesce(col(column).cast("double"), F.col("_med")))).drop("_med")
    return Fitted(name, fn, {"median": med})
