"""Column profiling: A01-A14, A16-A18.

Everything is derived from the value-count and moment kernels in long form
(one row per column or per (column, class)); no per-column driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import rnd, col, numeric_columns
from ..functions import stats as S
from .kernels import exact_mean_from_counts, moments, numeric_value_counts, quantile_wide, top_values, value_counts
from ..session import materialize

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def top5_text(vc: DataFrame, k: int = 5) -> DataFrame:
    """(column, mode, top5): most frequent non-null values, ties by value; top5 comma-joined."""
    tv = top_values(vc, k)
    return tv.groupBy("column").agg(
        F.min(F.when(F.col("rnk") == 1, F.col("value"))).alias("mode"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rnk", "value"))),
                                     lambda s: s["value"])).alias("top5"))


def outlier_counts(nvc: DataFrame, fences: DataFrame) -> DataFrame:
    """A06 from numeric value counts: rows strictly outside q1 - 1.5 iqr, q3 + 1.5 iqr."""
    f = fences.select("column", (F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("lo"),
                      (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("hi"))
    return (nvc.join(F.broadcast(f), "column")
            .groupBy("column").agg(F.sum(F.when((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")),
                                                F.col("n")).otherwise(0)).cast("long").alias("outliers")))


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column.

    total, non_null, null_count, null_ratio, unique_count, unique_ratio for all
    columns; mean, std, min, q25, median, q75, max, skew, kurt, outliers for
    numeric ones; mode and top5 (comma-joined) for the others.  Ratios are
    rounded to 4 dp and are 0.0 on empty input.
    """
    columns = columns or df.columns
    nums = [c for c in numeric_columns(df) if c in columns]
    others = [c for c in columns if c not in nums]
    # one raw pass per type family: numeric columns as doubles (NULLs kept), others as text
    parts = []
    if nums:
        nvc_all = materialize(value_counts(df, nums, value_type="double"), "value-counts")
        parts.append(nvc_all)
    if others:
        svc = materialize(value_counts(df, others), "value-counts")
        parts.append(svc)
    base = None
    for vc in parts:
        b = vc.groupBy("column").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null"),
            F.count("value").alias("unique_count"))
        base = b if base is None else base.unionByName(b)
    base = base.select(
        "column", F.col("total").cast("long").alias("total"), F.col("non_null").cast("long").alias("non_null"),
        (F.col("total") - F.col("non_null")).cast("long").alias("null_count"),
        rnd(F.coalesce(F.try_divide(F.col("total") - F.col("non_null"), F.col("total")), F.lit(0.0)), 4)
        .alias("null_ratio"),
        F.col("unique_count").cast("long").alias("unique_count"),
        rnd(F.coalesce(F.try_divide(F.col("unique_count"), F.col("non_null")), F.lit(0.0)), 4)
        .alias("unique_ratio"))
    out = base
    if nums:
        nvc = nvc_all.where(F.col("value").isNotNull())
        # moments from the rows: a row-level sum matches an exactly rounded mean where a sum of
        # n * value over distinct values can land on the other side of a 6-dp tie
        # the exact (order-free) mean is summed over the distinct values already counted;
        # the row-level pass only keeps the double moments (its mean output is pruned away)
        m = (moments(df, nums).select("column", "std", "min", "max", "skew", "kurt")
             .join(exact_mean_from_counts(nvc), "column"))
        qs = quantile_wide(None, None, QUARTILES, vc=nvc)
        oc = outlier_counts(nvc, qs)
        out = out.join(m, "column", "left").join(qs, "column", "left").join(oc, "column", "left")
    else:
        for c in ("mean", "std", "min", "max", "skew", "kurt", "q25", "median", "q75"):
            out = out.withColumn(c, F.lit(None).cast("double"))
        out = out.withColumn("outliers", F.lit(None).cast("long"))
    if others:
        out = out.join(top5_text(svc), "column", "left")
    else:
        out = out.withColumn("mode", F.lit(None).cast("string")).withColumn("top5", F.lit(None).cast("string"))
    return out


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Count and share of each target value, NULL included."""
    total = F.sum("count").over(Window.partitionBy())
    return (df.groupBy(col(target).alias("value")).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("ratio", F.col("count") / total))


def per_class_moments(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, class, mean, std) kept long; std NULL when the class has one row."""
    m = moments(df.where(col(target).isNotNull()), columns, by=target)
    return m.select("column", F.col(target).alias("class"), "mean", "std")


def normality(df: DataFrame, columns: list[str], large_n: int = 5000) -> DataFrame:
    """D'Agostino-Pearson p for columns with more than ``large_n`` values (n >= 8 otherwise NULL)."""
    m = moments(df, columns)
    p = S.normaltest_p(F.col("n"), F.col("m_skew"), F.col("m_kurt"))
    return m.select("column", "n", F.when((F.col("n") > large_n) & (F.col("var") > 0), p).alias("normal_p"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Natural-log Shannon entropy of the non-null values of each column."""
    vc = value_counts(df, columns).where(F.col("value").isNotNull())
    # -sum(n/N ln(n/N)) = ln N - sum(n ln n) / N: plain sums, combined map-side
    total = F.sum("n").cast("double")
    return vc.groupBy("column").agg((F.log(total) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / total)
                                    .alias("entropy"))


def datetime_counts(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(month 1-12, count) and (weekday Monday=0, count)."""
    c = col(column)
    by_month = df.where(c.isNotNull()).groupBy(F.month(c).alias("month")).agg(F.count(F.lit(1)).alias("count"))
    by_wd = df.where(c.isNotNull()).groupBy(F.weekday(c).alias("weekday")).agg(F.count(F.lit(1)).alias("count"))
    return by_month, by_wd


def datetime_trend(df: DataFrame, column: str) -> DataFrame:
    """Regress the sorted epoch seconds on their position: (n, slope, r2).

    Rows sharing a timestamp occupy a consecutive range of positions, and the
    regression only needs that range, so everything comes from the value counts
    of the timestamps plus their cumulative counts: no row-level window, and a
    timestamp holding a third of the rows is one row of the count table.
    With mean position m = (N + 1) / 2:
      Sxx = N (N^2 - 1) / 12,  Sxy = sum_t n_t (t - mean_t)(avg_pos_t - m),
      Syy = sum_t n_t (t - mean_t)^2,  slope = Sxy / Sxx,  r2 = Sxy^2 / (Sxx Syy).
    """
    from .kernels import cumulative_counts
    c = col(column)
    t = F.unix_micros(c.cast("timestamp")).cast("double") / 1e6
    vc = (df.where(c.isNotNull()).groupBy(t.alias("value")).agg(F.count(F.lit(1)).alias("n"))
          .withColumn("column", F.lit(column)))
    cum = cumulative_counts(vc.select("column", "value", "n"))
    tot = vc.groupBy("column").agg(F.sum("n").alias("_N"), (F.sum(F.col("n") * F.col("value")) / F.sum("n"))
                                   .alias("_mt"))
    from .features import with_scalars
    j = with_scalars(cum, tot.drop("column"))  # one profiled column: its totals enter as scalars
    avg_pos = F.col("cum_before") + (F.col("n") + 1) / 2.0
    m = (F.col("_N") + 1) / 2.0
    s = j.groupBy("column", "_N").agg(
        F.sum(F.col("n") * (F.col("value") - F.col("_mt")) * (avg_pos - m)).alias("_sxy"),
        F.sum(F.col("n") * (F.col("value") - F.col("_mt")) * (F.col("value") - F.col("_mt"))).alias("_syy"))
    n = F.col("_N").cast("double")
    sxx = n * (n * n - 1) / 12.0
    return s.select(F.col("_N").cast("long").alias("n"),
                    F.try_divide(F.col("_sxy"), F.nullif(sxx, F.lit(0.0))).alias("slope"),
                    F.try_divide(F.col("_sxy") * F.col("_sxy"), F.nullif(sxx * F.col("_syy"), F.lit(0.0)))
                    .alias("r2"))


def datetime_report(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """A14 for every datetime column: (column, n, slope, r2, p, has_trend).

    p is the two-sided test of the slope (one scalar per column on the driver); a trend holds when
    p < ``alpha``.  Fewer than three values: p NULL, no trend."""
    rows = []
    for c in columns:
        r = datetime_trend(df, c).first()
        n, slope, r2 = (r["n"], r["slope"], r["r2"]) if r is not None else (0, None, None)
        p = trend_pvalue(n, r2)
        rows.append((c, int(n), slope, r2, p, p is not None and p < alpha))
    return df.sparkSession.createDataFrame(
        rows, "column string, n long, slope double, r2 double, p double, has_trend boolean")


def trend_pvalue(n: int, r2: float | None) -> float | None:
    """Two-sided p of the slope from r2 (t = r sqrt((n-2)/(1-r2))), driver-side scalar."""
    if r2 is None or n is None or n < 3:
        return None
    if r2 >= 1:
        return 0.0
    t = (r2 ** 0.5) * ((n - 2) / (1 - r2)) ** 0.5
    return S.t_two_sided_p(t, n - 2)


def target_rate_spread(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Max - min of mean target per category (non-null categories), with band."""
    vc = value_counts(df.where(col(target).isNotNull()), columns, target).where(F.col("value").isNotNull())
    rate = F.col("sum_y") / F.col("n")
    sp = vc.groupBy("column").agg((F.max(rate) - F.min(rate)).alias("spread"))
    return sp.withColumn("band", F.when(F.col("spread") > 0.15, "high").when(F.col("spread") > 0.05, "medium")
                         .otherwise("low"))


def findings(num: DataFrame, cat: DataFrame) -> DataFrame:
    """Finding codes per column from the A17 report parts.

    num: (column, corr, skew, null_ratio, unique_count); cat: (column, spread, null_ratio, unique_count).
    Bands: |corr| .15/.05; |skew| 3/1; null .2/.05; unique <=2 / <=6 / >50; spread .15/.05.
    """
    def codes(parts):
        return F.concat_ws(",", F.filter(F.array(*parts), lambda x: x.isNotNull()))

    null_codes = [F.when(F.col("null_ratio") > 0.2, "null_high").when(F.col("null_ratio") > 0.05, "null_some")]
    uniq = [F.when(F.col("unique_count") <= 2, "binary").when(F.col("unique_count") <= 6, "low_cardinality")
            .when(F.col("unique_count") > 50, "high_cardinality")]
    n = num.select("column", codes([
        F.when(F.abs(F.col("corr")) > 0.15, "corr_strong").when(F.abs(F.col("corr")) > 0.05, "corr_weak")
        .otherwise("corr_none"),
        F.when(F.abs(F.col("skew")) > 3, "skew_heavy").when(F.abs(F.col("skew")) > 1, "skew_moderate"),
        *null_codes, *uniq]).alias("findings"))
    c = cat.select("column", codes([
        F.when(F.col("spread") > 0.15, "spread_strong").when(F.col("spread") > 0.05, "spread_weak")
        .otherwise("spread_none"), *null_codes, *uniq]).alias("findings"))
    return n.unionByName(c)
