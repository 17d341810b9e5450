"""The three shared kernels behind profiling, cleaning, encoding and quality.

1. ``value_counts``: long table (column, value, n[, sum_y]) from one unpivot +
   one aggregation.  Spark combines map-side, so the shuffle carries distinct
   values, not rows; a hot value costs nothing extra.
2. ``moments``: count/mean/std/min/max/skew/kurt per column (optionally per
   class) in long form; one aggregation instead of a per-column loop.
3. ``quantiles``: exact linear-interpolated quantiles (pandas ``quantile``,
   DuckDB ``quantile_cont``), read off cumulative counts where the value counts
   are there anyway, found by narrowing ranges (``selection``) from the rows.  No per-group value map is built in one task, unlike the
   ``percentile`` aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import col
from ..functions import stats as S
from .ordering import running_total


def long_form(df: DataFrame, columns: list[str], value_type: str = "string",
              keep: list[str] = ()) -> DataFrame:
    """(keep..., column, value) with every listed column stacked into ``value``."""
    if not columns:
        raise ValueError("no columns to stack")
    def typed(c):
        v = col(c).cast(value_type)
        return F.when(~F.isnan(v), v) if value_type == "double" else v  # NaN is a missing value
    casted = df.select(*[col(k) for k in keep], *[typed(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("value"))
                      for i, c in enumerate(columns)])
    return casted.select(*[col(k) for k in keep], F.inline(pairs))


def _family(dt: T.DataType) -> str:
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "double"
    return "string"


def value_counts(df: DataFrame, columns: list[str], target: str | None = None,
                 value_type: str = "string") -> DataFrame:
    """(column, value, n[, n_y, sum_y]); NULL values form their own row.

    With ``value_type="string"`` the grouping still happens on the native type
    family (integral / fractional / other) and only the distinct values are
    turned into text afterwards, so rows are never formatted one by one.
    """
    keep = [target] if target else []
    aggs = [F.count(F.lit(1)).alias("n")]
    if target:
        aggs += [F.count(col(target)).alias("n_y"), F.sum(col(target).cast("double")).alias("sum_y")]
    if value_type != "string":
        return long_form(df, columns, value_type, keep).groupBy("column", "value").agg(*aggs)
    types = {f.name: f.dataType for f in df.schema.fields}
    fams: dict[str, list[str]] = {}
    for c in columns:
        fams.setdefault(_family(types[c]), []).append(c)
    out = None
    for fam, cs in fams.items():
        part = (long_form(df, cs, fam, keep).groupBy("column", "value").agg(*aggs)
                .withColumn("value", F.col("value").cast("string")))
        out = part if out is None else out.unionByName(part)
    return out


def exact_mean(x) -> "F.Column":
    """Mean from an exact decimal sum: the same value for any partitioning or merge order.

    A double sum depends on the order partial sums are merged, which decides the last
    digit when the true mean sits on a rounding tie.  Values are summed as DECIMAL(38,18)
    (exact, order-free) and divided once in double; if a value or the sum does not fit,
    the plain double average is used.
    """
    x = F.when(~F.isnan(x.cast("double")), x)  # NaN is a missing value
    dsum = F.try_sum(x.try_cast("decimal(38,18)"))
    return F.coalesce(dsum.cast("double") / F.count(x), F.avg(x))


def exact_mean_from_counts(vc: DataFrame) -> DataFrame:
    """(column, mean) from numeric value counts: exact decimal sum of n * value over the distinct
    values (same result as ``exact_mean`` on the rows, at the cost of one row per distinct value)."""
    x = F.col("value").try_cast("decimal(38,18)")
    nn = vc.where(F.col("value").isNotNull())
    dsum = F.try_sum(F.try_multiply(x, F.col("n").cast("decimal(20,0)")))
    return nn.groupBy("column").agg(
        F.coalesce(dsum.cast("double") / F.sum("n"), F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))


def moments(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """(column[, by], n, mean, std, var, min, max, skew, kurt, m_skew, m_kurt) over non-null values.

    ``skew``/``kurt`` are the bias-corrected sample statistics (pandas ``skew``,
    ``kurt``); ``m_skew``/``m_kurt`` are Spark's population moments (needed by
    the normality test).
    """
    keep = [by] if by else []
    lf = long_form(df, columns, "double", keep)
    keys = ["column"] + keep
    agg = lf.groupBy(*keys).agg(
        F.count("value").alias("n"),
        exact_mean(F.col("value")).alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.var_samp("value").alias("var"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.skewness("value").alias("m_skew"),
        F.kurtosis("value").alias("m_kurt"),
    )
    return agg.withColumn("skew", S.sample_skew(F.col("n"), F.col("m_skew"), F.col("var"))) \
              .withColumn("kurt", S.sample_kurt(F.col("n"), F.col("m_kurt"), F.col("var")))


def numeric_value_counts(df: DataFrame, columns: list[str], target: str | None = None) -> DataFrame:
    """Value counts of non-null numeric values as doubles."""
    return value_counts(df, columns, target, "double").where(F.col("value").isNotNull())


def cumulative_counts(vc: DataFrame, group: str = "column") -> DataFrame:
    """Add ``cum`` (rows with value <= this one) and ``cum_before`` per column."""
    out = running_total(vc, [group], ["value"], weight="n", out="cum")
    return out.withColumn("cum_before", F.col("cum") - F.col("n"))


def quantiles(df: DataFrame | None, columns: list[str] | None, probs: list[float],
              vc: DataFrame | None = None, cum: DataFrame | None = None) -> DataFrame:
    """(column, q, value): exact quantiles with linear interpolation.

    For N non-null values the position is h = (N-1)q; the result is
    x[floor h] + (h - floor h)(x[ceil h] - x[floor h]) with x sorted ascending.
    ``cum`` (from ``cumulative_counts``) may be passed to reuse one ordering pass.  From the rows alone
    (``df``) the ranks are found by narrowing ranges; the values are not counted in full.
    """
    if cum is None:
        if vc is None:
            from .selection import select_quantiles
            return select_quantiles(df, columns, probs)
        cum = cumulative_counts(vc.select("column", "value", "n"))
    totals = cum.groupBy("column").agg(F.sum("n").alias("n_tot"))
    # probe positions: one (column, q) row per requested quantile, two ranks each
    probes = (totals.select("column", "n_tot", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
              .withColumn("h", (F.col("n_tot") - 1) * F.col("q"))
              .withColumn("lo", F.floor("h").cast("long"))
              .withColumn("hi", F.ceil("h").cast("long"))
              .withColumn("frac", F.col("h") - F.col("lo")))
    # equi-join on column; each value row meets only the few probes of its column (two per
    # quantile), and the value at both probe positions is picked in one aggregation
    hit = (cum.select("column", "value", "cum_before", "cum").join(F.broadcast(probes), "column")
           .where(((F.col("cum_before") <= F.col("lo")) & (F.col("lo") < F.col("cum")))
                  | ((F.col("cum_before") <= F.col("hi")) & (F.col("hi") < F.col("cum")))))
    inside = lambda k: (F.col("cum_before") <= F.col(k)) & (F.col(k) < F.col("cum"))
    picked = hit.groupBy("column", "q", "frac").agg(F.max(F.when(inside("lo"), F.col("value"))).alias("x_lo"),
                                                    F.max(F.when(inside("hi"), F.col("value"))).alias("x_hi"))
    return picked.select("column", "q",
                         (F.col("x_lo") + F.col("frac") * (F.col("x_hi") - F.col("x_lo"))).alias("value"))


def quantile_edges(cum: DataFrame | None, probs: list[float], df: DataFrame | None = None,
                   columns: list[str] | None = None) -> DataFrame:
    """(column, _edges array<double>) ascending, from a cumulative value-count table or the rows."""
    q = quantiles(df, columns, probs, cum=cum)
    return q.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))),
                                               lambda s: s["value"]).alias("_edges"))


def quantile_wide(df: DataFrame | None, columns: list[str] | None, probs: dict[str, float],
                  vc: DataFrame | None = None) -> DataFrame:
    """(column, <name>...) one row per column, quantiles as named columns."""
    q = quantiles(df, columns, list(probs.values()), vc)
    return q.groupBy("column").agg(*[
        F.max(F.when(F.col("q") == F.lit(float(p)), F.col("value"))).alias(name) for name, p in probs.items()])


def top_values(vc: DataFrame, k: int = 5, include_null: bool = False) -> DataFrame:
    """K most frequent values per column, ties by value; (column, value, n, rnk)."""
    src = vc if include_null else vc.where(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return src.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k)
