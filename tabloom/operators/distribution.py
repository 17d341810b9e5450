"""Distribution shape: A09/A10 normality, A11 KDE modality, A25 VIF.

Normality is one table for columns of any size: Shapiro-Wilk up to 5 000
values, D'Agostino-Pearson above, both as engine expressions over the value
counts.  A11 sums Gaussian kernels on a fixed grid.  A25 takes R^2 from the
k x k correlation matrix of a candidate set.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .gram import correlations, kernel_sums
from .kernels import cumulative_counts, long_form, moments, numeric_value_counts, quantile_wide
from .profile import normality as large_normality

# Polynomial coefficients of Royston's (1995) approximation (algorithm AS R94),
# lowest power first.
C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
C6 = [-0.4803, -0.082676, 0.0030302]
G = [-2.273, 0.459]

PANDAS_ROWS = 1_000_000  # values a pandas group of one column may hold
SMALL_N = 5000  # up to here the Shapiro-Wilk test is the fitting one
NORMAL_P = 0.05


def _poly(c, x):
    return S.horner(c[::-1], x)


def shapiro_wilk(df: DataFrame, columns: list[str], max_n: int = SMALL_N) -> DataFrame:
    """(column, n, w, p) of the Shapiro-Wilk test for columns with 8..``max_n`` values.

    All expressions of the engine: the value counts' cumulative counts give every distinct value its
    ranks, and W needs only plain sums over them - of the squared expected order statistics m_i, and of
    m_i x_i between the two outer values of each side, which have coefficients of their own.
    """
    st = moments(df, columns).where((F.col("n") >= 8) & (F.col("n") <= max_n) & (F.col("var") > 0)).select(
        "column", F.col("n").cast("double").alias("nd"), F.col("var"))
    cum = cumulative_counts(numeric_value_counts(df, columns).select("column", "value", "n"))
    # at most max_n ranks per column that takes part
    ranks = (cum.join(F.broadcast(st), "column")
             .withColumn("i", F.explode(F.sequence(F.col("cum_before") + 1, F.col("cum")))))
    ranks = S.with_normal_quantile(ranks, (F.col("i") - 0.375) / (F.col("nd") + 0.25), "m")
    at = lambda k: F.max(F.when(F.col("i") == k, F.col("value")))
    mid = (F.col("i") > 2) & (F.col("i") <= F.col("nd") - 2)
    sums = ranks.groupBy("column", "nd", "var").agg(
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.when(mid, F.col("m") * F.col("value"))).alias("mx"),
        at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(F.col("nd") - 1).alias("y2"), at(F.col("nd")).alias("y1"),
        F.max("m").alias("m1"), F.max(F.when(F.col("i") == F.col("nd") - 1, F.col("m"))).alias("m2"))
    u = 1 / F.sqrt(F.col("nd"))
    t = (sums.withColumn("a1", F.col("m1") / F.sqrt("mm") + _poly(C1, u))
         .withColumn("a2", F.col("m2") / F.sqrt("mm") + _poly(C2, u)))
    phi = ((F.col("mm") - 2 * F.col("m1") * F.col("m1") - 2 * F.col("m2") * F.col("m2"))
           / (1 - 2 * F.col("a1") * F.col("a1") - 2 * F.col("a2") * F.col("a2")))
    dot = F.col("a1") * (F.col("y1") - F.col("x1")) + F.col("a2") * (F.col("y2") - F.col("x2")) + F.col("mx") / F.sqrt(phi)
    t = t.withColumn("dot", dot)
    t = (t.withColumn("w", F.least(F.lit(1.0), F.col("dot") * F.col("dot") / (F.col("var") * (F.col("nd") - 1))))
         .withColumn("left", F.log(1 - F.col("w"))).withColumn("ln", F.log("nd")))
    n, ln, left = F.col("nd"), F.col("ln"), F.col("left")
    gamma = _poly(G, n)
    z = (F.when(n <= 11, (-F.log(gamma - left) - _poly(C3, n)) / F.exp(_poly(C4, n)))
         .otherwise((left - _poly(C5, ln)) / F.exp(_poly(C6, ln))))
    t = S.with_normal_tail(t, z, "tail")
    p = F.when(F.col("w") >= 1, F.lit(1.0)).when((n <= 11) & (left >= gamma), F.lit(0.0)).otherwise(F.col("tail"))
    return t.select("column", n.cast("long").alias("n"), "w", p.alias("p"))


def normality(df: DataFrame, columns: list[str], small_n: int = SMALL_N) -> DataFrame:
    """One row per column, whatever its size: (column, n, method, normal_p, is_normal).

    Shapiro-Wilk for 8..``small_n`` values, D'Agostino-Pearson above; fewer than 8 values or a constant
    column: method and p NULL, not normal.
    """
    big = large_normality(df, columns, small_n).select("column", "n", F.col("normal_p").alias("large_p"))
    small = shapiro_wilk(df, columns, small_n).select("column", F.col("p").alias("small_p"))
    p = F.coalesce("small_p", "large_p")
    return big.join(small, "column", "left").select(
        "column", F.col("n").cast("long").alias("n"),
        F.when(F.col("small_p").isNotNull(), "shapiro").when(F.col("large_p").isNotNull(), "dagostino").alias("method"),
        p.alias("normal_p"), F.coalesce(p > NORMAL_P, F.lit(False)).alias("is_normal"))


def modality(df: DataFrame, columns: list[str], grid: int = 200) -> DataFrame:
    """Number of strict interior local maxima of a Gaussian KDE (Scott bandwidth
    std * n^(-1/5)) on ``grid`` points from min to max; n < 2 or std = 0 -> 1 peak.  One row per column, also
    for columns without values.
    """
    st = _bandwidths(df, columns)
    peaks = (local_maxima(kernel_sums(df, columns, st, grid), "column", "i", "d")
             .groupBy("column").agg(F.count(F.lit(1)).alias("peaks")))
    named = df.sparkSession.createDataFrame([(c, c in st) for c in columns], "column string, varies boolean")
    out = named.join(peaks, "column", "left").select(
        "column", F.when(~F.col("varies"), F.lit(1)).otherwise(F.coalesce(F.col("peaks"), F.lit(0))).cast("long").alias("peaks"))
    return out.withColumn("multimodal", F.col("peaks") > 1)


def _bandwidths(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """(min, max, Scott bandwidth) of the columns with at least two values that differ; one row reaches the driver."""
    from ..functions.cols import col
    v = {c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in columns}
    row = df.agg(*[F.struct(F.count(x), F.min(x), F.max(x), F.stddev_samp(x)).alias(f"c{i}") for i, x in enumerate(v.values())]).first()
    return {c: (lo, hi, std * n ** -0.2) for c, (n, lo, hi, std) in zip(columns, row) if n >= 2 and std}


def local_maxima(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose ``value`` is strictly above both neighbours in ``order`` within ``group``.

    Meant for bounded series (a KDE grid: 200 points per column), so one window per group is fine.
    """
    w = Window.partitionBy(group).orderBy(order)
    return (df.withColumn("_prev", F.lag(value).over(w)).withColumn("_next", F.lead(value).over(w))
            .where((F.col(value) > F.col("_prev")) & (F.col(value) > F.col("_next"))).drop("_prev", "_next"))


def kde_density(df: DataFrame, columns: list[str], grid: int = 200) -> DataFrame:
    """(column, i, g, d): the unnormalised KDE of ``modality`` on its grid.

    Every task adds its values' kernels to one array of ``grid`` sums per column; only these arrays are shuffled.
    """
    return kernel_sums(df, columns, _bandwidths(df, columns), grid)


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, iqr, mad): quartile range and median absolute deviation from the value counts."""
    vc = numeric_value_counts(df, columns).select("column", "value", "n")
    q = quantile_wide(None, None, {"q1": 0.25, "med": 0.5, "q3": 0.75}, vc)
    dev = (vc.join(F.broadcast(q.select("column", "med")), "column")  # one row per profiled column
           .groupBy("column", F.abs(F.col("value") - F.col("med")).alias("value")).agg(F.sum("n").alias("n")))
    mad = quantile_wide(None, None, {"mad": 0.5}, dev)
    n = vc.groupBy("column").agg(F.sum("n").alias("n"))
    return n.join(q, "column").join(mad, "column").select("column", "n", (F.col("q3") - F.col("q1")).alias("iqr"), "mad")


def per_column_pandas(df: DataFrame, columns: list[str], fn, schema: str, min_n: int = 1,
                      max_n: int | None = PANDAS_ROWS) -> DataFrame:
    """Run a pandas function on each column's non-null values (one group per column).

    ``fn(pdf)`` gets (column, value) and returns rows of ``schema``.  A pandas group is held by one
    task: when a column has more than ``max_n`` values the call fails before any group is formed,
    rather than leaving the column out.
    """
    lf = long_form(df, columns, "double").where(F.col("value").isNotNull())
    sizes = {r["column"]: r["n"] for r in lf.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    over = [c for c, n in sizes.items() if max_n is not None and n > max_n]
    if over:
        raise ValueError(f"more than {max_n} values for one pandas group: {over}")
    few = [c for c in columns if sizes.get(c, 0) < min_n]
    return lf.where(~F.col("column").isin(few) if few else F.lit(True)).groupBy("column").applyInPandas(fn, schema)


def _double(name: str):
    from ..functions.cols import col
    return col(name).cast("double")


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """Variance inflation factors 1 / (1 - R^2), R^2 of each feature on the others.

    The k x k correlation matrix comes from one pass over the rows (A24, signed), on the rows where both columns
    have a value; only the k small regressions run on the driver.  A feature that the others determine gets infinity, a constant
    one NULL (and takes no part in the others' regressions).
    """
    at = {f: i for i, f in enumerate(features)}
    r = np.eye(len(features))
    for p in correlations(df, features).collect():  # k (k - 1) / 2 numbers
        r[at[p["feature_i"]], at[p["feature_j"]]] = r[at[p["feature_j"]], at[p["feature_i"]]] = p["corr"] or 0.0
    row = df.agg(*[F.var_pop(F.when(~F.isnan(x), x)).alias(f"v{i}") for i, x in
                   enumerate(_double(f) for f in features)]).first()
    varies = [i for i in range(len(features)) if row[f"v{i}"]]
    out = []
    for i, f in enumerate(features):
        others = [j for j in varies if j != i]
        value = None
        if i in varies:
            c = r[others, i]
            left = 1.0 - float(c @ np.linalg.pinv(r[np.ix_(others, others)], hermitian=True) @ c) if others else 1.0
            value = math.inf if left < 1e-9 else 1.0 / left
        out.append((f, value))
    return df.sparkSession.createDataFrame(out, "feature string, vif double")


__all__ = ["normality", "shapiro_wilk", "modality", "local_maxima", "vif"]
