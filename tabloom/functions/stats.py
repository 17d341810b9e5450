"""Statistical column expressions and small driver-side closed forms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_skew(n: Column, m_skew: Column, var: Column) -> Column:
    """Bias-corrected G1 from Spark's population skewness; constant -> 0, n < 3 -> NULL."""
    g1 = F.sqrt(n * (n - 1)) / (n - 2) * m_skew
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(var == 0, F.lit(0.0))
            .otherwise(g1))


def sample_kurt(n: Column, m_kurt: Column, var: Column) -> Column:
    """Bias-corrected excess kurtosis G2; constant -> 0, n < 4 -> NULL."""
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m_kurt + 6)
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(var == 0, F.lit(0.0))
            .otherwise(g2))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate Pearson r on pairwise non-null rows; NULL (not an error) when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xd = F.when(both, x.cast("double"))
    yd = F.when(both, y.cast("double"))
    den = F.stddev_samp(xd) * F.stddev_samp(yd)
    return F.try_divide(F.covar_samp(xd, yd), F.nullif(den, F.lit(0.0)))


def normaltest_p(n: Column, g: Column, k: Column) -> Column:
    """D'Agostino-Pearson K^2 p-value from n, population skewness g, excess kurtosis k.

    Skewness part after D'Agostino (1970), kurtosis part after Anscombe and
    Glynn (1983); p = exp(-K^2 / 2), the chi-square(2) tail.
    """
    nd = n.cast("double")
    b2 = k + 3
    y = g * F.sqrt((nd + 1) * (nd + 3) / (6 * (nd - 2)))
    beta2 = 3 * (nd * nd + 27 * nd - 70) * (nd + 1) * (nd + 3) / ((nd - 2) * (nd + 5) * (nd + 7) * (nd + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2 / (w2 - 1))
    z1 = delta * F.asinh(y / alpha)
    e = 3 * (nd - 1) / (nd + 1)
    v = 24 * nd * (nd - 2) * (nd - 3) / ((nd + 1) * (nd + 1) * (nd + 3) * (nd + 5))
    x = (b2 - e) / F.sqrt(v)
    s = (6 * (nd * nd - 5 * nd + 2) / ((nd + 7) * (nd + 9))
         * F.sqrt(6 * (nd + 3) * (nd + 5) / (nd * (nd - 2) * (nd - 3))))
    a = 6 + (8 / s) * (2 / s + F.sqrt(1 + 4 / (s * s)))
    d = 1 + x * F.sqrt(2 / (a - 4))
    term = F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1.0 / 3.0))
    z2 = ((1 - 2 / (9 * a)) - term) / F.sqrt(2 / (9 * a))
    return F.exp(-(z1 * z1 + z2 * z2) / 2)


# Coefficients of Acklam's rational approximation of the normal quantile (relative error
# 1.2e-9), and of the complementary error function (Numerical Recipes, relative error 1.2e-7).
QUANTILE_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
              -3.066479806614716e+01, 2.506628277459239e+00]
QUANTILE_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
              -1.328068155288572e+01, 1.0]
QUANTILE_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
              4.374664141464968e+00, 2.938163982698783e+00]
QUANTILE_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]
ERFC = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196,
        1.00002368, -1.26551223]


def horner(c: list[float], x: Column) -> Column:
    """Polynomial with the highest coefficient first."""
    out = F.lit(c[0])
    for k in c[1:]:
        out = out * x + F.lit(k)
    return out


def with_normal_quantile(df: DataFrame, p: Column, out: str) -> DataFrame:
    """Add the inverse of the standard normal distribution function at 0 < p < 1 (steps as columns of their
    own: each is computed once)."""
    t = (df.withColumn("_p", p).withColumn("_low", F.least(F.col("_p"), 1 - F.col("_p")))
         .withColumn("_q", F.sqrt(-2 * F.log("_low"))).withColumn("_d", F.col("_p") - 0.5)
         .withColumn("_r", F.col("_d") * F.col("_d")))
    q, r = F.col("_q"), F.col("_r")
    tail = horner(QUANTILE_C, q) / horner(QUANTILE_D, q)
    middle = horner(QUANTILE_A, r) * F.col("_d") / horner(QUANTILE_B, r)
    value = F.when(F.col("_low") < 0.02425, -F.signum("_d") * tail).otherwise(middle)
    return t.withColumn(out, value).drop("_p", "_low", "_q", "_d", "_r")


def with_normal_tail(df: DataFrame, z: Column, out: str) -> DataFrame:
    """Add the upper tail probability of the standard normal distribution at z."""
    t = (df.withColumn("_z", z).withColumn("_x", F.abs("_z") / math.sqrt(2.0))
         .withColumn("_t", 1 / (1 + 0.5 * F.col("_x"))))
    upper = 0.5 * F.col("_t") * F.exp(-F.col("_x") * F.col("_x") + horner(ERFC, F.col("_t")))
    return (t.withColumn("_u", upper).withColumn(out, F.when(F.col("_z") >= 0, F.col("_u")).otherwise(1 - F.col("_u")))
            .drop("_z", "_x", "_t", "_u"))


def t_two_sided_p(t: float, df: int) -> float:
    """Two-sided Student t p-value (regularised incomplete beta, driver-side scalar)."""
    if df <= 0 or t is None or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    x = df / (df + t * t)
    return _betainc(df / 2.0, 0.5, x)


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by continued fraction (Numerical Recipes form)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(math.log(x) * a + math.log(1 - x) * b + lbeta)
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1 - front * _betacf(b, a, 1 - x) / b


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        m2 = 2 * m
        aa = m * (b - m) * x / ((a + m2 - 1) * (a + m2))
        d = 1 + aa * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (a + b + m) * x / ((a + m2) * (a + m2 + 1))
        d = 1 + aa * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return h


EULER_GAMMA = 0.5772156649015329


def digamma_int(n: Column) -> Column:
    """psi(n) for positive integers: H(n-1) - gamma, via the asymptotic series (exact to ~1e-12 for n>=1)."""
    # psi(x) ~ ln x - 1/(2x) - 1/(12x^2) + 1/(120x^4) - 1/(252x^6), shifted by 6 for accuracy at small n
    x = n.cast("double")
    shift = sum((1 / (x + i) for i in range(6)), F.lit(0.0))
    z = x + 6
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * F.pow(z, 4)) - 1 / (252 * F.pow(z, 6))
    return series - shift
