"""Exact quantiles by narrowing: a mergeable sketch says where a rank lies, one more pass counts there.

``quantiles`` of a table need the values at certain ranks of every column, not the order of all values.

1. One pass: count of the values and a KLL sketch per column (fixed size; tasks send one each).
2. The sketch gives a range that holds each wanted rank but for its rank error, widened by a margin.
3. One pass: how many values lie below each range, and the distinct values inside the ranges with their counts.
   Only these are shuffled, about ``2 * MARGIN`` of the rows per wanted rank and their distinct values only.
4. The ranks are found in the running counts of a range.  A rank outside its range (the sketch errs with small
   probability) widens the range by doubling the margin until it holds the rank, at last all values.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import col
from .ordering import running_total

KLL_K = 2000
#: share of the rows by which a range is widened on either side (the sketch's rank error is about 0.0015)
MARGIN = 0.004
#: all values of a column with no more than these are in the range of each of its ranks
SHORT = 5000


def _value(df: DataFrame, c: str):
    v = col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _ranges(df: DataFrame, columns: list[str], probs: list[float], k: int, margin: float) -> list[dict]:
    """Per column and quantile: the number of values and the sketch's values a margin below and above."""
    sketched = df.agg(*[F.count(_value(df, c)).alias(f"n{i}") for i, c in enumerate(columns)],
                      *[F.kll_sketch_agg_double(_value(df, c), F.lit(k)).alias(f"s{i}") for i, c in enumerate(columns)])
    wide = []
    for i in range(len(columns)):
        for j, p in enumerate(probs):
            for name, x in (("a", p - margin), ("b", p + margin)):  # beyond the ends: no limit
                at = F.kll_sketch_get_quantile_double(f"s{i}", F.lit(x)) if 0 < x < 1 else F.lit(None).cast("double")
                wide.append(F.when(F.col(f"n{i}") > SHORT, at).alias(f"{name}{i}_{j}"))
    row = sketched.select(*[f"n{i}" for i in range(len(columns))], *wide).first()
    out = []
    for i, c in enumerate(columns):
        for j, p in enumerate(probs):
            lo, hi = row[f"a{i}_{j}"], row[f"b{i}_{j}"]
            h = (row[f"n{i}"] - 1) * p
            out.append({"column": c, "n": row[f"n{i}"], "q": p, "lo": math.floor(h), "hi": math.ceil(h),
                        "a": -math.inf if lo is None else lo, "b": math.inf if hi is None else hi})
    return [x for x in out if x["n"]]


def _counted(df: DataFrame, asked: list[dict]) -> None:
    """Values below and up to the end of the range of every asked quantile."""
    row = df.agg(*[F.count_if(_value(df, a["column"]) < F.lit(a["a"])).alias(f"u{i}") for i, a in enumerate(asked)],
                 *[F.count_if(_value(df, a["column"]) <= F.lit(a["b"])).alias(f"v{i}") for i, a in enumerate(asked)]).first()
    for i, a in enumerate(asked):
        a |= {"below": row[f"u{i}"], "upto": row[f"v{i}"]}


def select_quantiles(df: DataFrame, columns: list[str], probs: list[float], k: int = KLL_K, margin: float = MARGIN) -> DataFrame:
    """(column, q, value): exact quantiles with linear interpolation between the two ranks next to (n - 1) q.

    NULL and NaN are no values; a column without values gives no row."""
    spark = df.sparkSession
    probs = list(dict.fromkeys(float(p) for p in probs))
    done: list[dict] = []
    columns, wide = list(columns), margin
    while columns:
        asked = _ranges(df, columns, probs, k, wide)
        if not asked:
            break
        _counted(df, asked)
        fits = {c: True for c in columns}
        for a in asked:
            fits[a["column"]] &= a["below"] <= a["lo"] and a["hi"] < a["upto"]
        done += [a for a in asked if fits[a["column"]]]
        columns = [c for c in columns if not fits[c]]
        wide *= 2
    if not done:
        return spark.createDataFrame([], "column string, q double, value double")
    # ranges of one column that are the same (a constant, a short table) are read once
    number = {r: i for i, r in enumerate(sorted({(a["column"], a["a"], a["b"]) for a in done}))}
    none = F.array().cast("array<struct<part:int,value:double>>")
    inside = F.concat(*[F.when(_value(df, c).between(lo, hi), F.array(F.struct(F.lit(i).alias("part"), _value(df, c).alias("value"))))
                        .otherwise(none) for (c, lo, hi), i in number.items()])
    counts = df.select(F.inline(inside)).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    cum = running_total(counts, ["part"], ["value"], weight="n", out="cum")
    wanted = spark.createDataFrame([(number[a["column"], a["a"], a["b"]], a["column"], a["q"], a["lo"] - a["below"], a["hi"] - a["below"],
                                     (a["n"] - 1) * a["q"] - a["lo"]) for a in done],
                                   "part int, column string, q double, lo long, hi long, frac double")
    hit = cum.join(F.broadcast(wanted), "part")  # one row per column and quantile
    at = lambda r: (F.col("cum") - F.col("n") <= F.col(r)) & (F.col(r) < F.col("cum"))
    two = hit.where(at("lo") | at("hi")).groupBy("column", "q", "frac").agg(
        F.max(F.when(at("lo"), F.col("value"))).alias("x_lo"), F.max(F.when(at("hi"), F.col("value"))).alias("x_hi"))
    between = F.col("x_lo") + F.col("frac") * (F.col("x_hi") - F.col("x_lo"))
    return two.select("column", "q", F.when(F.col("x_lo") == F.col("x_hi"), F.col("x_lo")).otherwise(between).alias("value"))
