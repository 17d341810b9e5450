"""Mergeable sketches that settle most column pairs before any value is shuffled.

A column's sketch keeps the distinct values whose 64-bit hashes are the smallest ones (KMV, as a theta sketch of
2**``lg_k`` hashes at most).  One pass over a table builds the sketches of all its columns: tasks keep one sketch
per column, so what is shuffled does not grow with the rows.  Hashes below the smaller threshold of two columns
are a uniform sample of the values of both, and the share of the left ones that the right one has estimates
containment.  The estimate only rules pairs out; what it cannot rule out is counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import col
from .kernels import long_form

#: hashes kept per column
LG_K = 13
#: standard errors below the wanted ratio at which a pair is ruled out
SIGMAS = 5.0
#: bytes of left values that may be broadcast
SMALL_BYTES = 32 << 20


def column_sketches(df: DataFrame, columns: list[str], lg_k: int = LG_K) -> DataFrame:
    """(column, sketch, n): the theta sketch of the values (as text) of every column and their estimated number.

    At most 8 * 2**lg_k bytes a column; NULL is no value."""
    # hashes, not the text: the sketch leaves out empty strings
    one = df.agg(*[F.theta_sketch_agg(F.when(col(c).isNotNull(), F.xxhash64(col(c).cast("string"))), lg_k).alias(f"s{i}")
                   for i, c in enumerate(columns)])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch"))
                                         for i, c in enumerate(columns)])))
    return long.withColumn("n", F.theta_sketch_estimate("sketch"))


def containment(left: DataFrame, right: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(left_column, right_column, left_n, right_n, ratio, sample) of every pair of columns of two sketch tables.

    ``sample``: about how many left values the estimate rests on, those whose hash is kept on both sides."""
    k = float(1 << lg_k)
    packed = right.agg(F.collect_list(F.struct(F.col("column").alias("right_column"), F.col("sketch").alias("rs"),
                                               F.col("n").alias("right_n"))).alias("r"))  # one row: the columns of a table
    pairs = (left.withColumn("r", packed.select("r").scalar())
             .select(F.col("column").alias("left_column"), "sketch", F.col("n").alias("left_n"), F.inline("r")))
    both = F.theta_sketch_estimate(F.theta_intersection("sketch", "rs"))
    larger = F.greatest("left_n", "right_n")
    share = F.least(F.lit(1.0), F.lit(k) / F.greatest(larger, F.lit(1.0)))  # the smaller threshold of the two
    return pairs.select("left_column", "right_column", F.col("left_n").cast("double").alias("left_n"),
                        F.col("right_n").cast("double").alias("right_n"),
                        F.try_divide(both.cast("double"), F.col("left_n").cast("double")).alias("ratio"),
                        (F.col("left_n") * share).alias("sample"))


def possible_pairs(left: DataFrame, left_columns: list[str], right: DataFrame, right_columns: list[str],
                   min_ratio: float, lg_k: int = LG_K) -> list[tuple[str, str, float]]:
    """(left column, right column, estimated left values) of the pairs whose containment may reach ``min_ratio``:
    the estimate does not lie SIGMAS standard errors below it.  Columns with few kept hashes in common stay."""
    found = containment(column_sketches(left, left_columns, lg_k), column_sketches(right, right_columns, lg_k), lg_k)
    # a share of m values has a standard error of sqrt(p (1 - p) / m); m itself is known to some hundredths
    m = F.greatest(F.col("sample") * 0.9, F.lit(1.0))
    slack = F.lit(SIGMAS) * F.sqrt(F.lit(min_ratio * (1 - min_ratio)) / m) + F.lit(SIGMAS) / m
    kept = found.where((F.col("left_n") > 0) & (F.col("right_n") > 0) & (F.col("ratio") + slack >= F.lit(min_ratio)))
    return [(r["left_column"], r["right_column"], r["left_n"])
            for r in kept.select("left_column", "right_column", "left_n").collect()]  # one row per pair of columns


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (column, value as text) of the listed columns."""
    return long_form(df, columns, "string").where(F.col("value").isNotNull()).distinct()


def _overlap(left: DataFrame, right: DataFrame, pairs: list[tuple], small: bool) -> DataFrame:
    ls, rs = (list(dict.fromkeys(x)) for x in list(zip(*pairs))[:2])
    partners = F.create_map(*[x for c in ls for x in (F.lit(c), F.array(*[F.lit(p[1]) for p in pairs if p[0] == c]))])
    ld = distinct_values(left, ls)
    sizes = ld.groupBy(F.col("column").alias("left_column")).agg(F.count(F.lit(1)).alias("left_distinct"))
    asked = ld.select(F.col("column").alias("left_column"), "value", F.explode(F.element_at(partners, F.col("column"))).alias("right_column"))
    if small:
        held = ld.agg(F.sum(F.octet_length("value"))).first()[0] or 0
        if held <= SMALL_BYTES:  # the right rows are filtered where they are read, only hits are made distinct
            rd = long_form(right, rs, "string").withColumnRenamed("column", "right_column")
            met = rd.join(F.broadcast(asked), ["right_column", "value"]).select("left_column", "right_column", "value").distinct()
            n = met.groupBy("left_column", "right_column").agg(F.count(F.lit(1)).alias("overlap"))
            return n.join(F.broadcast(sizes), "left_column").select("left_column", "right_column", "overlap", "left_distinct")
    rd = distinct_values(right, rs).withColumnRenamed("column", "right_column")
    n = (asked.join(rd, ["right_column", "value"]).groupBy("left_column", "right_column").agg(F.count(F.lit(1)).alias("overlap")))
    return n.join(F.broadcast(sizes), "left_column").select("left_column", "right_column", "overlap", "left_distinct")


def exact_overlap(left: DataFrame, right: DataFrame, pairs: list[tuple], lg_k: int = LG_K) -> DataFrame:
    """(left_column, right_column, overlap, left_distinct) of the listed pairs (as ``possible_pairs`` gives them).

    Values of other columns are not read, and a left value meets the right columns its column is paired with.
    Left columns of at most 2**lg_k values (whose sketch holds them all) are broadcast if their bytes are few."""
    bound = float(1 << lg_k)
    out = left.sparkSession.createDataFrame([], "left_column string, right_column string, overlap long, left_distinct long")
    for small in (True, False):
        some = [p for p in pairs if (p[2] <= bound) == small]
        if some:
            out = out.union(_overlap(left, right, some, small))
    return out
