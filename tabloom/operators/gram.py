"""Sums over numeric columns that every task keeps in one small array and Spark adds up.

``gram``: the sums behind all pairwise statistics of k columns (pairs of rows where both are present), for any k
in one pass: a task multiplies its batches as matrices and sends one row per pair of columns.
``kernel_sums``: Gaussian kernels on a grid, one array of grid sums per task and column.
What is shuffled depends on the columns and the tasks, never on the rows or their distinct values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import col

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns of doubles, missing values as NaN."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1) if batch.num_columns else np.zeros((0, 0))


def gram(df: DataFrame, features: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every pair i < j of ``features``: sums over the rows where both columns
    have a value.  NULL and NaN are missing.

    Values are taken relative to a common origin per column (the mean of some rows, any value gives the same
    statistics), so that large offsets do not cancel."""
    k = len(features)
    plain = df.select(*[col(f).cast("double").alias(f"g{i}") for i, f in enumerate(features)])
    some = plain.limit(1000).agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in plain.columns]).first()
    origin = np.array([x if x is not None and np.isfinite(x) else 0.0 for x in some], np.float64)
    left, right = np.triu_indices(k, 1)

    def run(batches):
        total = np.zeros((6, k, k))
        for b in batches:
            x = _matrix(b).astype(np.float64) - origin
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            m = there.astype(np.float64)
            sq = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        if total[0].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), *(pa.array(t[left, right]) for t in total)],
                names=["i", "j", *SUMS])
    rows = plain.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in SUMS))
    return rows.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in SUMS])


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature_i, feature_j, n, corr): Pearson of every pair of columns in the order of ``features``, on the rows
    where both have a value; NULL when one of them does not vary there.  One row per pair, also without rows."""
    spark = df.sparkSession
    k = len(features)
    if k < 2:
        return spark.createDataFrame([], "feature_i string, feature_j string, n long, corr double")
    names = F.array(*[F.lit(f) for f in features])
    pairs = spark.range(k).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")).where("i < j")
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    # what rounding leaves of a constant column is no variance
    varies = (vx > 1e-14 * F.col("sxx")) & (vy > 1e-14 * F.col("syy"))
    r = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    found = gram(df, features).where("n > 0").select("i", "j", "n", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("corr"))
    return pairs.join(found, ["i", "j"], "left").select(
        F.get(names, F.col("i")).alias("feature_i"), F.get(names, F.col("j")).alias("feature_j"),
        F.coalesce(n, F.lit(0.0)).cast("long").alias("n"), "corr")


def kernel_sums(df: DataFrame, columns: list[str], stats: dict[str, tuple[float, float, float]], grid: int = 200) -> DataFrame:
    """(column, i, g, d): sums of exp(-((g - x) / h)^2 / 2) over the values x of a column at ``grid`` points g.

    ``stats``: (least, greatest, bandwidth h) of the columns that take part."""
    used = [c for c in columns if c in stats]
    plain = df.select(*[col(c).cast("double").alias(f"k{i}") for i, c in enumerate(used)])
    points = {c: np.array([lo + i * (hi - lo) / (grid - 1) for i in range(grid)]) for c, (lo, hi, _) in stats.items()}
    if not used:
        return df.sparkSession.createDataFrame([], "column string, i int, g double, d double")

    def run(batches):
        total = {c: np.zeros(grid) for c in used}
        for b in batches:
            x = _matrix(b).astype(np.float64)
            for at, c in enumerate(used):
                value, times = np.unique(x[~np.isnan(x[:, at]), at], return_counts=True)
                for lo in range(0, len(value), 4096):
                    z = (points[c][None, :] - value[lo: lo + 4096, None]) / stats[c][2]
                    total[c] += times[lo: lo + 4096] @ np.exp(-0.5 * z * z)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([total[c].tolist() for c in used], pa.list_(pa.float64()))],
                                         names=["column", "sums"])
    one = plain.mapInArrow(run, "column string, sums array<double>").select("column", F.posexplode("sums").alias("i", "s"))
    where = F.create_map(*[x for c in used for x in (F.lit(c), F.struct(F.lit(stats[c][0]).alias("lo"), F.lit(stats[c][1]).alias("hi")))])
    at = F.element_at(where, F.col("column"))
    return one.groupBy("column", "i").agg(F.sum("s").alias("d")).select(
        "column", "i", (at["lo"] + F.col("i") * (at["hi"] - at["lo"]) / (grid - 1)).alias("g"), "d")
