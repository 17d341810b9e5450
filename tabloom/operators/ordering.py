"""Running totals and row numbers inside groups that may be huge.

A plain ``Window.partitionBy(g).orderBy(v)`` sends every row of a group to one
task; with a two-class target or one column of a profile that is half the
data in one task.  ``running_total`` instead cuts each large group into
contiguous value slices (edges from ``percentile_approx``), runs the window per
(group, slice), and adds the totals of earlier slices from a tiny offsets
table.  Groups small enough for one task skip the slicing altogether.

The edges are collected to the driver (one short array per group) so that
every later recomputation, e.g. after an executor loss, assigns the same
slices.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import col

#: rows one task may sort for one slice of a group
ROWS_PER_SLICE = 4_000_000
#: percentile_approx accuracy used for slice edges (edges need not be exact)
_EDGE_ACCURACY = 10_000
#: inputs whose optimizer size estimate (times a safety factor for stacked long forms)
#: stays under this many bytes skip the slicing job: any group fits one task
SMALL_INPUT_BYTES = 64 * 1024 * 1024
_SAFETY = 64


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimized plan (no job is run); None if unavailable."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001
        return None


def _as_col(c) -> Column:
    return col(c) if isinstance(c, str) else c


def running_total(df: DataFrame, group_cols: list[str], order_cols: list, weight: str | None = None,
                  out: str = "_cum", rows_per_slice: int = ROWS_PER_SLICE,
                  group_rows: dict | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``weight`` (1 per row when None).

    ``order_cols[0]`` must be numeric or datetime: it defines the slices.  The
    remaining order columns only break ties inside a slice, so rows with equal
    ``order_cols[0]`` always share a slice.  ``group_cols`` must have few
    distinct values (columns of a table, classes of a target): one edge array
    per group is collected.
    """
    order = [_as_col(c) for c in order_cols]
    w_expr = F.lit(1).cast("long") if weight is None else col(weight)
    base = df.withColumn("_rt_w", w_expr)
    est = estimated_bytes(df) if group_rows is None else None
    if est is not None and est * _SAFETY <= SMALL_INPUT_BYTES:
        group_rows = {}
    if group_rows is None:
        counts = base.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n")).collect()
    else:
        counts = [{"_n": v} for v in group_rows.values()]
    big = [r for r in counts if r["_n"] > rows_per_slice]
    if not big:
        win = (Window.partitionBy(*[col(g) for g in group_cols]).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return base.withColumn(out, F.sum("_rt_w").over(win)).drop("_rt_w")

    key = order[0].cast("double")
    n_slices = max(math.ceil(r["_n"] / rows_per_slice) for r in big)
    probs = [i / n_slices for i in range(1, n_slices)]
    edge_rows = (base.groupBy(*group_cols)
                 .agg(F.percentile_approx(key, probs, _EDGE_ACCURACY).alias("_edges"))
                 .collect())
    schema = T.StructType([f for f in df.schema.fields if f.name in group_cols]
                          + [T.StructField("_edges", T.ArrayType(T.DoubleType()))])
    edges = df.sparkSession.createDataFrame(
        [tuple(r[g] for g in group_cols) + ([float(e) for e in r["_edges"]],) for r in edge_rows],
        schema)
    sliced = (base.join(F.broadcast(edges), group_cols, "left")
              .withColumn("_rt_s", F.size(F.filter(F.coalesce(F.col("_edges"), F.array().cast("array<double>")),
                                                   lambda e: e < key)))
              .drop("_edges"))
    gs = [col(g) for g in group_cols]
    local = (Window.partitionBy(*gs, F.col("_rt_s")).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = sliced.groupBy(*gs, F.col("_rt_s")).agg(F.sum("_rt_w").alias("_rt_t"))
    before = Window.partitionBy(*gs).orderBy("_rt_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*gs, "_rt_s", F.coalesce(F.sum("_rt_t").over(before), F.lit(0)).alias("_rt_o"))
    # offsets has at most groups x slices rows (bounded by the collected edges)
    return (sliced.withColumn("_rt_l", F.sum("_rt_w").over(local))
            .join(F.broadcast(offsets), [*group_cols, "_rt_s"])
            .withColumn(out, F.col("_rt_o") + F.col("_rt_l"))
            .drop("_rt_w", "_rt_s", "_rt_l", "_rt_o"))


def row_number_in(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "_rn",
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """1-based row number per group; order must be total (add an id as tiebreaker)."""
    return running_total(df, group_cols, order_cols, None, out, rows_per_slice)


def first_per_key(df: DataFrame, key_cols: list[str], order_cols: list, keep: str = "first") -> DataFrame:
    """Keep one row per key: the first (or last) in ``order_cols`` order.

    Expressed as an aggregation of ``min/max(struct(order..., row))`` so Spark
    combines map-side: a key holding a third of all rows never lands in one
    task as raw rows.  Null keys form one group (pandas semantics).
    """
    others = [c for c in df.columns if c not in key_cols]
    order = [_as_col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)]
    packed = F.struct(*order, *[col(c).alias(c) for c in others])
    pick = F.min(packed) if keep == "first" else F.max(packed)
    agg = df.groupBy(*[col(k) for k in key_cols]).agg(pick.alias("_pick"))
    return agg.select(*[col(k) for k in key_cols], *[F.col("_pick")[c].alias(c) for c in others]) \
        .select(*df.columns)


def dense_codes(values: DataFrame, column: str, out: str = "_code") -> DataFrame:
    """0-based code of each distinct value of ``column`` in sorted order, without a single-task window.

    Small inputs (by the optimizer's size estimate) use one window.  Otherwise the
    distinct values are range-partitioned, written once with their partition id
    (so every later read sees the same assignment), numbered inside each range and
    shifted by the sizes of the earlier ranges (one row per range).
    """
    from ..session import materialize
    d = values.select(col(column).alias("_lv")).where(F.col("_lv").isNotNull()).distinct()
    est = estimated_bytes(d)
    if est is not None and est * _SAFETY <= SMALL_INPUT_BYTES:
        return d.select(F.col("_lv").alias(column),
                        (F.row_number().over(Window.orderBy("_lv")) - 1).cast("long").alias(out))
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(d.repartitionByRange(n, "_lv").withColumn("_pid", F.spark_partition_id()), "codes")
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_pid").orderBy("_lv")))
    sizes = parts.groupBy("_pid").agg(F.count(F.lit(1)).alias("_s"))
    offs = sizes.select("_pid", F.coalesce(F.sum("_s").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # one row per range
    return local.join(F.broadcast(offs), "_pid").select(
        F.col("_lv").alias(column), (F.col("_o") + F.col("_r") - 1).cast("long").alias(out))
