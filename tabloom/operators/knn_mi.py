"""K-nearest-neighbour mutual information between continuous features and a
discrete target (Ross 2014, the estimator behind the reference's MI scores).

For a point i of class c (classes of one point are dropped): k_i = min(k, N_c - 1),
r_i = distance to its k_i-th nearest neighbour inside class c, m_i = number of
points of any class with |x_j - x_i| < r_i (itself included).
MI = psi(N) + mean psi(k_i) - mean psi(N_c(i)) - mean psi(m_i), clipped at 0.

Plan for up to ``CLASSES`` classes (no join of points, one shuffle of (feature, class, x)):
  * the wanted columns are written once; sizes of the classes and the features' scales come from wide aggregates;
  * the points are dealt by ranges of (feature, x), sorted, and written as blocks of ``SLICE`` points; every block's
    ends and the first and last k values of each class come to the driver;
  * the k nearest same-class neighbours of a 1-D point lie within k positions on either side: a block takes those of
    its own and, next to its edges, the k values of each class beyond them (a halo);
  * m_i is counted by binary search inside the block (x + r placed before equal points, x - r after them; where r
    is 0 it counts the points equal to x_i).  At most the first and last k values of each class reach beyond their
    block: the places they ask for are counted by the blocks in one more pass.
With more classes neighbours come from windows over (feature, class) slices with a halo, m_i from one running count
over points and probes.
A feature whose classes all have one point (or no values) has MI 0 and n 0.
Ties are broken, as in the reference library, by a tiny deterministic jitter
(here a function of the row id), after scaling each feature to unit variance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cols import col
from ..functions.stats import digamma_int
from ..session import materialize
from .kernels import long_form
from .ordering import row_number_in, running_total

JITTER = 1e-10
#: points of a block, positions of one class that a task takes at a time
SLICE = 250_000
#: classes of the target up to which points are counted in blocks
CLASSES = 256
#: points dealt to a task, rows of a file of the written columns
POINTS = 500_000
BLOCK = ("f int, part int, seq int, n int, lo double, hi double, xs binary, ys binary, sizes binary, firsts binary, "
         "lasts binary")


def _hash_normal(*cols) -> "F.Column":
    mask = F.lit((1 << 52) - 1)
    u1 = (F.xxhash64(*cols, F.lit(1)).bitwiseAND(mask).cast("double") + 1.0) / float(1 << 52)
    u2 = F.xxhash64(*cols, F.lit(2)).bitwiseAND(mask).cast("double") / float(1 << 52)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)


def knn_mutual_info(df: DataFrame, features: list[str], target: str, id_col: str, k: int = 3,
                    jitter: bool = True) -> DataFrame:
    """(feature, mutual_info, n) for each feature."""
    def typed(c):
        v = col(c).cast("double")
        return F.when(~F.isnan(v), v)  # NaN is a missing value

    rows = materialize(df.where(col(target).isNotNull()).select(
        col(target).alias("_y"), col(id_col).alias("_id"), *[typed(c).alias(f"_v{i}") for i, c in enumerate(features)]), "knn-rows", POINTS)
    sizes = rows.groupBy("_y").agg(*[F.count(f"_v{i}") for i in range(len(features))]).limit(CLASSES + 1).collect()
    if len(sizes) > CLASSES:
        named = rows.select(col("_y").alias(target), col("_id").alias(id_col), *[col(f"_v{i}").alias(c) for i, c in enumerate(features)])
        return _by_windows(named, features, target, id_col, k, jitter)
    return _by_blocks(rows, sizes, features, k, jitter)


def _psi(n: np.ndarray) -> np.ndarray:
    """psi of positive integers, as ``digamma_int``."""
    x = np.asarray(n, float)
    z = x + 6
    return (np.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z ** 4) - 1 / (252 * z ** 6)
            - sum(1 / (x + i) for i in range(6)))


def _points(rows: DataFrame, sizes: list, features: list[str], jitter: bool) -> DataFrame:
    """(f, y, x): feature's and class's numbers, values of unit variance (population std) with deterministic jitter."""
    scale = rows.agg(*[a for i in range(len(features)) for a in (F.stddev_pop(f"_v{i}"), F.avg(F.abs(f"_v{i}")))]).first()
    codes = rows.sparkSession.createDataFrame([(r["_y"], i) for i, r in enumerate(sizes)], rows.select("_y").schema.add("y", T.IntegerType()))

    def x(i, c):
        sd, mean = scale[2 * i], scale[2 * i + 1]
        if sd is None or math.isnan(sd):  # no values, or infinite ones: no two of them differ
            return F.when(F.col(f"_v{i}").isNotNull(), F.lit(0.0))
        v = F.col(f"_v{i}") / F.lit(sd) if sd > 0 else F.col(f"_v{i}")
        return v + F.lit(JITTER * max(1.0, mean / sd if sd > 0 else mean)) * _hash_normal(F.col("_id"), F.lit(c)) if jitter else v

    pairs = F.array(*[F.struct(F.lit(i).alias("f"), x(i, c).alias("x")) for i, c in enumerate(features)])
    return rows.join(F.broadcast(codes), "_y").select("y", F.inline(pairs)).where(F.col("x").isNotNull()).select("f", "y", "x")


def _by_blocks(rows: DataFrame, sizes: list, features: list[str], k: int, jitter: bool) -> DataFrame:
    spark = rows.sparkSession
    size, classes = SLICE, len(sizes)
    nc = np.array([[r[i + 1] for r in sizes] for i in range(len(features))], np.int64).reshape(len(features), classes)
    nc[nc == 1] = 0  # classes of one point are dropped
    total = int(nc.sum())
    if not total:
        return spark.createDataFrame([(f, 0.0, 0) for f in features], "feature string, mutual_info double, n long")

    def cut(batches):
        from pyspark import TaskContext
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        f, y, x = (np.concatenate(c) for c in zip(*got))
        del got
        part, seq = TaskContext.get().partitionId(), 0
        for i in np.unique(f):
            own = np.flatnonzero((f == i) & (nc[i, y] > 0))
            own = own[np.argsort(x[own])]
            for at in range(0, len(own), size):
                xs, ys = x[own[at: at + size]], y[own[at: at + size]]
                firsts, lasts = np.full((classes, k), np.inf), np.full((classes, k), -np.inf)
                for c in np.unique(ys):
                    v = xs[ys == c]
                    few = min(k, len(v))
                    firsts[c, :few], lasts[c, k - few:] = v[:few], v[len(v) - few:]
                yield pa.RecordBatch.from_pylist([{
                    "f": int(i), "part": part, "seq": seq, "n": len(xs), "lo": xs[0], "hi": xs[-1], "xs": xs.tobytes(),
                    "ys": ys.astype(np.int16).tobytes(), "sizes": np.bincount(ys, minlength=classes).tobytes(),
                    "firsts": firsts.tobytes(), "lasts": lasts.tobytes()}], schema=_arrow_schema)
                seq += 1

    _arrow_schema = pa.schema([("f", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("lo", pa.float64()),
                               ("hi", pa.float64()), *[(c, pa.binary()) for c in ("xs", "ys", "sizes", "firsts", "lasts")]])
    points = _points(rows, sizes, features, jitter).repartitionByRange(-(-total // POINTS), "f", "x")
    blocks = materialize(points.mapInArrow(cut, BLOCK), "knn-blocks")
    # a row per block: ranges of (feature, x) in order of their task
    ends = blocks.drop("xs", "ys").orderBy("f", "part", "seq").collect()
    halos = _halos(ends, classes, k)
    shared = spark.sparkContext.broadcast((halos, np.minimum(k, nc - 1)))

    def count(batches):
        halos, kk = shared.value
        for b in batches:
            for f, part, seq, xs, ys in zip(*(b.column(i).to_pylist() for i in range(5))):
                xs, ys = np.frombuffer(xs), np.frombuffer(ys, np.int16)
                before, after = halos[part, seq]
                r = np.empty(len(xs))
                for c in np.unique(ys):
                    own = np.flatnonzero(ys == c)
                    v = np.concatenate([before[c], xs[own], after[c]])
                    mid = v[k: len(v) - k]
                    near = [mid - v[k - d: len(v) - k - d] for d in range(1, k + 1)] + [
                        v[k + d: len(v) - k + d] - mid for d in range(1, k + 1)]
                    r[own] = np.partition(np.stack(near, 1), kk[f, c] - 1, axis=1)[:, kk[f, c] - 1]
                # places just inside the radius: the k-th neighbour at exactly r must not be counted even when x + r
                # rounds past it (shrink 1e-12 relative, far below the tie jitter); a radius of 0 or below the spacing
                # of numbers at x leaves them at x itself: they take in the points equal to x
                rr = r * (1 - 1e-12)
                up, lo = xs + rr, xs - rr
                up_right, lo_right = ~(up > xs), lo < xs  # whether points equal to the place come before it
                here = (up > xs[0]) & (up < xs[-1]) & (lo > xs[0]) & (lo < xs[-1])
                m = (np.where(up_right, np.searchsorted(xs, up, "right"), np.searchsorted(xs, up, "left"))
                     - np.where(lo_right, np.searchsorted(xs, lo, "right"), np.searchsorted(xs, lo, "left")))[here]
                asked, w = np.unique(np.stack([up, up_right, lo, lo_right], 1)[~here], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f], pa.int32()), pa.array([float(_psi(m).sum())]),
                     *[pa.array([a.tolist()], pa.list_(pa.float64())) for a in asked.T], pa.array([w.tolist()], pa.list_(pa.int64()))],
                    names=["f", "psi", "up", "up_right", "lo", "lo_right", "w"])

    places = "up array<double>, up_right array<double>, lo array<double>, lo_right array<double>"
    counted = blocks.select("f", "part", "seq", "xs", "ys").mapInArrow(count, f"f int, psi double, {places}, w array<long>").collect()
    psi = np.zeros(len(features))
    for i in range(len(features)):
        mine = [r for r in counted if r["f"] == i]
        asked = np.concatenate([np.stack([r[c] for c in ("up", "up_right", "lo", "lo_right")], 1) for r in mine] or [np.zeros((0, 4))])
        w = np.concatenate([np.array(r["w"], np.int64) for r in mine] or [np.zeros(0, np.int64)])
        at = np.concatenate([asked[:, :2], asked[:, 2:]])
        n = _ranks(blocks, [r for r in ends if r["f"] == i], i, at)
        psi[i] = math.fsum([*(r["psi"] for r in mine), *(w * _psi(n[:len(w)] - n[len(w):])).tolist()])
    out = []
    for i, f in enumerate(features):
        s = nc[i][nc[i] > 0].astype(float)
        n = int(s.sum())
        value = _psi(n) + ((_psi(np.minimum(k, s - 1)) - _psi(s)) * s).sum() / n - psi[i] / n if n else 0.0
        out.append((f, max(0.0, float(value)), n))
    return spark.createDataFrame(out, "feature string, mutual_info double, n long")


def _halos(ends: list, classes: int, k: int) -> dict:
    """(part, seq) of a block: the k values of each class before and after it, infinite where there are none."""
    out = {}
    for rows, side, pad in ((ends, "lasts", -np.inf), (ends[::-1], "firsts", np.inf)):
        f = None
        for r in rows:
            if r["f"] != f:
                f, near = r["f"], np.full((classes, k), pad)
            out.setdefault((r["part"], r["seq"]), []).append(near)
            own, had = np.frombuffer(r[side]).reshape(classes, k), np.frombuffer(r["sizes"], np.int64)
            near = near.copy()
            for c in np.flatnonzero(had):
                few = min(k, int(had[c]))
                near[c] = np.r_[near[c, few:], own[c, k - few:]] if pad < 0 else np.r_[own[c, :few], near[c, :k - few]]
    return out


def _ranks(blocks: DataFrame, ends: list, f: int, at: np.ndarray) -> np.ndarray:
    """Number of points of feature ``f`` before every place ``at`` (value, whether points equal to it come before it)."""
    if not len(at):
        return np.zeros(0, np.int64)
    ask, back = np.unique(at, axis=0, return_inverse=True)
    v, right = ask[:, 0], ask[:, 1] > 0
    n, hi = np.array([0] + [r["n"] for r in ends], np.int64), np.array([r["hi"] for r in ends])
    rank = np.cumsum(n)[np.where(right, np.searchsorted(hi, v, "right"), np.searchsorted(hi, v, "left"))]

    def run(batches):
        for b in batches:
            for xs in b.column(0).to_pylist():
                xs = np.frombuffer(xs)
                part = np.flatnonzero(np.where(right, (xs[0] <= v) & (v < xs[-1]), (xs[0] < v) & (v <= xs[-1])))
                if len(part):
                    n = np.where(right[part], np.searchsorted(xs, v[part], "right"), np.searchsorted(xs, v[part], "left"))
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n)], names=["at", "n"])

    for r in blocks.where(F.col("f") == f).select("xs").mapInArrow(run, "at long, n long").collect():
        rank[r["at"]] += r["n"]
    return rank[back.ravel()]


def _by_windows(df: DataFrame, features: list[str], target: str, id_col: str, k: int, jitter: bool) -> DataFrame:
    """The same by windows, for a target of any number of classes."""
    lf = (long_form(df, features, "double", [target, id_col])
          .where(F.col("value").isNotNull() & col(target).isNotNull())
          .select(F.col("column"), col(target).alias("_y"), col(id_col).alias("_id"), "value"))
    # unit variance (population std) and deterministic jitter, per feature
    sc = lf.groupBy("column").agg(F.stddev_pop("value").alias("_sd"), F.avg(F.abs("value")).alias("_ma"))
    x = F.when(F.col("_sd") > 0, F.col("value") / F.col("_sd")).otherwise(F.col("value"))
    lf = lf.join(F.broadcast(sc), "column").withColumn("x", x)
    if jitter:
        amp = F.lit(JITTER) * F.greatest(F.lit(1.0), F.when(F.col("_sd") > 0, F.col("_ma") / F.col("_sd"))
                                         .otherwise(F.col("_ma")))
        lf = lf.withColumn("x", F.col("x") + amp * _hash_normal(F.col("_id"), F.col("column")))
    lf = lf.select("column", "_y", "_id", "x")
    # class sizes; classes of one point are dropped
    nc = lf.groupBy("column", "_y").agg(F.count(F.lit(1)).alias("_nc")).where(F.col("_nc") > 1)
    pts = lf.join(nc, ["column", "_y"]).withColumn("_k", F.least(F.lit(k), F.col("_nc") - 1))
    pts = row_number_in(pts, ["column", "_y"], ["x", "_id"], out="_p")
    pts = materialize(pts, "positions")
    # r_i: k_i-th smallest distance among the k positions before and after
    r = neighbour_radius(pts, k)
    # m_i from one running count over points and probes
    points = pts.select("column", F.col("x").alias("_v"), F.lit(1).alias("_tie"), F.lit(1).cast("long").alias("_w"),
                        F.lit(None).cast("string").alias("_py"), F.lit(None).cast("long").alias("_pp"),
                        F.lit(None).cast("string").alias("_side"))
    # probes just inside the radius: the k-th neighbour at exactly r must not be counted even
    # when x + r rounds past it (shrink 1e-12 relative, far below the tie jitter)
    rr = F.col("_r") * (1 - 1e-12)
    # a radius of 0 (equal values) or below the spacing of numbers at x leaves the probes at x itself: they take in
    # the points equal to x, of which the point is one
    over, under = F.col("x") + rr, F.col("x") - rr
    up = r.select("column", over.alias("_v"), F.when(over > F.col("x"), 0).otherwise(2).alias("_tie"),
                  F.lit(0).cast("long").alias("_w"), F.col("_y").cast("string").alias("_py"), F.col("_p").alias("_pp"),
                  F.lit("up").alias("_side"))
    lo = r.select("column", under.alias("_v"), F.when(under < F.col("x"), 2).otherwise(0).alias("_tie"),
                  F.lit(0).cast("long").alias("_w"), F.col("_y").cast("string").alias("_py"), F.col("_p").alias("_pp"),
                  F.lit("lo").alias("_side"))
    swept = running_total(points.unionByName(up).unionByName(lo), ["column"], ["_v", "_tie"], weight="_w",
                          out="_cum")
    m = (swept.where(F.col("_side").isNotNull())
         .groupBy("column", "_py", "_pp")
         .agg((F.sum(F.when(F.col("_side") == "up", F.col("_cum"))) -
               F.sum(F.when(F.col("_side") == "lo", F.col("_cum")))).alias("_m"))
         .groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.avg(digamma_int(F.col("_m"))).alias("_pm")))
    size = F.col("_nc")
    per_class = nc.groupBy("column").agg(
        (F.sum(size * digamma_int(F.least(F.lit(k), size - 1))) / F.sum(size)).alias("_pk"),
        (F.sum(size * digamma_int(size)) / F.sum(size)).alias("_pn"))
    named = df.sparkSession.createDataFrame([(f,) for f in features], "column string")
    agg = named.join(m, "column", "left").join(per_class, "column", "left")
    value = F.greatest(F.lit(0.0), digamma_int(F.col("n")) + F.col("_pk") - F.col("_pn") - F.col("_pm"))
    return agg.select(F.col("column").alias("feature"),
                      F.when(F.col("n") > 0, value).otherwise(F.lit(0.0)).alias("mutual_info"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def neighbour_radius(pts: DataFrame, k: int, size: int | None = None) -> DataFrame:
    """(column, _y, _p, x, _k, _r): distance of every point to its _k-th nearest one of its (column, class), from
    positions _p = 1.. in the order of x."""
    size = max(size or SLICE, k)
    own = F.floor((F.col("_p") - 1) / size)
    at = F.pmod(F.col("_p") - 1, F.lit(size))
    slices = F.array_compact(F.array(own, F.when(at < k, own - 1), F.when(at >= size - k, own + 1)))
    rows = pts.select("column", "_y", "_p", "x", "_k", own.alias("_own"), F.explode(slices).alias("_s"))
    w = Window.partitionBy("column", "_y", "_s").orderBy("_p")
    near = [F.abs(F.col("x") - step("x", d).over(w)) for d in range(1, k + 1) for step in (F.lag, F.lead)]
    return (rows.withColumn("_ds", F.sort_array(F.array_compact(F.array(*near)))).where("_s = _own")
            .select("column", "_y", "_p", "x", "_k", F.element_at("_ds", F.col("_k").cast("int")).alias("_r")))
