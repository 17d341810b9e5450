"""Sums over windows that end at each row's own reference time, for keys of any size.

A sum over (reference - span .. reference) is a difference of two running sums, so a reference row asks for the
running sum at a few instants and no range join is needed.  Time is cut into slices; the running sum at an
instant is the sum of the key's earlier slices (one row per key and slice that has rows) plus the running sum
inside the slice.  A key that holds a third of the rows is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import col

DAY = 86_400_000_000  # microseconds
#: length of a time slice
SLICE_SECONDS = 6 * 3600
#: values are summed exactly as decimals, so that differences of long running sums keep all digits
DECIMAL = "decimal(28,8)"


def trailing_sums(refs: DataFrame, events: DataFrame, key: str, ref_id: str, ref_ts: str, ts: str, value: str,
                  spans: dict[str, int], slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """(ref_id, <name>..., <name>_n...): for every reference row the sum and the number of non-NULL values of its key's
    events from ``days`` before the reference up to it, both ends included, for every ``name: days`` of ``spans``.

    ``ref_id`` must identify the reference rows.  A reference without key or time has sums of 0; events without key
    or time are in no window."""
    def instant(c):
        return F.unix_micros(col(c).cast("timestamp"))
    no_id = F.lit(None).cast(refs.schema[ref_id].dataType)
    none = F.lit(None).cast(DECIMAL)
    moves = events.where(col(key).isNotNull() & col(ts).isNotNull()).select(
        col(key).alias("k"), instant(ts).alias("t"), F.lit(1).alias("tie"), col(value).try_cast(DECIMAL).alias("v"),
        no_id.alias("r"), F.lit(None).cast("string").alias("ask"))
    at = instant(ref_ts)
    asked = F.array(F.struct(F.lit("").alias("ask"), at.alias("t"), F.lit(2).alias("tie")),
                    *[F.struct(F.lit(n).alias("ask"), (at - F.lit(d * DAY)).alias("t"), F.lit(0).alias("tie")) for n, d in spans.items()])
    probes = (refs.where(col(key).isNotNull() & col(ref_ts).isNotNull()).select(col(key).alias("k"), col(ref_id).alias("r"), F.inline(asked))
              .select("k", "t", "tie", none.alias("v"), "r", "ask"))
    rows = moves.unionByName(probes).withColumn("s", F.floor(F.col("t") / F.lit(slice_seconds * 1_000_000)))
    zero = F.lit(0).cast("decimal(38,8)")
    per = rows.groupBy("k", "s").agg(F.coalesce(F.sum("v"), zero).alias("sv"), F.count("v").alias("sn"))
    earlier = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # one row per slice
    before = per.select("k", "s", F.coalesce(F.sum("sv").over(earlier), zero).alias("bv"), F.coalesce(F.sum("sn").over(earlier), F.lit(0)).alias("bn"))
    inside = Window.partitionBy("k", "s").orderBy("t", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = (rows.withColumn("lv", F.coalesce(F.sum("v").over(inside), zero)).withColumn("ln", F.count("v").over(inside))
           .where("ask is not null").join(before, ["k", "s"])
           .select("r", "ask", (F.col("bv") + F.col("lv")).alias("rv"), (F.col("bn") + F.col("ln")).alias("rn")))

    def of(name, c):
        return F.max(F.when(F.col("ask") == name, F.col(c)))
    sums = run.groupBy("r").agg(*[(of("", "rv") - of(n, "rv")).cast("double").alias(n) for n in spans],
                                *[(of("", "rn") - of(n, "rn")).alias(f"{n}_n") for n in spans])
    out = refs.select(col(ref_id)).join(sums, col(ref_id) == F.col("r"), "left")
    return out.select(col(ref_id), *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in spans],
                      *[F.coalesce(F.col(f"{n}_n"), F.lit(0)).cast("long").alias(f"{n}_n") for n in spans])


def recent_against_year(refs: DataFrame, events: DataFrame, key: str, ref_id: str, ref_ts: str, ts: str, value: str,
                        days: int = 30, year: int = 365) -> DataFrame:
    """(ref_id, recent, recent_n, yearly_mean, recent_ratio): the sum of the last ``days`` days, the mean of such a
    sum over the last ``year`` days, and how many times the mean the recent sum is (NULL where the mean is 0)."""
    s = trailing_sums(refs, events, key, ref_id, ref_ts, ts, value, {"recent": days, "yearly": year})
    mean = F.col("yearly") * F.lit(days / year)
    return s.select(col(ref_id), "recent", "recent_n", mean.alias("yearly_mean"),
                    F.try_divide(F.col("recent"), F.nullif(mean, F.lit(0.0))).alias("recent_ratio"))
