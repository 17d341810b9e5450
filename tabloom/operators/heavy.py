"""Frequent values of many columns without counting every value.

1. One pass keeps a frequent-items sketch per column (at most ``ITEMS`` tracked values; tasks merge their sketches).
2. One pass counts the sketch's ``CANDIDATES`` values exactly; what is shuffled is one row per candidate.
3. The sketch bounds the count of every value it did not return.  Where the k-th exact count lies above the bound,
   or the candidates' counts make up all rows, no other value can be among the k most frequent ones.  Columns where it does not (whose
   values are all about as rare) are the only ones whose values are counted in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import col
from .kernels import long_form, value_counts

#: tracked values of a sketch, and how many of them are counted exactly
ITEMS, CANDIDATES = 4096, 64
#: the sketch's error: a value it does not hold came up at most this share of the rows, divided by ITEMS
ERROR = 3.5


def candidates(df: DataFrame, columns: list[str], items: int = ITEMS, k: int = CANDIDATES) -> dict[str, dict]:
    """Per column: its number of non-NULL values, the sketch's most frequent values (as text) and ``bound``, above
    which the count of no other value lies.  A column's k values reach the driver."""
    def text(c):
        v = col(c)
        kind = df.schema[c].dataType.simpleString()
        return F.when(~F.isnan(v), v).cast("string") if kind in ("double", "float") else v.cast("string")
    plain = df.select(*[text(c).alias(f"h{i}") for i, c in enumerate(columns)])
    row = plain.agg(*[F.count(f"h{i}").alias(f"n{i}") for i in range(len(columns))],
                    *[F.expr(f"approx_top_k(h{i}, {k}, {items})").alias(f"t{i}") for i in range(len(columns))]).first()
    out = {}
    for i, c in enumerate(columns):
        found = [(x["item"], x["count"]) for x in row[f"t{i}"] or [] if x["item"] is not None]
        n = row[f"n{i}"]
        # a value that is not returned has at most the last estimate, or was dropped with at most the sketch's error
        bound = max(found[-1][1] if len(found) == k else 0, int(ERROR * n / items) + 1)
        out[c] = {"n": n, "values": [v for v, _ in found], "bound": bound}
    return out


def candidate_counts(df: DataFrame, found: dict[str, dict]) -> DataFrame:
    """(column, value, n): exact counts of the candidates."""
    used = [c for c, x in found.items() if x["values"]]
    if not used:
        return df.sparkSession.createDataFrame([], "column string, value string, n long")
    wanted = F.create_map(*[x for c in used for x in (F.lit(c), F.array(*[F.lit(v) for v in found[c]["values"]]))])
    lf = long_form(df, used, "string")
    return (lf.where(F.array_contains(F.element_at(wanted, F.col("column")), F.col("value")))
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))


def top_counts(df: DataFrame, columns: list[str], k: int = 5, items: int = ITEMS) -> DataFrame:
    """(column, value, n, rnk): the k most frequent non-NULL values (as text) of every column, ties by value; exact."""
    found = candidates(df, columns, items)
    counts = candidate_counts(df, found)
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    counted = counts.withColumn("rnk", F.row_number().over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("column")))
    held = counted.where(F.col("rnk") <= k).collect()  # k rows per column
    kept = [tuple(r)[:4] for r in held]
    seen = {r["column"]: r["all"] for r in held}
    sure = []
    for c in columns:
        mine = sorted(r[2] for r in kept if r[0] == c)
        # the candidates are all values there are, or no other value can come near
        if seen.get(c, 0) == found[c]["n"] or (len(mine) == k and mine[0] > found[c]["bound"]):
            sure.append(c)
    out = df.sparkSession.createDataFrame([r for r in kept if r[0] in sure], "column string, value string, n long, rnk int")
    rest = [c for c in columns if c not in sure]
    if rest:
        vc = value_counts(df, rest).where(F.col("value").isNotNull())
        out = out.unionByName(vc.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k))
    return out


def near_constant(df: DataFrame, columns: list[str], threshold: float) -> dict[str, float]:
    """Columns one of whose values (NULL is one) has at least ``threshold`` of the rows, with that exact share.

    A value with a share above the sketch's error is always a candidate, so nothing else is ever counted."""
    if not threshold > 2 * ERROR / ITEMS:
        raise ValueError(f"a share of {threshold} may lie below the sketch's error")
    found = candidates(df, columns, ITEMS, 2)
    best = {r["column"]: r["m"] for r in candidate_counts(df, found).groupBy("column").agg(F.max("n").alias("m")).collect()}
    total = df.count()
    top = {c: max(best.get(c, 0), total - found[c]["n"]) for c in columns}
    return {c: n / total for c, n in top.items() if total and n / total >= threshold}


def near_unique(df: DataFrame, columns: list[str], threshold: float) -> dict[str, float]:
    """Columns whose number of distinct values is at least ``threshold`` of their non-NULL values, with that exact
    ratio.  A sketch of the distinct values rules out the columns that are far below; the others are counted."""
    from .sketches import LG_K, SIGMAS, column_sketches
    if not columns:
        return {}
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    slack = 1 + SIGMAS / (1 << LG_K) ** 0.5
    near = [r["column"] for r in column_sketches(df, columns).select("column", "n").collect()
            if sizes[r["column"]] and r["n"] * slack >= threshold * sizes[r["column"]]]
    if not near:
        return {}
    exact = value_counts(df, near).where(F.col("value").isNotNull()).groupBy("column").agg(F.count(F.lit(1)).alias("d")).collect()
    return {r["column"]: r["d"] / sizes[r["column"]] for r in exact if r["d"] / sizes[r["column"]] >= threshold}
