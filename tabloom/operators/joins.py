"""Joins J01-J12 with diagnostics, key discovery and U03 duplicate counting.

Joins are plain DataFrame equi-joins; Spark picks broadcast only when the
measured side is under ``spark.sql.autoBroadcastJoinThreshold`` (AQE), else a
shuffle join.  Lookups deduplicate the right side by aggregation first, so a
lookup join never fans out.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cols import rnd, col
from .kernels import long_form
from .ordering import first_per_key
from .sketches import exact_overlap, possible_pairs


@dataclass
class JoinSpec:
    left: str
    right: str
    left_key: str
    right_key: str
    how: str = "left"


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side columns of two one-row aggregates (b enters as a scalar subquery)."""
    packed = b.select(F.struct(*[F.col(c) for c in b.columns]).alias("_sc")).scalar()
    return a.withColumn("_sc", packed).select("*", *[F.col("_sc")[c].alias(c) for c in b.columns]).drop("_sc")


def row_keys(df: DataFrame) -> list:
    """Columns that tell whole rows apart, NULLs equal, for counting distinct ones: 128 bits of hash, so that a task
    keeps two longs per distinct row and not the row.  Hashes pass over NULLs, so where they are is hashed too.
    Frames with nested columns (whose hash passes over NULLs inside) are told apart by the row itself."""
    if any(f.dataType.simpleString().startswith(("array", "map", "struct", "variant", "void")) for f in df.schema.fields):
        return [F.struct(*[col(c) for c in df.columns])]
    nulls = [functools.reduce(lambda a, b: a.bitwiseOR(b), [F.when(col(c).isNull(), 1 << i).otherwise(0).cast("long")
                                                          for i, c in enumerate(df.columns[at: at + 30])])
             for at in range(0, len(df.columns), 30)]
    return [F.xxhash64(F.lit(seed), *nulls, *[col(c) for c in df.columns]) for seed in (1, 2)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(n_rows, duplicate_rows) = count(*) - count(distinct row); NULLs compare equal."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(*row_keys(df)).alias("_d")) \
        .select("n_rows", (F.col("n_rows") - F.col("_d")).alias("duplicate_rows"))


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left",
         null_keys_match: bool = False, suffix: str = "_right") -> DataFrame:
    """Equi-join; right columns clashing with left get ``suffix``.

    When the key names differ the right key is dropped; for outer/right joins
    the surviving key is the coalesce of both so right-only rows keep theirs.
    ``null_keys_match`` gives pandas semantics (NULL key meets NULL key).
    """
    how = {"outer": "full_outer", "full": "full_outer"}.get(how, how)
    rk = "_jr_key"
    renames = {c: (c + suffix if c in left.columns and c != right_key else c) for c in right.columns}
    r = right.select(*[col(c).alias(renames[c]) for c in right.columns if c != right_key], col(right_key).alias(rk))
    cond = col(left_key).eqNullSafe(F.col(rk)) if null_keys_match else col(left_key) == F.col(rk)
    j = left.join(r, cond, how)
    if how in ("full_outer", "right"):
        j = j.withColumn(left_key, F.coalesce(col(left_key), F.col(rk)))
    return j.drop(rk)


def join_diagnostics(left: DataFrame, joined: DataFrame, new_columns: list[str]) -> DataFrame:
    """One row: rows_before, rows_after, rows_lost (negative = fan-out), n_cols,
    duplicate_rows, and per new column its null % (2 dp) as an array of structs."""
    before = left.agg(F.count(F.lit(1)).alias("rows_before"))
    after = joined.agg(
        F.count(F.lit(1)).alias("rows_after"),
        F.count_distinct(*row_keys(joined)).alias("_distinct"),
        *[F.count(col(c)).alias(f"_nn{i}") for i, c in enumerate(new_columns)])
    null_pct = F.array(*[F.struct(F.lit(c).alias("column"),
                                  rnd(F.try_divide((F.col("rows_after") - F.col(f"_nn{i}")) * 100.0,
                                                       F.col("rows_after")), 2).alias("null_pct"))
                         for i, c in enumerate(new_columns)])
    return one_row_join(before, after).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_lost"),
        F.lit(len(joined.columns)).alias("n_cols"),
        (F.col("rows_after") - F.col("_distinct")).alias("duplicate_rows"),
        null_pct.alias("new_column_null_pct"))


def match_rate(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Share of left rows with at least one partner (semi join), plus the left count."""
    r = right.select(col(right_key).alias("_k")).where(F.col("_k").isNotNull())
    hit = left.select(col(left_key).alias("_l")).join(r, F.col("_l") == F.col("_k"), "left_semi")
    a = left.agg(F.count(F.lit(1)).alias("left_rows"))
    b = hit.agg(F.count(F.lit(1)).alias("matched_rows"))
    return one_row_join(a, b).select("left_rows", "matched_rows",
                                         F.try_divide(F.col("matched_rows"), F.col("left_rows")).alias("match_rate"))


def relationship(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """1:1 / 1:N / N:1 / N:M from the maximum key multiplicity on each side."""
    lm = left.where(col(left_key).isNotNull()).groupBy(col(left_key)).count().agg(F.max("count").alias("left_max"))
    rm = right.where(col(right_key).isNotNull()).groupBy(col(right_key)).count().agg(F.max("count").alias("right_max"))
    lmany = F.coalesce(F.col("left_max"), F.lit(0)) > 1
    rmany = F.coalesce(F.col("right_max"), F.lit(0)) > 1
    return one_row_join(lm, rm).select(
        "left_max", "right_max",
        F.when(lmany & rmany, "N:M").when(lmany, "N:1").when(rmany, "1:N").otherwise("1:1").alias("relationship"))


def key_candidates_by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """Common columns ranked by duplicates in ``right`` (count - count distinct), ties by column order."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        return right.sparkSession.createDataFrame([], "column string, duplicates long, position int, chosen boolean")
    lf = long_form(right, common, "string")
    d = lf.groupBy("column").agg((F.count(F.lit(1)) - F.count_distinct("value")).alias("duplicates"))
    pos = F.create_map(*[x for i, c in enumerate(common) for x in (F.lit(c), F.lit(i))])
    d = d.withColumn("position", F.element_at(pos, F.col("column")))
    best = d.orderBy("duplicates", "position").limit(1).select(F.col("column").alias("_best"))
    return d.join(best, F.col("column") == F.col("_best"), "left") \
        .select("column", F.col("duplicates").cast("long").alias("duplicates"), "position",
                F.col("_best").isNotNull().alias("chosen"))


def key_candidates_by_overlap(left: DataFrame, right: DataFrame, min_ratio: float = 0.5) -> DataFrame:
    """J09 + U01: (left_column, right_column, overlap, left_distinct, ratio) for ratio >= ``min_ratio``.

    Sketches of all columns (one pass a side, nothing shuffled that grows with the rows) rule out the pairs
    whose containment is certainly lower; the values of the surviving pairs alone are made distinct and joined.
    """
    pairs = possible_pairs(left, left.columns, right, right.columns, min_ratio)
    return (exact_overlap(left, right, pairs)
            .withColumn("ratio", F.col("overlap") / F.col("left_distinct"))
            .where(F.col("ratio") >= F.lit(min_ratio)))


def lookup_join(left: DataFrame, right: DataFrame, key: str | None = None, order_by: list | None = None
                ) -> DataFrame:
    """Cardinality-preserving lookup of ``right`` onto ``left``.

    key: the common column with the fewest duplicates in ``right`` (J08) unless
    given; right deduplicated keep-first by ``order_by`` (default: all columns);
    right key cast to the left type; clash columns equal on every matched row
    collapse into one, others become ``_1``/``_2``.
    """
    if key is None:
        cand = key_candidates_by_name(left, right).where("chosen").first()
        if cand is None:
            raise ValueError("no common column to join on")
        key = cand["column"]
    ltype = dict(left.dtypes)[key]
    r = right.withColumn(key, col(key).cast(ltype))
    rest = [c for c in r.columns if c != key]
    r = first_per_key(r, [key], order_by or rest)
    clashes = [c for c in rest if c in left.columns]
    ren = r.select(col(key), *[col(c).alias(c + "__r") if c in clashes else col(c) for c in rest],
                   F.lit(True).alias("__matched"))
    j = left.join(ren, key, "left")
    if not clashes:
        return j.select(*left.columns, *[c for c in rest])
    # a clash collapses when left and right agree (NULL = NULL) on every row that found a partner
    eq = j.agg(*[F.coalesce(F.bool_and(F.when(F.col("__matched"), col(c).eqNullSafe(col(c + "__r")))),
                            F.lit(True)).alias(c) for c in clashes]).first().asDict()
    out = []
    for c in left.columns:
        out.append(col(c).alias(c) if c not in clashes or eq[c] else col(c).alias(c + "_1"))
    for c in rest:
        if c in clashes:
            if not eq[c]:
                out.append(col(c + "__r").alias(c + "_2"))
        else:
            out.append(col(c))
    return j.select(*out)


def positional_merge(t1: DataFrame, t2: DataFrame, row_id: str, drop_similar: bool = False) -> DataFrame:
    """Full outer join on an explicit row id; shared names combine-first
    (t1 value, else t2); optionally drop columns identical to an earlier one.

    Identical-column detection is one aggregation of ``bool_and(a <=> b)`` over
    same-typed pairs.
    """
    shared = [c for c in t2.columns if c in t1.columns and c != row_id]
    a = t1.select(*[col(c).alias(c if c == row_id else f"_a_{c}") for c in t1.columns])
    b = t2.select(*[col(c).alias(c if c == row_id else f"_b_{c}") for c in t2.columns])
    j = a.join(b, row_id, "full_outer")
    cols = [col(row_id)]
    names = [row_id]
    for c in t1.columns:
        if c == row_id:
            continue
        cols.append(F.coalesce(F.col(f"_a_{c}"), F.col(f"_b_{c}")).alias(c) if c in shared else F.col(f"_a_{c}").alias(c))
        names.append(c)
    for c in t2.columns:
        if c == row_id or c in shared:
            continue
        cols.append(F.col(f"_b_{c}").alias(c))
        names.append(c)
    merged = j.select(*cols)
    if not drop_similar:
        return merged
    types = dict(merged.dtypes)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1:]
             if x != row_id and y != row_id and types[x] == types[y]]
    if not pairs:
        return merged
    same = merged.agg(*[F.bool_and(col(x).eqNullSafe(col(y))).alias(f"p{k}")
                        for k, (x, y) in enumerate(pairs)]).first()
    drop = {y for k, (x, y) in enumerate(pairs) if same[f"p{k}"]}
    return merged.select(*[col(c) for c in names if c not in drop])


def merge_chain(catalog, base: str, specs: list[JoinSpec]) -> DataFrame:
    """Fold of joins over a base table; Catalyst plans the whole star at once."""
    def step(df, s: JoinSpec):
        return join(df, catalog.table(s.right), s.left_key, s.right_key, s.how)
    return functools.reduce(step, specs, catalog.table(base))


def attach(df: DataFrame, features: DataFrame, id_col: str, check_unique: bool = True) -> DataFrame:
    """Left join a feature (or label) table by id; duplicate ids are refused, not fanned out."""
    if check_unique:
        dup = features.groupBy(col(id_col)).count().where(F.col("count") > 1).limit(1).count()
        if dup:
            raise ValueError(f"id column '{id_col}' is not unique in the attached table")
    return df.join(features, id_col, "left")
