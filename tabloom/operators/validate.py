"""Output validation and role detection: M08, M10, M11, M13."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import col
from .kernels import value_counts

# Id column names recognised by name (compared after lower-casing and
# dropping every non-alphanumeric character on both sides).
ID_NAMES = ["id", "client_id", "user_id", "object_id", "customer_id"]


def _norm(name: str) -> str:
    return re.sub(r"[^0-9a-z]", "", name.lower())


def validate_outputs(train_in: DataFrame, test_in: DataFrame, train_out: DataFrame, test_out: DataFrame,
                     features: list[str]) -> DataFrame:
    """(check, ok, detail) rows.  Row counts and null counts come from one aggregation per frame."""
    spark = train_in.sparkSession

    def counts(df, feats):
        aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(col(f)).alias(f"_nn{i}") for i, f in enumerate(feats)]
        return df.agg(*aggs).first()

    tin = train_in.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    sin = test_in.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    ftr = [f for f in features if f in train_out.columns]
    fte = [f for f in features if f in test_out.columns]
    ctr, cte = counts(train_out, ftr), counts(test_out, fte)
    nulls_tr = sum(ctr["_rows"] - ctr[f"_nn{i}"] for i in range(len(ftr)))
    nulls_te = sum(cte["_rows"] - cte[f"_nn{i}"] for i in range(len(fte)))
    all_null = [f for i, f in enumerate(ftr) if ctr[f"_nn{i}"] == 0] + [f for i, f in enumerate(fte) if cte[f"_nn{i}"] == 0]
    order_tr = [c for c in train_out.columns if c in features]
    order_te = [c for c in test_out.columns if c in features]
    rows = [
        ("train_rows_kept", ctr["_rows"] == tin, f"{ctr['_rows']}/{tin}"),
        ("test_rows_kept", cte["_rows"] == sin, f"{cte['_rows']}/{sin}"),
        ("feature_count_1_to_5", 1 <= len(features) <= 5, str(len(features))),
        ("train_originals_kept", all(c in train_out.columns for c in train_in.columns), ""),
        ("test_originals_kept", all(c in test_out.columns for c in test_in.columns), ""),
        ("same_features_same_order", order_tr == order_te and order_tr == [f for f in features], ""),
        ("no_all_null_feature", not all_null, ",".join(all_null)),
        ("unique_names", len(set(train_out.columns)) == len(train_out.columns)
         and len(set(test_out.columns)) == len(test_out.columns), ""),
        ("feature_null_cells", nulls_tr == 0 and nulls_te == 0, f"{nulls_tr}/{nulls_te}"),
    ]
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def detect_target(train: DataFrame, test: DataFrame) -> DataFrame:
    """Columns in train but not test; prefer exactly two distinct non-null values, else the first.
    (column, position, n_distinct, chosen)."""
    cands = [c for c in train.columns if c not in test.columns]
    if not cands:
        return train.sparkSession.createDataFrame([], "column string, position int, n_distinct long, chosen boolean")
    vc = value_counts(train, cands).where(F.col("value").isNotNull())
    nd = vc.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    pos = F.create_map(*[x for i, c in enumerate(cands) for x in (F.lit(c), F.lit(i))])
    nd = nd.withColumn("position", F.element_at(pos, F.col("column")))
    w = Window.orderBy(F.when(F.col("n_distinct") == 2, 0).otherwise(1), "position")  # one row per candidate
    return nd.withColumn("chosen", F.row_number().over(w) == 1).select("column", "position", "n_distinct", "chosen")


def detect_id(test: DataFrame) -> DataFrame:
    """A column whose normalised name is a known id name or starts with 'id'; else the
    column with the most distinct values in test (ties by column order)."""
    names = {_norm(n) for n in ID_NAMES}
    by_name = [c for c in test.columns if _norm(c) in names or _norm(c).startswith("id")]
    vc = value_counts(test, test.columns).where(F.col("value").isNotNull())
    nd = vc.groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    pos = F.create_map(*[x for i, c in enumerate(test.columns) for x in (F.lit(c), F.lit(i))])
    nd = nd.withColumn("position", F.element_at(pos, F.col("column")))
    if by_name:
        chosen = F.col("column") == F.lit(by_name[0])
        return nd.withColumn("chosen", chosen).select("column", "position", "nunique", "chosen")
    w = Window.orderBy(F.desc("nunique"), "position")  # one row per column
    return nd.withColumn("chosen", F.row_number().over(w) == 1).select("column", "position", "nunique", "chosen")


def feature_columns(df: DataFrame, id_col: str, target: str, originals=()) -> list[str]:
    """Every column but id, target and the original columns."""
    return [c for c in df.columns if c not in (id_col, target) and c not in originals]
